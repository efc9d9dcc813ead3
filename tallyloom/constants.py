"""Values every module agrees on."""

# Task kinds, their primary metrics and the scoring tolerances.
TASKS = ("choice", "noul", "score", "box")
RANKING_TASKS = ("choice", "noul", "score")
PRIMARY_METRIC = {
    "choice": "target_mass_at_prediction",
    "noul": "binary_brier",
    "score": "normalized_expected_score_mae",
    "box": "mean_iou",
}
LOWER_IS_BETTER = ("binary_brier", "normalized_expected_score_mae", "normalized_score_rmse")
EPSILON = 1e-12
SUM_TOLERANCE = 1e-5
METRIC_TOLERANCE = 1e-8

# Metric names per task, in stored order.
TASK_METRICS = {
    "choice": (
        "target_mass_at_prediction",
        "uniform_accuracy_baseline",
        "fixed_answer_accuracy_baseline",
        "baseline_adjusted_skill",
        "baseline_adjusted_score",
    ),
    "noul": (
        "binary_brier",
        "accuracy",
        "positive_recall",
        "specificity",
        "precision",
        "balanced_accuracy",
        "f1",
        "true_positive",
        "false_positive",
        "false_negative",
        "true_negative",
        "positive_prevalence",
        "majority_accuracy_baseline",
        "constant_brier_baseline",
        "brier_skill",
        "baseline_adjusted_skill",
        "baseline_adjusted_score",
    ),
    "score": (
        "normalized_expected_score_mae",
        "normalized_score_rmse",
        "constant_score_baseline",
        "constant_mae_baseline",
        "baseline_adjusted_skill",
        "baseline_adjusted_score",
    ),
    "box": ("mean_iou", "accuracy_at_iou_0_5"),
}
METRICS = tuple(dict.fromkeys(m for t in TASKS for m in TASK_METRICS[t]))

# Reason codes of benchmarks without an adjusted score.
INELIGIBLE_REASON = {
    "noul": "single_target_class",
    "choice": "fixed_answer_is_perfect",
    "score": "constant_targets",
    "box": "task_is_not_ranked",
}

# Enumerations of the record formats.
ABSTENTIONS = ("refusal", "cannot_determine")
ABSTENTION_POLICY = "incorrect-max-error-v1"
RELATIONSHIPS = ("same_source_family", "related_domain", "evaluation_examples")
REGISTRATION_SOURCES = ("author_declaration", "contributor_review", "unknown")
DATASET_ACCESS = ("public", "private", "unknown")
COUNT_METHODS = ("non_lookup_parameters_v1", "embedding_excluded_parameters_v1")

# Anchors of the 0-100 parameter scale, one every 20 positions.
PARAMETER_ANCHORS = (50e6, 1e9, 5e9, 10e9, 20e9, 35e9)

# Default dataset-name prefix of the generalization family; callers add others.
GENERALIZATION_PREFIXES = ("datasets/generalization-",)

# Scores are rounded to this many digits once, when stored, so that ties are
# decided by the stored value and not by the order in which tasks summed it.
STORED_DIGITS = 12
