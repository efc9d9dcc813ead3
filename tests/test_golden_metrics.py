"""Expected metrics of small benchmarks: imbalance, soft targets, ties, abstentions."""

import pytest

from helpers import answer, decision, decisions, predictions
from tallyloom.plans.evaluation import metric_table

NOUL = ("false", "true")
AB = ("a", "b")
LOW_HIGH = (("a", 10.0), ("b", 30.0))
WIDE = (("a", 10.0), ("b", 90.0))
REFUSED = "refusal"

# Name, task, options, samples (target, prediction, repeat[, options]), expected.
GOLDEN = [
    ("msmarco_example", "noul", NOUL,
     [((0, 1), (0, 1), 1), ((0, 1), (1, 0), 10), ((1, 0), (1, 0), 89)],
     {"accuracy": 0.9, "positive_recall": 1 / 11, "specificity": 1, "precision": 1,
      "balanced_accuracy": 6 / 11, "binary_brier": 0.1, "baseline_adjusted_score": 1 / 11,
      "true_positive": 1, "false_negative": 10, "false_positive": 0, "true_negative": 89,
      "majority_accuracy_baseline": 0.89, "f1": 1 / 6, "constant_brier_baseline": 0.0979}),
    ("always_false", "noul", NOUL, [((0, 1), (1, 0), 11), ((1, 0), (1, 0), 89)],
     {"accuracy": 0.89, "positive_recall": 0, "specificity": 1, "precision": None,
      "balanced_accuracy": 0.5, "baseline_adjusted_score": 0}),
    ("single_class", "noul", NOUL, [((1, 0), (1, 0), 3)],
     {"accuracy": 1, "positive_recall": None, "balanced_accuracy": None,
      "baseline_adjusted_score": None, "brier_skill": None}),
    ("soft_noul", "noul", NOUL, [((0.75, 0.25), (0.8, 0.2), 1), ((0.25, 0.75), (0.2, 0.8), 1)],
     {"accuracy": 0.75, "balanced_accuracy": 0.75, "baseline_adjusted_score": 0.5,
      "binary_brier": 0.0025, "brier_skill": 0.96, "true_positive": 0.75, "false_positive": 0.25}),
    ("majority_choice", "choice", AB, [((1, 0), (1, 0), 4), ((0, 1), (1, 0), 1)],
     {"target_mass_at_prediction": 0.8, "fixed_answer_accuracy_baseline": 0.8,
      "uniform_accuracy_baseline": 0.5, "baseline_adjusted_score": 0}),
    ("all_a", "choice", AB, [((1, 0), (1, 0), 3)],
     {"target_mass_at_prediction": 1, "fixed_answer_accuracy_baseline": 1,
      "baseline_adjusted_score": None}),
    ("variable_options", "choice", AB,
     [((0, 1), (0, 1), 1), ((0, 0, 1), (0, 0, 1), 1, ("a", "b", "c"))],
     {"target_mass_at_prediction": 1, "fixed_answer_accuracy_baseline": 0.75,
      "uniform_accuracy_baseline": 5 / 12, "baseline_adjusted_score": 1}),
    ("constant_score_prediction", "score", LOW_HIGH,
     [((1, 0), (0.5, 0.5), 1), ((0, 1), (0.5, 0.5), 1)],
     {"normalized_expected_score_mae": 0.5, "normalized_score_rmse": 0.5,
      "constant_score_baseline": 0.5, "constant_mae_baseline": 0.5, "baseline_adjusted_score": 0}),
    ("perfect_score_prediction", "score", LOW_HIGH, [((1, 0), (1, 0), 1), ((0, 1), (0, 1), 1)],
     {"normalized_expected_score_mae": 0, "normalized_score_rmse": 0,
      "constant_mae_baseline": 0.5, "baseline_adjusted_score": 1}),
    ("constant_score_targets", "score", LOW_HIGH, [((0.25, 0.75), (0.25, 0.75), 2)],
     {"normalized_expected_score_mae": 0, "constant_mae_baseline": 0,
      "baseline_adjusted_score": None}),
    ("noul_threshold_tie", "noul", NOUL, [((0, 1), (0.5, 0.5), 1), ((1, 0), (0.5, 0.5), 1)],
     {"true_positive": 1, "false_positive": 1, "true_negative": 0, "false_negative": 0,
      "balanced_accuracy": 0.5, "baseline_adjusted_score": 0}),
    ("choice-abstention-soft-target", "choice", AB, [((0.25, 0.75), REFUSED, 1)],
     {"target_mass_at_prediction": 0, "baseline_adjusted_score": 0}),
    ("noul-abstentions-soft-targets", "noul", NOUL,
     [((0.8, 0.2), REFUSED, 1), ((0.2, 0.8), "cannot_determine", 1)],
     {"binary_brier": 1, "accuracy": 0, "balanced_accuracy": 0, "positive_recall": 0,
      "specificity": 0, "false_negative": 1, "false_positive": 1, "baseline_adjusted_score": 0}),
    ("score-abstentions-soft-nonuniform", "score", WIDE,
     [((0.75, 0.25), REFUSED, 1), ((0.25, 0.75), REFUSED, 1)],
     {"normalized_expected_score_mae": 1, "normalized_score_rmse": 1,
      "baseline_adjusted_skill": -3, "baseline_adjusted_score": 0}),
    ("choice-mixed-answer-and-api-refusal", "choice", AB,
     [((1, 0), (1, 0), 1), ((0, 1), REFUSED, 1)],
     {"target_mass_at_prediction": 0.5, "baseline_adjusted_skill": 0,
      "baseline_adjusted_score": 0}),
    ("noul-mixed-answer-and-api-refusal", "noul", NOUL,
     [((1, 0), (1, 0), 1), ((0, 1), REFUSED, 1)],
     {"binary_brier": 0.5, "accuracy": 0.5, "balanced_accuracy": 0.5, "specificity": 1,
      "positive_recall": 0, "baseline_adjusted_skill": 0, "baseline_adjusted_score": 0}),
    ("score-mixed-answer-and-api-refusal", "score", WIDE,
     [((1, 0), (1, 0), 1), ((0, 1), REFUSED, 1)],
     {"normalized_expected_score_mae": 0.5, "normalized_score_rmse": 0.5**0.5,
      "baseline_adjusted_skill": 0, "baseline_adjusted_score": 0}),
]


def _ids(options):
    return [o if isinstance(o, str) else o[0] for o in options]


@pytest.fixture(scope="module")
def computed(spark):
    d, p = [], []
    for name, task, shared, samples, _ in GOLDEN:
        for target, predicted, repeat, *own in samples:
            options = own[0] if own else shared
            ids = _ids(options)
            for _ in range(repeat):
                case = len(d)
                d.append(decision(name, case, task, options, dict(zip(ids, target))))
                if isinstance(predicted, str):
                    p.append(answer("r", name, case, abstention=predicted))
                else:
                    # Map order differs from candidate order in every second case.
                    pairs = list(zip(ids, predicted))
                    p.append(answer("r", name, case, dict(pairs[:: 1 - case % 2 * 2])))
    table = metric_table(predictions(spark, p), decisions(spark, d))
    return {r["benchmark_id"]: r.asDict() for r in table.collect()}


@pytest.mark.parametrize("golden", GOLDEN, ids=lambda g: g[0])
def test_expected_metrics(computed, golden):
    name, *_, expected = golden
    for metric, value in expected.items():
        found = computed[name][metric]
        if value is None:
            assert found is None, metric
        else:
            assert found == pytest.approx(value, abs=1e-9), metric


def test_baseline_covers_the_whole_benchmark(spark):
    """One answered decision of five: the baseline still uses all five targets."""
    targets = [(1, 0)] * 4 + [(0, 1)]
    d = [decision("b", i, "choice", AB, dict(zip(AB, t))) for i, t in enumerate(targets)]
    p = [answer("r", "b", 4, {"a": 1.0, "b": 0.0})]
    row = metric_table(predictions(spark, p), decisions(spark, d)).first()
    assert row["fixed_answer_accuracy_baseline"] == pytest.approx(0.8)
    assert row["baseline_adjusted_skill"] == pytest.approx(-4)
    assert row["baseline_adjusted_score"] == 0


def test_only_errors_leave_metrics_undefined(spark):
    d = [decision("b", 0, "noul", NOUL, {"false": 0, "true": 1}),
         decision("b", 1, "noul", NOUL, {"false": 1, "true": 0})]
    row = metric_table(predictions(spark, [answer("r", "b", 0, error="E")]), decisions(spark, d)).first()
    assert (row["succeeded"], row["failed"], row["abstained"]) == (0, 1, 0)
    assert row["binary_brier"] is None and row["accuracy"] is None
    assert row["baseline_adjusted_score"] is None
    assert row["true_positive"] == 0 and row["positive_prevalence"] == 0.5


def test_argmax_tie_takes_the_first_candidate(spark):
    d = [decision("b", 0, "choice", AB, {"a": 0.25, "b": 0.75})]
    p = [answer("r", "b", 0, {"b": 0.5, "a": 0.5})]
    row = metric_table(predictions(spark, p), decisions(spark, d)).first()
    assert row["target_mass_at_prediction"] == 0.25


def test_box_overlap(spark):
    target = (0.0, 0.0, 1.0, 1.0)
    d = [decision("b", i, "box", box=target) for i in range(4)]
    p = [answer("r", "b", 0, box=(0.0, 0.0, 0.5, 1.0)), answer("r", "b", 1, box=(0.3, 0.3, 0.3, 0.6)),
         answer("r", "b", 2, abstention="refusal"), answer("r", "b", 3, error="E")]
    row = metric_table(predictions(spark, p), decisions(spark, d)).first()
    assert row["mean_iou"] == pytest.approx(0.5 / 3)
    assert row["accuracy_at_iou_0_5"] == pytest.approx(1 / 3)
