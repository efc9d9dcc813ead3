"""Prediction x decision join and the per-(run, benchmark) metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import EPSILON
from tallyloom.functions import scoring as S
from tallyloom.session import dealt

DECISION_KEY = ("benchmark_id", "case_id", "question_id")
# The order of keys in a sort: its first eight bytes tell most cases apart, but hardly any benchmark.
SORTED_KEY = ("case_id", "question_id", "benchmark_id")
GRAIN = ("run_id", "benchmark_id")
CELLS = ("true_positive", "false_positive", "false_negative", "true_negative")


def join_decisions(predictions: DataFrame, decisions: DataFrame, count: int = 0) -> DataFrame:
    """Predictions with their decision; unknown keys fall out (see validation for those).

    Inner join on the full decision key. No hint is given: a decision table under the
    broadcast threshold is broadcast, a larger one is shuffled on a key that spreads
    every benchmark and every run over all partitions. With a `count` (see `session.pieces`)
    beyond Spark's own number of partitions, both are dealt over that many.
    """
    kept = decisions.select(*DECISION_KEY, "task", "options", "target", "target_box")
    left, right = dealt(predictions, count, *SORTED_KEY), dealt(kept, count, *SORTED_KEY)
    rest = [c for c in (*predictions.columns, *kept.columns) if c not in DECISION_KEY]
    return left.join(right, list(SORTED_KEY), "inner").select(*DECISION_KEY, *rest)


def row_scores(joined: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per-prediction columns: outcome flags, task value, signed error, IoU, confusion cells; and those in `keep`.

    The arrays in candidate order are projected first, because several values use them.
    """
    task, options = F.col("task"), F.col("options")
    probabilities, target = F.col("probabilities"), F.col("target")
    p, t = F.col("_p"), F.col("_t")
    ordered = task.isin("choice", "score")
    joined = joined.withColumns(
        {
            "_p": F.when(ordered, S.aligned(options, probabilities)),
            "_t": F.when(ordered & probabilities.isNotNull(), S.aligned(options, target)),
        }
    )
    abstained = F.col("abstention").isNotNull()
    answered = probabilities.isNotNull() | F.col("box").isNotNull()
    p_true = F.try_element_at(probabilities, F.lit("true"))
    cells = S.soft_confusion(p_true, target, abstained)

    def graded(name: str, when_abstained: float, value: Column) -> Column:
        graded_value = F.when(abstained, F.lit(when_abstained)).when(
            probabilities.isNotNull(), value
        )
        return F.when(task == name, graded_value)

    iou = F.when(abstained, F.lit(0.0)).otherwise(S.box_iou(F.col("box"), F.col("target_box")))
    return joined.select(
        *GRAIN,
        "case_id",
        "question_id",
        "task",
        answered.alias("answered"),
        F.col("error").isNotNull().alias("failed"),
        abstained.alias("abstained"),
        graded("choice", 0.0, S.choice_credit(p, t)).alias("credit"),
        graded("noul", 1.0, S.binary_brier(probabilities, target)).alias("brier"),
        graded("score", 1.0, S.score_error(options, p, t)).alias("signed_error"),
        F.when(task == "box", iou).alias("iou"),
        *[F.when(task == "noul", cell).alias(name) for name, cell in cells.items()],
        *keep,
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > EPSILON, part / whole)


def aggregate_scores(rows: DataFrame) -> DataFrame:
    """One shuffle to (run, benchmark): every task's sums in one partial aggregation.

    The task follows from the benchmark; as a grouping key it keeps the aggregation buffer
    numeric, so Spark hashes instead of sorting all rows. Distinct cases and keys are counted
    apart, over keys alone (`results.key_counts`).
    """
    error = F.col("signed_error")
    sums = rows.groupBy(*GRAIN, "task").agg(
        F.count(F.lit(1)).alias("recorded"),
        F.count_if("answered").alias("succeeded"),
        F.count_if("failed").alias("failed"),
        F.count_if("abstained").alias("abstained"),
        F.avg("credit").alias("target_mass_at_prediction"),
        F.avg("brier").alias("binary_brier"),
        F.avg(F.abs(error)).alias("normalized_expected_score_mae"),
        F.sqrt(F.avg(error * error)).alias("normalized_score_rmse"),
        F.avg("iou").alias("mean_iou"),
        F.avg(F.when(F.col("iou") >= 0.5, 1.0).when(F.col("iou") < 0.5, 0.0)).alias(
            "accuracy_at_iou_0_5"
        ),
        F.count("brier").alias("_n_noul"),
        *[F.sum(c).alias(c) for c in CELLS],
    )
    # A noul result without any gradable row still reports zero cells.
    noul = F.col("task") == "noul"
    tp, fp, fn, tn = (F.when(noul, F.coalesce(c, F.lit(0.0))) for c in CELLS)
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return sums.select(
        *[c for c in sums.columns if c not in (*CELLS, "_n_noul")],
        *[value.alias(name) for name, value in zip(CELLS, (tp, fp, fn, tn), strict=True)],
        F.when(noul, F.try_divide(tp + tn, F.col("_n_noul"))).alias("accuracy"),
        recall.alias("positive_recall"),
        specificity.alias("specificity"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
    )


def score_predictions(predictions: DataFrame, decisions: DataFrame, count: int = 0) -> DataFrame:
    """Joined, graded and aggregated; baselines are added by `adjusted_metrics`."""
    return aggregate_scores(row_scores(join_decisions(predictions, decisions, count)))


def adjusted_metrics(metrics: DataFrame, baselines: DataFrame) -> DataFrame:
    """Metrics with the benchmark's baselines, skill and clipped score.

    Baselines depend on targets only, so they are computed once per benchmark and joined to
    every run instead of being recomputed for each.
    """
    m = metrics.join(baselines.drop("task"), "benchmark_id", "left")
    task = F.col("task")
    fixed, constant = F.col("fixed_answer_accuracy_baseline"), F.col("constant_mae_baseline")
    brier_base = F.col("constant_brier_baseline")
    choice = F.when(
        fixed < 1 - EPSILON, (F.col("target_mass_at_prediction") - fixed) / (1 - fixed)
    )
    score = F.when(
        constant > EPSILON, 1 - F.col("normalized_expected_score_mae") / constant
    )
    skill = (
        F.when(task == "choice", choice)
        .when(task == "noul", 2 * F.col("balanced_accuracy") - 1)
        .when(task == "score", score)
    )
    return m.select(
        "*",
        F.when(brier_base > EPSILON, 1 - F.col("binary_brier") / brier_base).alias("brier_skill"),
        skill.alias("baseline_adjusted_skill"),
        S.clip_unit(skill).alias("baseline_adjusted_score"),
    )
