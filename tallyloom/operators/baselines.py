"""Trivial-prediction baselines over all decisions of a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import scoring as S
from tallyloom.operators.ranking import running_totals
from tallyloom.session import shared_path

BUCKETS = 16384
# Cuts of a range around the middle, each between the ends of the values left.
CUTS = 2


def noul_baselines(decisions: DataFrame) -> DataFrame:
    """Prevalence, majority accuracy and the Brier score of the constant prevalence."""
    t = F.try_element_at("target", F.lit("true"))
    stats = (
        decisions.where(F.col("task") == "noul")
        .groupBy("benchmark_id")
        .agg(F.avg(t).alias("positive_prevalence"), F.var_pop(t).alias("constant_brier_baseline"))
    )
    prevalence = F.col("positive_prevalence")
    return stats.select(
        "benchmark_id",
        "positive_prevalence",
        F.greatest(prevalence, 1 - prevalence).alias("majority_accuracy_baseline"),
        "constant_brier_baseline",
    )


def choice_baselines(decisions: DataFrame) -> DataFrame:
    """Uniform, best fixed id and best fixed position.

    A decision lacking an id (or position) falls back to 1/k. So the mean of a fixed answer
    is `(sum 1/k + sum over decisions having it of (t - 1/k)) / n`, which needs one exploded
    pass instead of one pass per id. Position 0 exists in every decision, so its rows also
    give n and the sum of 1/k.
    """
    options = F.col("options")
    cells = (
        decisions.where(F.col("task") == "choice")
        .select(
            "benchmark_id",
            F.try_divide(F.lit(1.0), F.size(options)).alias("share"),
            F.posexplode(
                F.arrays_zip(
                    F.col("options.id").alias("id"),
                    S.aligned(options, F.col("target")).alias("t"),
                )
            ).alias("pos", "option"),
        )
        .groupBy("benchmark_id", "pos", F.col("option.id").alias("id"))
        .agg(
            F.sum(F.col("option.t") - F.col("share")).alias("gain"),
            F.sum("share").alias("share"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    fixed = F.array(
        F.struct(F.lit("id").alias("kind"), F.col("id").alias("answer")),
        F.struct(F.lit("position").alias("kind"), F.col("pos").cast("string").alias("answer")),
    )
    first = (F.col("pos") == 0) & (F.col("fixed.kind") == "position")
    answers = (
        cells.select("benchmark_id", "pos", "gain", "share", "n", F.explode(fixed).alias("fixed"))
        .groupBy("benchmark_id", "fixed")
        .agg(
            F.sum("gain").alias("gain"),
            F.sum(F.when(first, F.col("n"))).alias("n"),
            F.sum(F.when(first, F.col("share"))).alias("share"),
        )
    )
    kind = F.col("fixed.kind")
    best = answers.groupBy("benchmark_id").agg(
        F.max(F.when(kind == "id", F.col("gain"))).alias("id_gain"),
        F.max(F.when(kind == "position", F.col("gain"))).alias("position_gain"),
        F.sum("n").alias("n"),
        F.sum("share").alias("uniform_total"),
    )
    uniform = F.col("uniform_total") / F.col("n")
    by_id = (F.col("uniform_total") + F.col("id_gain")) / F.col("n")
    by_position = (F.col("uniform_total") + F.col("position_gain")) / F.col("n")
    return best.select(
        "benchmark_id",
        uniform.alias("uniform_accuracy_baseline"),
        by_id.alias("fixed_id_baseline"),
        by_position.alias("fixed_position_baseline"),
        F.greatest(uniform, by_id, by_position).alias("fixed_answer_accuracy_baseline"),
    )


def group_medians(
    counts: DataFrame, group: str, value: str, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Exact interpolating median per group from (group, value, c), without holding a group.

    With known ends the value range is cut into equal-width buckets. At most BUCKETS rows per
    group tell which bucket(s) hold the middle ranks; their values are cut again between their
    own ends, so values that all lie close together are spread as well, and only the last cut's
    bucket(s) are ordered value by value.
    Without them, ranks are counted over range pieces of the data, so that no outlier can put
    all other values into one task.
    """
    counts = counts.where(F.col(value).isNotNull()).withColumnRenamed(value, "v")
    if low is None or high is None:
        return _medians_by_rank(counts.groupBy(group, "v").agg(F.sum("c").alias("c")), group)
    none = F.lit(0).cast("bigint")
    # One cell holds everything; each cut keeps the cells of the middle ranks, with their own ends.
    rows = counts.select(
        group, "v", "c", none.alias("cell"), F.lit(low).alias("low"), F.lit(high).alias("high"), none.alias("before"),
        F.lit(None).cast("bigint").alias("r1"), F.lit(None).cast("bigint").alias("r2"),
    )
    for _ in range(CUTS):
        rows = _middle_cells(rows, group)
    inside = F.sum("c").over(Window.partitionBy(group, "cell").orderBy("v"))
    ranked = rows.select(group, "v", "r1", "r2", (F.col("before") + inside).alias("upto"), "c")
    return _middle(ranked, group)


def _middle_cells(rows: DataFrame, group: str) -> DataFrame:
    """Cut each cell into BUCKETS of equal width and keep those with a middle rank, with the ends of their values."""
    width = F.col("high") - F.col("low")
    share = F.when(width > 0, (F.col("v") - F.col("low")) / width).otherwise(F.lit(0.0))
    bucket = F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)))
    placed = rows.select(group, "v", "c", F.col("cell").alias("parent"), bucket.alias("bucket"), "before", "r1", "r2")
    sizes = placed.groupBy(group, "parent", "bucket", "before", "r1", "r2").agg(
        F.sum("c").alias("size"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    inside = Window.partitionBy(group, "parent").orderBy("bucket")
    # One-based ranks of the two middle values, known after the first cut; equal when the group is odd.
    n = F.sum("size").over(Window.partitionBy(group))
    upto = F.col("before") + F.sum("size").over(inside)
    middle = sizes.select(
        group, "parent", "bucket", "low", "high", upto.alias("upto"), (upto - F.col("size")).alias("before"),
        F.coalesce("r1", F.floor((n + 1) / 2)).alias("r1"), F.coalesce("r2", F.floor((n + 2) / 2)).alias("r2"),
    ).where(
        ((F.col("before") < F.col("r1")) & (F.col("r1") <= F.col("upto")))
        | ((F.col("before") < F.col("r2")) & (F.col("r2") <= F.col("upto")))
    )
    cell = (F.col("parent") * BUCKETS + F.col("bucket")).alias("cell")
    kept = placed.select(group, "v", "c", "parent", "bucket").join(middle, [group, "parent", "bucket"])
    return kept.select(group, "v", "c", cell, "low", "high", "before", "r1", "r2")


def _medians_by_rank(counts: DataFrame, group: str) -> DataFrame:
    before = running_totals(counts, [group], [F.col("v")], F.col("c"), "before")
    size = counts.groupBy(group).agg(F.sum("c").alias("n"))
    ranked = before.join(size, group).select(
        group,
        "v",
        F.floor((F.col("n") + 1) / 2).alias("r1"),
        F.floor((F.col("n") + 2) / 2).alias("r2"),
        (F.col("before") + F.col("c")).alias("upto"),
        "c",
    )
    return _middle(ranked, group)


def _middle(ranked: DataFrame, group: str) -> DataFrame:
    """The mean of the values at ranks r1 and r2."""

    def at(rank: str) -> Column:
        hit = (F.col("upto") - F.col("c") < F.col(rank)) & (F.col(rank) <= F.col("upto"))
        return F.max(F.when(hit, F.col("v")))

    return ranked.groupBy(group).agg(((at("r1") + at("r2")) / 2).alias("median"))


def score_baselines(decisions: DataFrame) -> DataFrame:
    """Median normalised target and the mean absolute error around it.

    Equal targets are counted and stored first; the cuts for the median and the error read the counts.
    """
    path = shared_path(decisions.sparkSession, "target-counts")
    options = F.col("options")
    counts = (
        decisions.where(F.col("task") == "score")
        .select(
            "benchmark_id",
            S.normalized_expectation(options, S.aligned(options, F.col("target"))).alias("value"),
        )
        .groupBy("benchmark_id", "value")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    counts.write.parquet(path)
    counts = decisions.sparkSession.read.parquet(path)
    medians = group_medians(counts, "benchmark_id", "value", 0.0, 1.0)
    gap = F.abs(F.col("value") - F.col("median")) * F.col("c")
    return (
        counts.join(medians, "benchmark_id")
        .groupBy("benchmark_id")
        .agg(
            F.first("median").alias("constant_score_baseline"),
            (F.sum(gap) / F.sum("c")).alias("constant_mae_baseline"),
        )
    )


def baselines(decisions: DataFrame) -> DataFrame:
    """All baselines, one row per benchmark; other tasks' columns are NULL."""
    return (
        noul_baselines(decisions)
        .unionByName(
            choice_baselines(decisions).drop("fixed_id_baseline", "fixed_position_baseline"),
            allowMissingColumns=True,
        )
        .unionByName(score_baselines(decisions), allowMissingColumns=True)
    )
