"""Selected runs side by side: grid, best flags, spread, deltas, orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import LOWER_IS_BETTER, PRIMARY_METRIC
from tallyloom.operators.ranking import with_position, with_rank
from tallyloom.operators.results import is_complete

CELL = ("category", "benchmark_id")


def _primary_value() -> Column:
    value = F.lit(None).cast("double")
    for task, metric in PRIMARY_METRIC.items():
        value = F.when(F.col("task") == task, F.col(metric)).otherwise(value)
    return value


def higher_is_better(adjusted: bool = False) -> Column:
    return F.lit(True) if adjusted else F.col("task").isin("choice", "box")


def compare_runs(
    results: DataFrame,
    members: DataFrame,
    benchmarks: DataFrame,
    selected: Sequence[str],
    adjusted: bool = False,
) -> DataFrame:
    """One cell per (category, benchmark, selected run), empty cells kept.

    The grid is the selection (a short list given by the caller) exploded inside each
    benchmark row, so it is not a join. Runs without a result in the category are left out.
    """
    wanted = list(dict.fromkeys(selected))
    defined = benchmarks.select(F.col("id").alias("benchmark_id"), "task")
    scope = members.select(*CELL).join(defined, "benchmark_id")
    present = (
        results.where(F.col("run_id").isin(wanted))
        .join(members.select(*CELL), "benchmark_id", "inner")
        .select("category", "run_id")
        .distinct()
    )
    grid = scope.withColumn("run_id", F.explode(F.array(*[F.lit(w) for w in wanted]))).join(
        present, ["category", "run_id"], "left_semi"
    )
    shown = _primary_value()
    if adjusted:
        shown = F.when(F.col("task") != "box", F.col("baseline_adjusted_score")).otherwise(shown)
    cells = results.select(
        "run_id",
        "benchmark_id",
        "status",
        "provenance",
        shown.alias("value"),
        is_complete().alias("_done"),
    )
    return grid.join(cells, ["run_id", "benchmark_id"], "left").withColumn(
        "comparable", F.coalesce(F.col("_done") & F.col("value").isNotNull(), F.lit(False))
    ).drop("_done")


def benchmark_spread(cells: DataFrame) -> DataFrame:
    """Highest, lowest and range of comparable cells; NULL range below two."""
    value = F.when(F.col("comparable"), F.col("value"))
    return cells.groupBy(*CELL, "task").agg(
        F.count(value).alias("comparable_cells"),
        F.max(value).alias("highest"),
        F.min(value).alias("lowest"),
        F.when(F.count(value) >= 2, F.max(value) - F.min(value)).alias("spread"),
    )


def with_best(cells: DataFrame, adjusted: bool = False) -> DataFrame:
    """Flags every comparable cell holding the best value, if two or more compare."""
    ends = benchmark_spread(cells).drop("task", "spread")
    best = F.when(higher_is_better(adjusted), F.col("highest")).otherwise(F.col("lowest"))
    flag = F.col("comparable") & (F.col("comparable_cells") >= 2) & (F.col("value") == best)
    return (
        cells.join(ends, list(CELL))
        .withColumn("best", F.coalesce(flag, F.lit(False)))
        .drop("comparable_cells", "highest", "lowest")
    )


def with_delta(cells: DataFrame, reference: str, adjusted: bool = False) -> DataFrame:
    """Signed distance to the reference run, positive when better."""
    base = cells.where((F.col("run_id") == reference) & F.col("comparable")).select(
        *CELL, F.col("value").alias("_base")
    )
    sign = F.when(higher_is_better(adjusted), F.lit(1.0)).otherwise(F.lit(-1.0))
    delta = F.when(F.col("comparable"), (F.col("value") - F.col("_base")) * sign)
    return cells.join(base, list(CELL), "left").withColumn("delta", delta).drop("_base")


def comparison_positions(spreads: DataFrame, by_gap: bool = True) -> DataFrame:
    """Rows of each task by widest gap (unknown gaps last), or by benchmark id."""
    gap = [F.coalesce("spread", F.lit(-1.0)).desc()] if by_gap else []
    return with_position(spreads, ["category", "task"], [*gap, F.col("benchmark_id")])


def result_positions(results: DataFrame, metric: str) -> DataFrame:
    """Per-benchmark order: complete first, defined first, better first, run id."""
    value = F.col(metric)
    better = value if metric in LOWER_IS_BETTER else -value
    return with_position(
        results.select("benchmark_id", "run_id", "status", "provenance", metric),
        ["benchmark_id"],
        [~is_complete(), value.isNull(), better, F.col("run_id")],
    )


def metric_ranks(rows: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Competition rank of a metric in its own direction."""
    return with_rank(rows, keys, metric, descending=metric not in LOWER_IS_BETTER)
