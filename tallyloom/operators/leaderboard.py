"""Task scores, Task Avg, Borda and the derived leaderboards.

All functions carry the category as a column: every category is ranked in the same job.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import (
    GENERALIZATION_PREFIXES,
    PRIMARY_METRIC,
    RANKING_TASKS,
    TASKS,
)
from tallyloom.operators.ranking import tie_ranks, with_position
from tallyloom.operators.results import eligible, is_complete
from tallyloom.operators.scopes import generalization_scope, is_generalization, ranking_scope
from tallyloom.session import cut

RUN = ("category", "run_id")


def required_counts(members: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Defined benchmarks per (category, task)."""
    defined = benchmarks.select(F.col("id").alias("benchmark_id"), "task")
    return (
        members.select("category", "benchmark_id")
        .join(defined, "benchmark_id")
        .groupBy("category", "task")
        .agg(F.count(F.lit(1)).alias("required"))
    )


def scoped_results(results: DataFrame, members: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Results of defined category members, once per category."""
    defined = benchmarks.select(F.col("id").alias("benchmark_id"))
    kept = members.select("category", "benchmark_id").join(defined, "benchmark_id", "left_semi")
    return results.join(kept, "benchmark_id")


def _unpivot_tasks(wide: DataFrame, names: list[str], tasks: Iterable[str]) -> DataFrame:
    """(category, run, task, names...) from struct columns named after the tasks."""
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("task"), *[F.col(t)[n].alias(n) for n in names])
            for t in tasks
        ]
    )
    return wide.select(*RUN, F.explode(rows).alias("_t")).select(*RUN, "_t.*")


def task_means(
    results: DataFrame,
    members: DataFrame,
    benchmarks: DataFrame,
    metric: str = "baseline_adjusted_score",
    eligibility: Column | None = None,
) -> DataFrame:
    """Equal-weight mean of a metric per (category, run, task); NULL under the coverage gates.

    `eligibility` says which adjusted scores count, by default those whose own baselines leave room.

    The gates compare counts: complete measured results against required benchmarks, NULL
    values against none. So neither a run x benchmark grid nor a second pass is needed.
    """
    scoped = scoped_results(results, members, benchmarks)

    def value(task: str) -> Column:
        return F.col("mean_iou" if task == "box" and metric.startswith("baseline_adj") else metric)

    def counted(task: str) -> Column:
        gated = metric == "baseline_adjusted_score" and task != "box"
        return (eligible() if eligibility is None else eligibility) if gated else F.lit(True)

    def cell(task: str) -> Column:
        mine = F.col("task") == task
        return F.struct(
            F.count_if(mine & is_complete()).alias("complete"),
            F.count_if(mine & counted(task)).alias("eligible"),
            F.count_if(mine & counted(task) & value(task).isNull()).alias("undefined"),
            F.avg(F.when(mine & counted(task), value(task))).alias("mean"),
        ).alias(task)

    wide = scoped.groupBy(*RUN).agg(*[cell(t) for t in TASKS])
    long = _unpivot_tasks(wide, ["complete", "eligible", "undefined", "mean"], TASKS)
    required = required_counts(members, benchmarks)
    whole = (
        (F.col("complete") == F.col("required"))
        & (F.col("eligible") > 0)
        & (F.col("undefined") == 0)
    )
    return long.join(required, ["category", "task"]).select(
        *RUN,
        "task",
        F.col("complete"),
        F.col("required"),
        F.when(whole, F.col("mean")).alias("value"),
    )


def task_average(means: DataFrame) -> DataFrame:
    """Task Avg: the mean of the three ranking tasks, only when all three are defined."""
    three = means.where(F.col("task").isin(*RANKING_TASKS))
    return three.groupBy(*RUN).agg(
        F.when(F.count("value") == len(RANKING_TASKS), F.avg("value")).alias("task_avg")
    )


def raw_leaderboard(results: DataFrame, members: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Mean primary metric per (category, run, task) over completely answered scopes."""
    scoped = scoped_results(results, members, benchmarks)

    def cell(task: str) -> Column:
        value = F.col(PRIMARY_METRIC[task])
        done = (F.col("task") == task) & is_complete(measured=False) & value.isNotNull()
        return F.struct(
            F.count_if(done).alias("complete"), F.avg(F.when(done, value)).alias("mean")
        ).alias(task)

    wide = scoped.groupBy(*RUN).agg(
        F.bool_or(F.col("provenance") == "demo").alias("demo"), *[cell(t) for t in TASKS]
    )
    demo = wide.select(*RUN, "demo")
    long = _unpivot_tasks(wide, ["complete", "mean"], TASKS).join(demo, list(RUN))
    required = required_counts(members, benchmarks)
    total = F.coalesce("required", F.lit(0))
    return long.join(required, ["category", "task"], "left").select(
        *RUN,
        "task",
        "demo",
        F.when((total > 0) & (F.col("complete") == total), F.col("mean")).alias("score"),
        "complete",
        total.alias("total"),
    )


def leaderboard_order() -> list[Column]:
    """Measured first, then scored first, then the better score, then the run id."""
    better = F.when(F.col("task") == "choice", -F.col("score")).otherwise(F.col("score"))
    return [F.col("demo"), F.col("score").isNull(), better, F.col("run_id")]


def leaderboard_positions(board: DataFrame) -> DataFrame:
    return with_position(board, ["category", "task"], leaderboard_order())


def borda_points(values: DataFrame, value: str = "baseline_adjusted_score") -> DataFrame:
    """`(N - r) / (N - 1)` per (category, benchmark, run), r the average rank over exact ties."""
    keys = ["category", "benchmark_id"]
    ranks = tie_ranks(values, keys, value)
    sizes = values.groupBy(*keys).agg(F.count(value).alias("n"))
    average = F.col("rank") + (F.col("ties") - 1) / F.lit(2.0)
    return (
        values.select(*keys, "run_id", value)
        .join(ranks, [*keys, value])
        .join(sizes, keys)
        .select(
            *keys,
            "run_id",
            value,
            average.alias("average_rank"),
            F.try_divide(F.col("n") - average, F.col("n") - 1).alias("points"),
        )
    )


def _ranked_results(results: DataFrame, members: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Results over the non-box scope with the columns ranking looks at."""
    scope = ranking_scope(members, benchmarks).select("category", "benchmark_id")
    return results.select(
        "run_id",
        "benchmark_id",
        "task",
        "provenance",
        is_complete().alias("complete"),
        F.coalesce(eligible(), F.lit(False)).alias("eligible"),
        "baseline_adjusted_score",
    ).join(scope, "benchmark_id")


def _cohort(ranked: DataFrame, members: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """One aggregate per run decides coverage, demo, Task Avg and whether scores are usable."""
    value = F.col("baseline_adjusted_score")

    def task_mean(task: str) -> Column:
        mine = (F.col("task") == task) & F.col("eligible")
        defined = (F.count_if(mine) > 0) & (F.count_if(mine & value.isNull()) == 0)
        return F.when(defined, F.avg(F.when(mine, value)))

    average = sum((task_mean(t) for t in RANKING_TASKS), F.lit(0.0)) / len(RANKING_TASKS)
    runs = ranked.groupBy(*RUN).agg(
        F.count_if("complete").alias("complete"),
        F.bool_or(F.col("provenance") == "demo").alias("demo"),
        F.bool_and(F.col("eligible") & value.isNotNull()).alias("usable"),
        average.alias("task_avg"),
    )
    required = (
        ranking_scope(members, benchmarks)
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("required"))
    )
    return (
        runs.join(required, "category")
        .where(
            ~F.col("demo")
            & (F.col("complete") == F.col("required"))
            & F.col("task_avg").isNotNull()
        )
        .select(*RUN, "task_avg", "usable")
    )


def borda_cohort(results: DataFrame, members: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Runs that compete: measured, complete over the non-box scope, Task Avg defined."""
    ranked = _ranked_results(results, members, benchmarks)
    return _cohort(ranked, members, benchmarks).select(*RUN, "task_avg")


def borda_scores(results: DataFrame, members: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Mean Borda points of the cohort; all NULL when the category fails a gate.

    Gates: at least two runs, and every result of the cohort eligible with an adjusted
    score. `results` should be the stored table: ties are exact equality of stored scores.
    The cohort's scores are stored before ranking, so ranking reads a few narrow columns
    instead of repeating the scope and cohort joins.
    """
    ranked = _ranked_results(results, members, benchmarks)
    cohort = _cohort(ranked, members, benchmarks)
    entries = cut(
        ranked.select(*RUN, "benchmark_id", "baseline_adjusted_score").join(cohort, list(RUN))
    )
    per_run = entries.groupBy(*RUN).agg(
        F.first("task_avg").alias("task_avg"), F.first("usable").alias("usable")
    )
    gates = per_run.groupBy("category").agg(
        ((F.count(F.lit(1)) >= 2) & F.bool_and("usable")).alias("open")
    )
    means = borda_points(entries).groupBy(*RUN).agg(F.avg("points").alias("mean_points"))
    return (
        per_run.join(gates, "category")
        .join(means, list(RUN), "left")
        .select(*RUN, "task_avg", F.when(F.col("open"), F.col("mean_points")).alias("borda"))
    )


FAMILIES = ("diverse", "contextual")
FAMILY_TASKS = ("noul", "choice", "score")


def generalization_columns(
    members: DataFrame, benchmarks: DataFrame, prefixes: Iterable[str] = GENERALIZATION_PREFIXES
) -> DataFrame:
    """(category, family, task, benchmark_id) of the six generalization cells."""
    cells = F.lit(None).cast("string")
    for family in FAMILIES:
        for task in FAMILY_TASKS:
            hit = F.endswith("dataset", F.lit(f"-{family}-{task}"))
            cells = F.when(hit, F.lit(family)).otherwise(cells)
    found = benchmarks.where(is_generalization(F.col("dataset"), prefixes)).select(
        F.col("id").alias("benchmark_id"),
        cells.alias("family"),
        F.substring_index("dataset", "-", -1).alias("cell_task"),
    )
    return members.select("category", "benchmark_id").join(
        found.where(F.col("family").isNotNull()), "benchmark_id"
    )


def duplicate_families(columns: DataFrame) -> DataFrame:
    """Generalization cells claimed by more than one benchmark."""
    return (
        columns.groupBy("category", "family", "cell_task")
        .agg(F.count(F.lit(1)).alias("benchmarks"))
        .where(F.col("benchmarks") > 1)
    )


def generalization_comparison(
    results: DataFrame,
    members: DataFrame,
    benchmarks: DataFrame,
    prefixes: Iterable[str] = GENERALIZATION_PREFIXES,
) -> DataFrame:
    """Six adjusted cells per run and their mean, the mean only when all six exist."""
    columns = generalization_columns(members, benchmarks, prefixes)
    scored = results.join(columns, "benchmark_id").withColumn(
        "value", F.when(is_complete() & eligible(), F.col("baseline_adjusted_score"))
    )

    def cell(family: str, task: str) -> Column:
        mine = (F.col("family") == family) & (F.col("cell_task") == task)
        # More than one benchmark in a cell is an error; `duplicate_families` names it.
        twice = F.raise_error(F.lit(f"More than one benchmark for {family}-{task}"))
        named = F.when(mine, F.col("benchmark_id"))
        return F.when(F.min(named) != F.max(named), twice).otherwise(F.max(F.when(mine, F.col("value")))).alias(f"{family}_{task}")

    names = [f"{f}_{t}" for f in FAMILIES for t in FAMILY_TASKS]
    wide = scored.groupBy(*RUN).agg(*[cell(f, t) for f in FAMILIES for t in FAMILY_TASKS])
    total = sum((F.col(n) for n in names), F.lit(0.0))
    return wide.withColumn("average", total / len(names))


def radar_profiles(
    results: DataFrame,
    members: DataFrame,
    benchmarks: DataFrame,
    prefixes: Iterable[str] = GENERALIZATION_PREFIXES,
) -> DataFrame:
    """Three task scores on the category and three on its generalization part, times 100."""
    general = generalization_scope(members, benchmarks, prefixes)
    scopes = [("", members), ("general_", general)]
    parts = [
        task_means(results, scope, benchmarks)
        .where(F.col("task").isin(*RANKING_TASKS))
        .select(*RUN, F.concat(F.lit(prefix), F.col("task")).alias("axis"), "value")
        for prefix, scope in scopes
    ]
    axes = [p + t for p, _ in scopes for t in FAMILY_TASKS]
    return (
        parts[0]
        .unionByName(parts[1])
        .groupBy(*RUN)
        .pivot("axis", axes)
        .agg(F.first("value") * 100)
    )
