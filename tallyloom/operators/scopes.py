"""Which benchmarks and runs a question is about."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import GENERALIZATION_PREFIXES
from tallyloom.functions.text import benchmark_label, model_label


def membership(categories: DataFrame) -> DataFrame:
    """(category, benchmark_id, pos) from category records."""
    return categories.select(
        F.col("id").alias("category"), F.posexplode("benchmarks").alias("pos", "benchmark_id")
    )


def is_generalization(
    dataset: Column, prefixes: Iterable[str] = GENERALIZATION_PREFIXES
) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | F.startswith(dataset, F.lit(prefix))
    return hit


def ranking_scope(members: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Members that are defined and are not boxes."""
    ranked = benchmarks.where(F.col("task") != "box").select(F.col("id").alias("benchmark_id"))
    return members.join(ranked, "benchmark_id", "left_semi")


def generalization_scope(
    members: DataFrame,
    benchmarks: DataFrame,
    prefixes: Iterable[str] = GENERALIZATION_PREFIXES,
) -> DataFrame:
    general = benchmarks.where(is_generalization(F.col("dataset"), prefixes)).select(
        F.col("id").alias("benchmark_id")
    )
    return members.join(general, "benchmark_id", "left_semi")


def select_scope(
    members: DataFrame,
    benchmarks: DataFrame,
    category: str,
    *,
    names: Iterable[str] | None = None,
    task: str | None = None,
    generalization_only: bool = False,
    exclude_box: bool = False,
    prefixes: Iterable[str] = GENERALIZATION_PREFIXES,
) -> DataFrame:
    """Benchmarks of a category under the given restrictions (lazy; see `require_scope`)."""
    scope = members.where(F.col("category") == category)
    chosen = benchmarks.join(
        scope.select(F.col("benchmark_id").alias("id"), "pos"), "id", "inner"
    )
    if names is not None:
        chosen = chosen.where(F.col("id").isin(list(names)))
    if generalization_only:
        chosen = chosen.where(is_generalization(F.col("dataset"), prefixes))
    if exclude_box:
        chosen = chosen.where(F.col("task") != "box")
    if task is not None:
        chosen = chosen.where(F.col("task") == task)
    return chosen


def require_scope(
    members: DataFrame, chosen: DataFrame, category: str, names: Iterable[str] | None = None
) -> DataFrame:
    """Raise when a named benchmark is outside the category or nothing is left."""
    if names is not None:
        wanted = set(names)
        known = (
            members.where((F.col("category") == category) & F.col("benchmark_id").isin(*wanted))
            .agg(F.count_distinct("benchmark_id"))
            .first()[0]
        )
        if known != len(wanted):
            raise ValueError("Selected benchmark is not in the category")
    if chosen.isEmpty():
        raise ValueError("No benchmarks match the selection")
    return chosen


def merged_categories(members: DataFrame, categories: Iterable[str], name: str) -> DataFrame:
    """Union of categories; a benchmark keeps the place of its first occurrence."""
    order = F.create_map(
        *[F.lit(v) for i, c in enumerate(categories) for v in (c, i)]
    )
    placed = members.where(F.col("category").isin(list(categories))).withColumn(
        "_place", F.struct(order[F.col("category")].alias("c"), F.col("pos").alias("p"))
    )
    return placed.groupBy("benchmark_id").agg(F.min("_place").alias("_place")).select(
        F.lit(name).alias("category"),
        "benchmark_id",
        F.col("_place.c").alias("category_pos"),
        F.col("_place.p").alias("pos"),
    )


def scope_inventory(members: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Benchmarks, cases and decisions per category and task."""
    defined = benchmarks.select(
        F.col("id").alias("benchmark_id"), "task", "case_count", "decision_count"
    )
    return (
        members.join(defined, "benchmark_id")
        .groupBy("category", "task")
        .agg(
            F.count(F.lit(1)).alias("benchmarks"),
            F.sum("case_count").alias("cases"),
            F.sum("decision_count").alias("decisions"),
        )
    )


def search_models(models: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over model id, short name and label."""
    needle = F.lit(text.strip().lower())
    label = model_label(F.col("display_name"), F.col("adapter"), F.col("model_id"))
    hit = F.lit(False)
    for name in (F.col("model_id"), F.col("short_name"), label):
        hit = hit | F.coalesce(F.contains(F.lower(name), needle), F.lit(False))
    return models.where(hit)


def search_benchmarks(benchmarks: DataFrame, text: str) -> DataFrame:
    shown = F.concat_ws(" ", "id", benchmark_label(F.col("id"), F.col("task")))
    return benchmarks.where(F.contains(F.lower(shown), F.lit(text.strip().lower())))


def visible_runs(results: DataFrame, members: DataFrame, include_incomplete: bool = False):
    """Runs with a complete measured result; every run of a category that has none.

    The category-wide flag comes from a grouped aggregate joined back on the category, so no
    window spans all runs.
    """
    runs = (
        results.join(members.select("category", "benchmark_id"), "benchmark_id")
        .groupBy("category", "run_id")
        .agg(
            (
                ~F.bool_or(F.col("provenance") == "demo")
                & F.bool_or(F.col("status") == "complete")
            ).alias("ok")
        )
    )
    if include_incomplete:
        return runs
    some = runs.groupBy("category").agg(F.bool_or("ok").alias("_some"))
    return runs.join(some, "category").where(F.col("ok") | ~F.col("_some")).drop("_some")
