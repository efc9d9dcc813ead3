"""Evidence tables of a submission and the coverage gate in front of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import RANKING_TASKS, TASKS
from tallyloom.functions.text import format_parameters, report_cell
from tallyloom.operators.leaderboard import task_means
from tallyloom.operators.results import category_lists, is_complete
from tallyloom.operators.scopes import generalization_scope

# Volatile parts of a recorded environment.
VOLATILE = ("input_hashes", "image_preprocessing")
REPORT_TASKS = ("noul", "choice", "score", "box")


def evidence_tally(results: DataFrame) -> DataFrame:
    """Saved, complete, succeeded, abstained, failed per model and task, zero rows kept.

    The four task rows come from one wide aggregate, so no task table is joined in.
    """
    names = ("succeeded", "abstained", "failed")

    def cell(task: str) -> Column:
        mine = F.col("task") == task
        return F.struct(
            F.lit(task).alias("task"),
            F.count_if(mine).alias("saved"),
            F.count_if(mine & (F.col("status") == "complete")).alias("complete"),
            *[F.coalesce(F.sum(F.when(mine, F.col(n))), F.lit(0)).alias(n) for n in names],
        )

    return (
        results.groupBy("model_key")
        .agg(F.array(*[cell(t) for t in TASKS]).alias("rows"))
        .select("model_key", F.explode("rows").alias("r"))
        .select("model_key", "r.*")
    )


def losses_by_task(results: DataFrame) -> DataFrame:
    """Abstained and failed decisions per model, one column per ranking task."""
    return results.groupBy("model_key").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("task") == t, F.col(n))), F.lit(0)).alias(f"{t}_{n}")
            for t in RANKING_TASKS
            for n in ("abstained", "failed")
        ]
    )


def configurations(results: DataFrame) -> DataFrame:
    """Distinct (model, settings, environment) without volatile parts, policies summarised."""
    parsed = F.from_json("environment", "map<string,string>")
    receipts = F.from_json(
        F.try_element_at(parsed, F.lit("image_preprocessing")),
        "map<string,array<struct<policy:string>>>",
    )
    policies = F.array_sort(
        F.array_distinct(
            F.array_compact(F.transform(F.flatten(F.map_values(receipts)), lambda r: r["policy"]))
        )
    )
    stable = F.map_filter(parsed, lambda k, _: ~k.isin(*VOLATILE))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(stable)))
    return results.select(
        "model_key",
        "evaluator_version",
        F.to_json(ordered).alias("environment"),
        F.when(F.size(policies) > 0, F.array_join(policies, ",")).alias("policies"),
    ).distinct()


def coverage_gaps(results: DataFrame, members: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Required non-box benchmarks that a model lacks or has not completed, per category.

    Per model, the finished members are taken from the category's required list; both are at
    most as long as the category record, and no model x member pairs are made.
    """
    required = members.join(
        benchmarks.where(F.col("task") != "box").select(F.col("id").alias("benchmark_id")),
        "benchmark_id",
        "left_semi",
    ).select("category", "benchmark_id")
    finished = is_complete() & (F.col("failed") == 0)
    models = (
        results.select("model_key", "benchmark_id", finished.alias("finished"))
        .join(members.select("category", "benchmark_id"), "benchmark_id")
        .groupBy("category", "model_key")
        .agg(F.collect_set(F.when(F.col("finished"), F.col("benchmark_id"))).alias("done"))
    )
    return (
        models.join(category_lists(required), "category")
        .select("category", "model_key", F.array_except("required", "done").alias("gaps"))
        .where(F.size("gaps") > 0)
        .select(
            "category",
            "model_key",
            F.size("gaps").cast("bigint").alias("missing"),
            F.array_join("gaps", ", ").alias("affected"),
        )
    )


def _shown(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.2f", value * 100)).otherwise(F.lit("N/A"))


def report_table(
    results: DataFrame, members: DataFrame, benchmarks: DataFrame, models: DataFrame
) -> DataFrame:
    """Comparison table: parameters, task scores and `gen-` scores as text."""
    strict = results.withColumn(
        "status", F.when(F.col("failed") > 0, F.lit("partial")).otherwise(F.col("status"))
    )
    scopes = [("", members), ("gen-", generalization_scope(members, benchmarks))]
    columns = [p + t for p, _ in scopes for t in REPORT_TASKS]
    parts = [
        task_means(strict, scope, benchmarks).select(
            "category", "run_id", F.concat(F.lit(p), F.col("task")).alias("column"), "value"
        )
        for p, scope in scopes
    ]
    scores = (
        parts[0]
        .unionByName(parts[1])
        .groupBy("category", "run_id")
        .pivot("column", columns)
        .agg(F.first("value"))
    )
    return scores.join(models, "run_id").select(
        "category",
        report_cell(F.col("display_name")).alias("model"),
        format_parameters(F.col("total_params")).alias("total_params"),
        format_parameters(F.col("active_params")).alias("active_params"),
        *[_shown(F.col(f"`{c}`")).alias(c.replace("-", "_")) for c in columns],
    )


def coverage_exceptions(
    results: DataFrame, members: DataFrame, benchmarks: DataFrame
) -> DataFrame:
    """Models not complete over the non-box scope or with failed decisions in it."""
    required = members.join(
        benchmarks.where(F.col("task") != "box").select(F.col("id").alias("benchmark_id")),
        "benchmark_id",
        "left_semi",
    ).select("category", "benchmark_id")
    sizes = required.groupBy("category").agg(F.count(F.lit(1)).alias("required"))
    return (
        results.join(required, "benchmark_id")
        .groupBy("category", "run_id")
        .agg(
            F.count_if(is_complete() & (F.col("failed") == 0)).alias("complete"),
            F.sum("failed").alias("failed"),
        )
        .join(sizes, "category")
        .where((F.col("complete") != F.col("required")) | (F.col("failed") > 0))
    )
