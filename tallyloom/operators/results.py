"""Result rows: counts, status, eligibility, definitions, snapshot counts and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import EPSILON, INELIGIBLE_REASON, METRICS, STORED_DIGITS
from tallyloom.session import dealt

GRAIN = ("run_id", "benchmark_id")
DEFINITION = ("task", "dataset", "split", "primary_metric")


def key_counts(predictions: DataFrame, count: int = 0) -> DataFrame:
    """(run, benchmark, cases, keys, rows): distinct cases, distinct decision keys, and predictions.

    Only keys are shuffled, collapsed per case first, so no task sees all cases of a result. Dealt over `count` tasks by
    case (see `session.dealt`), keys and cases are both counted where they lie.
    """
    rows = dealt(predictions.select(*GRAIN, "case_id", "question_id"), count, "case_id", *GRAIN)
    keys = rows.groupBy(*GRAIN, "case_id", "question_id").agg(F.count(F.lit(1)).alias("n"))
    cases = keys.groupBy(*GRAIN, "case_id").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"))
    return cases.groupBy(*GRAIN).agg(
        F.count(F.lit(1)).alias("cases"), F.sum("keys").alias("keys"), F.sum("n").alias("rows")
    )


def result_status(known: Column, keys: Column, rows: Column, expected: Column, failed: Column) -> Column:
    """`invalid` with a duplicate or unknown key; `complete` if every known key is there and none failed."""
    invalid = (rows > keys) | (keys > known)
    return F.when(invalid, "invalid").when((known == expected) & (failed == 0), "complete").otherwise("partial")


def outcome_counts(
    predictions: DataFrame, benchmarks: DataFrame, decisions: DataFrame | None = None, count: int = 0
) -> DataFrame:
    """Cases, expected, succeeded, failed, abstained and status per (run, benchmark).

    With `decisions`, keys that no decision has are unknown and make the result invalid. Dealt over `count` tasks
    (see `session.dealt`), keys are counted and joined where they lie; without decisions so are cases.
    """
    key = ["case_id", "question_id", "benchmark_id"]
    place = ("case_id", *GRAIN) if decisions is None else key
    succeeded = F.col("probabilities").isNotNull() | F.col("box").isNotNull()
    rows = predictions.select(
        *GRAIN,
        "case_id",
        "question_id",
        succeeded.alias("s"),
        F.col("error").isNotNull().alias("f"),
        F.col("abstention").isNotNull().alias("a"),
    )
    keys = dealt(rows, count, *place).groupBy(*GRAIN, "case_id", "question_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in "sfa"]
    )
    if decisions is None:
        keys = keys.withColumn("known", F.lit(1))
    else:
        sound = dealt(decisions.select(*key), count, *place).distinct().withColumn("known", F.lit(1))
        keys = keys.join(sound, key, "left")
    cases = keys.groupBy(*GRAIN, "case_id").agg(
        F.count(F.lit(1)).alias("keys"), F.count("known").alias("known"), *[F.sum(c).alias(c) for c in "nsfa"]
    )
    counts = cases.groupBy(*GRAIN).agg(
        F.count(F.lit(1)).alias("cases"),
        *[F.sum(c).alias(c) for c in ("keys", "known")],
        F.sum("n").alias("rows"),
        F.sum("s").alias("succeeded"),
        F.sum("f").alias("failed"),
        F.sum("a").alias("abstained"),
    )
    defined = benchmarks.select(
        F.col("id").alias("benchmark_id"), F.col("decision_count").alias("expected")
    )
    status = result_status(*[F.col(c) for c in ("known", "keys", "rows", "expected", "failed")])
    return counts.join(defined, "benchmark_id").select(
        *GRAIN, "cases", "expected", "succeeded", "failed", "abstained", status.alias("status")
    )


def stored_results(
    metrics: DataFrame, benchmarks: DataFrame, runs: DataFrame, digits: int = STORED_DIGITS
) -> DataFrame:
    """The saved result table: run identity, counts, status and rounded metrics.

    `metrics` carries its counts, and those of `key_counts`; `recorded` counts the rows with a known key.
    """
    expected = benchmarks.select(
        F.col("id").alias("benchmark_id"), F.col("decision_count").alias("expected")
    )
    # A duplicate makes more rows than keys, an unknown key more rows than were recorded.
    known = F.least("recorded", "keys")
    keys = F.when(F.col("rows") > F.col("recorded"), known + 1).otherwise(F.col("keys"))
    status = result_status(known, keys, F.col("rows"), F.col("expected"), F.col("failed"))
    return (
        metrics.join(expected, "benchmark_id")
        .join(runs, "run_id")
        .select(
            *GRAIN,
            "task",
            *[F.round(m, digits).alias(m) for m in METRICS],
            "cases",
            "expected",
            "succeeded",
            "failed",
            "abstained",
            status.alias("status"),
            *[c for c in runs.columns if c != "run_id"],
        )
    )


def is_complete(measured: bool = True) -> Column:
    done = F.col("status") == "complete"
    return done & (F.col("provenance") == "measured") if measured else done


def eligible(task: Column | None = None) -> Column:
    """Whether a result's own baselines leave room for adjustment; boxes never count."""
    task = F.col("task") if task is None else task
    prevalence = F.col("positive_prevalence")
    return (
        F.when(task == "noul", (prevalence > EPSILON) & (prevalence < 1 - EPSILON))
        .when(task == "choice", F.col("fixed_answer_accuracy_baseline") < 1 - EPSILON)
        .when(task == "score", F.col("constant_mae_baseline") > EPSILON)
        .otherwise(F.lit(False))
    )


def default_eligibility(results: DataFrame, defaults: DataFrame, own: str = "own_eligible") -> DataFrame:
    """Adds `eligible`: what a result says itself, else the snapshot's default for its benchmark, else false.

    `defaults` has one row (benchmark_id, eligible) per benchmark of the snapshot that has a default.
    """
    stated = defaults.select("benchmark_id", F.col("eligible").alias("_default"))
    joined = results.join(stated, "benchmark_id", "left")
    return joined.withColumn("eligible", F.coalesce(own, "_default", F.lit(False))).drop("_default")


def with_eligibility(results: DataFrame) -> DataFrame:
    reason = F.lit(None).cast("string")
    for task, text in INELIGIBLE_REASON.items():
        reason = F.when(F.col("task") == task, F.lit(text)).otherwise(reason)
    flagged = results.withColumn("eligible", eligible())
    return flagged.withColumn("reason", F.when(~F.col("eligible"), reason))


def join_definitions(results: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Results of currently defined benchmarks, with the definition fields that differ.

    `results` carries its recorded definition as `recorded_<field>` columns.
    """
    current = benchmarks.select(F.col("id").alias("benchmark_id"), *DEFINITION)
    joined = results.join(current, "benchmark_id")
    differing = F.array_compact(
        F.array(
            *[
                F.when(~F.col(f"recorded_{f}").eqNullSafe(F.col(f)), F.lit(f))
                for f in DEFINITION
            ]
        )
    )
    return joined.withColumn("mismatch", F.concat_ws(",", differing))


def category_runs(results: DataFrame, members: DataFrame) -> DataFrame:
    """Runs of each category with model, demo flag and number of results."""
    return (
        results.join(members.select("category", "benchmark_id"), "benchmark_id")
        .groupBy("category", "run_id")
        .agg(
            F.min_by("model_id", "benchmark_id").alias("model_id"),
            F.bool_or(F.col("provenance") == "demo").alias("demo"),
            F.count(F.lit(1)).alias("results"),
        )
    )


def category_lists(members: DataFrame) -> DataFrame:
    """(category, required): the member list of each category, as its record holds it."""
    return members.groupBy("category").agg(
        F.array_sort(F.collect_set("benchmark_id")).alias("required")
    )


def missing_results(results: DataFrame, members: DataFrame, runs: DataFrame) -> DataFrame:
    """Category members a run has no complete measured result for.

    Per run, the set of finished members (never longer than the category's own list) is taken
    from that list; only what is missing becomes rows, not every run x member pair.
    """
    done = (
        results.where(is_complete())
        .select(*GRAIN)
        .join(members.select("category", "benchmark_id"), "benchmark_id")
        .groupBy("category", "run_id")
        .agg(F.collect_set("benchmark_id").alias("done"))
    )
    none = F.array().cast("array<string>")
    return (
        runs.select("run_id", "category")
        .join(done, ["category", "run_id"], "left")
        .join(category_lists(members), "category")
        .select(
            "category",
            "run_id",
            F.explode(F.array_except("required", F.coalesce("done", none))).alias("benchmark_id"),
        )
    )


def at_recorded_revision(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Each result with the targets of its own (repository, revision, subset)."""
    return results.join(targets, ["repo_id", "revision", "subset"], "inner")


def snapshot_counts(results: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Models, results, complete results and defined benchmarks of each snapshot."""
    found = results.groupBy("snapshot_id").agg(
        F.count_distinct("run_id").alias("models"),
        F.count(F.lit(1)).alias("results"),
        F.count_if(F.col("status") == "complete").alias("complete_results"),
    )
    defined = benchmarks.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("benchmarks"))
    return found.join(defined, "snapshot_id", "full")


def usage_totals(requests: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Per-request usage summed per run."""
    return requests.groupBy(key).agg(
        F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in counters]
    )


def usage_deltas(readings: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Cumulative counters turned into after-minus-before per run."""
    return readings.groupBy(key).agg(*[(F.max(c) - F.min(c)).alias(c) for c in counters])
