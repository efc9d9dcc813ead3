"""Nested cases, their decisions and the target-free view handed to scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import canonical_text
from tallyloom.operators.ranking import with_position

# spark.sql.optimizer.windowGroupLimitThreshold's default.
GROUP_LIMIT = 1000

INFERENCE_COLUMNS = ("case_id", "state", "state_json", "images", "questions")


def target_by_decision(targets: Column) -> Column:
    """Target structs keyed by decision id."""
    return F.map_from_entries(
        F.transform(targets, lambda t: F.struct(t["decision_id"], t))
    )


def one_target_each(decisions: Column, targets: Column) -> Column:
    """True when ids are unique on both sides and the two id sets are equal."""
    ids, owners = decisions["id"], targets["decision_id"]
    unique = (F.size(F.array_distinct(ids)) == F.size(ids)) & (
        F.size(F.array_distinct(owners)) == F.size(owners)
    )
    same = (F.size(F.array_except(ids, owners)) == 0) & (F.size(F.array_except(owners, ids)) == 0)
    return unique & same


def case_problem(decisions: Column, targets: Column) -> Column:
    """Why a case has not exactly one target for each decision; NULL for a sound one."""
    ids, owners = decisions["id"], targets["decision_id"]
    return (
        F.when(decisions.isNull() | targets.isNull(), "no decisions or targets")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated decision")
        .when(F.size(F.array_distinct(owners)) != F.size(owners), "repeated target")
        .when(F.size(F.array_except(ids, owners)) > 0, "decision without a target")
        .when(F.size(F.array_except(owners, ids)) > 0, "target without a decision")
    )


def _distribution(target: Column) -> Column:
    return F.map_from_arrays(target["ids"], target["probabilities"])


def decisions_from_cases(cases: DataFrame, strict: bool = False) -> DataFrame:
    """One row per decision of rows with exactly one target each; candidate order is kept.

    Unsound cases are left out, `accounted_decisions` has them with the reason; `strict` ends the
    job at the first one.
    """
    rows = accounted_decisions(cases)
    if strict:
        stop = F.raise_error(F.concat_ws(": ", "case_id", "problem"))
        rows = rows.withColumn("problem", F.when(F.col("problem").isNotNull(), stop))
    return rows.where(F.col("problem").isNull()).drop("problem")


def quarantined_cases(cases: DataFrame) -> DataFrame:
    """(case_id, problem) of the cases that decisions_from_cases() and questions_view() leave out."""
    problem = case_problem(F.col("input.decisions"), F.col("targets"))
    return cases.select("case_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def accounted_decisions(cases: DataFrame) -> DataFrame:
    """All cases in one pass: the decisions of sound ones, and one row with `problem` for each other case.

    Everything stays inside the row: the target is found by id in the case's own target
    array, so exploding needs neither a join nor a shuffle.
    """
    problem = case_problem(F.col("input.decisions"), F.col("targets"))
    checked = cases.withColumn("problem", problem)
    # A case with a problem gives one row without a decision.
    decisions = F.when(F.col("problem").isNull(), F.col("input.decisions"))
    rows = checked.select(
        "problem",
        "case_id",
        "group_id",
        "input_hash",
        "split",
        "language",
        F.col("input.state_json").alias("state_json"),
        "targets",
        F.posexplode_outer(decisions).alias("position", "decision"),
    )
    mine = F.get(
        F.filter("targets", lambda t: t["decision_id"] == F.col("decision.id")), F.lit(0)
    )
    return rows.withColumn("_target", mine).select(
        "case_id",
        F.col("decision.id").alias("question_id"),
        "position",
        F.col("decision.type").alias("task"),
        canonical_text(F.col("decision.instructions_json")).alias("instructions"),
        F.coalesce("decision.system_prompt", F.lit("")).alias("system_prompt"),
        F.transform(
            "decision.criteria",
            lambda c: F.struct(
                c["id"].alias("id"),
                canonical_text(c["description_json"]).alias("description"),
                c["description_json"].alias("description_json"),
                c["value"].alias("value"),
            ),
        ).alias("options"),
        F.col("_target.annotation_kind").alias("target_kind"),
        _distribution(F.col("_target")).alias("target"),
        F.coalesce("_target.metadata_json", F.lit("{}")).alias("target_metadata_json"),
        "group_id",
        "language",
        "input_hash",
        "split",
        "state_json",
        "problem",
    )


def questions_view(cases: DataFrame) -> DataFrame:
    """Cases with `questions` (array) and `targets` (map), still one row per case."""
    sound = cases.where(one_target_each(F.col("input.decisions"), F.col("targets")))
    questions = F.transform(
        "input.decisions",
        lambda d: F.struct(
            d["id"].alias("id"),
            d["type"].alias("task"),
            canonical_text(d["instructions_json"]).alias("instructions"),
            F.coalesce(d["system_prompt"], F.lit("")).alias("system_prompt"),
            F.transform(
                d["criteria"],
                lambda c: F.struct(
                    c["id"].alias("id"),
                    canonical_text(c["description_json"]).alias("description"),
                    c["value"].alias("value"),
                ),
            ).alias("options"),
        ),
    )
    targets = F.map_from_entries(
        F.transform("targets", lambda t: F.struct(t["decision_id"], _distribution(t)))
    )
    return sound.select(
        "case_id",
        "group_id",
        "language",
        F.col("input.state_json").alias("state"),
        F.col("input.state_json").alias("state_json"),
        F.create_map().cast("map<string,struct<path:string,sha256:string,policy:string>>").alias(
            "images"
        ),
        questions.alias("questions"),
        targets.alias("targets"),
        "input_hash",
        "split",
    )


def questions_of_task(cases: DataFrame, task: str | Column) -> DataFrame:
    """Questions of one task with their targets; cases left without a question are dropped."""
    wanted = task if isinstance(task, Column) else F.lit(task)
    kept = F.filter("questions", lambda q: q["task"] == wanted)
    return (
        cases.withColumn("questions", kept)
        .where(F.size("questions") > 0)
        .withColumn(
            "targets",
            F.map_filter("targets", lambda k, _: F.array_contains(F.col("questions.id"), k)),
        )
    )


def inference_view(cases: DataFrame) -> DataFrame:
    """What a scorer may see: no targets, groups, languages or provenance."""
    return cases.select(*INFERENCE_COLUMNS)


def first_cases(cases: DataFrame, limit: int, order: str = "ordinal") -> DataFrame:
    """The first N cases per benchmark in dataset order.

    Up to Spark's group limit, `row_number() <= N` is applied before the shuffle, so each task
    forwards at most N rows per benchmark. Beyond it, positions are counted over range pieces,
    so that no benchmark is ordered in one task.
    """
    if limit > GROUP_LIMIT:
        placed = with_position(cases, ["benchmark_id"], [F.col(order), F.col("case_id")], name="_n")
        return placed.where(F.col("_n") <= limit).drop("_n")
    window = Window.partitionBy("benchmark_id").orderBy(order, "case_id")
    return (
        cases.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= limit).drop("_n")
    )
