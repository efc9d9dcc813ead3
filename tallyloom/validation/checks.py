"""Data-quality checks. Every check returns rows `(check, subject, detail)`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import (
    ABSTENTION_POLICY,
    ABSTENTIONS,
    COUNT_METHODS,
    DATASET_ACCESS,
    EPSILON,
    METRIC_TOLERANCE,
    PRIMARY_METRIC,
    REGISTRATION_SOURCES,
    RELATIONSHIPS,
    TASKS,
)
from tallyloom.functions import text as X
from tallyloom.functions.scoring import clip_unit, valid_probabilities
from tallyloom.session import dealt

DECISION = ("benchmark_id", "case_id", "question_id")
RESULT = ("run_id", "benchmark_id")


def _found(rows: DataFrame, check: str, keys: list[str] | tuple[str, ...], detail: Column):
    """Violations: rows whose `detail` is not NULL."""
    return rows.select(
        F.lit(check).alias("check"),
        F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("subject"),
        detail.alias("detail"),
    ).where(F.col("detail").isNotNull())


def _found_once(rows: DataFrame, check: str, keys: list[str] | tuple[str, ...], detail: Column):
    """As `_found`, for rules over derived columns.

    A filter on the detail would be moved below the columns it reads, and these would then be derived again for each
    element or mention; what is exploded stays above them.
    """
    return rows.select(
        F.lit(check).alias("check"),
        F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("subject"),
        F.explode(F.array_compact(F.array(detail))).alias("detail"),
    )


def first_problem(*rules: tuple[str, Column]) -> Column:
    """The text of the first rule that holds; NULL conditions do not count."""
    out = F.lit(None).cast("string")
    for text, broken in reversed(rules):
        out = F.when(broken, F.lit(text)).otherwise(out)
    return out


def union_all(checks: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def raise_on(violations: DataFrame, shown: int = 20) -> None:
    """Raise with a few examples when there is any violation."""
    rows = violations.limit(shown).collect()
    if rows:
        lines = "; ".join(f"{r['check']} {r['subject']}: {r['detail']}" for r in rows)
        raise ValueError(f"Validation failed: {lines}")


def probability_problem() -> Column:
    bad = F.col("probabilities").isNotNull() & ~valid_probabilities(
        F.col("probabilities"), F.col("options.id")
    )
    return first_problem(("invalid distribution", bad))


def probability_maps(joined: DataFrame, keys=("run_id", *DECISION)) -> DataFrame:
    """Predicted maps against the option ids of their question."""
    return _found(joined, "probabilities", keys, probability_problem())


def question_problem() -> Column:
    """`options` is an array of (id, value)."""
    options, task = F.col("options"), F.col("task")
    ids = options["id"]
    values = options["value"]
    judged = task != "box"
    return first_problem(
        ("unknown task", ~task.isin(*TASKS)),
        ("box with options", (task == "box") & (F.size(options) > 0)),
        ("fewer than two options", judged & (F.coalesce(F.size(options), F.lit(0)) < 2)),
        ("duplicate option", judged & (F.size(F.array_distinct(ids)) != F.size(ids))),
        (
            "noul options",
            (task == "noul")
            & (F.array_sort(ids) != F.array(F.lit("false"), F.lit("true"))),
        ),
        (
            "score scale",
            (task == "score")
            & (
                F.exists(values, lambda v: v.isNull())
                | (F.size(F.array_distinct(values)) < 2)
            ),
        ),
    )


def question_rules(questions: DataFrame, keys=DECISION) -> DataFrame:
    return _found(questions, "question", keys, question_problem())


def case_rules(cases: DataFrame, keys=("case_id",)) -> DataFrame:
    """`questions` (id, task, options) against `targets` (map of probabilities, box)."""
    ids = F.col("questions.id")
    owners = F.map_keys("targets")

    def target(q: Column) -> Column:
        return F.try_element_at("targets", q["id"])

    def has_distribution(q: Column) -> Column:
        return F.coalesce(F.size(target(q)["probabilities"]), F.lit(0)) > 0

    def wrong_kind(q: Column) -> Column:
        box = target(q)["box"].isNotNull()
        return F.when(q["task"] == "box", ~box | has_distribution(q)).otherwise(box)

    def bad_distribution(q: Column) -> Column:
        return (q["task"] != "box") & ~valid_probabilities(
            target(q)["probabilities"], q["options"]["id"]
        )

    def flat(q: Column) -> Column:
        b = target(q)["box"]
        return (b["left"] == b["right"]) | (b["top"] == b["bottom"])

    return _found_once(
        cases,
        "case",
        keys,
        first_problem(
            ("duplicate question", F.size(F.array_distinct(ids)) != F.size(ids)),
            (
                "questions and targets differ",
                (F.size(F.array_except(ids, owners)) > 0)
                | (F.size(F.array_except(owners, ids)) > 0),
            ),
            ("target kind", F.exists("questions", wrong_kind)),
            ("flat target box", F.exists("questions", flat)),
            ("target distribution", F.exists("questions", bad_distribution)),
        ),
    )


def native_rows(rows: DataFrame, keys=("case_id",)) -> DataFrame:
    """Rows as delivered, before they become cases."""
    decisions, targets = F.col("input.decisions"), F.col("targets")
    ids, owners = decisions["id"], targets["decision_id"]

    def repeated(array: Column) -> Column:
        return F.size(F.array_distinct(array)) != F.size(array)

    return _found_once(
        rows,
        "native row",
        keys,
        first_problem(
            (
                "targets do not match decisions",
                repeated(ids)
                | repeated(owners)
                | (F.size(F.array_except(ids, owners)) > 0)
                | (F.size(F.array_except(owners, ids)) > 0),
            ),
            ("not a judgment", F.exists(decisions, lambda d: d["kind"] != "judgment")),
            (
                "ranking fields",
                F.exists(
                    decisions,
                    lambda d: (F.coalesce(F.size(d["documents"]), F.lit(0)) > 0)
                    | d["scoring"].isNotNull(),
                ),
            ),
            ("duplicate criterion", F.exists(decisions, lambda d: repeated(d["criteria"]["id"]))),
            (
                "not a distribution",
                F.exists(targets, lambda t: t["kind"] != "judgment_distribution"),
            ),
            (
                "target ids",
                F.exists(
                    targets,
                    lambda t: repeated(t["ids"]) | (F.size(t["ids"]) != F.size(t["probabilities"])),
                ),
            ),
        ),
    )


def split_rows(rows: DataFrame, split: str, keys=("case_id",)) -> DataFrame:
    differs = ~F.col("split").eqNullSafe(F.lit(split))
    return _found(rows, "split", keys, first_problem(("row of another split", differs)))


def box_problem(column: str = "box") -> Column:
    b = F.col(column)
    outside = reduce(
        lambda a, e: a | ~b[e].between(0.0, 1.0) | F.isnan(b[e]),
        ("left", "top", "right", "bottom"),
        F.lit(False),
    )
    return first_problem(
        ("edge outside [0, 1]", outside),
        ("edges out of order", (b["left"] > b["right"]) | (b["top"] > b["bottom"])),
    )


def box_edges(rows: DataFrame, column: str = "box", keys=("run_id", *DECISION)) -> DataFrame:
    return _found(rows, "box", keys, box_problem(column))


def outcome_problem() -> Column:
    outcomes = ("probabilities", "box", "error", "abstention")
    count = sum((F.col(o).isNotNull().cast("int") for o in outcomes), F.lit(0))
    task = F.col("task")
    return first_problem(
        ("not exactly one outcome", count != 1),
        ("unknown abstention", ~F.col("abstention").isin(*ABSTENTIONS)),
        ("box for a distribution question", F.col("box").isNotNull() & (task != "box")),
        ("distribution for a box question", F.col("probabilities").isNotNull() & (task == "box")),
    )


def prediction_outcomes(joined: DataFrame, keys=("run_id", *DECISION)) -> DataFrame:
    """Exactly one outcome, of a type that fits the task."""
    return _found_once(joined, "outcome", keys, outcome_problem())


def prediction_keys(predictions: DataFrame, decisions: DataFrame, count: int = 0) -> DataFrame:
    """Unknown decision keys, and keys recorded more than once within a run.

    Duplicates are counted with partial aggregation, so a task holds keys and not their copies. Dealt over `count` tasks
    by key (see `session.dealt`), both are found where the keys lie.
    """
    # The case first: its first eight bytes tell most keys apart when they are sorted.
    key = ["case_id", "question_id", "benchmark_id"]
    rows = dealt(predictions.select("run_id", *DECISION), count, *key)
    unknown = rows.join(dealt(decisions.select(*key), count, *key), key, "left_anti")
    repeated = (
        rows.groupBy("run_id", *DECISION)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )
    keys = ("run_id", *DECISION)
    return _found(unknown, "prediction key", keys, F.lit("unknown decision")).unionByName(
        _found(repeated, "prediction key", keys, F.lit("duplicate"))
    )


def dataset_sizes(decisions: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Cases and decisions per benchmark against the definition."""
    found = decisions.groupBy("benchmark_id").agg(
        F.count_distinct("case_id").alias("cases"), F.count(F.lit(1)).alias("decisions")
    )
    defined = benchmarks.withColumnRenamed("id", "benchmark_id")
    sizes = defined.join(found, "benchmark_id", "left")
    return _found(
        sizes,
        "dataset size",
        ["benchmark_id"],
        first_problem(
            ("case count", ~F.col("cases").eqNullSafe(F.col("case_count"))),
            ("decision count", ~F.col("decisions").eqNullSafe(F.col("decision_count"))),
        ),
    )


def duplicate_cases(cases: DataFrame) -> DataFrame:
    repeated = (
        cases.groupBy("benchmark_id", "case_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )
    return _found(repeated, "case id", ["benchmark_id", "case_id"], F.lit("duplicate"))


def input_hashes(recorded: DataFrame, dataset: DataFrame, count: int = 0) -> DataFrame:
    """Hashes a result recorded per (benchmark, case) against those of the dataset.

    `recorded` carries run_id. Dataset cases a run does not mention are found by counting its
    known cases, so no run x case grid is built. Dealt over `count` tasks by case (see `session.dealt`), hashes are
    compared and cases counted where they lie.
    """
    keys = ["benchmark_id", "case_id"]
    current = dataset.select(*keys, F.col("input_hash").alias("current_hash"))
    # The case first: its first eight bytes tell most keys apart when they are sorted.
    key = keys[::-1]
    compared = dealt(recorded, count, *key).join(dealt(current, count, *key), key, "left")
    wrong = _found(
        compared,
        "input hash",
        ["run_id", *keys],
        first_problem(
            ("unknown case", F.col("current_hash").isNull()),
            ("hash differs", ~F.col("input_hash").eqNullSafe(F.col("current_hash"))),
        ),
    )
    sizes = dataset.groupBy("benchmark_id").agg(F.count_distinct("case_id").alias("expected"))
    known = compared.where(F.col("current_hash").isNotNull())
    seen = known.groupBy("run_id", "benchmark_id").agg(F.count_distinct("case_id").alias("seen"))
    short = seen.join(sizes, "benchmark_id", "left")
    fewer = F.coalesce("expected", F.lit(0)) > F.col("seen")
    return wrong.unionByName(
        _found(short, "input hash", list(RESULT), first_problem(("cases missing", fewer)))
    )


def _long_metrics(results: DataFrame, metrics: list[str], value: str) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias(value)) for m in metrics]
    )
    return results.select(*RESULT, F.explode(pairs).alias("_p")).select(*RESULT, "_p.*")


def metric_differs(stored: Column, recomputed: Column, tolerance: float = METRIC_TOLERANCE) -> Column:
    """NULL matches NULL; numbers match within a tolerance."""
    one_null = stored.isNull() != recomputed.isNull()
    bound = F.greatest(F.lit(tolerance), 1e-9 * F.greatest(F.abs(stored), F.abs(recomputed)))
    return one_null | F.coalesce(F.abs(stored - recomputed) > bound, F.lit(False))


def stored_metrics(
    stored: DataFrame, recomputed: DataFrame, metrics: list[str], tolerance=METRIC_TOLERANCE
) -> DataFrame:
    """Stored against recomputed metrics: NULL matches NULL, numbers match within a tolerance.

    The two wide rows are joined on (run, benchmark) first and unpivoted after, so the join
    moves one row per result rather than one per metric.
    """
    left = stored.select(*RESULT, *[F.col(m).alias(f"s_{m}") for m in metrics])
    right = recomputed.select(*RESULT, *[F.col(m).alias(f"r_{m}") for m in metrics])
    both = left.withColumn("_s", F.lit(True)).join(
        right.withColumn("_r", F.lit(True)), list(RESULT), "full"
    )

    def differs(m: str) -> Column:
        return metric_differs(F.col(f"s_{m}"), F.col(f"r_{m}"), tolerance)

    rows = both.where(F.col("_s") & F.col("_r")).select(
        *RESULT,
        F.explode(
            F.array_compact(F.array(*[F.when(differs(m), F.lit(m)) for m in metrics]))
        ).alias("metric"),
    )
    lone = both.where(F.col("_s").isNull() | F.col("_r").isNull())
    side = F.when(F.col("_s").isNull(), "not stored").otherwise("not recomputed")
    return _found(rows, "stored metric", [*RESULT, "metric"], F.lit("differs")).unionByName(
        _found(lone, "stored metric", list(RESULT), side)
    )


def conflicting_results(results: DataFrame, content: list[str]) -> DataFrame:
    """Different contents under one (run, benchmark); identical copies are fine."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    groups = (
        results.select(*RESULT, digest.alias("digest"))
        .distinct()
        .groupBy(*RESULT)
        .agg((F.count(F.lit(1)) > 1).alias("differs"))
    )
    return _found(
        groups, "result", RESULT, first_problem(("conflicting contents", F.col("differs")))
    )


def collapse_duplicates(results: DataFrame) -> DataFrame:
    """Identical copies of a result become one row."""
    return results.distinct()


def model_identity(results: DataFrame, identity: list[str]) -> DataFrame:
    """One model identity per run."""
    digest = F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256)
    groups = (
        results.select("run_id", digest.alias("digest"))
        .distinct()
        .groupBy("run_id")
        .agg((F.count(F.lit(1)) > 1).alias("differs"))
    )
    return _found(
        groups, "model identity", ["run_id"], first_problem(("inconsistent", F.col("differs")))
    )


def summary_problem() -> Column:
    """Of a stored result beside the definition's case_count, decision_count and primary_metric."""
    task = F.col("task")
    primary = F.lit(None).cast("double")
    for name, metric in PRIMARY_METRIC.items():
        primary = F.when(task == name, F.col(metric)).otherwise(primary)
    baseline = (
        F.when(task == "choice", F.col("fixed_answer_accuracy_baseline"))
        .when(task == "score", F.col("constant_mae_baseline"))
        .when(task == "noul", F.col("positive_prevalence"))
    )
    fixed, constant = F.col("fixed_answer_accuracy_baseline"), F.col("constant_mae_baseline")
    skill = (
        F.when(
            (task == "choice") & (fixed < 1 - EPSILON),
            F.try_divide(F.col("target_mass_at_prediction") - fixed, 1 - fixed),
        )
        .when(
            (task == "score") & (constant > EPSILON),
            1 - F.try_divide(F.col("normalized_expected_score_mae"), constant),
        )
        .when(task == "noul", 2 * F.col("balanced_accuracy") - 1)
    )
    expected = clip_unit(skill)
    adjusted = F.col("baseline_adjusted_score")

    def unbounded(value: Column) -> Column:
        return F.coalesce(~value.between(0.0, 1.0), F.lit(False))

    kept = F.col("succeeded") + F.col("abstained")
    complete = (
        (F.col("failed") == 0)
        & (kept == F.col("expected"))
        & (F.col("cases") == F.col("case_count"))
    )
    bounded = [primary, baseline, adjusted, F.col("balanced_accuracy"), F.col("accuracy_at_iou_0_5")]
    return first_problem(
        ("metric outside [0, 1]", reduce(lambda a, v: a | unbounded(v), bounded, F.lit(False))),
        ("baseline missing", (task != "box") & baseline.isNull()),
        (
            "counts do not add up",
            (F.col("expected") != F.col("decision_count"))
            | (F.col("cases") > F.col("case_count"))
            | (kept + F.col("failed") > F.col("expected"))
            | ((kept == 0) != primary.isNull()),
        ),
        ("status", (F.col("status") == "complete") != complete),
        (
            "adjusted score",
            (task != "box")
            & (
                (adjusted.isNull() != expected.isNull())
                | F.coalesce(F.abs(adjusted - expected) > METRIC_TOLERANCE, F.lit(False))
            ),
        ),
    )


def summaries(results: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Counts, bounds, status and adjusted score of stored results."""
    defined = benchmarks.select(
        F.col("id").alias("benchmark_id"), "case_count", "decision_count", "primary_metric"
    )
    return _found(results.join(defined, "benchmark_id"), "summary", RESULT, summary_problem())


def definitions(benchmarks: DataFrame, categories: DataFrame) -> DataFrame:
    """Ids, metrics and category members of the definition tables."""
    metric = F.lit(None).cast("string")
    for task, name in PRIMARY_METRIC.items():
        metric = F.when(F.col("task") == task, F.lit(name)).otherwise(metric)
    fields = _found(
        benchmarks,
        "benchmark",
        ["id"],
        first_problem(
            ("unsafe id", ~X.is_safe_id(F.col("id"))),
            ("primary metric", ~F.col("primary_metric").eqNullSafe(metric)),
            ("empty", (F.col("case_count") <= 0) | (F.col("decision_count") <= 0)),
        ),
    )

    def repeated(rows: DataFrame, check: str) -> DataFrame:
        groups = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        return _found(groups, check, ["id"], F.lit("duplicate id"))

    listed = categories.select(F.col("id").alias("category"), F.explode("benchmarks").alias("id"))
    twice = (
        listed.groupBy("category", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    )
    unknown = listed.distinct().join(benchmarks.select("id"), "id", "left_anti")
    empty = F.coalesce(F.size("benchmarks"), F.lit(0)) <= 0
    return union_all(
        [
            fields,
            repeated(benchmarks, "benchmark"),
            repeated(categories, "category"),
            _found(categories, "category", ["id"], first_problem(("no members", empty))),
            _found(twice, "category member", ["category", "id"], F.lit("duplicate")),
            _found(unknown, "category member", ["category", "id"], F.lit("unknown")),
        ]
    )


def parameter_counts(models: DataFrame, key: str = "model_key") -> DataFrame:
    total, active = F.col("total_params"), F.col("active_params")
    method = F.col("parameter_count_method")
    return _found(
        models,
        "parameters",
        [key],
        first_problem(
            ("negative", (total < 0) | (active < 0)),
            ("unknown method", ~method.isin(*COUNT_METHODS)),
            ("active without total", active.isNotNull() & total.isNull()),
            ("active exceeds total", active > total),
            ("active and method must come together", active.isNull() != method.isNull()),
        ),
    )


def exposures(bridge: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Disclosure entries, one row per (model_key, entry)."""
    known = benchmarks.select(F.col("id").alias("benchmark_id")).distinct()
    rows = bridge.join(known.withColumn("_known", F.lit(True)), "benchmark_id", "left")

    def outside(column: str, allowed: tuple[str, ...]) -> Column:
        return F.col(column).isNotNull() & ~F.col(column).isin(*allowed)

    def length_outside(column: str, low: int, high: int) -> Column:
        return ~F.length(column).between(low, high)

    entries = _found(
        rows,
        "exposure",
        ["model_key", "benchmark_id"],
        first_problem(
            ("benchmark id", ~X.is_safe_id(F.col("benchmark_id")) | (F.length("benchmark_id") > 128)),
            ("unknown benchmark", F.col("_known").isNull()),
            (
                "relationship",
                F.col("relationship").isNull() | ~F.col("relationship").isin(*RELATIONSHIPS),
            ),
            ("registration source", outside("registration_source", REGISTRATION_SOURCES)),
            ("dataset access", outside("dataset_access", DATASET_ACCESS)),
            (
                "dataset",
                F.col("dataset").isNotNull()
                & (~X.matches(F.col("dataset"), X.DATASET_NAME) | (F.length("dataset") > 256)),
            ),
            (
                "revision",
                F.col("revision").isNotNull() & ~X.matches(F.col("revision"), X.COMMIT),
            ),
            (
                "text length",
                length_outside("config", 1, 128)
                | length_outside("split", 1, 64)
                | length_outside("note", 1, 1000)
                | length_outside("evidence_url", 1, 2048),
            ),
            ("evidence link", ~X.is_evidence_link(F.col("evidence_url"))),
        ),
    )
    sizes = bridge.groupBy("model_key").agg(F.count(F.lit(1)).alias("n"))
    return entries.unionByName(
        _found(sizes, "exposure", ["model_key"], first_problem(("too many entries", F.col("n") > 256)))
    )


def registry_ids(by_model: DataFrame) -> DataFrame:
    """Model ids listed by more than one disclosure group, or malformed."""
    groups = by_model.groupBy("model_key").agg(F.count(F.lit(1)).alias("n"))
    return _found(
        groups,
        "registry",
        ["model_key"],
        first_problem(
            ("model id", ~X.matches(F.col("model_key"), X.MODEL_KEY)),
            ("duplicate", F.col("n") > 1),
        ),
    )


def policies(results: DataFrame) -> DataFrame:
    """Dummy results are demos; abstentions need the declared scoring policy."""
    declared = F.col("abstention_scoring").eqNullSafe(F.lit(ABSTENTION_POLICY))
    return _found(
        results,
        "policy",
        RESULT,
        first_problem(
            ("dummy must be demo", (F.col("adapter") == "dummy") & (F.col("provenance") != "demo")),
            ("abstention policy", (F.col("abstained") > 0) & ~declared),
        ),
    )


def file_names(bundles: DataFrame, published: bool = True) -> DataFrame:
    """Folder name = metadata model id, file name = benchmark id.

    Expects `path`, `model_id` (of the folder's metadata) and `benchmark_id`.
    """
    parts = F.split("path", "/")
    folder, file = F.element_at(parts, -2), F.element_at(parts, -1)
    wanted = F.concat("benchmark_id", F.lit(".json.xz" if published else ".json"))
    return _found(
        bundles,
        "file name",
        ["path"],
        first_problem(
            ("no metadata", F.col("model_id").isNull()),
            ("folder differs from model id", folder != F.col("model_id")),
            ("file differs from benchmark id", file != wanted),
        ),
    )


def subset_owners(claims: DataFrame) -> DataFrame:
    """Subset names claimed by more than one dataset source."""
    owners = (
        claims.select("subset", "source")
        .distinct()
        .groupBy("subset")
        .agg((F.count(F.lit(1)) > 1).alias("several"))
    )
    return _found(owners, "subset", ["subset"], first_problem(("several sources", F.col("several"))))


def changed_subsets(installed: DataFrame, incoming: DataFrame, content: list[str]) -> DataFrame:
    """Subsets of both deliveries whose rows differ, copies counted.

    Rows are compared by digest: +1 per installed row, -1 per incoming one. The sums are
    partial, so a subset's rows never meet in one task.
    """
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select("subset", digest.alias("digest"), F.lit(sign).alias("sign"))

    balance = (
        signed(installed, 1)
        .unionByName(signed(incoming, -1))
        .groupBy("subset", "digest")
        .agg(
            F.sum("sign").alias("balance"),
            F.max(F.col("sign") > 0).alias("old"),
            F.max(F.col("sign") < 0).alias("new"),
        )
        .groupBy("subset")
        .agg(
            F.bool_or(F.col("balance") != 0).alias("changed"),
            F.bool_or("old").alias("old"),
            F.bool_or("new").alias("new"),
        )
    )
    changed = F.col("changed") & F.col("old") & F.col("new")
    return _found(balance, "subset", ["subset"], first_problem(("rows changed", changed)))
