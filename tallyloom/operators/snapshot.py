"""Dictionary encoding of a snapshot, its decoding, and the diff against the previous one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ranking import with_position
from tallyloom.validation.checks import raise_on

KEY = ("run_id", "benchmark_id")


def _dimension(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Distinct values with consecutive keys from 0 in canonical order."""
    distinct = rows.select(*columns).distinct().withColumn("_all", F.lit(0))
    order = [F.col(c) for c in columns]
    return (
        with_position(distinct, ["_all"], order, name=key)
        .drop("_all")
        .withColumn(key, F.col(key) - 1)
    )


def encode(results: DataFrame, benchmark_columns: list[str], model_columns: list[str]):
    """(benchmarks, models, facts): facts refer to both dimensions by integer key."""
    benchmarks = _dimension(results, benchmark_columns, "benchmark")
    models = _dimension(results, model_columns, "model")
    facts = results
    for dim, columns in ((benchmarks, benchmark_columns), (models, model_columns)):
        same = [F.col(f"f.{c}").eqNullSafe(F.col(f"d.{c}")) for c in columns]
        key = [c for c in dim.columns if c not in columns]
        facts = facts.alias("f").join(dim.alias("d"), same, "inner").select(
            *[F.col(f"f.{c}").alias(c) for c in facts.columns], *[F.col(f"d.{k}") for k in key]
        )
    kept = [c for c in facts.columns if c not in {*benchmark_columns, *model_columns}]
    return benchmarks, models, facts.select(*kept)


PARTS = ("benchmarks", "models", "facts")


def digests(benchmarks: DataFrame, models: DataFrame, facts: DataFrame) -> DataFrame:
    """(part, rows, digest) of the three tables of a snapshot; stored beside them."""
    rows = [
        content_digest(table, sorted(table.columns)).withColumn("part", F.lit(part))
        for part, table in zip(PARTS, (benchmarks, models, facts), strict=True)
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("part", "rows", "digest")


def digest_problems(benchmarks: DataFrame, models: DataFrame, facts: DataFrame, stored: DataFrame) -> DataFrame:
    """Violations (check, subject, detail): parts whose content is not what `stored` says, or of which it says nothing."""
    said = stored.select("part", F.col("rows").alias("s_rows"), F.col("digest").alias("s_digest"))
    both = digests(benchmarks, models, facts).join(said, "part", "left")
    detail = (
        F.when(F.col("s_digest").isNull(), "no digest")
        .when(F.col("rows") != F.col("s_rows"), "row count differs")
        .when(F.col("digest") != F.col("s_digest"), "content differs")
    )
    found = both.select(F.lit("snapshot").alias("check"), F.col("part").alias("subject"), detail.alias("detail"))
    return found.where(F.col("detail").isNotNull())


def decode_verified(benchmarks: DataFrame, models: DataFrame, facts: DataFrame, stored: DataFrame) -> DataFrame:
    """decode() after the digests of all three tables were recomputed; a difference is an error."""
    raise_on(digest_problems(benchmarks, models, facts, stored))
    return decode(benchmarks, models, facts)


def decode(benchmarks: DataFrame, models: DataFrame, facts: DataFrame) -> DataFrame:
    return facts.join(benchmarks, "benchmark").join(models, "model").drop("benchmark", "model")


def reference_problems(benchmarks: DataFrame, models: DataFrame, facts: DataFrame) -> DataFrame:
    """Dangling references, unused models and duplicate model entries."""
    content = [c for c in models.columns if c != "model"]

    def problem(rows: DataFrame, name: str, key: str) -> DataFrame:
        return rows.select(F.lit(name).alias("problem"), F.col(key).cast("bigint").alias("key"))

    return (
        problem(facts.join(benchmarks, "benchmark", "left_anti"), "dangling benchmark", "benchmark")
        .unionByName(problem(facts.join(models, "model", "left_anti"), "dangling model", "model"))
        .unionByName(problem(models.join(facts, "model", "left_anti"), "unused model", "model"))
        .unionByName(
            problem(
                models.groupBy(*content)
                .agg(F.count(F.lit(1)).alias("n"), F.min("model").alias("model"))
                .where(F.col("n") > 1),
                "duplicate model",
                "model",
            )
        )
    )


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def content_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """An order-independent digest of a table: row count and folded row digests.

    Row digests are summed as two 60-bit parts in decimal, so partial sums combine in any
    order and repeated rows count; the final hash covers both sums and the count.
    """
    digest = row_digest(columns)

    def part(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")

    sums = rows.select(part(1).alias("a"), part(16).alias("b")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    text = F.concat_ws(
        ":", F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")
    )
    return sums.select("rows", F.sha2(text, 256).alias("digest"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every (run, benchmark) of either snapshot with both states."""
    columns = ("status", "succeeded")
    old = before.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in columns])
    new = after.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in columns])
    change = (
        F.when(F.col("old_status").isNull(), "added")
        .when(F.col("new_status").isNull(), "removed")
        .when(
            (F.col("old_status") == "complete") & (F.col("new_status") != "complete"), "regressed"
        )
        .when(F.col("new_succeeded") < F.col("old_succeeded"), "fewer")
        .otherwise("kept")
    )
    return old.join(new, list(KEY), "full").withColumn("change", change)


def _warning(rows: DataFrame, kind: str, *subject: str) -> DataFrame:
    return rows.select(F.lit(kind).alias("warning"), F.concat_ws(" / ", *subject).alias("subject"))


def reduction_warnings(
    before: DataFrame,
    after: DataFrame,
    definitions: tuple[DataFrame, DataFrame],
    members: tuple[DataFrame, DataFrame],
) -> DataFrame:
    """Everything a new snapshot would lose, one warning per row.

    `definitions` are (old, new) tables with `id`; `members` (old, new) with category and
    benchmark_id.
    """
    texts = {
        "removed": "result_removed",
        "regressed": "completion_lost",
        "fewer": "fewer_succeeded",
    }
    diff = snapshot_diff(before, after)
    lost = F.lit(None).cast("string")
    for change, text in texts.items():
        lost = F.when(F.col("change") == change, F.lit(text)).otherwise(lost)
    rows = (
        diff.withColumn("warning", lost)
        .where(F.col("warning").isNotNull())
        .select("warning", F.concat_ws(" / ", *KEY).alias("subject"))
    )
    old_members, new_members = members
    gone = old_members.select("category").distinct().join(
        new_members.select("category").distinct(), "category", "left_anti"
    )
    lost_members = (
        old_members.select("category", "benchmark_id")
        .join(gone, "category", "left_anti")
        .join(new_members.select("category", "benchmark_id"), ["category", "benchmark_id"],
              "left_anti")
    )
    lost_definitions = definitions[0].select("id").join(
        definitions[1].select("id"), "id", "left_anti"
    )
    return (
        rows.unionByName(_warning(lost_definitions, "definition_removed", "id"))
        .unionByName(_warning(gone, "category_removed", "category"))
        .unionByName(_warning(lost_members, "member_removed", "category", "benchmark_id"))
        .unionByName(shrink_warning(before, after))
    )


def shrink_warning(before: DataFrame, after: DataFrame, keep: float = 0.8) -> DataFrame:
    """A warning when the serialised results lose more than a fifth of their bytes."""

    def sized(rows: DataFrame, side: str) -> DataFrame:
        size = F.octet_length(F.to_json(F.struct(*sorted(rows.columns))))
        return rows.select(F.lit(side).alias("side"), size.cast("bigint").alias("bytes"))

    both = (
        sized(before, "old")
        .unionByName(sized(after, "new"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("side") == "old", F.col("bytes"))), F.lit(0)).alias("o"),
            F.coalesce(F.sum(F.when(F.col("side") == "new", F.col("bytes"))), F.lit(0)).alias("n"),
        )
    )
    return both.where(F.col("n") < F.col("o") * keep).select(
        F.lit("content_shrank").alias("warning"),
        F.concat_ws(" -> ", F.col("o").cast("string"), F.col("n").cast("string")).alias("subject"),
    )


def set_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of only one side; empty when the two sets are equal."""
    a, b = left.select(*columns).distinct(), right.select(*columns).distinct()
    return (
        a.join(b, columns, "left_anti")
        .withColumn("only_in", F.lit("left"))
        .unionByName(b.join(a, columns, "left_anti").withColumn("only_in", F.lit("right")))
    )
