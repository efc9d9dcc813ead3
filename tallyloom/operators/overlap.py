"""Text reuse, overlap with evaluation inputs, and input lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import text_key


# Rows of one text that a task takes in a join; a text with more is shared by as many tasks as it needs.
ROWS_PER_TASK = 1_000_000


def hot_keys(counts: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(key, salts) of the keys with more rows than a task takes, from their exact counts `n`.

    There are at most (all rows / rows_per_task) of them.
    """
    salts = F.ceil(F.col("n") / rows_per_task).cast("int")
    return counts.where(F.col("n") > rows_per_task).select(F.col(key).alias("_hot"), salts.alias("_salts"))


def _salted_join(
    rows: DataFrame, per_key: DataFrame, key: str, how: str, rows_per_task: int = ROWS_PER_TASK, counts: DataFrame | None = None
) -> DataFrame:
    """Join rows with a table of one row per key; each frequent key gets its own number of salts.

    Keys are counted with partial aggregation. A row's salt is a hash of its columns, so a repeated task deals it alike;
    rows that are equal in every column share a salt.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, key, rows_per_task)
    plain = [c for c, kind in rows.dtypes if not kind.startswith("map")]
    dealt = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*plain), F.coalesce("_salts", F.lit(1))).cast("int")
    )
    last = F.coalesce("_salts", F.lit(1)) - 1
    repeated = per_key.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    sides = dealt.drop("_hot", "_salts"), repeated.drop("_hot", "_salts")
    return sides[0].join(sides[1], [key, "_salt"], how).drop("_salt")


def reuse_by_content(
    rows: DataFrame, text: str, order: list[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Marks every row whose exact text occurred earlier, with the row it can reuse.

    The first row per text is a minimum, so copies collapse before the shuffle and no task
    holds a group of copies. The same aggregation counts them, which tells how many tasks share
    a text in the join back. A single numeric order column keeps the minimum in a hash aggregate.
    """
    keyed = rows.withColumn("content_key", F.sha2(text, 256))
    if len(order) == 1:
        lowest = keyed.groupBy("content_key").agg(F.min(order[0]).alias("_lowest"), F.count(F.lit(1)).alias("n"))
        first = lowest.select("content_key", F.struct(F.col("_lowest").alias(order[0])).alias("source"), "n")
    else:
        first = keyed.groupBy("content_key").agg(F.min(F.struct(*order)).alias("source"), F.count(F.lit(1)).alias("n"))
    joined = _salted_join(keyed, first.drop("n"), "content_key", "inner", rows_per_task, first.select("content_key", "n"))
    mine = F.struct(*order)
    return joined.withColumn("reused", mine != F.col("source"))


def computed_once(rows: DataFrame, text: str, compute: Callable[[DataFrame], DataFrame]):
    """Run a costly computation on distinct texts and fan the results back out.

    `compute` receives (content_key, text) and returns (content_key, ...).
    """
    keyed = rows.withColumn("content_key", F.sha2(text, 256))
    distinct = keyed.select("content_key", text).distinct()
    return _salted_join(keyed, compute(distinct), "content_key", "inner")


def evaluation_keys(inputs: DataFrame, text: str) -> DataFrame:
    """Evaluation inputs per normalised text: benchmark, inputs and decisions."""
    return (
        inputs.withColumn("content_key", text_key(F.col(text)))
        .groupBy("content_key", "benchmark_id")
        .agg(F.count(F.lit(1)).alias("inputs"), F.sum("decisions").alias("decisions"))
    )


def overlap_audit(training: DataFrame, inputs: DataFrame, text: str) -> DataFrame:
    """Exact overlaps after whitespace normalisation, per (training config, benchmark).

    Training copies are counted per (config, text) before the join: a text repeated in a
    third of all rows reaches the join once per config.
    """
    copies = (
        training.select("config", text_key(F.col(text)).alias("content_key"))
        .groupBy("config", "content_key")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    return (
        copies.join(evaluation_keys(inputs, text), "content_key")
        .groupBy("config", "benchmark_id")
        .agg(
            F.sum("copies").alias("training_rows"),
            F.sum("inputs").alias("inputs"),
            F.sum("decisions").alias("decisions"),
        )
    )


def decontaminated(
    training: DataFrame, inputs: DataFrame, text: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Training rows whose normalised text is no evaluation input."""
    known = inputs.select(text_key(F.col(text)).alias("content_key")).distinct()
    keyed = training.withColumn("content_key", text_key(F.col(text)))
    return _salted_join(keyed, known, "content_key", "left_anti", rows_per_task).drop("content_key")


def decontamination_receipt(training: DataFrame, inputs: DataFrame, text: str) -> DataFrame:
    """Rows before and after, per config; keys are distinct, so counts cannot multiply."""
    known = inputs.select(text_key(F.col(text)).alias("content_key")).distinct().withColumn(
        "_hit", F.lit(1)
    )
    copies = (
        training.select("config", text_key(F.col(text)).alias("content_key"))
        .groupBy("config", "content_key")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    removed = F.when(F.col("_hit").isNotNull(), F.col("copies")).otherwise(0)
    return (
        copies.join(known, "content_key", "left")
        .groupBy("config")
        .agg(F.sum("copies").alias("before"), F.sum(removed).alias("removed"))
        .withColumn("after", F.col("before") - F.col("removed"))
    )


def removed_ids(
    training: DataFrame, inputs: DataFrame, text: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The training rows the receipt names."""
    known = inputs.select(text_key(F.col(text)).alias("content_key")).distinct()
    keyed = training.withColumn("content_key", text_key(F.col(text)))
    return _salted_join(keyed, known, "content_key", "left_semi", rows_per_task)


def word_count(text: Column) -> Column:
    """Whitespace-separated tokens; the default length of a field."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.coalesce(F.size(tokens), F.lit(0)).cast("bigint")


def length_audit(
    decisions: DataFrame,
    fields: list[str],
    limit: int,
    markers: int = 2,
    length: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """Required length per decision against a limit; overflow is reported, nothing is cut.

    With a built-in length expression measuring in place is cheaper than any shuffle. Pass a
    tokenizer through `measured_lengths`, which measures each distinct text once.
    """
    required = sum((length(F.col(f)) for f in fields), F.lit(markers).cast("bigint"))
    return decisions.withColumn("required", required).withColumn(
        "overflow", F.col("required") > limit
    )


def measured_lengths(
    decisions: DataFrame,
    key: list[str],
    fields: list[str],
    limit: int,
    length: Callable[[Column], Column],
    markers: int = 2,
) -> DataFrame:
    """The same audit for a costly `length` (a pandas UDF): one call per distinct text."""
    long = decisions.select(
        *key, F.explode(F.array(*[F.coalesce(f, F.lit("")) for f in fields])).alias("text")
    ).withColumn("content_key", F.sha2("text", 256))
    sizes = (
        long.select("content_key", "text")
        .distinct()
        .select("content_key", length(F.col("text")).cast("bigint").alias("tokens"))
    )
    return (
        long.groupBy(*key, "content_key")
        .agg(F.count(F.lit(1)).alias("uses"))
        .join(sizes, "content_key")
        .groupBy(*key)
        .agg((F.sum(F.col("uses") * F.col("tokens")) + markers).alias("required"))
        .withColumn("overflow", F.col("required") > limit)
    )


def shared_configs(train: DataFrame, subsets: DataFrame) -> DataFrame:
    """Train config names that are also evaluation subsets: candidate exposures."""
    return train.select("name").intersect(subsets.select("name"))
