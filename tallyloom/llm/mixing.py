"""Mix sources to target weights: budgets down a domain-language-source tree, then seeded token prefixes.

Every node's budget is shared among its children by weight. A child that cannot spend its share (its texts times
`epochs` are fewer tokens) keeps what it can spend; the rest goes to its siblings by weight, and only what all of them
cannot take is missing from the node itself, where the node's own siblings took it up before. Shares are whole tokens.

A leaf passes its documents `epochs` times at most, each epoch in an order of its own (MD5 of seed, epoch and doc_id).
It takes whole epochs, then the longest prefix of the next one that fits its budget. Orders are cut by buckets of the
hash: sums per (leaf, bucket) give the bucket in which a leaf's prefix ends, and only that bucket is put in order. So
no leaf is sorted, however large, and texts of other buckets are not shuffled.

Defined results: a null or blank text has no tokens and is never taken. Nulls in the tree columns count as the value
`(none)`. Repeated rows are documents of their own, and which of several equal rows is taken at the cut is open. An
empty table or a budget of 0 gives an empty result. A weight of 0 or less gives nothing to a node, and the tokens
below it count in no budget above. Extra columns are
kept, except `epoch` and `n_tokens`, which are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import shared_path

NONE = "(none)"
HEX_DIGITS = 4
WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Mix:
    """`weights` by path in the tree, such as ("web",) or ("web", "en"); a missing one is 1."""

    budget: int | None = None  # tokens; else `share` of all tokens there are
    share: float = 1.0
    epochs: int = 1
    seed: int = 0
    weights: Mapping[tuple[str, ...], int] = field(default_factory=dict)


def word_tokens(text: Column) -> Column:
    """Words of the whole text, as the default measure of tokens."""
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("bigint")


def _weight(path: Sequence[str], mix: Mix) -> Column:
    joined = F.concat_ws("\x01", *path)
    known = [(k, v) for k, v in mix.weights.items() if len(k) == len(path)]
    found = F.lit(1)
    for k, v in known:
        found = F.when(joined == "\x01".join(k), F.lit(max(int(v), 0))).otherwise(found)
    return found.cast(WIDE)


def _shared_out(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds `given`: the parent's `budget` filled up among siblings (`weight`, `most`), smallest room per weight first."""
    group = [F.lit(1), *parent] if parent else [F.lit(1)]
    order = [F.col("most").cast("double") / F.col("weight").cast("double"), F.col(name)]
    rows = Window.partitionBy(*group).orderBy(*order)
    before, after = rows.rowsBetween(Window.unboundedPreceding, -1), rows.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy(*group)
    used = F.coalesce(F.sum("most").over(before), F.lit(0)).cast(WIDE)
    left = F.sum("weight").over(after).cast(WIDE)
    # In this order those that cannot spend their share come first.
    full = F.col("most") * left <= F.greatest(F.col("budget") - used, F.lit(0).cast(WIDE)) * F.col("weight")
    marked = nodes.filter("weight > 0").withColumn("full", full)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everyone).cast(WIDE)
    open_budget = (F.col("budget") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everyone)).cast(WIDE)
    floored = marked.withColumns({"open_weight": open_weight, "open_budget": F.greatest(open_budget, F.lit(0))})
    whole = F.expr("cast((open_budget * weight) div open_weight as decimal(38,0))")
    floored = floored.withColumn("whole", F.when(F.col("full"), F.col("most")).otherwise(whole))
    rest = F.col("open_budget") - F.sum(F.when(F.col("full"), 0).otherwise(F.col("whole"))).over(everyone)
    place = F.row_number().over(Window.partitionBy(*group, "full").orderBy(name))
    one = F.when(~F.col("full") & (place <= rest), 1).otherwise(0)
    return floored.withColumn("given", F.least(F.col("most"), F.col("whole") + one).cast(WIDE)).drop(
        "full", "open_weight", "open_budget", "whole", "weight", "budget"
    )


def budgets(supply: DataFrame, tree: Sequence[str], mix: Mix) -> DataFrame:
    """(tree columns, supply, given) per leaf, from (tree columns, supply)."""
    # What a leaf without weight, or below a node without weight, holds can be spent by no one.
    barred = reduce(or_, [_weight(list(tree[:depth]), mix) <= 0 for depth in range(1, len(tree) + 1)])
    most = F.when(barred, F.lit(0)).otherwise(F.col("supply") * mix.epochs)
    leaves = supply.withColumn("most", most.cast(WIDE))
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("all"))
    asked = F.lit(mix.budget) if mix.budget is not None else F.floor(F.col("all") * F.lit(mix.share))
    given = total.select(asked.cast(WIDE).alias("budget"))
    parent: list[str] = []
    for depth, name in enumerate(tree, 1):
        path = list(tree[:depth])
        nodes = leaves.groupBy(*path).agg(F.sum("most").cast(WIDE).alias("most"))
        nodes = nodes.withColumn("weight", _weight(path, mix))
        # The root has one row; below it, a node meets its parent's row.
        joined = nodes.join(given, parent) if parent else nodes.join(given, F.lit(True))
        given = _shared_out(joined, parent, name).select(*path, F.col("given").alias("budget"))
        parent = path
    return supply.join(given, list(tree)).withColumnRenamed("budget", "given")


def mix_sources(
    docs: DataFrame,
    tree: Mapping[str, Column],
    mix: Mix,
    tokens: Column | None = None,
    doc_id: str = "doc_id",
    folder: str | None = None,
) -> DataFrame:
    """The chosen rows of `docs`, one per epoch that takes them, with `epoch` (from 0) and `n_tokens`.

    `tree` names the levels from the root down. `folder`: a new folder below the shared one for sums and cuts.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "mixing")
    own = [c for c in docs.columns if c not in ("epoch", "n_tokens")]
    levels = [f"m_{name}" for name in tree]
    measured = F.coalesce(tokens if tokens is not None else word_tokens(F.col("text")), F.lit(0)).cast("bigint")
    leaf_of = {f"m_{k}": F.coalesce(v.cast("string"), F.lit(NONE)) for k, v in tree.items()}
    # The caller's row is one struct, so that no name of its columns meets a working name.
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc")
    ident = F.col(f"`{doc_id}`").alias("id")
    keyed = docs.select(row, ident, measured.alias("n_tokens"), *[c.alias(name) for name, c in leaf_of.items()])

    def order_key(epoch: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.col("id").cast("string")))

    supply_path, cut_path = f"{folder}/supply", f"{folder}/cuts"
    keyed.groupBy(*levels).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("rows")).filter(
        "supply > 0"
    ).write.parquet(supply_path)
    given = budgets(spark.read.parquet(supply_path).drop("rows"), levels, mix).select(
        *levels,
        F.expr("cast(given div supply as bigint)").alias("whole"),
        F.expr("cast(given % supply as bigint)").alias("part"),
    )
    given.write.parquet(f"{folder}/given")
    given = spark.read.parquet(f"{folder}/given")
    # A small table of written size: Spark sees that size before it plans the joins with the documents.
    bucket = F.substring("key", 1, HEX_DIGITS)
    ordered = keyed.join(given, levels).withColumn("key", order_key(F.col("whole"))).withColumn("bucket", bucket)
    sums = (
        ordered.filter("part > 0")
        .groupBy(*levels, "bucket", "part")
        .agg(F.sum("n_tokens").alias("n"))
        .withColumn(
            "upto",
            F.sum("n").over(Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)),
        )
    )
    cuts = (
        sums.filter("upto > part")
        .groupBy(*levels)
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("used"))).alias("c"))
        .select(*levels, F.col("c.bucket").alias("cut"), F.col("c.used").alias("used"))
    )
    given.join(cuts, levels, "left").write.parquet(cut_path)
    marked = (
        keyed.join(spark.read.parquet(cut_path), levels)
        .withColumn("key", order_key(F.col("whole")))
        .withColumn("bucket", bucket)
        .filter("n_tokens > 0")
    )
    here = F.col("bucket") == F.col("cut")
    sure = marked.filter(F.col("cut").isNull() | ~here).withColumn(
        "times", F.col("whole") + ((F.col("part") > 0) & (F.col("bucket") < F.col("cut"))).cast("bigint")
    )
    running = F.sum("n_tokens").over(
        Window.partitionBy(*levels)
        .orderBy("key", "id", "n_tokens")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    last = (
        marked.filter(here)
        .withColumn("upto", running)
        .withColumn("times", F.col("whole") + (F.col("used") + F.col("upto") <= F.col("part")).cast("bigint"))
        .drop("upto")
    )
    taken = sure.unionByName(last).filter("times > 0")
    epochs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)).alias("epoch")
    return taken.select(*[F.col("doc").getField(c).alias(c) for c in own], "n_tokens", epochs)
