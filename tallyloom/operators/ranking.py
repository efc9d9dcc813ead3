"""Ranks and positions that never order a whole group inside one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    amount: Column,
    name: str,
    partitions: int | None = None,
) -> DataFrame:
    """Adds the sum of `amount` over the rows before this one in its group's total order.

    The rows are range-partitioned on (group, order) and stored, so that the piece number
    becomes data. A row's total is the one inside its own piece plus those of the group's
    earlier pieces. Pieces are cut by sampled quantiles: no task holds more than a piece, even
    if one group is everything and whatever the distribution of its values.
    """
    keys = list(keys)
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = cut(
        df.repartitionByRange(partitions, *keys, *order).select(
            "*", amount.alias("_amount"), F.spark_partition_id().alias("_piece")
        )
    )
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy(*keys, "_piece")
        .agg(F.sum("_amount").alias("_size"))
        .select(*keys, "_piece", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = (
        Window.partitionBy(*keys, "_piece")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        pieces.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_piece"])
        .select(*df.columns, (F.col("_before") + F.col("_inside")).cast("bigint").alias(name))
    )


def is_finite(value: str) -> Column:
    number = F.col(value)
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))


def tie_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    descending: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """(keys, value, ties, rank): competition rank of each distinct value within its group.

    Ties collapse before the shuffle; the rank is one more than the rows with better values.
    NULL and non-finite values have no rank.
    """
    ties = df.where(is_finite(value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    ahead = running_totals(ties, keys, [order], F.col("ties"), "rank", partitions)
    return ahead.withColumn("rank", F.col("rank") + 1)


def with_rank(
    df: DataFrame, keys: Sequence[str], value: str, *, descending: bool = True, name: str = "rank"
) -> DataFrame:
    """Competition rank (1, 1, 3) as a column; rows without a finite value keep NULL."""
    ranks = tie_ranks(df, keys, value, descending=descending).withColumnRenamed("rank", name)
    # Rows without a rank stay out of the join, where they would all share one key.
    ranked = df.where(is_finite(value)).join(ranks.drop("ties"), [*keys, value], "left")
    rest = df.where(~is_finite(value)).withColumn(name, F.lit(None).cast("bigint"))
    return ranked.unionByName(rest)


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    name: str = "position",
    partitions: int | None = None,
) -> DataFrame:
    """One-based position within each group under a total order."""
    before = running_totals(df, keys, order, F.lit(1).cast("bigint"), name, partitions)
    return before.withColumn(name, F.col(name) + 1)
