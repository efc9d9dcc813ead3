"""Content-addressed blobs and checksum manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.validation.checks import _found, first_problem


def verify_blobs(blobs: DataFrame, content: str, digest: str, declared: int | None = None):
    """Violations: wrong digest, digest delivered twice, total differing from the declared one."""
    wrong = ~F.sha2(F.col(content), 256).eqNullSafe(F.col(digest))
    bad = _found(blobs, "blob", [digest], first_problem(("digest differs", wrong)))
    repeated = blobs.groupBy(digest).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    out = bad.unionByName(_found(repeated, "blob", [digest], F.lit("duplicate")))
    if declared is not None:
        total = blobs.agg(F.count(F.lit(1)).alias("n"))
        short = F.col("n") != declared
        out = out.unionByName(_found(total, "blob", ["n"], first_problem(("count differs", short))))
    return out


def is_unsafe_path(path: Column) -> Column:
    """Absolute, or climbing out of the release."""
    return F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")


def verify_release(spark: SparkSession, root: str, checksums: DataFrame) -> DataFrame:
    """Files below `root` against (path, sha256): differing, missing, unlisted, unsafe."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = files.select(
        F.element_at(F.split("path", base), -1).alias("path"),
        F.sha2("content", 256).alias("found"),
    )
    both = checksums.select("path", F.col("sha256").alias("listed")).join(found, "path", "full")
    return _found(
        both,
        "release file",
        ["path"],
        first_problem(
            ("unsafe path", is_unsafe_path(F.col("path")) & F.col("listed").isNotNull()),
            ("missing", F.col("found").isNull()),
            ("unlisted", F.col("listed").isNull()),
            ("checksum differs", F.col("found") != F.col("listed")),
        ),
    )


def subset_owner(subsets: DataFrame, receipts: DataFrame) -> DataFrame:
    """The source receipt of each subset, or the single unscoped receipt as a fallback.

    `receipts` has source, and `subsets` (array, NULL when unscoped). Two owners give the
    owner count 2 and no source.
    """
    owners = (
        receipts.where(F.col("subsets").isNotNull())
        .select("source", F.explode("subsets").alias("subset"))
        .groupBy("subset")
        .agg(F.count(F.lit(1)).alias("owners"), F.min("source").alias("owner"))
    )
    # One value for all subsets, so it needs no join.
    unscoped = receipts.where(F.col("subsets").isNull()).agg(F.count(F.lit(1)), F.min("source")).first()
    fallback = F.lit(unscoped[1] if unscoped[0] == 1 else None).cast("string")
    return subsets.join(owners, "subset", "left").select(
        "subset",
        F.coalesce("owners", F.lit(0)).alias("owners"),
        F.when(F.col("owners") == 1, F.col("owner")).when(F.col("owners").isNull(), fallback).alias("source"),
    )
