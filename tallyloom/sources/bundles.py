"""Result bundles: one JSON document per (run, benchmark), plain or XZ-compressed."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.schema import RESULT

# Fixed value: the memory that the format grants an XZ decoder. It bounds the dictionary, not the document.
MAX_DECODER_MEMORY = 128 * 1024 * 1024


def decompress(payload: bytes, compressed: bool) -> tuple[str | None, str | None]:
    """(text, problem) of one bundle file; documents of any size are read."""
    if compressed:
        decoder = lzma.LZMADecompressor(format=lzma.FORMAT_XZ, memlimit=MAX_DECODER_MEMORY)
        try:
            payload = decoder.decompress(payload)
        except lzma.LZMAError:
            return None, "not an XZ stream"
        if not decoder.eof or decoder.unused_data:
            return None, "truncated stream or trailing data"
    try:
        return payload.decode("utf-8"), None
    except UnicodeDecodeError:
        return None, "not UTF-8"


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pairs = [
            decompress(c, p.endswith(".xz"))
            for p, c in zip(batch["path"], batch["content"], strict=True)
        ]
        yield pd.DataFrame(
            {
                "path": batch["path"],
                "text": [t for t, _ in pairs],
                "problem": [e for _, e in pairs],
            }
        )


def list_bundles(spark: SparkSession, root: str) -> DataFrame:
    """Bundle files below a folder, with whether their folder holds a metadata file."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ).select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), "length")
    name = F.element_at(F.split("path", "/"), -1)
    published = files.where(name == "metadata.json").select("folder", F.lit(True).alias("_p"))
    return (
        files.where((name != "metadata.json") & name.rlike(r"\.json(\.xz)?$"))
        .join(published, "folder", "left")
        .select("path", "folder", "length", F.coalesce("_p", F.lit(False)).alias("published"))
    )


def unpublished_archives(listed: DataFrame) -> DataFrame:
    """Compressed bundles without a sibling metadata file."""
    return listed.where(F.endswith("path", F.lit(".xz")) & ~F.col("published"))


def strict_json(text: Column) -> Column:
    """NULL for duplicate keys and for numbers JSON does not have."""
    return F.try_parse_json(text)


def read_bundles(spark: SparkSession, root: str) -> DataFrame:
    """One row per bundle file: `path`, `problem`, and the parsed `result` struct.

    Decompression is the only Python step; it works on Arrow batches of whole files that
    Spark has distributed. Parsing, duplicate-key and number checks stay in the JVM.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "content")
    )
    name = F.element_at(F.split("path", "/"), -1)
    bundles = files.where((name != "metadata.json") & name.rlike(r"\.json(\.xz)?$"))
    text = bundles.mapInPandas(_decode, "path string, text string, problem string")
    sound = strict_json(F.col("text")).isNotNull()
    problem = F.coalesce("problem", F.when(~sound, F.lit("invalid JSON")))
    result = F.when(problem.isNull(), F.from_json("text", RESULT))
    return text.select("path", problem.alias("problem"), result.alias("result"))


def bundle_problems(bundles: DataFrame) -> DataFrame:
    """Violations (check, subject, detail) of bundles that could not be read."""
    return bundles.where(F.col("problem").isNotNull()).select(
        F.lit("bundle").alias("check"), F.col("path").alias("subject"), F.col("problem").alias("detail")
    )


def _sound(bundles: DataFrame, strict: bool) -> DataFrame:
    """Bundles with a result; unless told otherwise, one with a problem ends the job with its path."""
    if not strict:
        return bundles.where(F.col("result").isNotNull())
    broken = F.raise_error(F.concat_ws(": ", "path", "problem"))
    return bundles.withColumn("result", F.when(F.col("problem").isNotNull(), broken).otherwise(F.col("result")))


def flat_results(bundles: DataFrame, strict: bool = True) -> DataFrame:
    """Summary columns of parsed bundles, without their predictions.

    `strict=False` leaves bundles with a problem out; `bundle_problems` has them.
    """
    r = "result"
    return _sound(bundles, strict).select(
        "path",
        f"{r}.run_id",
        F.col(f"{r}.benchmark.id").alias("benchmark_id"),
        F.col(f"{r}.benchmark.task").alias("task"),
        F.col(f"{r}.model.id").alias("model_id"),
        F.col(f"{r}.model.adapter").alias("adapter"),
        f"{r}.provenance",
        f"{r}.status",
        f"{r}.counts",
        f"{r}.metrics",
        f"{r}.environment",
    )


def flat_predictions(bundles: DataFrame, strict: bool = True) -> DataFrame:
    rows = _sound(bundles, strict).select(
        "result.run_id",
        F.col("result.benchmark.id").alias("benchmark_id"),
        F.explode("result.predictions").alias("p"),
    )
    return rows.select("run_id", "benchmark_id", "p.*")
