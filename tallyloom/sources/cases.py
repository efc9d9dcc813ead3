"""Case data: nested Parquet rows, manifest-listed files, JSON string columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.schema import NATIVE_CASE
from tallyloom.sources.definitions import plain
from tallyloom.validation.checks import raise_on, split_rows


def read_cases(spark: SparkSession, paths: str | list[str], split: str):
    """(rows of the split, violations for rows of another split)."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.schema(NATIVE_CASE).parquet(*listed)
    return rows.where(F.col("split") == split), split_rows(rows, split)


def manifest_files(manifest: DataFrame) -> DataFrame:
    """(dataset, split, cases, file) from entries with a `data_files` array."""
    return manifest.select(
        "dataset", "split", "cases", F.explode("data_files").alias("file")
    )


def read_manifest(
    spark: SparkSession, root: str, manifest: DataFrame, schema: T.StructType = NATIVE_CASE
) -> DataFrame:
    """All rows of the files a manifest lists, each with its (dataset, split).

    Only listed files are opened; what else lies in the folder may be of any kind. Their names pass through the driver,
    as Spark's own listing of a scan does. A listed file that is not there is an error.
    """
    files = manifest_files(manifest)
    base = root.rstrip("/")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    known = there.select(F.element_at(F.split("path", base + "/"), -1).alias("file"))
    missing = files.join(known, "file", "left_anti").select(
        F.lit("release file").alias("check"), F.col("file").alias("subject"), F.lit("missing").alias("detail")
    )
    raise_on(missing)
    paths = [f"{base}/{r['file']}" for r in files.select("file").distinct().toLocalIterator()]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    if not paths:
        return rows.select("*", F.lit(None).cast("string").alias("entry_dataset"), F.lit(None).cast("string").alias("entry_split"))
    located = rows.withColumn(
        "_path", F.element_at(F.split(plain(F.col("_metadata.file_path")), base + "/"), -1)
    )
    owner = files.select(F.col("file").alias("_path"), F.col("dataset").alias("entry_dataset"),
                         F.col("split").alias("entry_split"))
    return located.join(owner, "_path").drop("_path")


def manifest_counts(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Declared against delivered case counts per (dataset, split)."""
    found = rows.groupBy("entry_dataset", "entry_split").agg(F.count(F.lit(1)).alias("delivered"))
    return (
        manifest.select("dataset", "split", F.col("cases").alias("declared"))
        .join(
            found.withColumnsRenamed({"entry_dataset": "dataset", "entry_split": "split"}),
            ["dataset", "split"],
            "left",
        )
        .withColumn("delivered", F.coalesce("delivered", F.lit(0)))
        .withColumn("matches", F.col("declared") == F.col("delivered"))
    )


def parse_json_column(rows: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Adds `parsed`; rows whose text is no such JSON keep it in `parsed._corrupt`."""
    tolerant = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(
        F.col(column), tolerant, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    return rows.withColumn("parsed", parsed)
