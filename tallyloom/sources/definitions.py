"""Benchmark, category, metadata and registry definitions stored as JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.schema import BENCHMARK, CATEGORY, EXPOSURE, MODEL_METADATA

REGISTRY = T.StructType(
    [
        T.StructField(
            "disclosures",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("model_ids", T.ArrayType(T.StringType())),
                        T.StructField("training_exposure", T.ArrayType(EXPOSURE)),
                    ]
                )
            ),
        )
    ]
)


def plain(path: Column) -> Column:
    """A path or name of Spark's metadata columns, which are URI-encoded, as it is written."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select("*", plain(F.col("_metadata.file_name")).alias("file_name"))


def _named(rows: DataFrame, key: str) -> DataFrame:
    wanted = F.concat(F.col(key), F.lit(".json"))
    return rows.withColumn("name_matches", F.col("file_name") == wanted)


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """Definitions with `name_matches`: the file must be called `<id>.json`."""
    return _named(_read(spark, path, BENCHMARK), "id")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return _named(_read(spark, path, CATEGORY), "id")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(MODEL_METADATA).option("multiLine", True).json(path)
    folder = F.element_at(F.split(plain(F.col("_metadata.file_path")), "/"), -2)
    return rows.select("*", folder.alias("folder"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(REGISTRY).option("multiLine", True).json(path)
    return rows.select(F.explode("disclosures").alias("group")).select("group.*")
