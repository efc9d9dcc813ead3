"""Immutable results, per-model exports, snapshot generations and table exports."""

from __future__ import annotations

import lzma
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import csv_cell, markdown_cell, markdown_link
from tallyloom.operators.scoring import SORTED_KEY
from tallyloom.sources.files import CommitLog, delete
from tallyloom.validation.checks import conflicting_results, raise_on

PARTITION = ("run_id", "benchmark_id")
# Tasks that share one (run, benchmark) by default; a result with fewer rows has fewer files.
FILES_PER_RESULT = 16


def write_results(results: DataFrame, path: str, files_per_result: int = FILES_PER_RESULT) -> None:
    """Add results that do not exist yet, all or none; an existing (run, benchmark) is an error.

    The rows go to a folder of their own, where no reader looks. They become visible when their name takes the next
    number of the commit log, which exactly one writer can; another writer then compares its results with those added
    meanwhile and tries the number after that, so of two writers of one result one wins and the other gets the error.
    Rows are spread over `files_per_result` pieces per result, so that a run or benchmark holding most rows is written
    by several tasks.
    """
    spark = results.sparkSession
    base, token = path.rstrip("/"), uuid.uuid4().hex
    log = CommitLog(spark, f"{base}/_log")
    staged, keys_path = f"{base}/write={token}", f"{base}/_keys/write={token}"
    try:
        _in_pieces(results, files_per_result).write.partitionBy(*PARTITION).parquet(staged)
        stored = spark.read.schema(results.schema).parquet(staged)
        stored.select(*PARTITION).distinct().write.parquet(keys_path)
        keys = spark.read.parquet(keys_path)
        seen = 0
        while True:
            others = log.entries(seen)
            if others:
                old = spark.read.parquet(*[f"{base}/_keys/write={t}" for t in others])
                if not keys.join(old, list(PARTITION), "left_semi").isEmpty():
                    raise ValueError("Result already exists; use a new run id")
            seen += len(others)
            if log.commit(seen + 1, token):
                return
    except BaseException:
        for own in (staged, keys_path):  # never committed, so no reader has seen them
            delete(spark, own)
        raise


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All committed results; an error if there are none."""
    base = path.rstrip("/")
    tokens = CommitLog(spark, f"{base}/_log").entries()
    if not tokens:
        raise ValueError(f"No results in {base}")
    return spark.read.option("basePath", base).parquet(*[f"{base}/write={t}" for t in tokens]).drop("write")


def _in_pieces(rows: DataFrame, pieces: int) -> DataFrame:
    """One file per (partition, piece): few files, and no partition tied to one task."""
    names = [c for c in rows.columns if c not in PARTITION]
    piece = F.pmod(F.xxhash64(F.to_json(F.struct(*names))), F.lit(pieces))
    return rows.withColumn("_piece", piece).repartition(*PARTITION, "_piece").drop("_piece")


def export_results(
    results: DataFrame, path: str, content: list[str], files_per_result: int = FILES_PER_RESULT
) -> None:
    """Add or replace the supplied (model, benchmark) parts and keep all others.

    Two different results for one part are an error; identical ones collapse.
    """
    raise_on(conflicting_results(results, content))
    (
        _in_pieces(results.distinct(), files_per_result)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITION)
        .parquet(path)
    )


def publish_snapshot(
    results: DataFrame, root: str, snapshot_id: str, violations: DataFrame
) -> int:
    """Validate, then write a generation, and only then point to it; returns the pointer's number.

    A pointer is a numbered file that one publisher creates; who comes second takes the next number, so two never share
    one and the later of them is current. A rejected id leaves nothing behind and can be used again. Earlier generations
    stay where they are, so readers that resolved an older pointer keep working.
    """
    base = root.rstrip("/")
    raise_on(violations)
    results.write.mode("errorifexists").parquet(f"{base}/generations/snapshot_id={snapshot_id}")
    log = CommitLog(results.sparkSession, f"{base}/pointers")
    number = log.newest() + 1
    while not log.commit(number, snapshot_id):
        number += 1
    return number


def current_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The generation the newest pointer names."""
    base = root.rstrip("/")
    log = CommitLog(spark, f"{base}/pointers")
    return spark.read.parquet(f"{base}/generations/snapshot_id={log.entry(log.newest())}")


def write_documents(rows: DataFrame, root: str, name: str, content: str) -> DataFrame:
    """Write one document per row to `root/<name>`; returns (name, bytes) when run.

    Names ending in `.xz` are compressed. A file appears under its name only when whole, and
    a retried task writes the same bytes again.
    """
    base = root.rstrip("/")

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = fs.FileSystem.from_uri(base if "://" in base else f"file://{base}")
        for batch in batches:
            sizes = []
            for file, text in zip(batch["name"], batch["content"], strict=True):
                payload = text.encode("utf-8")
                if file.endswith(".xz"):
                    payload = lzma.compress(payload)
                target = f"{folder}/{file}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                staged = f"{target}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(staged) as out:
                    out.write(payload)
                store.move(staged, target)
                sizes.append(len(payload))
            yield pd.DataFrame({"name": batch["name"], "bytes": sizes})

    picked = rows.select(F.col(name).alias("name"), F.col(content).alias("content"))
    return picked.mapInPandas(save, "name string, bytes long")


def write_bundles(bundles: DataFrame, root: str, compressed: bool = True) -> None:
    """Result structs as `<run_id>/<benchmark id>.json[.xz]`, one file each."""
    suffix = ".json.xz" if compressed else ".json"
    rows = bundles.select(
        F.concat(
            F.col("result.run_id"), F.lit("/"), F.col("result.benchmark.id"), F.lit(suffix)
        ).alias("name"),
        F.to_json("result", {"ignoreNullFields": "false"}).alias("content"),
    )
    write_documents(rows, root, "name", "content").write.format("noop").mode("overwrite").save()


def csv_lines(table: DataFrame, columns: list[str]) -> DataFrame:
    """Every cell quoted and made safe for spreadsheets; `url` and `huggingface` come last."""
    cells = [
        csv_cell(F.coalesce(F.col(c).cast("string"), F.lit("")))
        for c in [*columns, "url", "huggingface"]
    ]
    rest = [c for c in table.columns if c not in {*columns, "url", "huggingface"}]
    return table.select(*rest, F.concat_ws(",", *cells).alias("line"))


def csv_header(columns: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' for c in [*columns, "url", "huggingface"])


def _document(heads: list[str], lines: DataFrame, order: list[str]) -> DataFrame:
    """Head lines and table lines with a common order: (place, order columns, line)."""
    spark = lines.sparkSession
    types = dict(lines.dtypes)
    keys = [f"k{i}" for i in range(len(order))]
    body = lines.select(F.lit(len(heads)).alias("place"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], "line")
    head = spark.createDataFrame(list(enumerate(heads)), "place int, line string")
    empty = [F.lit(None).cast(types[c]).alias(k) for c, k in zip(order, keys, strict=True)]
    return head.select("place", *empty, "line").unionByName(body)


def write_csv(table: DataFrame, columns: list[str], order: list[str], path: str) -> None:
    """A whole CSV document: header line, then the rows by `order`, each line ended by CRLF."""
    document = _document([csv_header(columns)], csv_lines(table, columns), order)
    write_lines(document, [c for c in document.columns if c != "line"], path, "\r\n")


def write_markdown(table: DataFrame, columns: list[str], order: list[str], path: str) -> None:
    """A whole Markdown table: header, separator row, then the rows by `order`."""
    heads = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    document = _document(heads, markdown_lines(table, columns), order)
    write_lines(document, [c for c in document.columns if c != "line"], path)


def markdown_lines(table: DataFrame, columns: list[str], linked: str = "Model") -> DataFrame:
    def cell(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        if name == linked:
            return markdown_link(value, F.col("url"), F.col("huggingface"))
        return markdown_cell(value)

    rest = [c for c in table.columns if c not in {*columns, "url", "huggingface"}]
    body = F.concat_ws(" | ", *[cell(c) for c in columns])
    return table.select(*rest, F.concat(F.lit("| "), body, F.lit(" |")).alias("line"))


def write_lines(lines: DataFrame, order: list[str], path: str, separator: str = "\n") -> None:
    """Ordered text output; the global sort is a range partitioning, not one task."""
    (
        lines.orderBy(*order)
        .select("line")
        .write.mode("errorifexists")
        .option("lineSep", separator)
        .text(path)
    )


def save_colocated(table: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """A table bucketed and sorted on the decision key, and read back; `path` keeps it out of the warehouse folder.

    Decisions and predictions stored with the same number of buckets are joined, and their keys counted, without a
    shuffle of either.
    """
    key = SORTED_KEY
    writer = table.repartition(buckets, *key).write.mode("errorifexists").bucketBy(buckets, *key).sortBy(*key)
    (writer if path is None else writer.option("path", path)).saveAsTable(name)
    return table.sparkSession.table(name)
