"""Incremental prediction ingest and live outcome counts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyloom.schema import PREDICTION
from tallyloom.session import drop_shuffles
from tallyloom.sources.files import delete, exists, names

KEY = ("run_id", "benchmark_id", "case_id", "question_id")
GRAIN = ("run_id", "benchmark_id")
ARRIVED = "arrived_at"

ARRIVING = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("benchmark_id", T.StringType()),
        *PREDICTION.fields,
        T.StructField(ARRIVED, T.TimestampType()),
    ]
)
# Seen keys live in RocksDB on the executors' disks; a batch writes only its own changes to the checkpoint.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
}
# Rows that a task takes on before it drops copies among them.
HELD_ROWS = 100_000
# Batches of live counts between two compactions.
COMPACT_EVERY = 16


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that a query takes over when it starts."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _first_of_each_key(rows: pa.Table) -> pa.Table:
    """Per key the earliest arrival, and of equal ones the smallest content."""
    order = [(k, "ascending") for k in (*KEY, ARRIVED, "_content")]
    at = pc.sort_indices(rows.select([n for n, _ in order]), sort_keys=order, null_placement="at_end")
    keys = rows.select(list(KEY)).take(at)
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in KEY:
        codes = keys[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return rows.take(at.filter(pa.array(new)))


def _without_content(rows: pa.Table) -> list[pa.RecordBatch]:
    return _first_of_each_key(rows).drop_columns("_content").to_batches()


def _copies_removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of each Arrow batch, so that a key with most rows is small before the shuffle."""
    for batch in batches:
        if batch.num_rows:
            yield from _without_content(pa.Table.from_batches([batch]))


def _one_per_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of a task; it holds its keys, not their copies."""
    held: list[pa.RecordBatch] = []
    size = kept = 0
    for batch in batches:
        if batch.num_rows:
            held, size = [*held, batch], size + batch.num_rows
            if size > 2 * kept + HELD_ROWS:
                held = _first_of_each_key(pa.Table.from_batches(held)).to_batches()
                size = kept = sum(b.num_rows for b in held)
    if held:
        yield from _without_content(pa.Table.from_batches(held))


def arriving_predictions(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """A stream over the Parquet files that land in `path`."""
    reader = spark.readStream.schema(ARRIVING)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ingest(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Append new predictions to a Parquet table, then stop when the input is used up.

    Of the rows of one key the first batch's stays; inside a batch the earliest `arrived_at` (null last) counts, and of
    equal ones the smallest content as JSON text, so a replay stores the same row. A row that comes late is taken and a
    copy is not, whenever either arrives. The keys seen so far are state of the stream: a batch looks up and adds its own
    keys only and never reads the target. Each batch owns a folder and overwrites it when it is replayed.
    """
    fields = [f.name for f in ARRIVING.fields]
    content = F.to_json(F.struct(*[f for f in fields if f not in (*KEY, ARRIVED)]), {"ignoreNullFields": "false"})
    arriving = arriving_predictions(spark, source, files_per_trigger)

    def settled(rows: DataFrame, keep) -> DataFrame:
        """Rows by `keep`, which sees their content; it is made where it is needed and not shuffled."""
        return rows.withColumn("_content", content).mapInArrow(keep, rows.schema)

    # One row of a key per batch, so which one the state lets through does not depend on the order of rows.
    single = settled(settled(arriving, _copies_removed).repartition(*KEY), _one_per_key)
    new = single.dropDuplicates(list(KEY)).select(*fields)
    cores = spark.sparkContext.defaultParallelism

    def save(batch: DataFrame, batch_id: int) -> None:
        # The state has many partitions for its keys' sake; as many files would be many batches of whoever reads them.
        # A task takes several of them as they are, without a shuffle.
        batch.coalesce(cores).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        drop_shuffles(batch)

    with _settings(spark, STATE):
        return (
            new.writeStream.outputMode("append")
            .foreachBatch(save)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def outcome_counts(stream: DataFrame) -> DataFrame:
    answered = F.col("probabilities").isNotNull() | F.col("box").isNotNull()
    return stream.groupBy(*GRAIN).agg(
        F.count(F.lit(1)).alias("recorded"),
        F.count_if(answered).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count_if(F.col("abstention").isNotNull()).alias("abstained"),
    )


def live_counts(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Running counts of a stream that holds one row per decision (see `ingest`).

    Each batch writes the rows that changed under its own batch id and replaces that batch
    when it is replayed, so a lost executor or a restart cannot count anything twice. Every
    COMPACT_EVERY batches they are merged into a snapshot.
    """
    counts = outcome_counts(arriving_predictions(spark, source, files_per_trigger))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        drop_shuffles(batch)
        if (batch_id + 1) % COMPACT_EVERY == 0:
            compact_counts(batch.sparkSession, target, batch_id)

    with _settings(spark, STATE):
        return (
            counts.writeStream.outputMode("update")
            .foreachBatch(save)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def _folders(spark: SparkSession, target: str, kind: str) -> list[int]:
    found = [n.partition("=") for n in names(spark, target)]
    return sorted(int(number) for name, _, number in found if name == kind)


def _updates(spark: SparkSession, target: str, upto: int | None = None, before: int | None = None) -> DataFrame:
    """Rows of the newest whole snapshot (older than `before`) and of the batches after it (up to `upto`)."""
    whole = [
        s
        for s in _folders(spark, target, "snapshot")
        if (before is None or s < before) and exists(spark, f"{target}/snapshot={s}/_SUCCESS")
    ]
    start = whole[-1] if whole else -1
    tail = [b for b in _folders(spark, target, "batch") if b > start and (upto is None or b <= upto)]
    parts = [spark.read.parquet(f"{target}/snapshot={start}")] if whole else []
    if tail:
        parts.append(spark.read.option("basePath", target).parquet(*[f"{target}/batch={b}" for b in tail]))
    if not parts:
        raise ValueError(f"No counts in {target}")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    fields = F.struct("recorded", "succeeded", "failed", "abstained", "batch")
    return rows.groupBy(*GRAIN).agg(F.max_by(fields, "batch").alias("c")).select(*GRAIN, "c.*")


def compact_counts(spark: SparkSession, target: str, batch_id: int) -> None:
    """Merge the last snapshot and the batches up to `batch_id` into a snapshot of that number.

    What it was made from stays until the next one is whole: a replay of this batch can make it again, and a reader
    that has listed the folders can go on.
    """
    older = [s for s in _folders(spark, target, "snapshot") if s < batch_id]
    _updates(spark, target, batch_id, before=batch_id).write.mode("overwrite").parquet(f"{target}/snapshot={batch_id}")
    if older:
        gone = [f"snapshot={s}" for s in older[:-1]]
        gone += [f"batch={b}" for b in _folders(spark, target, "batch") if b <= older[-1]]
        for folder in gone:
            delete(spark, f"{target}/{folder}")


def latest_counts(spark: SparkSession, target: str, benchmarks: DataFrame) -> DataFrame:
    """The newest row per (run, benchmark), with coverage against the definition.

    Reads a snapshot and fewer than 2 * COMPACT_EVERY batches, however long the stream runs.
    """
    newest = _updates(spark, target).drop("batch")
    expected = benchmarks.select(
        F.col("id").alias("benchmark_id"), F.col("decision_count").alias("expected")
    )
    return newest.join(expected, "benchmark_id").withColumn(
        "coverage", F.col("recorded") / F.col("expected")
    )
