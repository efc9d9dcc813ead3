"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hash instead of sort joins wherever every build partition is measured to be small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# With it Spark removes a query's shuffle files when the query ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Rows of a task when a table is dealt over tasks by its size.
ROWS_PER_TASK = 200_000


def build_session(
    app: str = "tallyloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **settings: str,
) -> SparkSession:
    """A session with adaptive execution and UTC; the cluster's own settings stay in force."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a machine-local one only for a local master."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="tallyloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_root(spark), f"{purpose}-{uuid.uuid4().hex}")


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run inside are removed when it ends.

    Spark keeps them otherwise until the driver happens to collect garbage, so that those of steps long done fill the disk.
    """
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)


def drop_shuffles(rows: DataFrame) -> None:
    """Remove the shuffle files that the rows of a stream's batch came from; it cannot be read again.

    `released` does not reach them, as they belong to the stream and not to what is run on its batch.
    """
    made = rows._jdf.queryExecution().toRdd()
    made.getNumPartitions()  # the way back to the shuffles is known then
    made.cleanShuffleDependencies(True)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it again; the shuffle files of the write are removed at once."""
    spark = df.sparkSession
    with released(spark):
        df.write.parquet(path)
    return spark.read.parquet(path)


def pieces(rows: DataFrame, per_task: int = ROWS_PER_TASK) -> int:
    """How many tasks of `per_task` rows a table makes; of a stored table only the footers are read."""
    return max(1, math.ceil(rows.count() / per_task))


def dealt(rows: DataFrame, count: int, *key: str) -> DataFrame:
    """Rows over `count` partitions by key, so that a task stays small; Spark's own partitions if those are as many."""
    if count <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows
    return rows.repartition(count, *key)


def cut(df: DataFrame) -> DataFrame:
    """Store a table reliably, so that later plans read it instead of recomputing it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)
