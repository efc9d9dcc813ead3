"""Connected components of a link table by alternating large and small stars.

Each task first replaces its links by a forest of stars. Then every node hands its larger neighbours to its smallest
neighbour (large star) and its smaller ones as well (small star), until nothing changes; the rounds grow with the
logarithm of the components' size. Each round is written to the shared folder, so no lineage and no driver memory
grows. Results: one row (node, label) per linked node, label being the smallest node of its component. Null links and
links of a node with itself count as none; repeated links count once; no links give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import written

TASK_LINKS = 1 << 20


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, some at a time, as (node, smallest node they lead to)."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = index[: len(a)], index[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, root[y], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        moved = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) > TASK_LINKS:
            yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
    if held:
        yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, label) from the first two columns of `links`, integers; `folder` is a new one below the shared folder."""
    a, b = (F.col(f"`{c}`").cast("bigint") for c in links.columns[:2])
    edges = links.select(a.alias("a"), b.alias("b")).filter("a <> b").mapInArrow(_forest, "a bigint, b bigint")
    edges = written(edges, f"{folder}/0")
    before = None
    for step in range(1, 100):
        # Large star: both directions, the larger neighbours of v go to the smallest of v and its neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Small star: v and its smaller neighbours go to the smallest of them.
        down = large.filter("a > b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b")
        new = small.unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        edges = written(new, f"{folder}/{step}")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
