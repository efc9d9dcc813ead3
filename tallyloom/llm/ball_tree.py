"""Exact top-k inner-product search: one ball tree per shard, branch and bound in blocks of queries.

Vectors are dealt to shards of a bounded size and queries to blocks of a bounded size; each (shard, block) pair is one
group, so a task holds one shard and one block. A node's inner products with q are at most q.c + |q| r. Nodes are
opened in the order of that bound; a node below the query's current kth score is left closed. Shards are searched in
rounds, each of eight times as many as before; the kth score of all rounds so far goes along with the queries.

Defined results: vectors that are null, hold null or non-finite components, or have a null id take no part, nor do
empty ones. A query meets only vectors of its own length, and no row with its own id. Of queries with equal ids the
one with the smallest vector counts; repeated candidate rows count each. Fewer than k candidates give them all.
Equal scores go to the smaller id. Empty tables give an empty result. Scores are exact 64-bit integers and must fit
one, as must all partial sums; components are whole numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import shared_path

SHARD_ROWS = 8192
BLOCK_ROWS = 4096
LEAF_ROWS = 64
ROUND_GROWTH = 8
EXACT = float(2**53)
NONE = np.iinfo(np.int64).min  # below all scores


@dataclass
class Tree:
    """Nodes in breadth-first order; `rows` is ordered so that each node owns a range."""

    points: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    child: np.ndarray  # index of the first of two children, or -1


def build_tree(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
    """Halve at the median along the line between two far points until `leaf` rows are left."""
    order = np.arange(len(points))
    spans, child, centers, radii = [(0, len(points))], [], [], []
    i = 0
    while i < len(spans):
        a, b = spans[i]
        own = points[order[a:b]]
        center = own.mean(axis=0)
        away = ((own - center) ** 2).sum(axis=1)
        centers.append(center)
        radii.append(math.sqrt(away.max()))
        if b - a > leaf and radii[-1] > 0:
            one = own[away.argmax()]
            two = own[((own - one) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own @ (two - one), half)]
            child.append(len(spans))
            spans += [(a, a + half), (a + half, b)]
        else:
            child.append(-1)
        i += 1
    start, stop = np.array(spans).T
    return Tree(points[order], ids[order], start, stop, np.array(centers), np.array(radii), np.array(child))


class Search:
    """Branch and bound of a block of queries over one tree."""

    def __init__(self, tree: Tree, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
        self.tree, self.queries, self.own, self.k = tree, queries, own, k
        self.norm = np.sqrt((queries**2).sum(axis=1))
        self.score = np.full((len(queries), k), NONE)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.kth = floor.copy()
        most = np.abs(queries).max(initial=0) * np.abs(tree.points).max(initial=0) * queries.shape[1]
        # Sums of integers below 2^53 are exact in doubles, in any order.
        self.exact = most < EXACT
        self.scale = np.sqrt((tree.center**2).sum(axis=1)) + tree.radius

    def bound(self, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        t = self.tree
        at = np.einsum("ij,ij->i", self.queries[q], t.center[node]) + self.norm[q] * t.radius[node]
        return at + 1e-9 * self.norm[q] * self.scale[node] + 1e-6  # above all rounding of the bound itself

    def scan(self, q: np.ndarray, leaf: int) -> None:
        """Score all rows of a leaf against the queries q and keep each one's k best."""
        t = self.tree
        rows = slice(t.start[leaf], t.stop[leaf])
        if self.exact:
            score = (self.queries[q] @ t.points[rows].T).astype(np.int64)
        else:
            score = self.queries[q].astype(np.int64) @ t.points[rows].T.astype(np.int64)
        ids = np.broadcast_to(t.ids[rows], score.shape)
        score = np.where((ids == self.own[q][:, None]) | (score < self.kth[q][:, None]), NONE, score)
        hit = np.flatnonzero((score > NONE).any(axis=1))
        if not len(hit):
            return
        q = q[hit]
        score = np.hstack([self.score[q], score[hit]])
        ids = np.hstack([self.found[q], ids[hit]])
        best = np.lexsort((ids, ~score), axis=1)[:, : self.k]
        self.score[q] = np.take_along_axis(score, best, 1)
        self.found[q] = np.take_along_axis(ids, best, 1)
        self.kth[q] = np.maximum(self.kth[q], self.score[q][:, -1])

    def scan_pairs(self, q: np.ndarray, leaf: np.ndarray) -> None:
        order = np.argsort(leaf, kind="stable")
        q, leaf = q[order], leaf[order]
        cuts = np.flatnonzero(np.diff(leaf)) + 1
        for part, first in zip(np.split(q, cuts), leaf[np.r_[0, cuts]] if len(leaf) else [], strict=True):
            self.scan(part, first)

    def run(self) -> Search:
        t, everyone = self.tree, np.arange(len(self.queries))
        # Straight down to the most promising leaf, for a first kth score.
        node = np.zeros(len(everyone), np.int64)
        while (inner := np.flatnonzero(t.child[node] >= 0)).size:
            left = t.child[node[inner]]
            node[inner] = left + (self.bound(inner, left + 1) > self.bound(inner, left))
        first = node.copy()
        self.scan_pairs(everyone, node)
        # Open what can still hold one of the k best, level by level.
        q, node = everyone, np.zeros(len(everyone), np.int64)
        leaves: list[tuple[np.ndarray, ...]] = []
        while len(q):
            upper = self.bound(q, node)
            keep = upper >= self.kth[q]
            q, node, upper = q[keep], node[keep], upper[keep]
            end = t.child[node] < 0
            fresh = end & (node != first[q])
            leaves.append((q[fresh], node[fresh], upper[fresh]))
            q, node = np.repeat(q[~end], 2), (t.child[node[~end]][:, None] + [0, 1]).ravel()
        q, node, upper = (np.concatenate(x) for x in zip(*leaves, strict=True))
        # Each query's leaves by falling bound, some more per round.
        order = np.lexsort((-upper, q))
        q, node, upper = q[order], node[order], upper[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        done, step = 0, 1
        while len(q):
            now = (place < done + step) & (upper >= self.kth[q])
            self.scan_pairs(q[now], node[now])
            later = (place >= done + step) & (upper >= self.kth[q])
            q, node, upper, place = q[later], node[later], upper[later], place[later]
            done, step = done + step, step * 2
        return self


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def quantised(table: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """Replaces `vector` by floor(scale * x); rows with null or non-finite components are left out."""
    x = F.col(f"`{vector}`")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return table.filter(x.isNotNull() & (F.size(x) > 0) & sound).withColumn(
        vector, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    )


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score) for tables of (id bigint, vector array<double> of integers)."""
    points = vectors.filter("id is not null").select("id", "vector", F.size("vector").alias("dim"))
    asked = (
        queries.filter("id is not null")
        .select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
        .groupBy("query_id")
        .agg(F.min("q").alias("q"))
        .withColumn("dim", F.size("q"))
    )
    shards = max(1, math.ceil(points.count() / shard_rows))
    blocks = max(1, math.ceil(asked.count() / block_rows))
    points = points.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)))
    keys, schema = ["shard", "block", "dim"], "query_id bigint, vec_id bigint, score bigint"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        tree = build_tree(_matrix(left["vector"]), left["id"].to_numpy())
        own = right["query_id"].to_numpy()
        result = Search(tree, _matrix(right["q"]), own, right["floor"].to_numpy(), k).run()
        q, slot = np.nonzero(result.score > NONE)
        return pa.table(
            {
                "query_id": pa.array(own[q], pa.int64()),
                "vec_id": pa.array(result.found[q, slot], pa.int64()),
                "score": pa.array(result.score[q, slot], pa.int64()),
            }
        )

    def over(some_points: DataFrame, some_queries: DataFrame) -> DataFrame:
        return (
            some_points.groupBy(*keys).cogroup(some_queries.groupBy(*keys)).applyInArrow(search, schema)
        )

    folder = shared_path(vectors.sparkSession, "top-k")
    every_block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    done, found = 0, None
    for number, stop in enumerate(rounds(shards)):
        floor = F.lit(NONE)
        now = asked
        if found is not None:
            kth = found.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") >= k)
            now, floor = asked.join(kth.drop("n"), "query_id", "left"), F.coalesce("kth", floor)
        these = F.explode(F.sequence(F.lit(done).cast("bigint"), F.lit(stop - 1).cast("bigint"))).alias("shard")
        part = over(
            points.filter(F.col("shard").between(done, stop - 1)).select("*", every_block),
            now.select("query_id", "dim", "q", "block", these, floor.alias("floor")),
        )
        found = part if found is None else found.drop("rank").unionByName(part)
        found = found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
        done = stop
        if done < shards:
            found.write.parquet(f"{folder}/{number}")
            found = vectors.sparkSession.read.parquet(f"{folder}/{number}")
    return found


def rounds(shards: int) -> list[int]:
    """Where each round of shards ends: after 1, 1 + 8, 1 + 8 + 64 of them and so on, and after the last."""
    ends, size = [1], ROUND_GROWTH
    while ends[-1] < shards:
        ends.append(min(ends[-1] + size, shards))
        size *= ROUND_GROWTH
    return ends
