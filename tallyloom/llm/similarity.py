"""From index groups to components: what set and edit joins have in common.

Rows (key, node, info) say that a node's signature `key` was made; info is size << 1 | exact. Nodes with a common key,
of which one is exact, may be linked. Pairs of small groups are verified directly. Members of larger groups are
compared by sketches that never overstate the difference, and only a spanning forest of each group's possible links is
verified; a group in which a link of the forest proves false has its other possible links between different components
verified as well. So no link is lost, and no group's pairs are all written out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow import mixed, ranges, whole_groups
from tallyloom.llm.components import components
from tallyloom.session import written

SMALL_GROUP = 8
TILE = 2048
WIDE = 4096  # members whose distances are held all at once (32 MB)


@dataclass(frozen=True)
class Join:
    """The rules of a join.

    fits(info, info): sizes in reach of each other and one side exact; most(size, size): largest sketch distance of a
    link, for arrays and for columns; verify: Arrow function over (x, y, doc, text) sorted by (x, y), two rows a pair;
    sketch: a string array -> one row of `words` 64-bit words (as bytes) for each text.
    """

    fits: Callable[[np.ndarray, np.ndarray], np.ndarray]
    most: Callable
    verify: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    sketch: Callable[[pa.Array], np.ndarray]
    words: int  # 64-bit words of a sketch
    small_group: int = SMALL_GROUP


def frequent_keys(rows: DataFrame, sample: int, parts: int, tile: int = TILE) -> dict[int, int]:
    """Keys of a sample of index rows that would fill more than a tile -> number of tiles.

    Beyond the 8 most frequent keys per partition, none can have more than an eighth of a partition's share.
    """
    often = rows.groupBy("key").count().filter(F.col("count") * sample > tile).orderBy(F.desc("count"), "key")
    return {r["key"]: -(-r["count"] * sample // tile) for r in often.limit(8 * parts).collect()}


class Tiles:
    """Replaces a frequent key by one key per pair of tiles; a node goes to all pairs with its own tile."""

    def __init__(self, tiles: dict[int, int]):
        self.hot = np.sort(np.array(list(tiles), np.int64).view(np.uint64))
        self.count = np.array([tiles[int(k)] for k in self.hot.view(np.int64)], np.int64)

    def deal(self, key: np.ndarray, node: np.ndarray, info: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(self.hot):
            return key, node, info
        at = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
        is_hot = self.hot[at] == key
        k, o, i, n = key[is_hot], node[is_hot], info[is_hot], self.count[at[is_hot]]
        each = np.repeat(np.arange(len(k)), n)
        mine = (mixed(o) % n.astype(np.uint64)).astype(np.int64)[each]
        other = ranges(np.zeros(len(n), np.int64), n)
        pair = (np.minimum(mine, other) << 24 | np.maximum(mine, other)).astype(np.uint64)
        return (
            np.concatenate([key[~is_hot], mixed(k[each] ^ mixed(pair + np.uint64(5)))]),
            np.concatenate([node[~is_hot], o[each]]),
            np.concatenate([info[~is_hot], i[each]]),
        )


def index_batches(key: np.ndarray, node: np.ndarray, info: np.ndarray, rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(key), rows):
        part = slice(at, at + rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[part].view(np.int64)), pa.array(node[part].view(np.int64)), pa.array(info[part])],
            ["key", "node", "info"],
        )


def _grouped(join: Join):
    """Sorted by key: pairs of small groups as (0, x, y, 0), members of larger ones as (key, node, 0, info)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "x", "y", "info"]
        for table in whole_groups(batches, ["key"], 1 << 17):
            key = table["key"].to_numpy()
            same = key[1:] == key[:-1]
            # Most keys have one row and no partner.
            some = np.flatnonzero(np.append(same, False) | np.append(False, same))
            key, node, info = key[some], table["node"].to_numpy()[some], table["info"].to_numpy()[some]
            order = np.lexsort((info, node, key))
            key, node, info = key[order], node[order], info[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (info[1:] != info[:-1])
            key, node, info = key[new], node[new], info[new]
            change = np.ones(len(key), bool)
            change[1:] = key[1:] != key[:-1]
            head = np.flatnonzero(change)
            size = np.diff(np.append(head, len(key)))
            each = np.repeat(size, size)
            large = each > join.small_group
            if large.any():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[large]),
                        pa.array(node[large]),
                        pa.array(np.zeros(large.sum(), np.int64)),
                        pa.array(info[large]),
                    ],
                    names,
                )
            small = (each > 1) & ~large
            key, node, info = key[small], node[small], info[small]
            found = []
            for step in range(1, join.small_group):
                i = np.flatnonzero(key[step:] == key[:-step]) if len(key) > step else np.zeros(0, np.int64)
                j = i + step
                good = join.fits(info[i], info[j]) & (node[i] != node[j])
                found.append(np.stack([np.minimum(node[i], node[j])[good], np.maximum(node[i], node[j])[good]], 1))
            pairs = np.unique(np.concatenate(found), axis=0)
            if len(pairs):
                zero = pa.array(np.zeros(len(pairs), np.int64))
                yield pa.RecordBatch.from_arrays([zero, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), zero], names)

    return run


def _possible(sketch: np.ndarray, info: np.ndarray, join: Join, start: int, stop: int) -> np.ndarray:
    """Sketch distance of some members of a group to all, and -1 where a link is impossible."""
    rows, n = slice(start, stop), info >> 1
    apart = np.zeros((len(n[rows]), len(n)), np.int64)
    for w in range(join.words):
        apart += np.bitwise_count(sketch[rows, w][:, None] ^ sketch[:, w][None, :])
    good = (apart <= join.most(n[rows][:, None], n[None, :])) & join.fits(info[rows][:, None], info[None, :])
    out = np.where(good, np.minimum(apart, 32000), -1).astype(np.int16)
    out[np.arange(len(out)), start + np.arange(len(out))] = -1
    return out


def _spanning(n: int, possible: Callable[[int, int], np.ndarray]) -> list[tuple[int, int]]:
    """A minimum spanning forest of the possible links of n members.

    A group of up to WIDE members has its distances worked out at once, a larger one row by row as they are needed, so
    memory grows with the members and not with their pairs.
    """
    if n <= WIDE:
        known = np.concatenate([possible(at, min(at + 128, n)) for at in range(0, n, 128)])
    open_, found = np.ones(n, bool), []
    nearest, parent = np.full(n, 32767, np.int16), np.full(n, -1)
    for _ in range(n):
        waiting = np.where(open_, nearest, 32767)
        at = int(waiting.argmin())
        if waiting[at] == 32767:
            at = int(open_.argmax())
        else:
            found.append((int(parent[at]), at))
        open_[at] = False
        apart = known[at] if n <= WIDE else possible(at, at + 1)[0]
        closer = open_ & (apart >= 0) & (apart < nearest)
        nearest[closer], parent[closer] = apart[closer], at
    return found


def _compared(join: Join):
    """Larger groups, sorted by key, with sketches and labels: (key, x, y) of a spanning forest of possible links, or,
    where labels are given, of all possible links between different labels."""

    def linked(key: np.ndarray, node: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        i, j = i[node[i] != node[j]], j[node[i] != node[j]]
        x, y = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        return pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(x), pa.array(y)], ["key", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key"], 1 << 13):
            key, node, info = (table[c].to_numpy() for c in ("key", "node", "info"))
            label = table["label"].to_numpy()
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(key), join.words)
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            found = []
            for a, b in zip(head, np.append(head[1:], len(key)), strict=True):
                possible = partial(_possible, sketch[a:b], info[a:b], join)
                if table["whole"][int(a)].as_py():
                    own = label[a:b]
                    for at in range(0, b - a, 128):
                        block = possible(at, min(at + 128, b - a))
                        i, j = np.nonzero((block >= 0) & (own[at : at + 128][:, None] != own[None, :]))
                        i += at
                        found.append((a + i[i < j], a + j[i < j]))
                        if sum(len(i) for i, _ in found) > 1 << 20:
                            yield linked(key, node, found)
                            found = []
                else:
                    i, j = np.array(_spanning(b - a, possible), np.int64).reshape(-1, 2).T
                    found.append((a + i, a + j))
            if found:
                yield linked(key, node, found)

    return run


def _sketched(join: Join):
    """(doc, text) -> (doc, text, sketch), once for each doc of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sketch = [x.tobytes() for x in join.sketch(part.column(1))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sketch, pa.binary())], ["doc", "text", "sketch"])

    return run


def linked_components(
    rows: list[DataFrame], classes: DataFrame, texts: DataFrame, join: Join, folder: str, tasks: int = 0
) -> DataFrame:
    """(node, label) of all linked representatives.

    `rows` are index rows (key, node, info), in one table or in several without common keys: one after another is
    shuffled, over `tasks` tasks if these are more than Spark's own, so that the disk holds the rows of one at a time.
    Texts and pairs are then shuffled in as many parts. `classes` has (node, rep, n): the representative of each node; `texts` has (doc, text) for at least all
    representatives. `folder` is a new one below the shared folder. Only texts that some group has together with others
    are kept and sketched.
    """
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stored(df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{folder}/{name}")

    def sliced(make: Callable[[int], DataFrame], name: str) -> DataFrame:
        """The table that `make` returns in slices; each is written before the next one is begun."""
        made = [stored(make(i), f"{name}/slice={i}") for i in range(len(rows))]
        return spark.read.schema(made[0].schema).parquet(*[f"{folder}/{name}/slice={i}" for i in range(len(rows))])

    def slice_of(some: DataFrame, i: int, *key: str) -> DataFrame:
        return some if len(rows) == 1 else some.filter(F.pmod(F.xxhash64(*key), F.lit(len(rows))) == i)

    def grouped(i: int) -> DataFrame:
        ordered = rows[i].repartition(max(parts, tasks), "key").sortWithinPartitions("key")
        return ordered.mapInArrow(_grouped(join), "key bigint, x bigint, y bigint, info bigint")

    groups = sliced(grouped, "groups")
    members = groups.filter("info > 0").select("key", F.col("x").alias("node"), "info")
    pairs = groups.filter("info = 0").select("x", "y").distinct()
    # Sketches as numbers: their distance is a built-in expression.
    width = range(join.words)
    together = members.select("node").unionByName(pairs.select(F.explode(F.array("x", "y")).alias("node"))).distinct()
    some = stored(classes.join(together, "node"), "together")
    wanted = some.select(F.col("rep").alias("doc")).distinct()
    given = texts

    def sketched(i: int) -> DataFrame:
        # By shuffle at every size: the ids grow with the corpus.
        found = slice_of(given, i, "doc").join(slice_of(wanted, i, "doc").hint("merge"), "doc").select("doc", "text")
        return found.mapInArrow(_sketched(join), "doc bigint, text string, sketch binary")

    texts = sliced(sketched, "texts").dropDuplicates(["doc"])
    classes = some.join(texts.select(F.col("doc").alias("rep"), "sketch"), "rep")
    texts = texts.select("doc", "text")

    def compared(some: DataFrame, label: Column, whole: bool) -> DataFrame:
        wide = some.join(classes.select("node", "sketch"), "node").select(
            "key", "node", "info", "sketch", label.alias("label"), F.lit(whole).alias("whole")
        )
        return (
            wide.repartition(parts, "key")
            .sortWithinPartitions("key", "node")
            .mapInArrow(_compared(join), "key bigint, x bigint, y bigint")
        )

    def verified(candidates: DataFrame, name: str) -> DataFrame:
        """(x, y, linked) of pairs of representatives, for pairs of nodes; stored."""

        def side(node: str, prefix: str) -> DataFrame:
            names = [F.col(c).alias(f"{prefix}_{c}") for c in ("rep", "n", "sketch")]
            return classes.select(F.col("node").alias(node), *names)

        def word(name: str, i: int) -> Column:
            halves = [F.conv(F.hex(F.substring(name, 8 * i + 4 * j + 1, 4)), 16, 10).cast("bigint") for j in (0, 1)]
            return F.shiftleft(halves[0], 32).bitwiseOR(halves[1])

        apart = sum((F.bit_count(word("a_sketch", i).bitwiseXOR(word("b_sketch", i))) for i in width), F.lit(0))
        near = candidates.join(side("x", "a"), "x").join(side("y", "b"), "y")
        near = near.filter(apart <= join.most(F.col("a_n"), F.col("b_n")))
        both = near.select(F.least("a_rep", "b_rep").alias("x"), F.greatest("a_rep", "b_rep").alias("y")).distinct()
        if len(rows) > 1:
            both = stored(both, f"{name}-pairs")

        def judged(i: int) -> DataFrame:
            some = slice_of(both.filter("x <> y"), i, "x", "y")
            return (
                some.select("x", "y", F.explode(F.array("x", "y")).alias("doc"))
                .join(texts, "doc")
                .select("x", "y", "doc", "text")
                .repartition(parts, "x", "y")
                .sortWithinPartitions("x", "y", "doc")
                .mapInArrow(join.verify, "x bigint, y bigint, linked boolean")
            )

        return sliced(judged, name)

    forest = stored(compared(members, F.lit(0).cast("bigint"), False), "forest")
    checked = verified(pairs.unionByName(forest.select("x", "y")).distinct(), "checked")
    links = checked.filter("linked").select("x", "y")
    labels = components(links, f"{folder}/first")
    rep = classes.select("node", "rep")

    def represented(table: DataFrame) -> DataFrame:
        one = table.join(rep.select(F.col("node").alias("x"), F.col("rep").alias("a")), "x")
        two = one.join(rep.select(F.col("node").alias("y"), F.col("rep").alias("b")), "y")
        return two.select("key", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))

    doubtful = represented(forest).join(links, ["x", "y"], "left_anti").select("key").distinct()
    again = members.join(doubtful, "key", "left_semi").join(rep, "node")
    again = again.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    left = stored(compared(again, F.coalesce("label", "rep"), True).select("x", "y").distinct(), "left")
    if left.isEmpty():
        return labels
    more = verified(left, "more").filter("linked").select("x", "y")
    return components(links.unionByName(more), f"{folder}/second")
