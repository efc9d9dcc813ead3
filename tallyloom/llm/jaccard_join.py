"""Exact set-similarity join on word n-grams, by partitioning the universe of shingles.

Two sets with Jaccard >= t differ in at most H = (1 - t) / (1 + t) * (|x| + |y|) shingles. Shingles are hashed into
segments; sizes fall into bands of ratio 1 / t, and a set is indexed in the scheme of its own band and of the band
below, so that both partners of any link share a scheme. By pigeonhole, if the weights of a scheme's segments add up
to more than H, then some segment of weight 1 is equal in both sets, or some segment of weight 2 differs in at most
one shingle. Weight-1 segments are indexed by their subset, weight-2 segments by their subset and its one-deletion
neighbourhood. The weights of each band are chosen by cost: rows that are made, and chance meetings of empty segments
at the number of sets in the band. Slack beyond H + 1 lets most sets leave their empty segments out of the index.

Sets that are equal are one class from the start. Members of larger index groups are compared by parity sketches,
which never overstate the difference; of a group's possible links only a spanning forest goes on. Candidates are
verified on whole sets. Where a link of a forest proves false, that group's other possible links between different
components are verified as well, so no link is lost. Very frequent index keys, found in a sample of documents (this
only routes work), are compared tile by tile.

A shingle stands for itself as a 64-bit hash of its words.

Defined results: a text without words has an empty set and links with nothing; fewer words than `words` are one
shingle. A null doc_id comes before all others. Inside, a row goes by a hash of id and text: rows with equal id and
text are one, rows with equal ids (or none) and different texts have their own sets and components, which are one only
if the sets are linked. An empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow import NULL_ID, Hashes, free_name, keyed_texts, mixed, ranges, row_key, whole_groups
from tallyloom.llm.similarity import SMALL_GROUP, TILE, Join, Tiles, frequent_keys, index_batches, linked_components
from tallyloom.session import shared_path, written
from tallyloom.sources.files import delete

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORDS = 8  # 64-bit words of a sketch
LARGEST_SET = 1 << 40
# What a shingle costs in the comparison of two sets, against an index row, in the choice of weights.
MEETING_COST = 0.7
CHUNK_BYTES = 1 << 19
# Index rows that are shuffled at once, as long as no more than SLICES passes over the texts are needed for it.
SLICE_ROWS = 1 << 24
SLICES = 3
# Index rows of a task, which are sorted in memory.
TASK_ROWS = 1 << 21

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@dataclass(frozen=True)
class Bands:
    """Size bands and, per band, its segments: `total` of them, the first `double` with weight 2, and the slack."""

    edge: np.ndarray  # smallest size of each band
    total: np.ndarray
    double: np.ndarray
    slack: np.ndarray


def edges(num: int, den: int, largest: int) -> np.ndarray:
    found = [1]
    while found[-1] <= largest:
        found.append(found[-1] * den // num + 1)
    return np.array(found, np.int64)


def _weights(size: int, need: int, sets: int) -> tuple[int, int, int]:
    """(segments, of them with weight 2, slack) of total weight need + slack, at the least cost for sets of `size`.

    Segments that are empty meet by chance. With slack for those that a set may be expected to have, they need no rows
    (see index_rows); without, they have rows, and each chance meeting costs the comparison of two sets.
    """
    best = None
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        for wide in (False, True):
            slack = 0
            for _ in range(20 if wide else 1):
                double = math.ceil((need + slack) * share / 2)
                total = double + max(need + slack - 2 * double, 0)
                fill = size / total
                once, twice = math.exp(-fill) * (total - double), math.exp(-fill) * double * (1 + fill)
                # Beyond so many deviations hardly one of all sets is left.
                away = math.sqrt(2 * math.log(max(sets, 2)) * (once + 4 * twice))
                enough = math.ceil(once + 2 * twice + away + 1) if wide else 0
                if slack >= enough:
                    break
                slack = enough
            else:
                continue
            if total > 2 * size + 1:
                continue
            rows = total + double * size / total
            meetings = 0.0 if wide else sets * math.exp(-2 * fill) * (total - double + double * (1 + fill) ** 2)
            cost = rows + MEETING_COST * size * meetings
            if best is None or cost < best[0]:
                best = (cost, total, double, slack)
    if best is None:
        return need, 0, 0
    return best[1], best[2], best[3]


def choose_bands(num: int, den: int, sizes: dict[int, int], largest: int) -> Bands:
    """`sizes`: sets per band."""
    edge = edges(num, den, largest)
    chosen = []
    for band in range(len(edge) - 1):
        high = int(edge[band + 1]) - 1
        most = (high + high * den // num) * (den - num) // (den + num)
        chosen.append(_weights(int(edge[band]), most + 1, sizes.get(band, 0) + sizes.get(band + 1, 0)))
    return Bands(edge, *(np.array(x, np.int64) for x in zip(*chosen, strict=True)))


@dataclass
class Sets:
    """Distinct shingles of several texts: sorted within each text."""

    row: np.ndarray
    shingle: np.ndarray
    size: np.ndarray  # per text

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each set."""
        end = np.cumsum(self.size)
        out = []
        for salt in (1, 2):
            sums = np.zeros(len(self.shingle) + 1, np.uint64)
            np.cumsum(mixed(self.shingle + np.uint64(salt)), out=sums[1:])
            out.append(mixed(sums[end] - sums[end - self.size] + self.size.astype(np.uint64)))
        return out[0], out[1]

    def sketches(self) -> np.ndarray:
        """Parity of the shingles per bit; each shingle in the difference of two sets flips one bit."""
        bit = (self.shingle & np.uint64(64 * WORDS - 1)).astype(np.int64)
        odd = np.bincount(self.row * (64 * WORDS) + bit, minlength=len(self.size) * 64 * WORDS) & 1
        return np.packbits(odd.astype(np.uint8).reshape(-1, 64 * WORDS), axis=1)


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, Sets]]:
    """(first row, sets of the rows from there) over a string column, in parts of bounded size."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1, at + 1)
        yield at, _sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], words)
        at = to


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Sets:
    rows = len(offsets) - 1
    low = _LOWER[data]
    inside = ~_SPACE[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = inside[last]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = np.searchsorted(offsets, start, "right") - 1
    word = Hashes(_BYTES[low], BASES[0]).of(start, stop - start) + (stop - start).astype(np.uint64)
    count = np.bincount(owner, minlength=rows)
    head = np.cumsum(count) - count
    # One shingle per window; a text with fewer words has one of all its words.
    n = np.where(count == 0, 0, np.maximum(count - words + 1, 1))
    at, row = ranges(head, n), np.repeat(np.arange(rows), n)
    size = np.minimum(words, count)[row]
    shingle = np.full(len(at), 7, np.uint64) * size.astype(np.uint64)
    for k in range(words):
        have = k < size
        value = word[np.where(have, at + k, 0)] if len(word) else np.zeros(0, np.uint64)
        shingle = np.where(have, mixed(shingle * np.uint64(BASES[1]) + value), shingle)
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    row, shingle = row[new], shingle[new]
    return Sets(row, shingle, np.bincount(row, minlength=rows))


def _described(words: int):
    """(row, doc, n, h1, h2) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in shingle_sets(batch.column(2), words):
                h1, h2 = sets.fingerprints()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(h1)),
                        batch.column(1).slice(at, len(h1)),
                        pa.array(sets.size.astype(np.int64)),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                    ],
                    ["row", "doc", "n", "h1", "h2"],
                )

    return run


def _sketch(words: int):
    def run(text: pa.Array) -> np.ndarray:
        return np.concatenate([sets.sketches() for _, sets in shingle_sets(text, words)])

    return run


def index_rows(sets: Sets, node: np.ndarray, bands: Bands, below: int) -> tuple[np.ndarray, ...]:
    """(key, node, size << 1 | exact) of the scheme of each set's own band (below = 0) or of the one below (1)."""
    scheme = np.searchsorted(bands.edge, sets.size, "right") - 1 - below
    use = (sets.size > 0) & (scheme >= 0)
    m = np.where(use, bands.total[np.maximum(scheme, 0)], 0)
    base = np.cumsum(m) - m
    member = use[sets.row]
    row, shingle = sets.row[member], sets.shingle[member]
    # Shingles are sorted, so the segments of a set are stretches of it.
    segment = (((shingle >> np.uint64(32)) * m[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    place = base[row] + segment
    sums = np.zeros(len(shingle) + 1, np.uint64)
    value = mixed(shingle ^ np.uint64(BASES[0]))
    np.cumsum(value, out=sums[1:])
    filled = np.bincount(place, minlength=int(m.sum()))
    stop = np.cumsum(filled)
    subset = sums[stop] - sums[np.concatenate([[0], stop[:-1]])] if len(stop) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(m)), m)
    inner = np.arange(len(owner)) - base[owner]
    tag = mixed((scheme[owner].astype(np.uint64) << np.uint64(40)) + inner.astype(np.uint64) + np.uint64(1))
    exact = mixed(subset ^ tag)
    info = sets.size << 1
    low = np.maximum(scheme, 0)
    wide = inner < bands.double[low][owner]
    # A link leaves matching segments of more than `slack` weight. If those of a set that could match as empty weigh
    # no more, another one matches as well, and the empty subsets need no rows. Other sets have all rows.
    empty = np.where(wide, 2 * (filled <= 1), filled == 0)
    every = np.bincount(owner, empty, minlength=len(m)) > bands.slack[low]
    one = (filled > 0) | every[owner]
    two = (segment < bands.double[low][row]) & ((filled[place] > 1) | every[row])
    less = mixed((subset[place[two]] - value[two]) ^ tag[place[two]])
    return (
        np.concatenate([exact[one], less]),
        np.concatenate([node[owner[one]], node[row[two]]]),
        np.concatenate([info[owner[one]] | 1, info[row[two]]]),
    )


def index_size(bands: Bands, sets: dict[int, int]) -> int:
    """About how many index rows the sets of each band have, in both of their schemes."""
    each = bands.total + bands.double * bands.edge[:-1] / np.maximum(bands.total, 1)
    return int(sum(n * (each[b] + (each[b - 1] if b else 0)) for b, n in sets.items()))


def _indexed(words: int, bands: Bands, tiles: Tiles, part: int = 0, parts: int = 1):
    """(key, node, info) of each task's distinct sets; the node is the set's first fingerprint.

    Of `parts` slices of the keys only one is made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.zeros(0, np.uint64)
            for _, sets in shingle_sets(batch.column(2), words):
                node = sets.fingerprints()[0]
                first = np.zeros(len(node), bool)
                first[np.unique(node, return_index=True)[1]] = True
                first &= ~np.isin(node, known)
                known = np.union1d(known, node)
                keep = first[sets.row]
                some = Sets(sets.row[keep], sets.shingle[keep], np.where(first, sets.size, 0))
                for below in (0, 1):
                    made = index_rows(some, node, bands, below)
                    if parts > 1:
                        mine = (made[0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32) == part
                        made = tuple(x[mine] for x in made)
                    yield from index_batches(*tiles.deal(*made))

    return run


def _linked(text: pa.Array, words: int, num: int, den: int) -> np.ndarray:
    """Whether rows 2i and 2i + 1 are linked, for every i."""
    parts = list(shingle_sets(text, words))
    owner = np.concatenate([at + s.row for at, s in parts]) // 2
    shingle = np.concatenate([s.shingle for _, s in parts])
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    twice = (owner[1:] == owner[:-1]) & (shingle[1:] == shingle[:-1])
    same = np.bincount(owner[1:][twice], minlength=len(text) // 2)
    total = np.bincount(owner, minlength=len(text) // 2)
    return same * den >= (total - same) * num


def _verified(words: int, num: int, den: int):
    """Sorted by (x, y), two rows with a text each: (x, y, linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["x", "y"], 1 << 9):
            x, y, doc = (table[c].to_numpy() for c in ("x", "y", "doc"))
            # A document may stand in the table more than once: one row for each side is enough.
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            size = np.cumsum(np.array(pc.binary_length(table["text"]).to_numpy())[at])
            done = 0
            while done < len(at):
                # Some pairs at a time, by the size of their texts.
                before = size[done - 1] if done else 0
                to = int(np.searchsorted(size, before + CHUNK_BYTES, "right")) // 2 * 2
                to = max(to, done + 2)
                text = table["text"].take(pa.array(at[done:to])).combine_chunks()
                text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
                pair = at[done:to:2]
                linked = _linked(text, words, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(x[pair]), pa.array(y[pair]), pa.array(linked)], ["x", "y", "linked"])
                done = to

    return run


def grouped_rows(
    docs: DataFrame,
    words: int = 3,
    num: int = 90,
    den: int = 100,
    folder: str | None = None,
    sample: int = 64,
    tile: int = TILE,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """(row, doc, n, first_row, first_doc) of every row of (doc_id, text); links: Jaccard >= num / den.

    `row` is `arrow.row_key`; first is the row of the component with the smallest id. A null id is the smallest number.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "jaccard-join")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = keyed_texts(docs)

    def stored(df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{folder}/{name}")

    described = stored(
        given.mapInArrow(_described(words), "row bigint, doc bigint, n bigint, h1 bigint, h2 bigint"), "sets"
    )
    full = described.filter("n > 0")
    classes = stored(full.groupBy("n", "h1", "h2").agg(F.min(F.struct("doc", "row")).alias("place")), "classes")

    largest = classes.agg(F.max("n")).first()[0] or 1
    edge = edges(num, den, largest)
    band = F.lit(0)
    for i, low in enumerate(edge.tolist()[1:], 1):
        band = F.when(F.col("n") >= low, i).otherwise(band)
    counts = dict(classes.groupBy(band.alias("band")).count().collect())
    bands = choose_bands(num, den, counts, largest)

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m, n = a >> 1, b >> 1
        return (np.minimum(m, n) * den >= np.maximum(m, n) * num) & ((a | b) & 1 == 1)

    def most(m, n):
        gap, whole = den - num, den + num
        if isinstance(m, Column):
            return F.floor((m + n) * gap / whole)
        return (m + n) * gap // whole

    shape = "key bigint, node bigint, info bigint"
    part = given.filter(F.pmod(F.xxhash64("row"), F.lit(sample)) == 0)
    tiles = Tiles(frequent_keys(part.mapInArrow(_indexed(words, bands, Tiles({})), shape), sample, parts, tile))
    size = index_size(bands, counts)
    slices = min(max(1, math.ceil(size / SLICE_ROWS)), SLICES)
    labels = linked_components(
        [given.mapInArrow(_indexed(words, bands, tiles, i, slices), shape) for i in range(slices)],
        classes.select(F.col("h1").alias("node"), F.col("place.row").alias("rep"), "n"),
        given.select(F.col("row").alias("doc"), "text"),
        Join(fits, most, _verified(words, num, den), _sketch(words), WORDS, small_group),
        folder,
        math.ceil(size / slices / TASK_ROWS),
    )
    named = classes.withColumn("rep", F.col("place.row")).join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    linked = named.filter("label is not null")
    firsts = linked.groupBy("label").agg(F.min("place").alias("first"))
    # Most sets are linked with nothing; theirs is the first row of equal sets.
    joined = linked.join(firsts, "label").select("n", "h1", "h2", F.col("first").alias("place"))
    placed = joined.unionByName(named.filter("label is null").select("n", "h1", "h2", "place"))
    found = full.join(placed, ["n", "h1", "h2"]).select("row", "doc", "n", "place")
    alone = described.filter("n = 0").select("row", "doc", "n", F.struct("doc", "row").alias("place"))
    return found.unionByName(alone).select(
        "row", "doc", "n", F.col("place.row").alias("first_row"), F.col("place.doc").alias("first_doc")
    )


def linked_documents(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, **parameters) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text); links: Jaccard >= num / den."""
    return grouped_rows(docs, words, num, den, **parameters).select(
        F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif("first_doc", F.lit(NULL_ID)).alias("component_id"),
    )


def one_of_each_group(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, folder: str | None = None) -> DataFrame:
    """The rows of `docs` without near duplicates: the one with the smallest doc_id of each group stays, whole.

    Rows without words are in no group and all stay. Of rows with equal id and text one stays. The rows to leave out,
    and those that occur more than once, are written first: Spark sees their size and shuffles `docs` only if it is large.
    What the join wrote for itself is deleted then.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "one-of-each-group")
    rows = grouped_rows(docs.select("doc_id", "text"), words, num, den, folder=f"{folder}/join")
    rows = written(rows, f"{folder}/rows").filter("n > 0")
    delete(spark, f"{folder}/join")
    gone = written(rows.filter("row <> first_row").select("row").distinct(), f"{folder}/gone")
    often = rows.filter("row = first_row").groupBy("row").count().filter("count > 1")
    repeated = written(often.select("row"), f"{folder}/repeated")
    key = free_name(docs, "j_row")
    keyed = docs.withColumn(key, row_key())

    def joined(some: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        return some.join(listed.select(F.col("row").alias(key)), key, how)

    kept = joined(keyed, gone, "left_anti")
    once = joined(kept, repeated, "left_semi").dropDuplicates([key])
    return joined(kept, repeated, "left_anti").unionByName(once).drop(key)
