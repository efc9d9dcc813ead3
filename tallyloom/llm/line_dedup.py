"""Line dedup: near-equal lines across all documents by a segment-partition edit join; the first one stays.

Lines of `min_chars` or more code points take part in the join. With `exact_chars`, shorter lines of that size or more
take part as exact copies, unless they are blank; all others are never touched. Equal lines are one class by two
64-bit hashes. A class's line is cut into threshold + 1 segments, indexed by (length, segment number, substring). At
most `threshold` edits leave one segment whole, so each line also probes, for its own and each smaller length in
reach, the substrings that can lie opposite a segment (positions limited by the edits that may stand to the left and
to the right of it). Candidates are verified by banded bit-parallel edit distance. Members of frequent segments are
compared by parity sketches of character pairs, of which an edit changes four at the most.

Links make components of lines; all occurrences but the first (smallest doc_id, then line number) are removed.

Defined results: a null text is empty. A null doc_id comes before all others. Rows with equal id and text are one
document and are cut alike; rows with equal ids (or none) and different texts are documents of their own, in an order
by a hash of the text. An empty table gives an empty result. In `remove_lines` extra columns of any name stay; a text
of which nothing is left becomes the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.binding import let
from tallyloom.llm.arrow import Hashes, free_name, keyed_texts, mixed, ranges, row_key, whole_groups
from tallyloom.llm.similarity import SMALL_GROUP, TILE, Join, Tiles, frequent_keys, index_batches, linked_components
from tallyloom.session import shared_path, written
from tallyloom.sources.files import delete

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CHUNK_BYTES = 1 << 19
VERIFIED_CHARS = 1 << 21  # of pairs that are verified in step, at their longest line
WORDS = 4
NEWLINE = 10

_VALUES = mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64))  # of the code points of the first plane


class Lines:
    """The lines of several texts, as code points; `data` has the same in UTF-8."""

    def __init__(
        self,
        data: np.ndarray,
        point: np.ndarray,
        text_start: np.ndarray,
        text_stop: np.ndarray,
        min_chars: int,
        exact_chars: int | None = None,
    ):
        breaks = np.flatnonzero(point == NEWLINE)
        texts = np.arange(len(text_start))
        row = np.concatenate([texts, np.searchsorted(text_start, breaks, "right") - 1])
        start, stop = np.concatenate([text_start, breaks + 1]), np.concatenate([text_stop, breaks])
        start, stop = start[np.lexsort((start, row))], stop[np.lexsort((stop, row))]
        row = np.sort(row)
        number = np.arange(len(row)) - np.searchsorted(row, texts)[row]
        keep = stop - start >= min_chars
        if exact_chars is not None:
            short = np.flatnonzero(~keep & (stop - start >= exact_chars))
            if len(short):
                size = (stop - start)[short]
                inner = point[ranges(start[short], size)]
                seen = (inner != 32) & ((inner < 9) | (inner > 13))
                keep[short] = np.logical_or.reduceat(seen, np.cumsum(size) - size)
        self.row, self.number, self.start, self.size = row[keep], number[keep], start[keep], (stop - start)[keep]
        few = len(point) == 0 or point.max() < len(_VALUES)
        values = _VALUES[point] if few else mixed(point.astype(np.uint64) + np.uint64(1))
        self.data = data
        self.one = Hashes(values, BASES[0])
        self.values = values

    def nodes(self) -> np.ndarray:
        return mixed(self.one.of(self.start, self.size) + self.size.astype(np.uint64))

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each line; the first is its node."""
        two = Hashes(self.values, BASES[1]).of(self.start, self.size)
        return self.nodes(), mixed(two + self.size.astype(np.uint64))

    def texts(self, some: np.ndarray) -> pa.Array:
        """The lines at `some` as strings, copied in one go."""
        data = self.data
        first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        start, stop = first[self.start[some]], first[self.start[some] + self.size[some]]
        offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
        copied = data[ranges(start, stop - start)].tobytes()
        return pa.Array.from_buffers(pa.string(), len(some), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(copied)])

    def sketches(self) -> np.ndarray:
        """Parity of the pairs of neighbouring characters, per bit."""
        bits = 64 * WORDS
        pair = mixed(self.values[:-1] * np.uint64(BASES[1]) + self.values[1:]) & np.uint64(bits - 1)
        at = ranges(self.start, self.size - 1)
        owner = np.repeat(np.arange(len(self.size)), self.size - 1)
        out = np.zeros((len(self.size), bits // 8), np.uint8)
        for a in range(0, len(self.size), 4096):
            part = slice(np.searchsorted(owner, a), np.searchsorted(owner, a + 4096))
            rows = min(4096, len(self.size) - a)
            count = np.bincount((owner[part] - a) * bits + pair[at[part]].astype(np.int64), minlength=rows * bits)
            out[a : a + rows] = np.packbits((count & 1).astype(np.uint8).reshape(rows, bits), axis=1)
        return out


def line_parts(column: pa.Array, min_chars: int, exact_chars: int | None = None) -> Iterator[tuple[int, Lines]]:
    """(first row, lines of the rows from there), in parts of bounded size."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1, at + 1)
        part = data[offsets[at] : offsets[to]]
        point = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        edge = chars[offsets[at : to + 1] - offsets[at]]
        yield at, Lines(part, point, edge[:-1], edge[1:], min_chars, exact_chars)
        at = to


def _sketch(text: pa.Array) -> np.ndarray:
    return np.concatenate([lines.sketches() for _, lines in line_parts(text, 0)])


def _segments(size: np.ndarray, i: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines of a size: even, the longer segments last."""
    count = threshold + 1
    short = count - size % count
    length = size // count
    start = i * length + np.maximum(i - short, 0)
    return start, length + (i >= short)


def index_rows(lines: Lines, node: np.ndarray, some: np.ndarray, threshold: int, min_chars: int) -> Iterator[tuple]:
    """(key, node, size << 1 | is index) for the lines at `some`."""
    start, size, own = lines.start[some], lines.size[some], node[some]

    def keys(at: np.ndarray, length: np.ndarray, whole: np.ndarray, i: int) -> np.ndarray:
        return mixed(lines.one.of(at, length) ^ mixed((whole * 64 + i).astype(np.uint64)))

    for i in range(threshold + 1):
        p, length = _segments(size, i, threshold)
        yield keys(start + p, length, size, i), own, size << 1 | 1
        for gap in range(threshold + 1):
            whole = size - gap
            p, length = _segments(whole, i, threshold)
            low = max(-i, gap - (threshold - i))
            high = min(i, gap + threshold - i)
            for shift in range(low, high + 1):
                if gap == 0 and shift == 0:
                    continue
                fits = (whole >= min_chars) & (p + shift >= 0) & (p + shift + length <= size)
                yield keys((start + p + shift)[fits], length[fits], whole[fits], i), own[fits], (size << 1)[fits]


def _first(node: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = np.unique(node, return_index=True)[1]
    return np.sort(some[~np.isin(node[some], known)]), np.union1d(known, node)


def _listed(min_chars: int, exact_chars: int | None):
    """(row, doc, line, n, h1, h2, text) of every line that takes part; a batch has the text of each once, if edits count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc", "line", "n", "h1", "h2", "text"]
        for batch in batches:
            row, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            known = np.zeros(0, np.uint64)
            for at, lines in line_parts(batch.column(2), min_chars, exact_chars):
                if not len(lines.row):
                    continue
                h1, h2 = lines.fingerprints()
                some, known = _first(h1, known)
                some = some[lines.size[some] >= min_chars]
                place = np.full(len(h1), -1)
                place[some] = np.arange(len(some))
                text = lines.texts(some).take(pa.array(place, mask=place < 0))
                own = at + lines.row
                columns = [row[own], doc[own], lines.number, lines.size, h1.view(np.int64), h2.view(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), text], names)

    return run


def _indexed(threshold: int, min_chars: int, tiles: Tiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.zeros(0, np.uint64)
            for _, lines in line_parts(batch.column(2), min_chars):
                node = lines.nodes()
                some, known = _first(node, known)
                rows = zip(*index_rows(lines, node, some, threshold, min_chars), strict=True)
                yield from index_batches(*tiles.deal(*(np.concatenate(x) for x in rows)))

    return run


def banded_distances(a: list[str], b: list[str], threshold: int) -> np.ndarray:
    """Edit distances of pairs, exact up to `threshold`; beyond it, some number above it.

    All pairs step through their second text together. Bit k of a pair's vectors stands for row column - threshold + k
    of its matrix, so the band of 2 * threshold + 1 diagonals moves down with the columns. The distance is followed
    along the diagonal that ends in the last cell.
    """
    width = 2 * threshold + 1
    full = np.uint64((1 << width) - 1)
    n, m = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    most_n, most_m = int(n.max(initial=0)), int(m.max(initial=0))
    # 0 and 1 stand for no character, on either side, and never match.
    rows = np.zeros((len(a), most_n + 2 * width + max(most_m - most_n, 0)), np.uint32)
    for i, x in enumerate(a):
        rows[i, threshold : threshold + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") + 2
    columns = np.ones((len(b), most_m), np.uint32)
    for i, x in enumerate(b):
        columns[i, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") + 2
    one = np.uint64(1)
    vp = np.full(len(a), full & ~((one << np.uint64(threshold)) - one), np.uint64)
    vn = np.zeros(len(a), np.uint64)
    bit = np.clip(threshold + n - m, 0, width - 1).astype(np.uint64)
    distance = np.abs(n - m)
    begin = np.maximum(m - n, 0)
    weights = one << np.arange(width, dtype=np.uint64)
    for j in range(most_m):
        same = (rows[:, j : j + width] == columns[:, j : j + 1]) @ weights
        d0 = ((((same & vp) + vp) ^ vp) | same | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        below = d0 >> one
        vp = (hn | ~(below | hp)) & full
        vn = below & hp
        distance += ((d0 >> bit & one) == 0) & (j >= begin) & (j < m)
    return np.where(np.abs(n - m) > threshold, threshold + 1, distance)


def _verified(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["x", "y"], 1 << 10):
            x, y, doc = (table[c].to_numpy() for c in ("x", "y", "doc"))
            text = table["text"].to_pylist()
            # A line may come from several batches: one row for each side is enough.
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new).reshape(-1, 2)
            size = np.array([len(text[i]) for i in at[:, 0]])
            order = np.argsort(size)
            linked = np.zeros(len(at), bool)
            done = 0
            while done < len(order):
                # As many pairs in step as their longest line allows.
                to = min(done + 128, len(order))
                while to > done + 1 and (to - done) * size[order[to - 1]] > VERIFIED_CHARS:
                    to = done + (to - done) // 2
                part, done = order[done:to], to
                a, b = [text[i] for i in at[part, 0]], [text[i] for i in at[part, 1]]
                linked[part] = banded_distances(a, b, threshold) <= threshold
            yield pa.RecordBatch.from_arrays([pa.array(x[at[:, 0]]), pa.array(y[at[:, 0]]), pa.array(linked)], ["x", "y", "linked"])

    return run


def line_verdicts(
    docs: DataFrame,
    threshold: int = 2,
    min_chars: int = 32,
    exact_chars: int | None = None,
    folder: str | None = None,
    sample: int = 64,
    tile: int = TILE,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """(row, doc, line, n, class_row, class_doc, class_line, linked) of every line that takes part in (doc_id, text) rows.

    The class is the first occurrence of the line's component; `linked`: the component has other texts than this one.
    The line stays if it is its class. `row` is `arrow.row_key`; a null doc_id is shown as the smallest number.
    """
    if not 0 <= threshold <= 15 or min_chars < 2 * (threshold + 1):
        raise ValueError("threshold is 0 to 15, and min_chars at least 2 * (threshold + 1)")
    if exact_chars is not None and exact_chars < 1:
        raise ValueError("exact_chars is at least 1")
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "line-dedup")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = keyed_texts(docs)

    def stored(df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{folder}/{name}")

    shape = "row bigint, doc bigint, line bigint, n bigint, h1 bigint, h2 bigint, text string"
    lines = stored(given.mapInArrow(_listed(min_chars, exact_chars), shape), "lines")
    place = F.min(F.struct("doc", "row", "line")).alias("place")
    classes = stored(lines.groupBy("n", "h1", "h2").agg(place), "classes")

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (np.abs((a >> 1) - (b >> 1)) <= threshold) & ((a | b) & 1 == 1)

    def most(m, n):
        return F.lit(4 * threshold) if isinstance(m, Column) else 4 * threshold + 0 * (m + n)

    rows = "key bigint, node bigint, info bigint"
    part = given.filter(F.pmod(F.xxhash64("row"), F.lit(sample)) == 0)
    few = part.mapInArrow(_indexed(threshold, min_chars, Tiles({})), rows)
    tiles = Tiles(frequent_keys(few, sample, parts, tile))
    labels = linked_components(
        [given.mapInArrow(_indexed(threshold, min_chars, tiles), rows)],
        classes.filter(F.col("n") >= min_chars).select(F.col("h1").alias("node"), F.col("h1").alias("rep"), "n"),
        lines.filter("text is not null").select(F.col("h1").alias("doc"), "text"),
        Join(fits, most, _verified(threshold), _sketch, WORDS, small_group),
        folder,
    )
    named = classes.select("n", "h1", "h2", "place").join(labels.withColumnRenamed("node", "h1"), "h1", "left")
    linked = named.filter("label is not null")
    firsts = linked.groupBy("label").agg(F.min("place").alias("first"))
    # Most lines are linked with nothing and are their own class.
    joined = linked.join(firsts, "label").select("n", "h1", "h2", F.col("first").alias("place"), F.lit(True).alias("linked"))
    alone = named.filter("label is null").select("n", "h1", "h2", "place", F.lit(False).alias("linked"))
    return (
        lines.select("row", "doc", "line", "n", "h1", "h2")
        .join(joined.unionByName(alone), ["n", "h1", "h2"])
        .select("row", "doc", "line", "n", *[F.col(f"place.{c}").alias(f"class_{c}") for c in ("row", "doc", "line")], "linked")
    )


def removed_lines(verdicts: DataFrame) -> DataFrame:
    """(row, removed: sorted line numbers, from 0) of rows that lose lines."""
    gone = verdicts.filter((F.col("row") != F.col("class_row")) | (F.col("line") != F.col("class_line")))
    return gone.groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def remove_lines(docs: DataFrame, folder: str | None = None, **parameters) -> DataFrame:
    """`docs` with the removed lines taken out of `text`; all other columns, n_chars too, stay as they are.

    The numbers of the lines are written first. What was written to find them, which has the texts of all lines, is
    deleted then.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "remove-lines")
    verdicts = line_verdicts(docs.select("doc_id", "text"), folder=f"{folder}/verdicts", **parameters)
    gone = written(removed_lines(verdicts), f"{folder}/gone")
    delete(spark, f"{folder}/verdicts")
    key, removed = free_name(docs, "l_row"), free_name(docs, "l_removed")

    def left(lines: Column) -> Column:
        numbers = F.sequence(F.lit(0).cast("bigint"), F.size(lines).cast("bigint") - 1)
        return F.transform(F.array_except(numbers, F.col(removed)), lambda i: F.get(lines, i.cast("int")))

    kept = F.array_join(let(F.split("text", "\n"), left), "\n")
    listed = gone.select(F.col("row").alias(key), F.col("removed").alias(removed))
    joined = docs.withColumn(key, row_key()).join(listed, key, "left")
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(kept)
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
