"""Removal of repeated byte strings by longest-previous-factor arrays, over all documents.

Every byte that lies in a string of `length` bytes which also starts earlier is removed; earlier means a smaller
doc_id, or an earlier start in the same document. That is the case for the strings at positions whose longest previous
factor is at least `length`.

1. Anchors. Each window of `length` bytes picks the gram of `gram` bytes with the smallest hash in it; equal windows
   pick the same one at the same place. Neighbouring windows share anchors, so a document has few runs of windows, one
   per anchor. Of runs with equal anchor and equal bytes, all but the first are repeats; a task settles its own first.
2. Anchors that occur with different surroundings are left. The bytes around them are fetched, and groups of anchors
   are dealt to tasks. Each task builds the suffix order of its windows (prefix doubling up to `length`) and the common
   prefixes of neighbours in it. The previous and the next smaller position in suffix order give each window its
   longest previous factor; where that is `length`, the window has an earlier match and goes.
3. The most frequent anchors, found in a sample of documents (this only routes work), could fill a task. Their windows
   are dealt out one by one instead, by 128 bits of hash, after each task has settled its own.

Whole copies of runs (1) and of single windows of frequent anchors (3) are set aside by two independent 64-bit hashes,
so that no group holds them all; all else is compared by bytes.

Defined results: a null text is empty. A null doc_id comes before all others. Rows with the same doc_id, or none, and
different texts are documents of their own, in an order by a hash of the text; rows with equal id and text are one
document and are cut alike. An empty table gives an empty result. Extra columns are not carried; the result has
doc_id, n_bytes, removed and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow import NULL_ID, Hashes, keyed_texts, mixed, ranges, whole_groups
from tallyloom.session import shared_path

CHUNK_BYTES = 1 << 21
PLACE_BITS = 22  # of a position in a chunk; the rest of a sort key is hash
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

FIRST, REPEAT, FREQUENT = 0, 1, 2

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts, without a copy per row."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _pieces(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Groups of (row, start in row, from, to) of bounded size; long rows overlap by length - 1."""
    group, size = [], 0
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at = a
        while b - at >= length:
            to = min(b, at + CHUNK_BYTES // 2)
            if size + to - at > CHUNK_BYTES and group:
                yield group
                group, size = [], 0
            group.append((row, at - a, at, to))
            size += to - at
            if to == b:
                break
            at = to - length + 1
    if group:
        yield group


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor hash, run hash) of all runs of windows with one anchor."""
    found: list[tuple[np.ndarray, ...]] = []
    width = length - gram + 1
    place = np.uint64((1 << PLACE_BITS) - 1)
    for group in _pieces(offsets, length):
        row, shift, a, b = (np.array(x, np.int64) for x in zip(*group, strict=True))
        size = b - a
        text = np.concatenate([data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        begin = np.cumsum(size) - size
        values = _BYTES[text]
        first, second = Hashes(values, BASES[0]), Hashes(values, BASES[1])
        grams = first.every(gram)
        key = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_sliding_min(key, width) & place).astype(np.int64)
        window = ranges(begin, size - length + 1)
        own = anchor[window]
        new = np.ones(len(window), bool)
        new[1:] = (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1)
        head = np.flatnonzero(new)
        windows = np.diff(np.append(head, len(window)))
        start, at = window[head], own[head]
        part = np.searchsorted(begin, start, "right") - 1
        inner = ((at - start) << 16 | windows).astype(np.uint64)
        run = mixed(second.of(start, windows + length - 1) ^ mixed(inner))
        found.append((row[part], start - begin[part] + shift[part], windows, mixed(grams[at] + np.uint64(1)), run))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _later(
    keys: tuple[np.ndarray, ...], doc: np.ndarray, row: np.ndarray, start: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For rows in any order: whether an equal key is at an earlier position, and which rows are a key's first."""
    order = np.lexsort((start, row, doc, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (row[order] != row[head]) | (start[order] != start[head])
    out, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
    out[order], first[order] = later, new
    return out, first


def _packed(start: np.ndarray, n: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return start << 12 | n << 2 | kind


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(docs: DataFrame, length: int, gram: int, frequent: np.ndarray) -> DataFrame:
    """(a, s, doc, row, at): firsts of each task keyed by anchor; its repeats and frequent anchors spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, start, n, a, s = anchor_runs(*_texts(batch.column(2)), length, gram)
            if not len(place):
                continue
            row, doc = batch.column(0).to_numpy()[place], batch.column(1).to_numpy()[place]
            later, first = _later((a, s), doc, row, start)
            keep = later | first  # a further row at the position of the first adds nothing
            kind = np.where(later, REPEAT, FIRST)
            hot = ~later & np.isin(a, frequent)
            kind[hot] = FREQUENT
            a[hot] = mixed(a[hot] ^ s[hot])
            a[later] = mixed((row[later] * 1_000_003 + start[later]).view(np.uint64))
            s[later] = 0
            own = [pa.array(doc[keep]), pa.array(row[keep]), pa.array(_packed(start, n, kind)[keep])]
            columns = [_signed(a[keep]), _signed(s[keep]), *own]
            for at in range(0, len(columns[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 17) for c in columns], ["a", "s", "doc", "row", "at"])

    return docs.mapInArrow(run, "a bigint, s bigint, doc bigint, row bigint, at bigint")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, s, doc, row, at): repeats, and firsts whose anchor has other surroundings as well."""
    last = None  # (a, s, row, start) of the first row of the present (a, s)
    waiting = None  # the last first: (a, doc, row, at, whether an earlier first has its anchor)

    def out(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "doc", "row", "at"])

    for batch in batches:
        if not batch.num_rows:
            continue
        a, s, doc, row, at = (batch.column(i).to_numpy() for i in range(5))
        kind, start = at & 3, at >> 12
        done = kind == REPEAT
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
        if last is not None:
            new[0] = (a[0], s[0]) != last[:2]
        head = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        known = head >= 0
        head_row = np.where(known, row[head], last[2] if last else 0)
        head_start = np.where(known, start[head], last[3] if last else 0)
        later = done | (~new & ((row != head_row) | (start != head_start)))
        i = head[-1]
        last = (a[i], s[i], row[i], start[i]) if i >= 0 else last
        yield out(a[later], doc[later], row[later], at[later] & ~np.int64(3) | REPEAT)
        hot = new & (kind == FREQUENT)
        yield out(a[hot], doc[hot], row[hot], at[hot])
        pick = np.flatnonzero(new & (kind == FIRST))
        if len(pick):
            firsts = [x[pick] for x in (a, doc, row, at)]
            if waiting is not None:
                firsts = [np.append(old, x) for old, x in zip(waiting, firsts, strict=False)]
            same = firsts[0][1:] == firsts[0][:-1]
            wanted = np.append(waiting[4] if waiting is not None else False, same)
            wanted[:-1] |= same
            waiting = (*(x[-1] for x in firsts), bool(wanted[-1]))
            yield out(*(x[:-1][wanted[:-1]] for x in firsts))
    if waiting is not None and waiting[4]:
        yield out(*(np.array([x], np.int64) for x in waiting[:4]))


def _fetch(length: int):
    """Documents with their wanted runs -> bytes of the runs, or the single windows of frequent anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "s", "doc", "row", "at", "bytes"]
        for batch in batches:
            data, offsets = _texts(batch.column(2))
            asked = batch.column(3)
            count = np.diff(np.frombuffer(asked.buffers()[1], np.int32)[asked.offset : asked.offset + len(asked) + 1])
            flat = asked.flatten()
            a, at = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            place = np.repeat(np.arange(len(asked)), count)
            row, doc = batch.column(0).to_numpy()[place], batch.column(1).to_numpy()[place]
            start, n = at >> 12, at >> 2 & 1023
            begin = offsets[place] + start
            some = np.flatnonzero(at & 3 == FIRST)
            for i in range(0, len(some), 1 << 14):
                p = some[i : i + (1 << 14)]
                size = n[p] + length - 1
                around = pa.Array.from_buffers(
                    pa.binary(),
                    len(p),
                    [
                        None,
                        pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32).tobytes()),
                        pa.py_buffer(data[ranges(begin[p], size)].tobytes()),
                    ],
                )
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, (a[p], np.zeros(len(p), np.int64), doc[p], row[p], at[p])), around], names
                )
            many = np.flatnonzero(at & 3 == FREQUENT)
            for i in range(0, len(many), 1 << 12):
                p = many[i : i + (1 << 12)]
                size = n[p] + length - 1
                values = _BYTES[data[ranges(begin[p], size)]]
                window = ranges(np.cumsum(size) - size, n[p])
                one, two = (Hashes(values, base).of(window, length) for base in BASES)
                each = np.repeat(np.arange(len(p)), n[p])
                w_doc, w_row, w_start = doc[p][each], row[p][each], ranges(start[p], n[p])
                later, first = _later((one, two), w_doc, w_row, w_start)
                keep = later | first
                kind = np.where(later, REPEAT, FREQUENT)
                one[later] = mixed((w_row[later] * 1_000_003 + w_start[later]).view(np.uint64))
                columns = [
                    _signed(one[keep]),
                    _signed(two[keep]),
                    pa.array(w_doc[keep]),
                    pa.array(w_row[keep]),
                    pa.array(_packed(w_start, np.ones(len(each), np.int64), kind)[keep]),
                    pa.nulls(int(keep.sum()), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def suffix_levels(text: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(size, rank of each position by its next `size` bytes) by prefix doubling, `length` last; zeros follow the end."""
    words = np.zeros(len(text) + 8, np.uint64)
    words[: len(text)] = text
    key = np.zeros(len(text), np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | words[i : i + len(text)]
    rank = np.unique(key, return_inverse=True)[1]
    size, levels = 8, [(8, rank.astype(np.int32))]
    while size < length:
        step = min(size, length - size)
        ahead = np.zeros(len(text), np.int64)
        ahead[:-step] = rank[step:]
        rank = np.unique(rank * (len(text) + 1) + ahead, return_inverse=True)[1]
        size += step
        levels.append((size, rank.astype(np.int32)))
    return levels


def common_prefixes(
    text: np.ndarray, levels: list[tuple[int, np.ndarray]], one: np.ndarray, two: np.ndarray
) -> np.ndarray:
    """Bytes that the suffixes at two positions have in common, up to the size of the last level."""
    length, rank = levels[-1]
    whole = rank[one] == rank[two]
    found = np.where(whole, length, 0)
    open_ = np.flatnonzero(~whole)
    p, q, last = one[open_].copy(), two[open_].copy(), len(text) - 1
    for size, rank in reversed(levels[:-1]):
        step = size * (rank[np.minimum(p, last)] == rank[np.minimum(q, last)])
        p += step
        q += step
    alive = np.ones(len(open_), bool)
    for _ in range(7):
        alive &= text[np.minimum(p, last)] == text[np.minimum(q, last)]
        p += alive
        q += alive
    found[open_] = p - one[open_]
    return found


def _before(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the nearest one before it, in suffix order, at a smaller position; 0 for none.

    `common` is that of each suffix with the one right before it. Minima over 2^k entries let all suffixes walk to
    their previous smaller position together.
    """
    low = [np.append(-1, position).astype(np.int32)]
    shared = [np.append(0, common).astype(np.int32)]
    if len(position):
        shared[0][1] = 0
    while 1 << len(low) <= len(position):
        half = 1 << (len(low) - 1)
        for table in (low, shared):
            table.append(table[-1].copy())
            np.minimum(table[-2][half:], table[-2][:-half], out=table[-1][half:])
    own = low[0][1:]
    at, found = np.arange(len(position)), shared[0][1:].copy()
    for k in reversed(range(len(low))):
        skip = np.flatnonzero(low[k][at] >= own)
        found[skip] = np.minimum(found[skip], shared[k][at[skip]])
        at[skip] -= 1 << k
    return found


def previous_factors(text: np.ndarray, at: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factor, up to `length`, of the suffix at each of `at`: what it shares with one at a smaller `position`.

    No suffix at a smaller position shares more than the previous or the next smaller one in suffix order.
    """
    levels = suffix_levels(text, length)
    order = np.lexsort((position, levels[-1][1][at]))
    place, own = at[order], position[order]
    common = np.zeros(len(order), np.int64)
    common[1:] = common_prefixes(text, levels, place[:-1], place[1:])
    back = np.zeros(len(order), np.int64)
    back[1:] = common[:0:-1]
    factor = np.zeros(len(order), np.int64)
    factor[order] = np.maximum(_before(own, common), _before(own[::-1], back)[::-1])
    return factor


def _positions(doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rank of each (doc, row, start); equal ones have one rank."""
    order = np.lexsort((start, row, doc))
    new = np.zeros(len(order), np.int64)
    for x in (doc, row, start):
        new[1:] |= x[order][1:] != x[order][:-1]
    position = np.empty(len(order), np.int64)
    position[order] = np.cumsum(new)
    return position


def _factors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["a"], 1 << 14):
            at, doc, row = (table[c].to_numpy() for c in ("at", "doc", "row"))
            kind, start, n = at & 3, at >> 12, at >> 2 & 1023
            done = kind == REPEAT
            found = [(row[done], at[done])]
            hot = np.flatnonzero(kind == FREQUENT)
            if len(hot):
                a, s = table["a"].to_numpy()[hot], table["s"].to_numpy()[hot]
                later = hot[_later((a, s), doc[hot], row[hot], start[hot])[0]]
                found.append((row[later], at[later]))
            some = np.flatnonzero(kind == FIRST)
            if len(some):
                around = table["bytes"].take(pa.array(some)).combine_chunks()
                around = around if isinstance(around, pa.Array) else pa.concat_arrays(around.chunks)
                data, offsets = _texts(around)
                text = data[offsets[0] : offsets[-1]]
                window = ranges(offsets[:-1] - offsets[0], n[some])
                each = np.repeat(some, n[some])
                w_row, w_start = row[each], ranges(start[some], n[some])
                position = _positions(doc[each], w_row, w_start)
                later = previous_factors(text, window, position, length) >= length
                one = np.ones(int(later.sum()), np.int64)
                found.append((w_row[later], _packed(w_start[later], one, one * REPEAT)))
            row, at = (np.concatenate(x) for x in zip(*found, strict=True))
            row, start, n = _joined(row, at >> 12, at >> 2 & 1023)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(_packed(start, n, np.full(len(row), REPEAT)))], ["row", "at"]
            )

    return run


def _joined(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows that follow each other become one row, of at most 1,000 windows."""
    if not len(row):
        return row, start, n
    order = np.lexsort((start, row))
    row, start, n = row[order], start[order], n[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1])
    head = np.flatnonzero(new)
    size = np.add.reduceat(n, head)
    parts = -(-size // 1000)
    each = np.repeat(np.arange(len(head)), parts)
    inner = ranges(np.zeros(len(head), np.int64), parts) * 1000
    return row[head][each], start[head][each] + inner, np.minimum(1000, size[each] - inner)


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _texts(batch.column(2))
            removed, kept, sizes = [], [], np.diff(offsets)
            for i, listed in enumerate(batch.column(3)):
                text = data[offsets[i] : offsets[i + 1]]
                at = listed.values.to_numpy() if listed.is_valid else np.zeros(0, np.int64)
                if not len(at) or not len(text):
                    removed.append([])
                    kept.append(text.tobytes())
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, np.minimum(at >> 12, len(text)), 1)
                np.add.at(edge, np.minimum((at >> 12) + (at >> 2 & 1023) + length - 1, len(text)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                removed.append([{"start": x, "stop": y} for x, y in turn.reshape(-1, 2).tolist()])
                kept.append(text[~gone].tobytes())
            spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(sizes), pa.array(removed, spans), pa.array(kept, pa.binary())],
                ["doc", "n_bytes", "removed", "kept"],
            )

    return run


def remove_repeats(
    docs: DataFrame, length: int = 100, gram: int = 40, folder: str | None = None, sample: int = 64, often: int = 16
) -> DataFrame:
    """(doc_id, n_bytes, removed spans [start, stop) in bytes, kept bytes) of each row of (doc_id, text).

    One document in `sample` is looked at for frequent anchors; one seen `often` times there may count as frequent.
    """
    if not 8 <= gram < length <= 1000:
        raise ValueError("8 <= gram < length <= 1000")
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "suffix-dedup")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = keyed_texts(docs)
    none = np.zeros(0, np.uint64)
    seen = _runs(given.filter(F.pmod(F.xxhash64("row"), F.lit(sample)) == 0), length, gram, none)
    # Beyond the 8 most frequent anchors per partition, none can have more than an eighth of a partition's share.
    counts = seen.filter(F.col("at").bitwiseAND(3) == FIRST).groupBy("a").count().filter(F.col("count") >= often)
    hot = [r["a"] for r in counts.orderBy(F.desc("count"), "a").limit(8 * parts).collect()]
    frequent = np.array(sorted(hot), np.int64).view(np.uint64)
    sorted_runs = (
        _runs(given, length, gram, frequent).repartition(parts, "a").sortWithinPartitions("a", "s", "doc", "row", "at")
    )
    settled = "a bigint, doc bigint, row bigint, at bigint"
    sorted_runs.mapInArrow(_settle, settled).write.parquet(f"{folder}/runs")
    runs = spark.read.parquet(f"{folder}/runs")
    kind = F.col("at").bitwiseAND(3)
    # The same exchange of the texts serves both joins below.
    texts = given.repartition(parts, "row")
    wanted = runs.filter(kind != REPEAT).groupBy("row").agg(F.collect_list(F.struct("a", "at")).alias("asked"))
    around = texts.join(wanted, "row").mapInArrow(
        _fetch(length), "a bigint, s bigint, doc bigint, row bigint, at bigint, bytes binary"
    )
    factors = (
        around.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(_factors(length), "row bigint, at bigint")
    )
    repeats = runs.filter(kind == REPEAT).select("row", "at").unionByName(factors)
    per_doc = repeats.groupBy("row").agg(F.collect_list("at").alias("gone"))
    spans = "removed array<struct<start:bigint,stop:bigint>>"
    cut = texts.join(per_doc, "row", "left").mapInArrow(
        _cut(length), f"doc bigint, n_bytes bigint, {spans}, kept binary"
    )
    return cut.select(F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), "n_bytes", "removed", "kept")
