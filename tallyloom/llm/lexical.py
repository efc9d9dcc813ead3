"""Ranked lexical search: an inverted index in shards and best-first search over intervals of documents.

build_index() writes, for each shard of neighbouring rows, one posting list per term (positions in the shard, in order
of doc_id, and occurrences) and the shard's document lengths. search() weighs the terms by counts over all shards.
In a shard a query starts with the interval of all documents. A sparse table over each posting list finds the largest
impact of a term in any interval (range maximum); the sum over the query's terms bounds the score of every document in
it. Intervals are opened by falling bound, the best of each query first and some more per round: the document of the
largest single impact is scored, and the interval splits there into two with bounds of their own. Intervals that have
few postings left are scored whole. An interval goes when its bound is below the query's kth score, or equals it
and has only later documents.

The kth scores of a pilot (one shard in PILOT) go along with the queries to all other shards. Queries are dealt to
blocks of BLOCK_ITEMS, posting lists go only to blocks that hold their term, and each (shard, block) is one group.

Defined results: a null or empty text has no terms; such documents count nowhere and such items have no rows. Rows with
one doc_id, or none, are documents of their own; a null doc_id comes after all others among equal scores. Rows with one
item_id, or none, are one item that has the terms of all. Equal scores go to the smaller doc_id. Empty tables give an
empty result. Extra columns are not read. A text must stay below 2 GB.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.arrow import ranges
from tallyloom.session import shared_path

SHARD_DOCS = 4096
SHARD_BYTES = 16 << 20
BLOCK_ITEMS = 256
PILOT = 16
SHARDS_OF_A_COPY = 16
LEAF_POSTINGS = 256  # intervals with fewer postings of the query's terms are scored whole
WIDEST = 64  # intervals opened per query and round at most

# Terms are runs of ASCII letters and digits and of all bytes beyond ASCII; letters A-Z become lower case, others are 0.
_LOWER = np.zeros(256, np.uint8)
_LOWER[128:] = np.arange(128, 256)
_LOWER[48:58] = np.arange(48, 58)
_LOWER[97:123] = np.arange(97, 123)
_LOWER[65:91] = np.arange(97, 123)

INDEX = "kind string, shard bigint, term string, n_docs bigint, n_terms bigint, at binary, tf binary, ids binary, absent binary"


def terms_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms in order, dictionary-encoded, and the number of terms of each text (null: none)."""
    if not len(texts):
        return pa.array([], pa.large_string()).dictionary_encode(), np.zeros(0, np.int64)
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    low = _LOWER[raw]
    inside = low != 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True  # terms end with their text
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], np.cumsum(stops - starts)])
    data = low[inside]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words.dictionary_encode(), np.diff(np.searchsorted(starts, ends))


def _shard_rows(shard: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The index rows of a shard: its documents first, then one row per term."""
    order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_end")
    ids, texts = ids.take(order), texts.take(order)
    words, count = terms_of(texts)
    vocabulary = words.dictionary.cast(pa.string())
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.repeat(np.arange(len(ids)), count)
    keys, tf = np.unique(code * len(ids) + place, return_counts=True)
    of, at = np.divmod(keys, max(len(ids), 1))
    cuts = np.searchsorted(of, np.arange(len(vocabulary) + 1)) * 4
    blob = lambda a: pa.Array.from_buffers(
        pa.binary(), len(vocabulary), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(a.astype(np.int32))]
    )
    none, size = pa.nulls(1, pa.binary()), len(vocabulary)
    fixed = {
        "kind": pa.array(["docs"] + ["terms"] * size),
        "shard": pa.array(np.full(size + 1, shard)),
        "term": pa.concat_arrays([pa.nulls(1, pa.string()), vocabulary]),
        "n_docs": pa.array(np.append([(count > 0).sum()], np.diff(cuts) // 4)),
        "n_terms": pa.array(np.append([count.sum()], np.zeros(size, np.int64))),
        "at": pa.concat_arrays([none, blob(at)]),
        "tf": pa.concat_arrays([pa.array([count.astype(np.int64).tobytes()], pa.binary()), blob(tf)]),
        "ids": pa.concat_arrays([pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()), pa.nulls(size, pa.binary())]),
        "absent": pa.concat_arrays([pa.array([ids.is_null().to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.nulls(size, pa.binary())]),
    }
    return pa.RecordBatch.from_pydict(fixed)


def build_index(docs: DataFrame, path: str | None = None, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the index of a table of (doc_id bigint, text) and returns it; `path` is a folder that all executors reach.

    A task cuts its rows into shards, so texts are not shuffled; a shard has at most `shard_docs` documents, and ends
    with the text that reaches `shard_bytes`.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        docs = size = made = 0

        def closed() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column(0) for b in held])
            texts = pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in held])
            return _shard_rows((TaskContext.get().partitionId() << 32) + made, ids, texts)

        for batch in batches:
            lengths = np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(float))
            start = 0
            while start < batch.num_rows:
                upto = size + np.cumsum(lengths[start:])
                take = min(int(np.searchsorted(upto, shard_bytes)) + 1, shard_docs - docs, batch.num_rows - start)
                held.append(batch.slice(start, take))
                docs, size, start = docs + take, float(upto[take - 1]), start + take
                if docs >= shard_docs or size >= shard_bytes:
                    yield closed()
                    held, docs, size, made = [], 0, 0, made + 1
        if held:
            yield closed()

    spark = docs.sparkSession
    path = path or shared_path(spark, "lexical-index")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(shards, INDEX)
    rows.write.partitionBy("kind").parquet(path)
    return spark.read.schema(INDEX).parquet(path)


class Postings:
    """Posting lists of one shard with impacts, and sparse tables of the places of their maxima."""

    def __init__(self, term: np.ndarray, at: np.ndarray, impact: np.ndarray, size: int):
        """Postings sorted by (term, at); `size` is the number of documents."""
        self.at, self.impact, self.size = at, impact, size
        self.key = term * (size + 1) + at
        n = len(at)
        longest = int(np.bincount(term).max()) if n else 0
        self.table = np.empty((max(longest.bit_length(), 1), n), np.int32)
        self.table[0] = np.arange(n)
        for level in range(1, len(self.table)):
            below = self.table[level - 1]
            # Entries whose reach leaves their list are never asked for.
            other = below[np.minimum(np.arange(n) + (1 << (level - 1)), n - 1)]
            self.table[level] = np.where(impact[other] > impact[below], other, below)

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the largest impact in low .. high - 1 (not empty)."""
        level = np.frexp(high - low)[1] - 1
        one, two = self.table[level, low], self.table[level, high - (1 << level)]
        return np.where(self.impact[two] > self.impact[one], two, one)


class Search:
    """Best-first search of a block of queries; a query is a set of (term, lower bound of its kth score)."""

    def __init__(self, postings: Postings, query: np.ndarray, term: np.ndarray, floor: np.ndarray, k: int):
        """Rows (query, term), sorted by query; `floor` is per query."""
        self.p, self.k = postings, k
        self.score = np.zeros((len(floor), k), np.int64)
        self.found = np.full((len(floor), k), postings.size, np.int64)
        self.kth, self.last = floor.astype(np.int64).copy(), np.full(len(floor), postings.size)
        self.scored = 0
        low = np.searchsorted(postings.key, term * (postings.size + 1))
        high = np.searchsorted(postings.key, term * (postings.size + 1) + postings.size)
        some = high > low
        self.term, self.low, self.high = term[some], low[some], high[some]
        own = np.unique(query[some], return_counts=True)
        self.query, self.first, self.count = own[0], np.zeros(len(own[0]), np.int64), own[1]

    def _keep_best(self, query: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        """Scored documents, each (query, at) once in the whole search."""
        self.scored += len(query)
        good = (score > self.kth[query]) | ((score == self.kth[query]) & (at < self.last[query]) & (score > 0))
        query, at, score = query[good], at[good], score[good]
        if not len(query):
            return
        asked = np.unique(query)
        all_q = np.concatenate([query, np.repeat(asked, self.k)])
        all_s = np.concatenate([score, self.score[asked].ravel()])
        all_d = np.concatenate([at, self.found[asked].ravel()])
        order = np.lexsort((all_d, -all_s, all_q))
        place = np.arange(len(order)) - np.searchsorted(all_q[order], all_q[order])
        order, place = order[place < self.k], place[place < self.k]
        self.score[all_q[order], place] = all_s[order]
        self.found[all_q[order], place] = all_d[order]
        full = self.score[asked, -1] > 0
        higher = full & (self.score[asked, -1] >= self.kth[asked])
        # Found here: later documents of the same score lose. The floor of other shards leaves ties open.
        self.kth[asked[higher]] = self.score[asked[higher], -1]
        self.last[asked[higher]] = self.found[asked[higher], -1]

    def _bounded(self, bound: np.ndarray, query: np.ndarray, start: np.ndarray) -> np.ndarray:
        kth = self.kth[query]
        return (bound > 0) & ((bound > kth) | ((bound == kth) & (start < self.last[query])))

    def run(self) -> Search:
        p = self.p
        # Intervals: (query, start, bound, rows first .. first + count) over rows (term, low, high).
        query, count = self.query, self.count
        first = np.cumsum(count) - count
        term, low, high = self.term, self.low, self.high
        start = np.zeros(len(query), np.int64)
        top = p.largest(low, high) if len(low) else low
        bound = np.add.reduceat(p.impact[top], first) if len(query) else first
        weight = np.add.reduceat(high - low, first) if len(query) else first
        width = 1
        while len(query):
            order = np.lexsort((-bound, query))
            place = np.empty(len(query), np.int64)
            place[order] = np.arange(len(query)) - np.searchsorted(query[order], query[order])
            now = place < width
            opened, rest = np.flatnonzero(now), np.flatnonzero(~now)
            small = weight[opened] <= LEAF_POSTINGS
            self._score_whole(opened[small], query, first, count, low, high)
            split = opened[~small]
            fresh = self._split(split, query, start, first, count, term, low, high)
            # What is left, with the new intervals, in new arrays.
            rows = ranges(first[rest], count[rest])
            term, low, high = (np.concatenate([a[rows], b]) for a, b in zip((term, low, high), fresh[4:], strict=True))
            query, start, bound, count = (
                np.concatenate([a[rest], b]) for a, b in zip((query, start, bound, count), fresh[:4], strict=True)
            )
            live = self._bounded(bound, query, start)
            first = np.cumsum(count) - count
            if not live.all():
                rows = ranges(first[live], count[live])
                term, low, high = term[rows], low[rows], high[rows]
                query, start, bound, count = query[live], start[live], bound[live], count[live]
                first = np.cumsum(count) - count
            weight = np.add.reduceat(high - low, first) if len(query) else first
            width = min(2 * width, WIDEST)
        return self

    def _score_whole(self, chosen, query, first, count, low, high) -> None:
        """All documents of some intervals."""
        if not len(chosen):
            return
        p = self.p
        rows = ranges(first[chosen], count[chosen])
        size = high[rows] - low[rows]
        posts = ranges(low[rows], size)
        owner = np.repeat(np.repeat(np.arange(len(chosen)), count[chosen]), size)
        key, inverse = np.unique(owner * p.size + p.at[posts], return_inverse=True)
        score = np.zeros(len(key), np.int64)
        np.add.at(score, inverse, p.impact[posts])
        self._keep_best(query[chosen[key // p.size]], key % p.size, score)

    def _split(self, chosen, query, start, first, count, term, low, high):
        """Scores the documents of the largest impact and returns the intervals on both sides of each."""
        p = self.p
        if not len(chosen):
            none = np.zeros(0, np.int64)
            return (none,) * 7
        rows = ranges(first[chosen], count[chosen])
        t, a, b = term[rows], low[rows], high[rows]
        head = np.cumsum(count[chosen]) - count[chosen]
        owner = np.repeat(np.arange(len(chosen)), count[chosen])
        top = p.largest(a, b)
        most = np.maximum.reduceat(p.impact[top], head)
        is_most = p.impact[top] == most[owner]
        at_most = np.flatnonzero(is_most)
        _, which = np.unique(owner[at_most], return_index=True)
        cut = p.at[top[at_most[which]]]  # one document for each interval
        middle = np.searchsorted(p.key, t * (p.size + 1) + cut[owner])
        middle = np.clip(middle, a, b)
        has = (middle < b) & (p.at[np.minimum(middle, len(p.at) - 1)] == cut[owner])
        gain = np.where(has, p.impact[np.minimum(middle, len(p.at) - 1)], 0)
        self._keep_best(query[chosen], cut, np.add.reduceat(gain, head))
        sides = []
        for left, right, begin in ((a, middle, start[chosen]), (middle + has, b, cut + 1)):
            full = np.flatnonzero(right > left)
            own, size = np.unique(owner[full], return_counts=True)
            if not len(own):
                continue
            best = p.impact[p.largest(left[full], right[full])]
            bound = np.add.reduceat(best, np.cumsum(size) - size)
            sides.append((query[chosen[own]], begin[own], bound, size, t[full], left[full], right[full]))
        if not sides:
            none = np.zeros(0, np.int64)
            return (none,) * 7
        return tuple(np.concatenate(x) for x in zip(*sides, strict=True))


def term_weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """100 - 90 + (90 * length * n) div total, in whole numbers of any size."""
    if 90.0 * float(lengths.max(initial=0)) * n < 2.0**62:
        return 10 + (90 * lengths * n) // total
    return np.array([10 + 90 * int(x) * n // total for x in lengths])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of a table of (item_id, text)."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, count = terms_of(batch.column(1))
            owner = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), count)))
            yield pa.RecordBatch.from_arrays([owner, words.cast(pa.large_string()).cast(pa.string())], names=["item_id", "term"])

    picked = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    return picked.mapInArrow(terms, "item_id bigint, term string").distinct()


def search(index: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS, pilot: int = PILOT) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, over an index of build_index()."""
    spark = index.sparkSession
    docs = index.filter("kind = 'docs'").select("shard", "n_docs", "n_terms", F.lit(None).cast("string").alias("term"), "at", "tf", "ids", "absent")
    lists = index.filter("kind = 'terms'").select("shard", "n_docs", "n_terms", "term", "at", "tf", "ids", "absent")
    totals = docs.agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
    n, total, copies = int(totals[0] or 0), int(totals[1] or 0), -(-totals[2] // SHARDS_OF_A_COPY) or 1
    folder = shared_path(spark, "lexical-query")
    item_terms(items).write.parquet(f"{folder}/asked")
    asked = spark.read.parquet(f"{folder}/asked")
    blocks = max(1, math.ceil(asked.select("item_id").distinct().count() / block_items))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")
    wanted = asked.select("term").distinct().withColumnRenamed("term", "q_term")
    matched = lists.join(wanted, F.col("term") == F.col("q_term"))
    df = matched.groupBy("q_term").agg(F.sum("n_docs").alias("df"))
    asked.join(df, asked["term"] == df["q_term"]).select(block, "item_id", "term", "df").write.parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")

    def found(group: pa.Table, packed: pa.Table) -> pa.Table:
        out = {name: pa.array([], pa.int64()) for name in ("item_id", "doc_id", "score")}
        if not packed.num_rows or not group.num_rows:
            return pa.table(out)
        whole = group.filter(pc.is_null(group["term"])).to_pylist()[0]
        group = group.filter(pc.is_valid(group["term"])).sort_by("term")
        lengths = np.frombuffer(whole["tf"], np.int64)
        rows = packed["asked"].combine_chunks().flatten()
        names = group["term"].combine_chunks()
        place = pc.index_in(rows.field("term"), value_set=names)
        here = pc.is_valid(place)
        rows, place = rows.filter(here), place.filter(here).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(rows):
            return pa.table(out)
        weight = np.zeros(len(names), np.int64)
        frequency = rows.field("df").to_numpy(zero_copy_only=False)
        known = {x: term_weight(n, int(x)) for x in np.unique(frequency)}
        weight[place] = [known[x] for x in frequency]
        joined = lambda name: np.frombuffer(b"".join(group[name].to_pylist()), np.int32).astype(np.int64)
        at, tf = joined("at"), joined("tf")
        of = np.repeat(np.arange(len(names)), pc.binary_length(group["at"]).to_numpy() // 4)
        impact = weight[of] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norms(lengths, n, total)[at]))
        items = rows.field("item_id").fill_null(0).to_numpy(zero_copy_only=False)
        blank = rows.field("item_id").is_null().to_numpy(zero_copy_only=False)
        floors = rows.field("floor").to_numpy(zero_copy_only=False)
        order = np.lexsort((place, items, blank))
        items, blank, place, floors = items[order], blank[order], place[order], floors[order]
        change = np.append([True], (items[1:] != items[:-1]) | (blank[1:] != blank[:-1]))
        query = np.cumsum(change) - 1
        result = Search(Postings(of, at, impact, len(lengths)), query, place, floors[change], k).run()
        q, slot = np.nonzero(result.score > 0)
        doc = result.found[q, slot]
        absent = np.frombuffer(whole["absent"], bool)[doc]
        return pa.table(
            {
                "item_id": pa.array(items[change][q], pa.int64(), mask=blank[change][q]),
                "doc_id": pa.array(np.frombuffer(whole["ids"], np.int64)[doc], pa.int64(), mask=absent),
                "score": pa.array(result.score[q, slot], pa.int64()),
            }
        )

    def over(chosen: Column, floors: DataFrame | None) -> DataFrame:
        """Candidates from the shards that `chosen` selects."""
        priced = terms.withColumn("floor", F.lit(0).cast("bigint"))
        if floors is not None:
            f = floors.select(F.col("item_id").alias("f_item"), F.col("kth"))
            priced = terms.join(f, F.col("item_id").eqNullSafe(F.col("f_item")), "left").select(
                *terms.columns, F.coalesce("kth", F.lit(0).cast("bigint")).alias("floor")
            )
        packed = priced.groupBy("block").agg(F.collect_list(F.struct("item_id", "term", "df", "floor")).alias("asked"))
        every_block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block")
        spread = docs.filter(chosen).select(every_block, *lists.columns)
        per_block = terms.select("block", F.col("term").alias("q_term")).distinct()
        part = lists.filter(chosen).join(per_block, F.col("term") == F.col("q_term")).select("block", *lists.columns)
        left = spread.unionByName(part)
        # A block's row goes to all shards; copies of it keep that from being the work of one task.
        every_copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))).alias("p_copy")
        copied = packed.select(F.col("block").alias("p_block"), "asked", every_copy)
        pairs = docs.filter(chosen).select(every_block, "shard", F.pmod(F.xxhash64("shard"), F.lit(copies)).alias("copy"))
        right = pairs.join(copied, (F.col("block") == F.col("p_block")) & (F.col("copy") == F.col("p_copy")))
        right = right.select(F.col("block").alias("r_block"), F.col("shard").alias("r_shard"), "asked")
        return (
            left.groupBy("block", "shard")
            .cogroup(right.groupBy("r_block", "r_shard"))
            .applyInArrow(found, "item_id bigint, doc_id bigint, score bigint")
        )

    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = F.pmod(F.xxhash64("shard"), F.lit(pilot)) == 0
    seen = over(first, None).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    floors = seen.groupBy("item_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") >= k)
    everywhere = over(F.lit(True), floors)
    ranked = everywhere.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
