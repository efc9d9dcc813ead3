"""Language identification by interpolated Kneser-Ney character models.

Texts become symbol sequences: lower-cased letters, and one boundary for every run of other characters. Spark counts
the n-grams of all training texts per language; continuation counts of the lower orders follow from the distinct
n-grams of the order above. The model has all n-grams, of any number. Up to `max_cells` table cells per order it is
broadcast: sorted arrays of 64-bit hashes with one column of log probabilities per language. A larger one stays a
written table of cells; texts are dealt into blocks of bounded size, and each block's distinct n-grams are joined with
that table. Both ways give the same results. Each whole text gets the language with the lowest cross-entropy per
symbol. It is rejected if that entropy lies above what calibration documents of that language show; all of them are
judged, and their quantiles are right to one rank in RANKS. A language with fewer than ENOUGH rows takes the wider of its own and the pooled limit, and something for the doubt. Without any
calibration row that its own language claims, only texts without a letter are rejected.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected. Rows without text or
language teach nothing; with no training rows every text is `und`. Ties go to the language first in order. Repeated
rows are judged alike and counted each. An empty table gives an empty result. Extra columns are kept; the columns
added here (lang_pred, score, cross_entropy, n_symbols, rejected) replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import shared_path

ORDER = 4
BITS = 16
UNKNOWN = "und"
HARD = "\ue000"  # between texts; never merged with its neighbours
CHUNK_CHARS = 1 << 20
# Odd, so that multiplication is a bijection of 64-bit keys; spreads packed n-grams evenly over the hash range.
MIX = np.uint64(0x9E3779B97F4A7C15)
# Symbols beyond which more text does not make the verdict firmer.
FIRM = 400.0
# Calibration: rows from which a language has a limit of its own, and ranks that its quantiles tell apart; up to so many
# rows they are exact.
ENOUGH, RANKS = 50, 100_000
# Rows of each language that a caller's own bound on calibration rows leaves at the least.
FEWEST = 200
# Added to the limit of a language with fewer rows, divided by the root of their number plus one: a nat per symbol.
DOUBT = FIRM**0.5

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else 0, for the basic plane."""
    if not _LETTERS:
        _LETTERS.append(np.array([i if chr(i).isalpha() else 0 for i in range(1 << 16)], np.uint16))
    return _LETTERS[0]


@dataclass
class Symbols:
    """Symbols of several texts in one array, each text after ORDER - 1 boundaries."""

    symbol: np.ndarray
    start: np.ndarray  # of each text's own symbols
    stop: np.ndarray
    owner: np.ndarray  # index of the text; a long text has several stretches

    def keys(self, order: int = ORDER) -> np.ndarray:
        """Packed n-gram that ends at each symbol."""
        s = self.symbol.astype(np.uint64)
        key = s.copy()
        for back in range(1, order):
            key[back:] |= s[:-back] << np.uint64(BITS * back)
        return key

    def own(self) -> np.ndarray:
        """Marks the symbols that belong to a text."""
        edge = np.zeros(len(self.symbol) + 1, np.int8)
        full = self.start < self.stop
        np.add.at(edge, self.start[full], 1)
        np.add.at(edge, self.stop[full], -1)
        return np.cumsum(edge[:-1]) > 0


def _symbols(stretches: list[str], owner: list[int]) -> Symbols:
    pad = HARD * (ORDER - 1)
    joined = pad + "".join(x + pad for x in stretches)
    point = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    symbol = _letters()[np.minimum(point, 0xFFFF)]
    high = np.flatnonzero(point > 0xFFFF)
    if len(high):
        values, inverse = np.unique(point[high], return_inverse=True)
        folded = [0xE001 + int(v) % 0xFFF if chr(int(v)).isalpha() else 0 for v in values]
        symbol[high] = np.array(folded, np.uint16)[inverse]
    keep = symbol != 0
    keep[1:] |= symbol[:-1] != 0
    hard = point == ord(HARD)
    keep |= hard
    place = np.concatenate([[0], np.cumsum(keep)])
    size = np.array([len(x) for x in stretches], np.int64)
    begin = (ORDER - 1) + np.concatenate([[0], np.cumsum(size + ORDER - 1)])[:-1]
    return Symbols(symbol[keep], place[begin], place[begin + size], np.array(owner, np.int64))


def symbol_chunks(texts: list[str | None]) -> Iterator[Symbols]:
    """All texts in chunks of bounded size. A longer text goes on after a word, or after a cut where it has none."""
    stretches, owner, size = [], [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        for at in range(0, max(len(text), 1), CHUNK_CHARS):
            part = text[at : at + CHUNK_CHARS]
            if size + len(part) > CHUNK_CHARS and stretches:
                yield _symbols(stretches, owner)
                stretches, owner, size = [], [], 0
            stretches.append(part)
            owner.append(i)
            size += len(part) + ORDER
    if stretches:
        yield _symbols(stretches, owner)


@dataclass
class Level:
    """One order: sorted hashes of its n-grams with log probabilities, and of its contexts with log back-off weights."""

    gram: np.ndarray
    logp: np.ndarray  # n-grams x languages
    context: np.ndarray
    backoff: np.ndarray  # contexts x languages


@dataclass
class LanguageModel:
    languages: list[str]
    levels: list[Level] = field(default_factory=list)  # order 1 first
    floor: np.ndarray | None = None  # log probability of a symbol that was never seen, per language
    mean: np.ndarray | None = None  # cross-entropy of calibration documents
    limit: np.ndarray | None = None  # bound of the scaled excess over it
    symbols: int = 0  # distinct symbols of all training texts
    cells: str | None = None  # written table of a model that is not held in `levels`
    block_chars: int = CHUNK_CHARS  # text of a block that is judged with its part of `cells`

    def log_probability(self, key: np.ndarray, order: int) -> np.ndarray:
        """Per n-gram (row) and language: log p(last symbol | those before it)."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(key), len(self.languages)))
        level = self.levels[order - 1]
        out = np.empty((len(key), len(self.languages)), np.float32)
        at, hit = _find(level.gram, key)
        out[hit] = level.logp[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            lower = self.log_probability(_suffix(key[miss], order - 1), order - 1)
            at, seen = _find(level.context, key[miss] >> np.uint64(BITS))
            out[miss] = lower + np.where(seen[:, None], level.backoff[at], np.float32(0))
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of -log p (texts x languages), symbols, and letters of each text."""
        total = np.zeros((len(texts), len(self.languages)))
        count, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for part in symbol_chunks(texts):
            full = part.start < part.stop
            start, stop, owner = part.start[full], part.stop[full], part.owner[full]
            if not len(start):
                continue
            np.add.at(count, owner, stop - start)
            np.add.at(letters, owner, np.diff(np.concatenate([[0], np.cumsum(part.symbol != 0)])[np.c_[start, stop]])[:, 0])
            if self.languages:
                logp = self.log_probability(part.keys(), ORDER)
                logp[~part.own()] = 0
                np.subtract.at(total, owner, np.add.reduceat(logp, start, axis=0, dtype=np.float64))
        return total, count, letters


def _suffix(key: np.ndarray, order: int) -> np.ndarray:
    return key & np.uint64((1 << (BITS * order)) - 1)


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys' hashes in a sorted hash array, and whether they are there."""
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    hashed = key * MIX
    at = np.minimum(np.searchsorted(table, hashed), len(table) - 1)
    return at, table[at] == hashed


def _hashed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashed = key * MIX
    order = np.argsort(hashed)
    return hashed[order], values[order]


def _counts(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over all training texts; each task adds up its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return key, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                key, n = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)],
                    ["lang", "gram", "n"],
                )

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = batch.column(1).filter(pa.array(langs == lang)).to_pylist()
                for part in symbol_chunks(texts):
                    key, n = np.unique(part.keys()[part.own()], return_counts=True)
                    held.setdefault(lang, []).append((key, n))
                    size += len(key)
                if len(held[lang]) > 8:
                    before = sum(len(k) for k, _ in held[lang])
                    held[lang] = [merged(held[lang])]
                    size -= before - len(held[lang][0][0])
            if size > 4_000_000:
                yield from rows()
                held, size = {}, 0
        yield from rows()

    counted = train.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _lower(grams: DataFrame, order: int) -> DataFrame:
    """Continuation counts: in how many distinct n-grams of the order above an n-gram is the end."""
    ending = F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1))
    return grams.groupBy("lang", ending.alias("gram")).agg(F.count("*").alias("n"))


def _shares(grams: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, gram, share): number of the language, and the discounted share of its context's mass."""
    ones = grams.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long")))
    discount = dict.fromkeys(languages, 0.5)
    for lang, one, two in ones.collect():
        discount[lang] = min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
    numbers = grams.sparkSession.createDataFrame(
        [(x, i, discount[x]) for i, x in enumerate(languages)], "lang string, number int, discount double"
    )
    context = F.call_function("shiftrightunsigned", "gram", F.lit(BITS)).alias("context")
    totals = grams.groupBy("lang", context).agg(F.sum("n").alias("total"))
    joined = grams.select("lang", "gram", "n", context).join(totals, ["lang", "context"])
    # One row per language: at most 10,000.
    return joined.join(F.broadcast(numbers), "lang").select(
        F.col("number").alias("lang"), "gram", ((F.col("n") - F.col("discount")) / F.col("total")).alias("share")
    )


def fit_languages(
    train: DataFrame,
    calibration: DataFrame,
    max_cells: int = 4_000_000,
    calibration_rows: int | None = None,
    quantile: float = 0.999,
    slack: float = 1.25,
) -> LanguageModel:
    """Fit on (lang, text) rows; `calibration` has the same columns and should hold other rows.

    `max_cells` decides only where the model lies, in memory or in a table. All calibration rows count, unless a caller
    gives `calibration_rows`: then about so many do, dealt evenly to the languages, but FEWEST of each that has them.
    """
    spark = train.sparkSession
    path = shared_path(spark, "langid-grams")
    known = train.filter("lang is not null and text is not null")
    _counts(known).write.parquet(path)
    grams = spark.read.parquet(path)
    # Languages are names in the labels; a label set beyond this bound is not one of languages.
    languages = [r[0] for r in grams.select("lang").distinct().orderBy("lang").limit(10_001).collect()]
    if len(languages) > 10_000:
        raise ValueError("More than 10,000 languages")
    model = LanguageModel(languages)
    if not languages:
        return model
    tables = [grams]
    for order in range(ORDER - 1, 0, -1):
        tables.append(_lower(tables[-1], order))
    # The highest order has the most rows: each n-gram of a lower one is the end of another one above.
    if grams.count() <= max_cells // len(languages):
        for order, table in enumerate(reversed(tables), 1):
            cells = _shares(table, languages).toArrow()
            gram, lang, share = (cells[c].to_numpy() for c in ("gram", "lang", "share"))
            gram = gram.view(np.uint64)
            # What the n-grams leave of a context's mass goes to the order below.
            context, place = np.unique(gram >> np.uint64(BITS), return_inverse=True)
            rest = np.ones((len(context), len(languages)))
            np.subtract.at(rest, (place, lang), share)
            rest = np.maximum(rest, 1e-9)
            if order == 1:
                model.symbols = len(np.unique(gram))
                model.floor = np.log(rest[0] / (model.symbols + 1000.0)).astype(np.float32)
            _add_level(model, order, gram, lang, share, context, rest)
    else:
        _write_cells(model, tables[::-1], shared_path(spark, "langid-cells"))
        model.block_chars = max(max_cells // len(languages), 1 << 10)
    _calibrate(model, calibration, calibration_rows, quantile, slack)
    return model


def _write_cells(model: LanguageModel, tables: list[DataFrame], path: str) -> None:
    """The model as rows (level, key, lang, value): shares of n-grams at level `order`, what they leave of their
    contexts at level -`order`."""
    spark = tables[0].sparkSession
    for order, table in enumerate(tables, 1):
        _shares(table, model.languages).write.parquet(f"{path}/shares/{order}")
        shares = spark.read.parquet(f"{path}/shares/{order}")
        context = F.call_function("shiftrightunsigned", "gram", F.lit(BITS)).alias("key")
        rest = shares.groupBy(context, "lang").agg(F.greatest(1 - F.sum("share"), F.lit(1e-9)).alias("value"))
        if order == 1:
            model.symbols = shares.agg(F.count_distinct("gram")).first()[0]
            left = np.ones(len(model.languages))
            for r in rest.collect():
                left[r["lang"]] = r["value"]
            model.floor = np.log(left / (model.symbols + 1000.0)).astype(np.float32)
        level = F.lit(order).alias("level")
        cells = shares.select(level, F.col("gram").alias("key"), "lang", F.col("share").alias("value"))
        if order > 1:
            cells = cells.unionByName(rest.select(F.lit(-order).alias("level"), "key", "lang", "value"))
        cells.write.mode("append").parquet(f"{path}/cells")
    model.cells = f"{path}/cells"


def _add_level(
    model: LanguageModel,
    order: int,
    gram: np.ndarray,
    lang: np.ndarray,
    share: np.ndarray,
    contexts: np.ndarray,
    rest: np.ndarray,
) -> None:
    """Add an order; `contexts` are sorted, and the ends of all n-grams are in the order below."""
    width = len(model.languages)
    keys, row = np.unique(gram, return_inverse=True)
    if order == 1:
        # The lowest order backs off to an even spread over all symbols that may come.
        p = np.repeat(np.exp(model.floor.astype(float))[None, :], len(keys), axis=0)
    else:
        lower = np.exp(model.log_probability(_suffix(keys, order - 1), order - 1).astype(float))
        p = rest[np.searchsorted(contexts, keys >> np.uint64(BITS))] * lower
    np.add.at(p, (row, lang), share)
    hashed, logp = _hashed(keys, np.log(p).astype(np.float32))
    if order == 1:
        model.levels.append(Level(hashed, logp, np.zeros(0, np.uint64), np.zeros((1, width), np.float32)))
    else:
        context, backoff = _hashed(contexts, np.log(rest).astype(np.float32))
        model.levels.append(Level(hashed, logp, context, backoff))


def _part_of(model: LanguageModel, cells: pa.Table) -> LanguageModel:
    """The model with the levels that stand in some rows of its table."""
    part = replace(model, levels=[], cells=None)
    level, lang, value = (cells[c].to_numpy() for c in ("level", "lang", "value"))
    key = cells["key"].to_numpy().view(np.uint64)
    for order in range(1, ORDER + 1):
        own, above = level == order, level == -order
        contexts, place = np.unique(key[above], return_inverse=True)
        rest = np.ones((len(contexts), len(model.languages)))
        rest[place, lang[above]] = value[above]
        _add_level(part, order, key[own], lang[own], value[own], contexts, rest)
    return part


def _calibrate(model: LanguageModel, rows: DataFrame, most: int | None, quantile: float, slack: float) -> None:
    """Means and limits from the rows that their own language claims, all unless `most` is given; their scores go to the shared folder."""
    known = rows.filter("lang is not null and text is not null").select("lang", "text")
    names = rows.sparkSession.createDataFrame([(x,) for x in model.languages], "lang string")
    known = known.join(F.broadcast(names), "lang", "left_semi")
    if most is not None:
        each = max(most // len(model.languages), FEWEST)
        shares = known.groupBy("lang").agg(F.least(F.lit(1.0), each / F.count("*")).alias("share"))
        known = known.join(F.broadcast(shares), "lang").filter(
            F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_003)) < (F.col("share") * 1_000_003).cast("int") + 1
        ).select("lang", "text")
    path = shared_path(rows.sparkSession, "langid-calibration")
    own = scored(known, model).filter("lang = lang_pred")
    own.select("lang", "cross_entropy", "n_symbols").write.parquet(path)
    found = rows.sparkSession.read.parquet(path)
    width = len(model.languages)
    number = {x: i for i, x in enumerate(model.languages)}
    middle = F.percentile_approx("cross_entropy", 0.5, RANKS).alias("mean")
    overall = found.agg(middle).first()["mean"]
    if overall is None:
        # Nothing is known of any language's own texts.
        model.mean, model.limit = np.zeros(width), np.full(width, np.inf)
        return
    # A language without a row of its own is judged by the rows of all.
    mean = np.full(width, overall)
    means = found.groupBy("lang").agg(middle)
    for r in means.collect():
        mean[number[r["lang"]]] = r["mean"]
    firm = F.sqrt(F.least(F.col("n_symbols").cast("double"), F.lit(FIRM)))
    # One row per language: at most 10,000.
    excess = found.join(F.broadcast(means), "lang").select("lang", ((F.col("cross_entropy") - F.col("mean")) * firm).alias("excess"))
    tail = F.percentile_approx("excess", quantile, RANKS).alias("tail")

    def bound(highest: float) -> float:
        return max(slack * highest, 1.0)

    # Few rows say less of their tail, and the fewer the less: what is added is small against foreign text.
    pooled = bound(excess.agg(tail).first()["tail"])
    limit = np.full(width, pooled + DOUBT)
    for r in excess.groupBy("lang").agg(tail, F.count("*").alias("n")).collect():
        i, some = number[r["lang"]], bound(r["tail"])
        limit[i] = some if r["n"] >= ENOUGH else max(pooled, some) + DOUBT / np.sqrt(r["n"] + 1)
    model.mean, model.limit = mean, limit


def scored(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds lang_pred, score, cross_entropy (nats per symbol), n_symbols and rejected."""
    added = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("cross_entropy", T.DoubleType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("rejected", T.BooleanType()),
    ]
    names = {f.name for f in added}
    given = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in names])
    schema = T.StructType([*given.schema.fields, *added])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if model.cells is not None:
        return _scored_by_blocks(given, shared, text, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _judged(shared.value, batch, text, schema.names)

    return given.mapInArrow(run, schema)


def _judged(m: LanguageModel, batch: pa.RecordBatch, text: str, names: list[str]) -> pa.RecordBatch:
    languages = np.array([*m.languages, UNKNOWN], object)
    total, count, letters = m.cross_entropies(batch.column(batch.schema.get_field_index(text)).to_pylist())
    known = (letters > 0) & bool(m.languages)
    best, score, entropy = np.full(len(count), -1), np.zeros(len(count)), np.full(len(count), np.nan)
    reject = ~known
    if known.any():
        mean = total[known] / count[known][:, None]
        top = mean.argmin(axis=1)
        lowest = mean[np.arange(len(top)), top]
        firm = np.minimum(count[known], FIRM / 8)[:, None]
        best[known], entropy[known] = top, lowest
        score[known] = 1 / np.exp((lowest[:, None] - mean) * firm).sum(axis=1)
        if m.limit is not None:
            excess = (lowest - m.mean[top]) * np.sqrt(np.minimum(count[known], FIRM))
            reject[known] = excess > m.limit[top]
    return pa.RecordBatch.from_arrays(
        [
            *batch.columns,
            pa.array(languages[best].tolist(), pa.string()),
            pa.array(score),
            pa.array(entropy, mask=~known),
            pa.array(count),
            pa.array(reject),
        ],
        names,
    )


def _runs(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which the integer columns do not change."""
    change = np.zeros(batch.num_rows, bool)
    for c in columns:
        values = batch.column(batch.schema.get_field_index(c)).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _in_blocks(text: str, chars: int):
    """Adds b_block, which a task counts on whenever it has read `chars` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).to_pylist()
            ids = np.empty(batch.num_rows, np.int64)
            for i, x in enumerate(column):
                if size >= chars:
                    block, size = block + 1, 0
                ids[i] = block
                size += len(x or "") + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], [*batch.schema.names, "b_block"])

    return run


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b_block, level, key) of (b_block, text): all that a block's texts look up, once for each block and task."""
    held: dict[int, list[np.ndarray]] = {}
    at = None

    def rows() -> Iterator[pa.RecordBatch]:
        for order, parts in held.items():
            key = np.unique(np.concatenate(parts))
            for level, k in ((order, key), (-order, np.unique(key >> np.uint64(BITS)))):
                if level != -1:
                    columns = [np.full(len(k), at, np.int64), np.full(len(k), level, np.int32), k.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["b_block", "level", "key"])

    for batch in batches:
        for part in _runs(batch, "b_block"):
            block = part.column(0)[0].as_py()
            if block != at:
                yield from rows()
                held, at = {}, block
            for symbols in symbol_chunks(part.column(1).to_pylist()):
                key = np.unique(symbols.keys()[symbols.own()])
                for order in range(1, ORDER + 1):
                    held.setdefault(order, []).append(np.unique(_suffix(key, order) if order < ORDER else key))
            held = {order: [np.unique(np.concatenate(parts))] for order, parts in held.items()}
    yield from rows()


def _scored_by_blocks(given: DataFrame, shared, text: str, schema: T.StructType) -> DataFrame:
    """Every block of texts meets the cells of its own n-grams, sorted before the texts, in one task."""
    spark = given.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "langid-blocks")
    block = T.StructField("b_block", T.LongType())
    given.mapInArrow(_in_blocks(text, shared.value.block_chars), T.StructType([*given.schema.fields, block])).write.parquet(path)
    dealt = spark.read.parquet(path)
    wanted = dealt.select("b_block", F.col(f"`{text}`").alias("text"))
    wanted = wanted.mapInArrow(_requests, "b_block bigint, level int, key bigint").distinct()
    cells = wanted.join(spark.read.parquet(shared.value.cells), ["level", "key"])
    names = ["level", "key", "lang", "value"]
    cells = cells.select("b_block", F.lit(0).alias("b_text"), *[F.col(c).alias(f"b_{c}") for c in names])
    texts = dealt.withColumn("b_text", F.lit(1))
    both = cells.unionByName(texts, allowMissingColumns=True)
    own = given.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, model = [], None, None
        for batch in batches:
            for part in _runs(batch, "b_block", "b_text"):
                block = part.column(part.schema.get_field_index("b_block"))[0].as_py()
                if block != at:
                    held, at, model = [], block, None
                if part.column(part.schema.get_field_index("b_text"))[0].as_py() == 0:
                    part = part.select([f"b_{c}" for c in names])
                    held.append(pa.Table.from_batches([part]).rename_columns(names))
                    continue
                if model is None:
                    empty = pa.table({"level": np.zeros(0, np.int32), "key": np.zeros(0, np.int64), "lang": np.zeros(0, np.int32), "value": np.zeros(0)})
                    model = _part_of(shared.value, pa.concat_tables(held) if held else empty)
                    held = []
                yield _judged(model, part.select(own), text, schema.names)

    return both.repartition(parts, "b_block").sortWithinPartitions("b_block", "b_text").mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    """0 to 4 by the checksum of the id as text; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)), F.lit(0))


def fit_by_folds(docs: DataFrame) -> LanguageModel:
    """Counts on folds 2 to 4, calibration on fold 1; fold 0 is never learned from."""
    part = fold(F.col("doc_id"))
    return fit_languages(docs.filter(part >= 2).select("lang", "text"), docs.filter(part == 1).select("lang", "text"))
