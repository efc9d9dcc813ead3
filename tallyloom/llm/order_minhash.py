"""Order MinHash fingerprints of documents, in built-in expressions only.

A text is cut into units: words, pieces of at most PIECE code points of longer ones, and single characters of scripts
that are written without spaces. Each run of `words` units is a k-mer; its occurrences in the text are numbered, so that
each (k-mer, number) is an element of its own. Elements are dealt to buckets by hash. In each bucket the `picks`
elements of smallest hash are taken, put back into the order in which they stand in the text, and the tuple of their
k-mers is hashed. A fingerprint is the list of these hashes; two texts agree in a bucket only if they share its smallest
k-mers in the same order, so moved text lowers the likeness as an edit does, while a set of shingles would not see it.

Elements get one hash each and the buckets stand for the independent hash functions of the scheme; empty buckets of both
texts count for neither. Equal k-mers of a text are found by one sort of longs, hash above and position below.

Defined results: a null text is empty; a text without units (empty or blank) has an empty fingerprint, and two such
fingerprints have likeness 1, one with any other 0. A text with fewer units than a k-mer is one k-mer. Equal texts have
equal fingerprints. Only a text's size bounds the work on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.binding import let
from tallyloom.operators.ranking import with_position
from tallyloom.session import shared_path

PIECE = 32
# Thai and Lao, Burmese, Khmer, kana, Han: as ranges, which a regular expression tests far faster than scripts.
UNSPACED = (
    "\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u3040-\\u30FF"
    "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{3FFFF}"
)
UNIT = f"[^\\x20\\x09-\\x0D{UNSPACED}]{{1,{PIECE}}}|[{UNSPACED}]"


@dataclass(frozen=True)
class Sketch:
    """Parameters of a fingerprint; fingerprints of different ones cannot be compared."""

    words: int = 3  # units of a k-mer
    picks: int = 2  # smallest elements of a bucket
    bucket_bits: int = 6  # 64 buckets


def _left(x: Column, bits: Column | int) -> Column:
    return F.call_function("shiftleft", x, bits if isinstance(bits, Column) else F.lit(bits))


def _right(x: Column, bits: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", x, bits if isinstance(bits, Column) else F.lit(bits))


def kmers(text: Column, sketch: Sketch = Sketch()) -> Column:
    """Hashes of all k-mers in text order."""

    def hashed(u: Column) -> Column:
        last = F.greatest(F.size(u) - sketch.words, F.lit(0))
        one = lambda i: F.xxhash64(*[F.get(u, i + j) for j in range(sketch.words)])
        return F.when(F.size(u) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), last), one))

    return let(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), hashed)


def _elements(h: Column, bits: Column) -> Column:
    """Per element a long: hash of (k-mer, occurrence number) above, position in the lowest `bits`."""
    sorted_longs = F.sort_array(F.transform(h, lambda x, i: _left(x, bits).bitwiseOR(i.cast("bigint"))))

    def numbered(p: Column) -> Column:
        low = _left(F.lit(1).cast("bigint"), bits) - 1
        starts = F.filter(
            F.sequence(F.lit(0), F.size(p) - 1),
            lambda t: (t == 0) | (_right(F.get(p, t), bits) != _right(F.get(p, t - 1), bits)),
        )

        def runs(s: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                length = F.coalesce(F.get(s, k + 1), F.size(p)) - start

                def element(o: Column) -> Column:
                    at = F.get(p, start + o).bitwiseAND(low)
                    g = _right(F.xxhash64(F.get(h, at.cast("int")), o), 1)
                    return _left(_right(g, bits), bits).bitwiseOR(at)

                return F.transform(F.sequence(F.lit(0), length - 1), element)

            return F.flatten(F.transform(s, run))

        return let(starts, runs)

    return let(sorted_longs, numbered)


def fingerprint(text: Column, sketch: Sketch = Sketch()) -> Column:
    """array<int>, one entry for each bucket that is not empty: its number above, 32 - bucket_bits bits of hash below."""
    shift, own_bits = 63 - sketch.bucket_bits, 32 - sketch.bucket_bits
    bucket = lambda x: _right(x, shift)

    def signed(h: Column) -> Column:
        def chosen(q: Column, bits: Column) -> Column:
            least = F.filter(
                q,
                lambda x, t: (t < sketch.picks) | (bucket(F.get(q, t - sketch.picks)) != bucket(x)),
            )
            low = _left(F.lit(1).cast("bigint"), bits) - 1

            def tuples(m: Column) -> Column:
                firsts = F.filter(
                    F.sequence(F.lit(0), F.size(m) - 1),
                    lambda t: (t == 0) | (bucket(F.get(m, t)) != bucket(F.get(m, t - 1))),
                )

                def one(t: Column) -> Column:
                    def of(b: Column) -> Column:
                        own = F.filter(F.slice(m, t + 1, sketch.picks), lambda y: bucket(y) == b)
                        in_order = F.sort_array(F.transform(own, lambda y: y.bitwiseAND(low).cast("int")))
                        code = F.aggregate(in_order, F.lit(42).cast("bigint"), lambda a, i: F.xxhash64(a, F.get(h, i)))
                        kept = _right(code, 64 - own_bits)
                        # As a signed int of the same 32 bits.
                        sign = F.lit(1 << 31).cast("bigint")
                        return (_left(b, own_bits).bitwiseOR(kept).bitwiseXOR(sign) - sign).cast("int")

                    return let(bucket(F.get(m, t)), of)

                return F.transform(firsts, one)

            return let(least, tuples)

        # At most 63 - bucket_bits - 1 bits of position leave the bucket untouched.
        bits = F.ceil(F.log2(F.size(h).cast("double") + 1)).cast("int")
        body = let(bits, lambda b: let(F.sort_array(_elements(h, b)), lambda q: chosen(q, b)))
        return F.when(F.size(h) == 0, F.array().cast("array<int>")).otherwise(body)

    return let(kmers(F.coalesce(text, F.lit("")), sketch), signed)


def fingerprint_text(prints: Column) -> Column:
    """Eight hexadecimal digits for each entry."""
    digits = lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.lower(F.array_join(F.transform(prints, digits), ""))


def likeness(a: Column, b: Column, sketch: Sketch = Sketch()) -> Column:
    """Share of the buckets that hold the same hash, of those that are not empty in both; 0 to 1."""
    own_bits = 32 - sketch.bucket_bits
    buckets = lambda x: F.transform(x, lambda y: _right(y, own_bits))
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(buckets(a), buckets(b)))
    same = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty), with the key of its text under its id: (k_id, k_one, k_two), never null."""
    text, none = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").isNull()
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint")).alias("k_id"),
        F.xxhash64(F.lit(1), none, text).alias("k_one"),
        F.xxhash64(F.lit(2), none, text).alias("k_two"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text.alias("text"),
    )


KEY = ["k_id", "k_one", "k_two"]


def compare_with_edited(docs: DataFrame, sketch: Sketch = Sketch()) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, prints, edited_prints, near_edited, near_next) of a table of (doc_id, text).

    A document's edited text has its last half replaced by the beginning of the next document in descending order of
    doc_id, null last and equal ids by hashes of their texts; the first follows on the last. Rows with one id are
    documents of their own. Equal rows are worked on once and multiplied at the end: each but one of them is followed
    by its own copy. Texts are compared as equal by two 64-bit hashes. Extra columns are not read.

    Texts are shuffled once by (doc_id, hashes), and the beginning that a document's predecessor takes once more.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "order-minhash")
    keyed = _keyed(docs)
    counted = keyed.select(*KEY, "doc_id", F.length("text").alias("n_chars"), fingerprint(F.col("text"), sketch).alias("prints"))
    counted.groupBy(*KEY, "doc_id", "n_chars", "prints").agg(F.count("*").alias("copies")).write.parquet(f"{folder}/prints")
    prints = spark.read.parquet(f"{folder}/prints")
    order = [F.col("doc_id").isNull(), F.desc("k_id"), F.col("k_one"), F.col("k_two")]
    slim = prints.select(*KEY, "doc_id", F.col("n_chars").alias("n_before"))
    with_position(slim, [], order).drop("doc_id").write.parquet(f"{folder}/order")
    placed = spark.read.parquet(f"{folder}/order")
    size = placed.count()
    # Each document with its predecessor, of which it is the next.
    before = placed.select(*[F.col(c).alias(f"p_{c}") for c in KEY], (F.col("position") % max(size, 1) + 1).alias("position"), "n_before")
    pairs = placed.drop("n_before").join(before, "position").drop("position")

    texts = keyed.select(*KEY, "text").dropDuplicates(KEY)
    own = texts.join(prints, KEY).select(
        *KEY, "doc_id", "n_chars", "prints", F.substring("text", F.lit(1), F.ceil(F.col("n_chars") / 2).cast("int")).alias("head")
    )
    followed = texts.join(prints.drop("doc_id"), KEY).join(pairs, KEY)
    tail = lambda n: F.substring(F.col("text"), F.lit(1), F.floor(F.col(n) / 2).cast("int"))
    nexts = followed.select(
        F.explode(
            F.filter(
                F.array(
                    F.struct(*[F.col(f"p_{c}").alias(c) for c in KEY], tail("n_before").alias("tail"), F.lit(1).cast("bigint").alias("times")),
                    F.struct(*KEY, tail("n_chars").alias("tail"), (F.col("copies") - 1).alias("times")),
                ),
                lambda x: x["times"] > 0,
            )
        ).alias("x"),
        F.col("prints").alias("next_prints"),
    ).select("x.*", "next_prints")
    edited = own.join(nexts, KEY).select(
        "doc_id", "n_chars", "prints", "next_prints", "times", F.concat("head", "tail").alias("edited")
    )
    judged = edited.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "prints",
        fingerprint(F.col("edited"), sketch).alias("edited_prints"),
        likeness(F.col("prints"), F.col("next_prints"), sketch).alias("near_next"),
        "times",
    )
    return judged.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "prints",
        "edited_prints",
        likeness(F.col("prints"), F.col("edited_prints"), sketch).alias("near_edited"),
        "near_next",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("copy"),
    ).drop("copy")
