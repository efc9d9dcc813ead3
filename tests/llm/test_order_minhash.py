import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from llm_helpers import documents, prose
from tallyloom.llm.order_minhash import Sketch, compare_with_edited, fingerprint, fingerprint_text, likeness

UNIT = re.compile(r"[ぁ-ゟァ-ヿ一-鿿฀-๿]|[^\x20\x09-\x0Dぁ-ゟァ-ヿ一-鿿฀-๿]{1,32}")


def chained(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v, seed)
    return seed


def eight(x):
    return x.to_bytes(8, "little")


def order_minhash(text, s):
    units = [u.encode() for u in UNIT.findall(text or "")]
    hashes = [chained(*units[i : i + s.words]) for i in range(max(len(units) - s.words, 0) + 1)] if units else []
    seen, buckets, bits = Counter(), {}, len(hashes).bit_length() if hashes else 0
    for at, h in enumerate(hashes):
        g = chained(eight(h), seen[h].to_bytes(4, "little")) >> 1
        seen[h] += 1
        buckets.setdefault(g >> (63 - s.bucket_bits), []).append((g >> bits, at))
    prints = []
    for b in sorted(buckets):
        code = 42
        for at in sorted(at for _, at in sorted(buckets[b])[: s.picks]):
            code = chained(eight(code), eight(hashes[at]))
        prints.append(b << (32 - s.bucket_bits) | code >> (32 + s.bucket_bits))
    return prints


def like(a, b, s):
    part = lambda x: {y >> (32 - s.bucket_bits) for y in x}
    either = len(part(a) | part(b))
    return len(set(a) & set(b)) / either if either else 1.0


def text_of(prints):
    return "".join(f"{x:08x}" for x in prints)


TEXTS = [None, "", "  \n", "a", "a b", "a b c", "a b c a b c a b c", "x " * 500, "日本語のテキスト です", "é🙂 " * 3, "w" * 100, prose(1, 40), prose(2, 3000)]


@pytest.mark.parametrize("sketch", [Sketch(), Sketch(2, 3, 4), Sketch(1, 1, 0)])
def test_fingerprints_equal_a_plain_version(spark, sketch):
    rows = documents(spark, list(enumerate(TEXTS))).select("doc_id", fingerprint_text(fingerprint(F.col("text"), sketch)).alias("f")).collect()
    for r in rows:
        assert r["f"] == text_of(order_minhash(TEXTS[r["doc_id"]], sketch)), TEXTS[r["doc_id"]]


def expected(rows, s):
    """Rows sorted as the operator does it, where no two different texts share an id."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (order_minhash(x, s) for x in (text, edited, after))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b), like(a, b, s), like(a, c, s)))
    return Counter(out)


def result(df):
    names = ("doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("prints")), fingerprint_text(F.col("edited_prints")), "near_edited", "near_next")
    return Counter(map(tuple, df.select(*names).collect()))


def test_edited_texts_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(i * 3 - 20, t) for i, t in enumerate(TEXTS)] + [(100 + i, prose(i, r.randint(1, 200))) for i in range(30)]
    rows += [(500, rows[-1][1])] * 7 + [(None, "null id " * 5)] * 3  # repeated rows
    docs = documents(spark, rows).withColumns({"k_id": F.lit("x"), "copies": F.lit(None), "position": F.lit(1), "tail": F.lit(2), "copy": F.lit(3)})
    assert result(compare_with_edited(docs.repartition(5))) == expected(rows, Sketch())


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rows = [(1, prose(i, 50)) for i in range(6)] + [(None, prose(9, 30)), (None, prose(8, 30)), (2, "a b c d")]
    found = compare_with_edited(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in found) == Counter((i, len(t)) for i, t in rows)
    known = {t[: len(t) - len(t) // 2] + u[: len(t) // 2] for _, t in rows for _, u in rows}
    assert {r["edited_sha256"] for r in found} <= {hashlib.sha256(x.encode()).hexdigest() for x in known}


def test_order_and_copies(spark):
    a = prose(1, 400, 5000).split()
    moved, cut, other = a[200:] + a[:200], a[:390] + ["new"] + a[391:], prose(3, 400, 5000).split()
    rows = [(i, " ".join(x)) for i, x in enumerate((a, a, moved, cut, other))]
    f = documents(spark, rows).select("doc_id", fingerprint(F.col("text")).alias("f"))
    first = f.filter("doc_id = 0").select(F.col("f").alias("g"))
    near = {r[0]: r[1] for r in f.join(first).select("doc_id", likeness(F.col("f"), F.col("g"))).collect()}
    assert near[0] == near[1] == 1.0 and near[4] < 0.05
    assert near[3] > 0.85 and near[2] < near[3] - 0.2  # the same shingles in another order are less alike than an edit


def test_empty_and_single(spark):
    assert compare_with_edited(documents(spark, [])).collect() == []
    for rows in ([(1, "one two three four five six")], [(4, None)], [(4, "x y")] * 3):
        assert result(compare_with_edited(documents(spark, rows))) == expected(rows, Sketch())


def test_no_python_in_the_plan(spark):
    plan = compare_with_edited(documents(spark, [(1, "a b c d")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)
