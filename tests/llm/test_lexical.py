import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import LOWER, documents, prose
from tallyloom.llm.lexical import Postings, Search, build_index, item_terms, norms, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    rows = []
    for item, own in asked.items():
        scored = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // total if c else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        rows += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return Counter(rows)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_terms():
    texts = ["Ab-c_d 12é", None, "", "x", "y z", "\x00\x7f{|}", "É ÀB"]
    import pyarrow as pa

    words, count = terms_of(pa.array(texts).slice(0))
    assert words.to_pylist() == [w for t in texts for w in terms(t)]
    assert count.tolist() == [len(terms(t)) for t in texts]
    words, count = terms_of(pa.array(["skipped", *texts]).slice(1))
    assert words.to_pylist() == [w for t in texts for w in terms(t)] and len(count) == len(texts)


def test_norms_beyond_64_bits():
    assert norms(np.array([10**9]), 10**12, 10**15).tolist() == [10 + 90 * 10**9 * 10**12 // 10**15]


@pytest.mark.parametrize("shape", [(4096, 1 << 24, 256, 16), (7, 3000, 3, 2)])
def test_equals_brute_force(spark, shape):
    r = random.Random(3)
    rows = [(i, prose(i, r.randint(1, 80), 60)) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(40)]  # copies: ties
    rows += [(300, None), (301, ""), (302, " .,; "), (None, rows[6][1]), (None, rows[7][1].upper()), (7, "other text é")]
    rows += [(400, prose(5, 9000, 80)), (-4, rows[5][1])]
    items = [(i, prose(i, 12, 60)) for i in range(25)]
    items += [(30, None), (31, ""), (32, "nowhere"), (33, rows[5][1]), (None, "é other"), (None, prose(6, 4, 60)), (33, "abc"), (34, prose(9, 300, 60))]
    index = build_index(documents(spark, rows).repartition(3), shard_docs=shape[0], shard_bytes=shape[1])
    found = search(index, items_of(spark, items), 10, block_items=shape[2], pilot=shape[3]).collect()
    assert Counter(map(tuple, found)) == brute_force(rows, items, 10)


def test_bounds_prune():
    r = np.random.default_rng(1)
    at = np.concatenate([np.sort(r.choice(4000, 1500, replace=False)) for _ in range(4)])
    of = np.repeat(np.arange(4), 1500)
    impact = (r.pareto(1.0, 6000) * 1000).astype(np.int64) + 1
    p = Postings(of, at, impact, 4000)
    for low, high in ((0, 1500), (1500, 1501), (3001, 4400)):
        best = p.largest(np.array([low]), np.array([high]))[0]
        assert impact[best] == impact[low:high].max() and low <= best < high
    s = Search(p, np.zeros(4, np.int64), np.arange(4), np.zeros(1, np.int64), 5).run()
    score = np.bincount(at, impact, 4000).astype(np.int64)
    best = np.lexsort((np.arange(4000), -score))[:5]
    assert s.found[0].tolist() == best.tolist() and s.score[0].tolist() == score[best].tolist()
    assert s.scored < 2000  # of some 3,400 documents with a posting


def test_empty_tables_and_clashing_names(spark):
    docs = documents(spark, [(1, "a b"), (2, "a")]).withColumns({"shard": F.lit("x"), "term": F.lit(None), "block": F.lit(1), "df": F.lit(2), "kind": F.lit("k")})
    items = items_of(spark, [(1, "a"), (2, "b")]).withColumns({"term": F.lit("x"), "rank": F.lit(1), "block": F.lit(1)})
    index = build_index(docs)
    assert Counter(map(tuple, search(index, items).collect())) == brute_force([(1, "a b"), (2, "a")], [(1, "a"), (2, "b")], 10)
    assert search(index, items.limit(0)).collect() == []
    assert search(build_index(docs.limit(0)), items).collect() == []
    assert search(build_index(documents(spark, [(1, None), (2, "..")])), items).collect() == []
    assert item_terms(items).count() == 2
