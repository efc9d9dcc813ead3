import random

import numpy as np

from llm_helpers import documents
from tallyloom.llm import langid
from tallyloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    found = QUERIES["op1_language_id"](spark, SMALL)
    true = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = found.join(true, "doc_id").filter("held_out").collect()
    assert len(rows) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def fitted(spark):
    rows = [(i, "the cat and the dog sat there " * 3, "en", "s") for i in range(6)]
    rows += [(10 + i, "der hund und die katze saßen dort " * 3, "de", "s") for i in range(6)]
    frame = documents(spark, [*rows, (90, None, "en", "s"), (91, "untaught", None, "s"), (92, "", "de", "s")])
    return langid.fit_languages(frame, frame)


def test_probabilities_add_up(spark):
    model = fitted(spark)
    assert model.languages == ["de", "en"]
    letters = sorted(set("thecatandthedogsattheredirhunddiekatzesaßendort"))
    # All symbols that were seen, and as many others as the lowest order makes room for.
    symbols = np.array([0, *map(ord, letters), *range(50_000, 51_000)], np.uint64)
    shift = np.uint64(langid.BITS)
    for context in ("the", "ße ", "zzz"):
        key = np.uint64(0)
        for c in context:
            key = (key << shift) | np.uint64(ord(c) if c != " " else 0)
        total = np.exp(model.log_probability((key << shift) | symbols, langid.ORDER)).sum(axis=0)
        assert np.allclose(total, 1, atol=1e-3)


def test_edges(spark):
    model = fitted(spark)
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, "the dog"), (4, "the dog"), (None, "die katze"), (5, "the cat " * 30_000)]
    frame = documents(spark, rows).selectExpr("*", "'zz' as lang_pred", "1 as rejected")
    found = langid.scored(frame, model).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] in (1, 2, 3):
            assert (r["lang_pred"], r["score"], r["rejected"], r["cross_entropy"]) == ("und", 0.0, True, None)
        else:
            assert r["lang_pred"] == ("de" if r["doc_id"] is None else "en")
    assert langid.scored(frame.limit(0), model).collect() == []
    empty = langid.fit_languages(frame.limit(0).select("lang", "text"), frame.limit(0).select("lang", "text"))
    assert {r["lang_pred"] for r in langid.scored(frame, empty).collect()} == {"und"}


def test_long_text_in_pieces(spark, monkeypatch):
    model = fitted(spark)
    text = "the cat, and there the dog: " * 200
    whole, n, letters = model.cross_entropies([text, "x", text])
    monkeypatch.setattr(langid, "CHUNK_CHARS", 700)
    parts, m, same = model.cross_entropies([text, "x", text])
    assert (letters == same).all() and abs(n - m).max() <= 40
    assert np.allclose(whole / n[:, None], parts / m[:, None], rtol=0.05)
    assert (whole.argmin(axis=1)[[0, 2]] == parts.argmin(axis=1)[[0, 2]]).all()


def test_all_grams_count_where_the_model_is_a_table(spark):
    r = random.Random(3)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(2, 6)))
    texts = [(lang, " ".join(word(x) for _ in range(400))) for lang, x in (("aa", "abcdefgh"), ("bb", "efghijkl")) for _ in range(12)]
    texts += [("cc", " ".join(word("cdghkl") for _ in range(30)))]
    rows = [(i, text, lang, "s") for i, (lang, text) in enumerate(texts)]
    rows += [(100, None, None, "s"), (101, "12", None, "s"), (102, "größe 🙂 ab", None, "s"), (100, "ab cd", None, "s")]
    frame = documents(spark, rows).repartition(3)
    train = frame.select("lang", "text")
    held, stored = langid.fit_languages(train, train), langid.fit_languages(train, train, max_cells=3000)
    assert held.cells is None and stored.cells is not None and not stored.levels
    assert len(held.levels[-1].gram) > 1000
    found = [sorted(map(tuple, langid.scored(frame, m).collect()), key=repr) for m in (held, stored)]
    assert len(found[0]) == len(rows)
    for a, b in zip(*found, strict=True):
        assert a[:6] == b[:6] and a[8:] == b[8:]
        assert np.allclose([a[6], a[7] or 0], [b[6], b[7] or 0], atol=1e-5)


def test_rare_languages_reject_too(spark):
    r = random.Random(5)
    words = {"aa": ["the", "cat", "and", "dog", "sat", "there"], "bb": ["der", "hund", "und", "katze", "dort"], "cc": ["un", "chien", "avec", "chat"]}
    text = lambda lang: " ".join(r.choice(words[lang]) for _ in range(60))
    rows = [(i, text("aa"), "aa", "s") for i in range(700)] + [(1000 + i, text("bb"), "bb", "s") for i in range(70)]
    rows += [(2000 + i, text("cc"), "cc", "s") for i in range(5)]
    frame = documents(spark, rows).select("lang", "text")
    # bb has 70 rows, but fewer than 50 in a common sample of 200; cc has 5 in all.
    model = langid.fit_languages(frame, frame, calibration_rows=200)
    assert np.isfinite(model.limit).all()
    junk = ["".join(r.choice("abcdehiknrstuvz") for _ in range(400)) for _ in range(20)]
    own = [text(lang) for lang in words for _ in range(20)]
    found = {r["doc_id"]: r for r in langid.scored(documents(spark, [*enumerate(junk), *enumerate(own, 100)]), model).collect()}
    assert all(found[i]["rejected"] for i in range(20))
    assert not any(found[100 + i]["rejected"] for i in range(60))
    assert [found[100 + i]["lang_pred"] for i in range(60)] == [lang for lang in words for _ in range(20)]
