import random

from llm_helpers import WORD, documents, prose
from tallyloom.llm.quality import LineRules, clean_lines


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    at = {}
    for k in range(len(words) - 2):
        at.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeated = {k + o for places in at.values() if len(places) > 1 for k in places for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


def test_base_counts(spark):
    r = random.Random(6)
    texts = [None, "", " \n ", "a b", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n x\n", "tab\tand\x0bvt\x0cff\rcr z", "\u00a0 \u2003 é🙂 # | <>"]
    texts += [" ".join(r.choice("abc") + r.choice("\n ") for _ in range(r.randint(0, 300))) for _ in range(60)]
    texts += [prose(1, 60), "word " * 30_000, prose(2, 20_000, 5000)]
    rows = clean_lines(documents(spark, list(enumerate(texts))).selectExpr("*", "1 as kept", "2 as n_words", "3 as q_words", "4 as Q_left")).collect()
    for x in rows:
        found = (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"])
        assert found == counts(texts[x["doc_id"]]), x["doc_id"]
        assert x["base_failed"] == (found[0] < 50 or 100 * found[4] > 50 * found[0])
        assert not (x["kept"] and x["base_failed"]) and (x["q_words"], x["Q_left"]) == (3, 4)


def test_line_rules(spark):
    good = "\n".join(prose(i, 12) + "." for i in range(6))
    junk = ["Home | News | Sport | Shop | Help | About", "Please Accept ALL Cookies now.", "one two three four five six seven without end"]
    rows = [(1, good), (2, "\n".join([good, *junk])), (3, "\n".join([prose(9, 55) + "."] + [prose(20 + i, 30) for i in range(4)])), (4, "Title\n" + good)]
    found = {r["doc_id"]: r for r in clean_lines(documents(spark, rows)).collect()}
    assert found[1]["clean_text"] == good and found[1]["kept"] and found[1]["lost"] == 0
    assert found[2]["clean_text"] == good and found[2]["n_lines_removed"] == 3 and found[2]["kept"]
    assert found[3]["n_lines_removed"] == 4 and found[3]["lost"] > 0.5 and not found[3]["kept"]
    assert found[4]["clean_text"].startswith("Title\n") and found[4]["kept"]
    strict = clean_lines(documents(spark, rows), LineRules(max_lost=0.0)).filter("kept").collect()
    assert {r["doc_id"] for r in strict} == {1, 4}
    assert clean_lines(documents(spark, [])).collect() == []
