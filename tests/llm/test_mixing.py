import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from llm_helpers import documents
from tallyloom.llm.mixing import Mix, mix_sources

CLASHING = ("whole", "part", "cut", "used", "id", "doc", "key", "bucket", "times", "upto", "m_lang")


def tree():
    return {"lang": F.col("lang"), "source": F.col("source")}


def fill(budget, nodes):
    """Shares of (name, weight, most) by stepwise filling: those with too little first, the rest by weight."""
    open_, given = sorted(n for n in nodes if n[1] > 0), {}
    while open_:
        weight = sum(w for _, w, _ in open_)
        short = [n for n in open_ if n[2] * weight <= budget * n[1]]
        if not short:
            floors = {n: budget * w // weight for n, w, _ in open_}
            rest = budget - sum(floors.values())
            given |= {n: floors[n] + (i < rest) for i, (n, _, _) in enumerate(open_)}
            break
        first = min(short, key=lambda n: (n[2] / n[1], n[0]))
        given[first[0]] = first[2]
        budget -= first[2]
        open_.remove(first)
    return given


def expected(rows, mix):
    n = lambda t: len((t or "").split())
    leaf = defaultdict(list)
    for doc, text, lang, source in rows:
        if n(text):
            leaf[(lang or "(none)", source or "(none)")].append((doc, n(text)))
    supply = {k: sum(x for _, x in v) for k, v in leaf.items()}
    budget = mix.budget if mix.budget is not None else int(sum(supply.values()) * mix.share)
    langs = defaultdict(int)
    for (lang, source), x in supply.items():
        if mix.weights.get((lang, source), 1) > 0:
            langs[lang] += x * mix.epochs
    out = []
    for lang, share in fill(budget, [(k, mix.weights.get((k,), 1), m) for k, m in langs.items()]).items():
        nodes = [(s, mix.weights.get((k, s), 1), x * mix.epochs) for (k, s), x in supply.items() if k == lang]
        for source, tokens in fill(share, nodes).items():
            docs = leaf[lang, source]
            whole, part = divmod(tokens, supply[lang, source])
            key = lambda d: hashlib.md5(f"{mix.seed}:{whole}:{d[0]}".encode()).hexdigest()  # noqa: B023, E731
            used = 0
            for doc, size in sorted(docs, key=key):
                used += size
                out += [(doc, e) for e in range(whole + (used <= part))]
    return sorted(out)


def test_equals_stepwise_filling(spark):
    rows = [(i, "w " * (1 + i * 7 % 13), "en" if i % 3 else "de", f"src{i % 5 if i % 2 else 0}") for i in range(200)]
    rows += [(900, None, "en", "src0"), (901, " \n", "de", "src1"), (902, "a b", None, None)]
    frame = documents(spark, rows).selectExpr("*", "'x' as epoch", "'y' as m_key", *[f"'z' as {c}" for c in CLASHING])
    for mix in (
        Mix(share=0.5, epochs=1, seed=3),
        Mix(share=1.7, epochs=2, seed=4, weights={("en",): 5, ("en", "src3"): 9, ("de", "src0"): 0}),
        Mix(budget=101, epochs=3, weights={("(none)",): 7}),
        Mix(share=9.0, epochs=2),
    ):
        found = mix_sources(frame, tree(), mix).collect()
        assert sorted((r["doc_id"], r["epoch"]) for r in found) == expected(rows, mix)
        assert all(r["m_key"] == "y" and all(r[c] == "z" for c in CLASHING) for r in found)


def test_shortage_beside_a_weight_of_zero_goes_to_others(spark):
    rows = [(i, "w " * 10, "d0", "en") for i in range(100)] + [(200, "w " * 10, "d0", "de")]
    rows += [(300 + i, "w " * 10, "d1", "en") for i in range(100)]
    found = mix_sources(documents(spark, rows), tree(), Mix(budget=600, weights={("d0", "en"): 0})).collect()
    spent = defaultdict(int)
    for r in found:
        spent[r["lang"], r["source"]] += r["n_tokens"]
    assert spent == {("d0", "de"): 10, ("d1", "en"): 590}


def test_no_tokens_and_no_budget(spark):
    frame = documents(spark, [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, "en", "s")])
    assert mix_sources(frame, tree(), Mix(budget=0)).collect() == []
    assert mix_sources(frame.limit(0), tree(), Mix()).collect() == []
    assert sorted(r["doc_id"] for r in mix_sources(frame, tree(), Mix()).collect()) == [1, 1]
