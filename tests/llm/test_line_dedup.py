import random

import numpy as np
import pytest

import corpus_pipeline
from llm_helpers import documents, edit_distance, groups, row_keys, shared_ids
from tallyloom.llm.line_dedup import banded_distances, line_verdicts, remove_lines
from tallyloom.llm.queries import QUERIES

SHORT = 12


def changed(r, text, edits):
    chars = list(text)
    for _ in range(edits):
        at, kind = r.randrange(len(chars) + 1), r.randrange(3)
        chars[at : at + (kind != 0)] = [r.choice("abcü🙂")] * (kind != 1)
    return "".join(chars)


def corpus():
    r = random.Random(4)
    line = lambda n: "".join(r.choice("abcdefg ") for _ in range(n))
    bases = [line(r.randint(10, 40)) for _ in range(8)] + [line(SHORT), line(SHORT + 1)]
    rows = []
    for i in range(40):
        lines = [changed(r, r.choice(bases), r.randint(0, 4)) for _ in range(4)] + [line(20), "", "short"]
        r.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows + [(90, None), (91, ""), (92, "\n\n"), (None, bases[0] + "\n" + bases[0])]


def verdicts(rows, threshold):
    """(doc, line) -> (class, linked), trying all pairs of distinct lines."""
    first = {}
    places = sorted(((d is not None, d or 0), n, x) for d, t in rows for n, x in enumerate((t or "").split("\n")))
    for doc, number, text in places:
        if len(text) >= SHORT:
            first.setdefault(text, (doc, number))
    texts = {place: text for text, place in first.items()}
    root = groups(list(texts), lambda a, b: abs(len(texts[a]) - len(texts[b])) <= threshold and edit_distance(texts[a], texts[b]) <= threshold)
    size = {p: sum(q == root[p] for q in root.values()) for p in root}
    return {(d, n): (root[first[x]], size[first[x]] > 1) for d, n, x in places if len(x) >= SHORT}


@pytest.mark.parametrize(
    ("threshold", "parameters"), [(2, {}), (2, {"sample": 1, "tile": 2, "small_group": 2}), (1, {"small_group": 3})]
)
def test_equals_brute_force(spark, threshold, parameters):
    rows = corpus()
    null = -(1 << 63)
    found = line_verdicts(documents(spark, rows), threshold, SHORT, **parameters).collect()
    key = lambda d: (d != null, 0 if d == null else d)
    got = {(key(r["doc"]), r["line"]): ((key(r["class_doc"]), r["class_line"]), r["linked"]) for r in found}
    assert len(found) == len(got)
    assert got == verdicts(rows, threshold)


def test_removal_keeps_first_lines_and_other_columns(spark):
    line, other = "a line of a good length, first seen here", "a line of a good length, first seen hera"
    rows = [(1, f"x\n{line}\ny"), (2, f"{other}\nx\n{line}"), (3, "x\nx"), (4, None), (5, "")]
    frame = documents(spark, rows).selectExpr("*", "1 as removed", "'k' as line", "'l' as l_row", "2 as row", "3 as L_REMOVED")
    kept = {r["doc_id"]: r for r in remove_lines(frame, threshold=1).collect()}
    assert {k: r["text"] for k, r in kept.items()} == {1: f"x\n{line}\ny", 2: "x", 3: "x\nx", 4: None, 5: ""}
    assert [kept[2][c] for c in ("removed", "line", "l_row", "row", "L_REMOVED")] == [1, "k", "l", 2, 3]


def test_rows_of_one_id_or_none_keep_their_own_lines(spark):
    a, b, c = "z" * 40, "yet another line of its own, long enough", "precious second line, found nowhere else"
    rows = [(5, a + "qq"), (7, b + "\n" + a), (7, "a beginning that is nowhere else in the table\n" + c)]
    rows += [(None, a), (None, "first of a text without an id, and alone\n" + b)]
    kept = sorted(r["text"] for r in remove_lines(documents(spark, rows)).collect())
    assert kept == sorted([a, "", "", rows[2][1], rows[4][1]])


@pytest.mark.parametrize("parameters", [{}, {"sample": 1, "tile": 2, "small_group": 2}])
def test_shared_ids_equal_brute_force(spark, parameters):
    rows = shared_ids(corpus())
    keys = row_keys(spark, rows)
    first, texts = {}, {}
    places = sorted(((d is not None, d or 0), keys[d, t], n, x) for d, t in rows for n, x in enumerate(t.split("\n")) if len(x) >= SHORT)
    for doc, row, number, text in places:
        texts.setdefault(first.setdefault(text, (doc, row, number)), text)
    root = groups(list(texts), lambda a, b: abs(len(texts[a]) - len(texts[b])) <= 2 and edit_distance(texts[a], texts[b]) <= 2)
    found = line_verdicts(documents(spark, rows), 2, SHORT, **parameters).collect()
    assert {(r["row"], r["line"]): (r["class_row"], r["class_line"]) for r in found} == {
        (row, number): root[first[x]][1:] for _, row, number, x in places
    }


def test_query_counts_rows_without_an_id(spark, tmp_path):
    line = "one line that is long enough to take part in this"
    rows = [(None, line), (None, line + "\nand one more line"), (3, line), (3, line), (4, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"], r["removed_lines"]) for r in found)
    assert [x[:2] for x in got] == [(0, 1), (0, 2), (3, 1), (3, 1), (4, 0)]
    assert sum(x[2] for x in got[:2]) == 1 and got[2:] == [(3, 1, 1, [0]), (3, 1, 1, [0]), (4, 0, 0, [])]


def test_long_lines_are_verified_a_few_at_a_time(spark, monkeypatch):
    from tallyloom.llm import line_dedup

    monkeypatch.setattr(line_dedup, "VERIFIED_CHARS", 100)
    rows = corpus()
    found = line_verdicts(documents(spark, rows), 2, SHORT, small_group=2).count()
    assert found == len(verdicts(rows, 2))


def test_repeated_rows_and_empty_tables(spark):
    text = "one line that is long enough to take part in this"
    frame = documents(spark, [(1, text), (1, text), (2, text)])
    assert sorted((r["doc_id"], r["text"]) for r in remove_lines(frame).collect()) == [(1, text), (1, text), (2, "")]
    assert remove_lines(documents(spark, [])).collect() == []
    assert line_verdicts(documents(spark, [(1, "short")])).collect() == []


def test_banded_distances():
    r = random.Random(8)
    a = ["".join(r.choice("ab🙂") for _ in range(r.randint(0, 12))) for _ in range(600)]
    b = [changed(r, x, r.randint(0, 3)) if x else "" for x in a]
    exact = np.array([edit_distance(x, y) for x, y in zip(a, b, strict=True)])
    for threshold in range(4):
        assert (np.minimum(banded_distances(a, b, threshold), threshold + 1) == np.minimum(exact, threshold + 1)).all()


def test_short_lines_as_exact_copies(spark):
    long = "one line that is long enough to take part in this"
    rows = [(1, f"Home\n\n{long}\nü\n   "), (2, f"Home\nHame\n\nü\n   \n{long}"), (3, "Home\r\nHome\nx"), (4, "x"), (None, "Hame")]
    kept = remove_lines(documents(spark, rows), threshold=2, min_chars=6, exact_chars=1).collect()
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in kept)
    assert got == [(0, "Hame"), (1, f"Home\n\n{long}\nü\n   "), (2, "\n   "), (3, "Home\r\nx"), (4, "")]


@pytest.mark.parametrize("name", ["op8", "pipeline"])
def test_operators_take_short_lines(spark, tmp_path, name):
    rows = [(i, f"menu\nyesterday it rained {'abcdefgh'[i] * 9}\nimprint\nx") for i in range(6)]
    frame = documents(spark, rows)
    if name == "op8":
        frame.write.parquet(f"{tmp_path}/documents.parquet")
        found = {r["doc_id"]: r["removed_lines"] for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
        assert found == {0: [], **{i: [0, 2, 3] for i in range(1, 6)}}
    else:
        found = dict(corpus_pipeline.first_lines(spark, frame, "").select("doc_id", "text").collect())
        assert found == {i: text if i == 0 else text.split("\n")[1] for i, text, *_ in rows}


def test_a_wide_group_has_the_forest_of_a_narrow_one(monkeypatch):
    from functools import partial

    import numpy as np

    from tallyloom.llm import similarity
    from tallyloom.llm.line_dedup import WORDS

    r = np.random.default_rng(3)
    kinds = r.integers(0, 2**62, (6, WORDS)).astype(np.uint64)
    sketch = kinds[r.integers(0, 6, 300)] ^ (np.uint64(1) << r.integers(0, 60, (300, WORDS)).astype(np.uint64))
    info = r.integers(20, 23, 300) << 1 | 1
    join = similarity.Join(lambda a, b: abs((a >> 1) - (b >> 1)) <= 1, lambda m, n: 8 + 0 * (m + n), None, None, WORDS)
    possible = partial(similarity._possible, sketch, info, join)
    narrow = similarity._spanning(300, possible)
    monkeypatch.setattr(similarity, "WIDE", 10)
    assert similarity._spanning(300, possible) == narrow
    assert len(narrow) == 294
