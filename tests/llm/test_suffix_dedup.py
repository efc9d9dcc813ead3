import random

import numpy as np
import pytest

from llm_helpers import documents, row_keys, shared_ids
from tallyloom.llm.suffix_dedup import common_prefixes, previous_factors, remove_repeats, suffix_levels

LENGTH = 30


def brute(rows, length, keys=None):
    """Row index -> kept bytes, over rows in order of (doc_id, start)."""
    seen, kept = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, keys[rows[i]] if keys else 0))
    for i in order:
        doc, data = rows[i][0], (rows[i][1] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            first = seen.setdefault(data[p : p + length], (i, p))
            if first != (i, p):
                gone[p : p + length] = b"\1" * length
        kept[i] = bytes(b for b, g in zip(data, gone, strict=True) if not g)
    return kept


def corpus():
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared, edge = text(80), text(LENGTH)
    rows = [(i, text(r.randint(0, 150)) + shared + text(r.randint(0, 40))) for i in range(30)]
    rows += [(100 + i, text(20) + edge + text(25)) for i in range(10)]
    rows += [(200, "x" * 400), (201, "x" * 90), (202, None), (203, ""), (None, shared), (204, rows[3][1]), (205, "ab" * 300)]
    rows += [(210, text(50) + shared * 3)]
    return rows


@pytest.mark.parametrize("parameters", [{}, {"sample": 1, "often": 1}], ids=["plain", "frequent anchors"])
def test_equals_brute_force(spark, parameters):
    rows = corpus()
    found = {r["doc_id"]: r for r in remove_repeats(documents(spark, rows), LENGTH, 10, **parameters).collect()}
    expected = brute(rows, LENGTH)
    for i, (doc, text) in enumerate(rows):
        assert bytes(found[doc]["kept"]) == expected[i], doc
        data = (text or "").encode()
        spans = found[doc]["removed"]
        assert found[doc]["n_bytes"] == len(data)
        rest = b"".join(data[a:b] for a, b in zip([0, *[s["stop"] for s in spans]], [*[s["start"] for s in spans], len(data)], strict=True))
        assert rest == expected[i]


@pytest.mark.parametrize("parameters", [{}, {"sample": 1, "often": 1}], ids=["plain", "frequent anchors"])
def test_rows_of_one_id_or_none_are_cut_by_their_own_text(spark, parameters):
    rows = shared_ids(corpus())
    expected = brute(rows, LENGTH, row_keys(spark, rows))
    found = remove_repeats(documents(spark, rows), LENGTH, 10, **parameters).collect()
    key = lambda d, x: (d is not None, d or 0, x)
    got = sorted(key(r["doc_id"], bytes(r["kept"])) for r in found)
    assert got == sorted(key(rows[i][0], x) for i, x in expected.items())


def test_nothing_goes_that_is_new(spark):
    one, other = "y" * 7 + "abcdefghijklmnopqrstuvwxyz" * 4, "0123456789 + " * 3 + "zyxwvutsrqponmlkjihgfedcba" * 3
    found = remove_repeats(documents(spark, [(1, one), (2, one), (2, other)]), 100, 40).collect()
    new = remove_repeats(documents(spark, [(2, other)]), 100, 40).first()["kept"]
    assert sorted((r["doc_id"], len(r["kept"])) for r in found) == sorted([(1, len(one)), (2, len(one) - 111), (2, len(new))])


def test_repeated_rows_and_empty_tables(spark):
    text = "one document that stands in the table twice, long enough to count"
    found = remove_repeats(documents(spark, [(1, text), (1, text), (2, text)]), LENGTH, 10).collect()
    assert sorted((r["doc_id"], len(r["kept"])) for r in found) == [(1, len(text)), (1, len(text)), (2, 0)]
    assert remove_repeats(documents(spark, []), LENGTH, 10).collect() == []


def test_long_texts_are_cut_into_overlapping_pieces(spark, monkeypatch):
    from tallyloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 256)
    rows = corpus()
    found = {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(documents(spark, rows), LENGTH, 10).collect()}
    assert found == {rows[i][0]: kept for i, kept in brute(rows, LENGTH).items()}


def shared(text, p, q, length):
    n = 0
    while n < length and max(p, q) + n < len(text) and text[p + n] == text[q + n]:
        n += 1
    return n


@pytest.mark.parametrize("length", [9, 30, 64, 100])
@pytest.mark.parametrize("letters", [1, 2, 4])
def test_longest_previous_factors_equal_a_quadratic_version(length, letters):
    r = np.random.default_rng(length + letters)
    text = r.integers(0, letters, 500).astype(np.uint8)
    text[300:420] = text[40:160]
    at = np.arange(len(text) - length + 1)
    for position in (at, r.permutation(len(at)), r.integers(0, 60, len(at))):  # as in the text, in any order, with ties
        expected = [
            max((shared(text, p, q, length) for q in at if position[q] < position[p]), default=0) for p in at[::7]
        ]
        assert previous_factors(text, at, position, length)[::7].tolist() == expected
    levels = suffix_levels(text, length)
    one, two = r.choice(at, 300), r.choice(at, 300)
    assert common_prefixes(text, levels, one, two).tolist() == [shared(text, p, q, length) for p, q in zip(one, two, strict=True)]


def test_no_windows_have_no_factors():
    none = np.zeros(0, np.int64)
    assert previous_factors(np.zeros(40, np.uint8), none, none, 30).tolist() == []
    assert previous_factors(np.zeros(40, np.uint8), np.array([3]), np.array([7]), 30).tolist() == [0]
