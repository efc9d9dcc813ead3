import random

import numpy as np
import pytest

from llm_helpers import documents, groups, prose, row_keys, shared_ids, shingles
from tallyloom.llm import jaccard_join, similarity
from tallyloom.llm.components import components
from tallyloom.llm.jaccard_join import Bands, Sets, choose_bands, edges, grouped_rows, index_rows, linked_documents, one_of_each_group
from tallyloom.session import shared_path


def corpus():
    r = random.Random(2)
    rows = [(i, prose(i, r.randint(1, 60))) for i in range(40)]
    base = prose(99, 120).split()
    for i in range(60):  # a family of near copies: words replaced, inserted and left out
        words = list(base)
        for _ in range(r.randint(0, 6)):
            at = r.randrange(len(words))
            words[at : at + r.randint(0, 1)] = [f"w{r.randrange(50)}"] * r.randint(0, 1)
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, "Two words" if i % 2 else "two  WORDS") for i in range(4)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "one"), (304, "ONE"), (None, rows[0][1]), (305, rows[0][1])]
    return rows


@pytest.mark.parametrize(
    ("n", "num", "parameters"),
    [(3, 90, {}), (3, 90, {"sample": 1, "tile": 3, "small_group": 2}), (5, 80, {"small_group": 4})],
)
def test_equals_brute_force(spark, n, num, parameters):
    rows = corpus()
    sets = {(-1 if d is None else d): shingles(t, n) for d, t in rows}
    link = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    expected = groups(list(sets), link)
    found = linked_documents(documents(spark, rows), n, num, 100, **parameters).collect()
    got = {(-1 if r["doc_id"] is None else r["doc_id"]): r for r in found}
    assert len(found) == len(rows)
    for doc, component in expected.items():
        own = got[doc]["component_id"]
        assert ((-1 if own is None else own), got[doc]["n_shingles"]) == (component, len(sets[doc])), doc


@pytest.mark.parametrize("parameters", [{}, {"sample": 1, "tile": 3, "small_group": 2}])
def test_rows_of_one_id_or_none_have_their_own_sets(spark, parameters):
    rows = shared_ids(corpus())
    keys = row_keys(spark, rows)
    place = {((d is not None, d or 0), keys[d, t]): (d, t) for d, t in rows}
    sets = {p: shingles(t, 3) for p, (_, t) in place.items()}
    link = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])
    expected = {p[1]: q for p, q in groups(list(sets), link).items()}
    found = grouped_rows(documents(spark, rows), **parameters).collect()
    assert len(found) == len(rows)
    assert {r["row"]: r["first_row"] for r in found} == {row: first[1] for row, first in expected.items()}


def test_near_copies_of_texts_that_share_an_id(spark):
    texts = [prose(70 + i, 200) for i in range(3)]
    for doc in (1, None):
        rows = [(doc, t) for t in texts] + [(5 + i, t + " more") for i, t in enumerate(texts)]
        frame = documents(spark, rows)
        assert all(r["component_id"] == doc for r in linked_documents(frame).collect())
        kept = one_of_each_group(frame.selectExpr("*", "'x' as j_row", "'y' as other_id"))
        assert sorted(r["text"] for r in kept.collect()) == sorted(texts)
        assert kept.columns == [*frame.columns, "j_row", "other_id"]


def test_rows_that_stay_of_repeated_and_empty_ones(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, ""), (None, ""), (None, "u v w x y"), (None, "p q r s t")]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in one_of_each_group(documents(spark, rows)).collect())
    assert kept == [(0, ""), (0, ""), (0, "p q r s t"), (0, "u v w x y"), (1, "a b c d e f")]
    assert one_of_each_group(documents(spark, [])).collect() == []


def test_repeated_rows_and_empty_tables(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (4, "a b c d"), (6, "x y z")]
    found = sorted(tuple(r) for r in linked_documents(documents(spark, rows)).collect())
    assert found == [(4, 2, 4), (5, 2, 4), (5, 2, 4), (6, 1, 6)]
    assert linked_documents(documents(spark, [])).collect() == []


def test_weights_reach_the_bound():
    for sets in (1, 1000, 10**9):
        bands = choose_bands(90, 100, {i: sets for i in range(200)}, 100_000)
        edge = edges(90, 100, 100_000)
        for band, (total, double, slack) in enumerate(zip(bands.total, bands.double, bands.slack, strict=True)):
            high = int(edge[band + 1]) - 1
            assert total + double >= (high + high * 100 // 90) * 10 // 190 + 1 + slack
    assert choose_bands(90, 100, {}, 50).double.sum() == 0
    assert np.any(choose_bands(90, 100, {i: 10**12 for i in range(99)}, 50).double)


@pytest.mark.parametrize("weights", [(3, 0, 0), (9, 0, 6), (2, 1, 0), (8, 3, 8), (30, 30, 40)])
def test_equal_keys_for_all_close_sets(weights):
    """Sets within the weight of a scheme share a key, one side of it exact, with and without empty segments."""
    total, double, slack = weights
    r = np.random.default_rng(1)
    bands = Bands(np.array([1, 1000]), np.array([total]), np.array([double]), np.array([slack]))
    reach = total + double - 1 - slack
    for size in (1, 2, 3, 5, 12, 40):
        for _ in range(60):
            a = set(r.integers(0, 2**63, size).tolist())
            b = set(a)
            for _ in range(reach):
                if r.random() < 0.5 and len(b) > 1:
                    b.remove(sorted(b)[r.integers(len(b))])
                else:
                    b.add(int(r.integers(0, 2**63)))
            if len(a ^ b) > reach:
                continue
            both = [np.array(sorted(x), np.uint64) for x in (a, b)]
            sets = Sets(np.repeat([0, 1], [len(x) for x in both]), np.concatenate(both), np.array([len(x) for x in both]))
            key, node, info = index_rows(sets, np.array([0, 1], np.uint64), bands, 0)
            rows = [{}, {}]
            for k, n, i in zip(key.tolist(), node.tolist(), info.tolist(), strict=True):
                rows[n][k] = rows[n].get(k, 0) | (i & 1)
            assert any(rows[0][k] | rows[1][k] for k in rows[0].keys() & rows[1].keys())


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    found = {r["node"]: r["label"] for r in components(frame, shared_path(spark, "test")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert components(frame.limit(0), shared_path(spark, "test")).collect() == []


@pytest.mark.parametrize("parameters", [{}, {"sample": 1, "tile": 3, "small_group": 2}])
def test_a_large_index_is_shuffled_in_slices(spark, tmp_path, monkeypatch, parameters):
    """Slice by slice the result is the same, and no slice has more than about its share of the index."""
    frame = documents(spark, corpus())
    expected = sorted(map(str, linked_documents(frame, 3, 80, 100, **parameters).collect()))
    shuffled = []
    real = similarity._grouped
    monkeypatch.setattr(similarity, "_grouped", lambda join: shuffled.append(1) or real(join))
    monkeypatch.setattr(jaccard_join, "SLICE_ROWS", 100)
    monkeypatch.setattr(jaccard_join, "TASK_ROWS", 50)
    found = linked_documents(frame, 3, 80, 100, folder=str(tmp_path / "j"), **parameters)
    assert sorted(map(str, found.collect())) == expected
    assert len(shuffled) == jaccard_join.SLICES > 1
    keys = [spark.read.parquet(str(tmp_path / "j" / "groups" / f"slice={i}")).filter("info > 0") for i in range(len(shuffled))]
    for i, one in enumerate(keys):
        for other in keys[i + 1 :]:
            assert one.join(other, "key").isEmpty()
