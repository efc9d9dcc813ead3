import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.ball_tree import NONE, Search, build_tree, quantised, rounds, top_k


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vector array<float>")


@pytest.mark.parametrize("sizes", [(8192, 4096), (60, 7), (20, 5)])
def test_equals_brute_force(spark, sizes):
    r = np.random.default_rng(1)
    points = r.normal(size=(400, 6)).astype(np.float32)
    points[100:200] = points[100]  # a very common vector, and ties
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6)]
    rows += [(904, []), (None, [1.0] * 6), (950, [0.5, 0.5]), (1000, [0.25, 1.0])]
    vectors = quantised(table(spark, rows), "vector")
    found = top_k(vectors, vectors.filter("id % 50 = 0"), 5, *sizes).collect()
    whole = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in rows if i is not None and v and i < 900 or i in (950, 1000)}
    expected = set()
    for q in (i for i in whole if i % 50 == 0):
        score = {i: int(whole[q] @ v) for i, v in whole.items() if i != q and len(v) == len(whole[q])}
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
        expected |= {(q, rank, i, s) for rank, (i, s) in enumerate(best, 1)}
    assert {tuple(x) for x in found} == expected
    assert len(found) == len(expected)


def test_bounds_hold_and_prune():
    r = np.random.default_rng(2)
    centers = r.normal(size=(20, 4)) * 1000
    points = np.floor(np.repeat(centers, 100, axis=0) + r.normal(size=(2000, 4)))
    tree = build_tree(points, np.arange(2000), 32)
    for node in range(len(tree.start)):
        own = tree.points[tree.start[node] : tree.stop[node]]
        assert (np.sqrt(((own - tree.center[node]) ** 2).sum(axis=1)) <= tree.radius[node] + 1e-6).all()
    search = Search(tree, points[:50], np.arange(50), np.full(50, NONE), 3)
    scanned = []
    scan = search.scan
    search.scan = lambda q, leaf: (scanned.append(len(q)), scan(q, leaf))
    search.run()
    assert sum(scanned) < 0.5 * 50 * (tree.child < 0).sum()


def test_few_and_none(spark):
    vectors = quantised(table(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])]), "vector")
    found = top_k(vectors, vectors.filter("id = 0"), 5).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 256 * 512), (0, 2, 1, 256 * 512)]
    assert top_k(vectors.limit(0), vectors, 5).collect() == []
    assert top_k(vectors, vectors.filter(F.lit(False)), 5).collect() == []


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0**28
    rows = [(0, [big, 1.0, big]), *((i, [big, float(i % 7), big]) for i in range(1, 120)), (200, [-big, 3.0, -big])]
    vectors = spark.createDataFrame(rows, "id bigint, vector array<double>")
    found = top_k(vectors, vectors.filter("id in (0, 200)"), 5, 30, 4).collect()
    expected = set()
    for q in (0, 200):
        own = [int(x) for x in dict(rows)[q]]
        score = {i: sum(a * int(b) for a, b in zip(own, v, strict=True)) for i, v in rows if i != q}
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
        expected |= {(q, rank, i, s) for rank, (i, s) in enumerate(best, 1)}
    assert {tuple(x) for x in found} == expected


def test_rounds_cover_all_shards():
    assert [rounds(n) for n in (1, 2, 9, 10, 80)] == [[1], [1, 2], [1, 9], [1, 9, 10], [1, 9, 73, 80]]


def test_columns_of_other_names_do_no_harm(spark):
    more = "id bigint, vector array<double>, shard string, block string, dim string, floor string, q string, score string"
    vectors = spark.createDataFrame([(i, [float(i)], *"abcdef") for i in range(4)], more)
    found = top_k(vectors, vectors.filter("id = 0"), 2).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 0), (0, 2, 2, 0)]
