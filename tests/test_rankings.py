import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import result, results, scope
from tallyloom.operators import comparison as C
from tallyloom.operators import leaderboard as L
from tallyloom.operators.baselines import group_medians
from tallyloom.operators.ranking import tie_ranks, with_position

IDS = ("x-noul", "y-noul", "x-choice", "x-score")


def borda(spark, rows, ids=IDS):
    members, benchmarks = scope(spark, ids)
    scored = L.borda_scores(results(spark, rows), members, benchmarks)
    return {r["run_id"]: r["borda"] for r in scored.collect()}


def grid(scores, **kwargs):
    """Result rows from {run: [score per id]}."""
    return [result(run, b, s, **kwargs) for run, row in scores.items() for b, s in zip(IDS, row)]


def test_borda_shares_points_between_ties(spark):
    found = borda(spark, grid({"a": [0.9, 0.5, 0.2, 0.4], "b": [0.5, 0.5, 0.2, 0.3], "c": [0.1, 0.5, 0.1, 0.9]}))
    assert found["a"] == pytest.approx((1 + 0.5 + 0.75 + 0.5) / 4)
    assert found["b"] == pytest.approx((0.5 + 0.5 + 0.75 + 0) / 4)
    # Points of one benchmark always add up to N / 2.
    assert sum(found.values()) == pytest.approx(3 / 2)


def test_borda_keeps_under_monotone_transforms(spark):
    scores = {f"r{i}": [random.Random(i * 7 + j).randint(0, 4) / 5 for j in range(4)] for i in range(6)}
    squared = {k: [v * v for v in row] for k, row in scores.items()}
    assert borda(spark, grid(scores)) == pytest.approx(borda(spark, grid(squared)))


def test_borda_gates(spark):
    full = {"a": [0.1] * 4, "b": [0.2] * 4}
    assert borda(spark, grid({"a": [0.1] * 4})) == {"a": None}
    partial = grid(full) + [result("c", b, 0.9, status="partial") for b in IDS]
    demo = grid(full) + [result("d", b, 0.9, provenance="demo") for b in IDS]
    assert set(borda(spark, partial)) == set(borda(spark, demo)) == {"a", "b"}
    # One benchmark without room nulls every score but keeps the rows.
    no_room = [r for r in grid(full) if r[1] != "y-noul"]
    no_room += [result(run, "y-noul", None, room=0.0) for run in full]
    assert borda(spark, no_room) == {"a": None, "b": None}


def test_boxes_do_not_rank(spark):
    ids = (*IDS, "x-box")
    rows = grid({"a": [0.1] * 4, "b": [0.2] * 4}) + [result("b", "x-box", 0.0)]
    assert borda(spark, rows, ids) == {"a": 0.0, "b": 1.0}


def test_task_scores_need_every_required_benchmark(spark):
    members, benchmarks = scope(spark, IDS)
    rows = [result("a", "x-noul", 0.4), result("a", "y-noul", None, room=0.0),
            result("b", "x-noul", 0.4), result("c", "x-noul", 0.4), result("c", "y-noul", None)]
    means = L.task_means(results(spark, rows), members, benchmarks).where("task = 'noul'")
    found = {r["run_id"]: r["value"] for r in means.collect()}
    # Ineligible benchmarks drop out; missing ones and undefined scores null the task.
    assert found == {"a": pytest.approx(0.4), "b": None, "c": None}


def test_demo_and_partial_cells_cannot_win(spark):
    members, benchmarks = scope(spark, ("x-noul", "x-choice"))
    rows = [result("a", "x-noul", 0.3), result("b", "x-noul", 0.2), result("c", "x-noul", 0.1, status="partial"),
            result("d", "x-noul", 0.0, provenance="demo"), result("a", "x-choice", 0.9)]
    cells = C.compare_runs(results(spark, rows), members, benchmarks, ["a", "b", "c", "d", "a", "zz"])
    assert cells.count() == 8
    best = {(r["benchmark_id"], r["run_id"]) for r in C.with_best(cells).where("best").collect()}
    assert best == {("x-noul", "b")}
    delta = {r["run_id"]: r["delta"] for r in C.with_delta(cells, "a").where("benchmark_id = 'x-noul'").collect()}
    assert delta["b"] == pytest.approx(0.1) and delta["c"] is None and delta["d"] is None
    spread = {r["benchmark_id"]: r["spread"] for r in C.benchmark_spread(cells).collect()}
    assert spread["x-noul"] == pytest.approx(0.1) and spread["x-choice"] is None


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds two thirds of the rows, and one value most of that group."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 11}", 0.0 if i % 2 else rng.random() - 0.5, i) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "g string, v double, i int").repartition(16)


def test_tie_ranks_equal_brute_force(hot):
    rows, df = hot
    for descending in (True, False):
        found = {(r["g"], r["v"]): (r["ties"], r["rank"]) for r in tie_ranks(df, ["g"], "v", descending=descending).collect()}
        counts = Counter((g, v) for g, v, _ in rows)
        for (g, v), n in counts.items():
            ahead = sum(c for (h, w), c in counts.items() if h == g and (w > v if descending else w < v))
            assert found[g, v] == (n, ahead + 1)


def test_positions_equal_brute_force(hot):
    rows, df = hot
    found = {r["i"]: r["position"] for r in with_position(df, ["g"], [F.col("v").desc(), F.col("i")], partitions=7).collect()}
    for group in {g for g, _, _ in rows}:
        ordered = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))
        assert [found[r[2]] for r in ordered] == list(range(1, len(ordered) + 1))


@pytest.mark.parametrize("ends", [(None, None), (-0.5, 0.5)])
def test_medians_equal_brute_force(hot, ends):
    from statistics import median

    rows, df = hot
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    found = {r["g"]: r["median"] for r in group_medians(counts, "g", "v", *ends).collect()}
    for group in {g for g, _, _ in rows}:
        assert found[group] == pytest.approx(median(v for g, v, _ in rows if g == group), abs=1e-15)


def test_median_of_an_even_group_interpolates(spark):
    counts = spark.createDataFrame([("a", 0.0, 2), ("a", 1.0, 2), ("b", 0.2, 1)], "g string, v double, c bigint")
    found = {r["g"]: r["median"] for r in group_medians(counts, "g", "v", 0.0, 1.0).collect()}
    assert found == {"a": 0.5, "b": 0.2}


def test_order_independent_of_partitioning(spark):
    rows = grid({f"r{i}": [((i * 7 + j) % 5) / 5 for j in range(4)] for i in range(8)})
    members, benchmarks = scope(spark, IDS)
    table = results(spark, rows)
    outputs = [sorted(map(tuple, L.borda_scores(t, members, benchmarks).collect()))
               for t in (table, table.repartition(5), table.coalesce(1))]
    assert outputs[0] == outputs[1] == outputs[2]
