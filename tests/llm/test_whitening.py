import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.whitening import Spectrum, fit, integer_vectors, rank_one, secular_roots, whiten


def table(spark, rows, parts=5):
    return spark.createDataFrame(rows, "id bigint, v array<float>").repartition(parts)


def exact(rows):
    """n, S and covariance of the sound vectors, in whole numbers up to the last division."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    away = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    y = np.array(away, float) / n
    return n, away, y, y.T @ y / n


def test_secular_roots():
    r = np.random.default_rng(1)
    for size in (1, 2, 7, 40):
        d = np.sort(r.random(size)) * 100
        z = r.normal(size=size)
        offset, near = secular_roots(d, z * z, 3.0)
        assert np.allclose(np.sort(d[near] + offset), np.linalg.eigvalsh(np.diag(d) + 3 * np.outer(z, z)), rtol=1e-12)


@pytest.mark.parametrize("values", [[0.0] * 6, [1.0, 1.0, 1.0, 2.0, 2.0, 5.0], [0.0, 1e-18, 1.0, 1.0 + 1e-15, 3.0, 1e9]])
def test_rank_one_with_deflation(values):
    r = np.random.default_rng(2)
    q = np.linalg.qr(r.normal(size=(6, 6)))[0]
    m = q @ np.diag(values) @ q.T
    for x in (r.normal(size=6), q[:, 2], q[:, 1] + q[:, 3], np.zeros(6)):
        e, v = rank_one(np.array(values), q, x, 2.0)
        assert np.allclose(v.T @ v, np.eye(6), atol=1e-13)
        assert np.allclose(v @ np.diag(e) @ v.T, m + 2 * np.outer(x, x), atol=1e-12 * max(1, values[-1]))
        assert (np.diff(e) >= 0).all()


def test_updates_and_merges_equal_the_scatter():
    r = np.random.default_rng(3)
    x = r.integers(-500, 500, (120, 7)) * [9, 5, 3, 3, 2, 1, 0] + 1000
    states = []
    for part in np.split(x, [1, 2, 50]):
        s = Spectrum.empty(7)
        for v in part:
            s.add(v, 1)
        states.append(s)
    whole = states[0]
    for s in states[1:]:
        whole.merge(s)
    weighted = Spectrum.empty(7)
    for v in x:
        weighted.add(v, 3)
    away = x - x.mean(axis=0)
    scatter = away.T @ away
    size = np.abs(scatter).max()
    assert whole.n == 120 and (whole.sums == x.sum(axis=0)).all()
    assert np.allclose(whole.vectors @ np.diag(whole.values) @ whole.vectors.T, scatter, atol=1e-11 * size)
    assert np.allclose(weighted.vectors @ np.diag(weighted.values) @ weighted.vectors.T, 3 * scatter, atol=1e-10 * size)


def test_equals_brute_force(spark):
    r = np.random.default_rng(4)
    v = (r.normal(size=(300, 12)) @ np.diag(np.linspace(1, 0.05, 12)) @ r.normal(size=(12, 12))).astype(np.float32)
    v[100:200] = v[100]  # a very common vector
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    junk = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [])]
    n, away, y, cov = exact(rows)
    e, q = np.linalg.eigh(cov)
    found = whiten(integer_vectors(table(spark, rows + junk), "id", "v")).collect()
    assert len(found) == 300 * 8 and {r["n"] for r in found} == {300}
    for x in found:
        i, k = x["id"], x["component"]
        assert x["deviation"] == sum(c * c for c in away[i])
        assert math.isclose(x["explained"], e[-k] / np.trace(cov), rel_tol=1e-10)
        assert math.isclose(abs(x["whitened"]), abs(y[i] @ q[:, -k]) / math.sqrt(e[-k]), rel_tol=1e-7, abs_tol=1e-8)
        assert x["identity_error"] < 1e-9
    for k in range(1, 9):  # one sign for all rows
        w = np.array([x["whitened"] for x in sorted(found, key=lambda x: x["id"]) if x["component"] == k])
        assert abs(w @ (y @ q[:, -k])) > 0.999999 * np.linalg.norm(w) * np.linalg.norm(y @ q[:, -k])


def test_edges(spark):
    none = integer_vectors(table(spark, []), "id", "v")
    assert fit(none) == {} and whiten(none).collect() == []
    one = whiten(integer_vectors(table(spark, [(1, [0.5, 0.25])]), "id", "v")).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    # Null and repeated ids count each; lengths are apart; a flat direction has no variance; extra columns may clash.
    rows = [(None, [0.0, 1.0]), (None, [1.0, 1.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0]), (8, [1.0]), (9, [3.0])]
    mixed = table(spark, rows).withColumns({"x": F.lit(1), "n": F.lit("a"), "dim": F.lit(None), "component": F.lit(2)})
    found = whiten(integer_vectors(mixed, "id", "v")).collect()
    assert sorted((r["component"], r["n"]) for r in found) == [(1, 2)] * 2 + [(1, 4)] * 4 + [(2, 4)] * 4
    flat = [r for r in found if r["component"] == 2]
    assert all(r["whitened"] is None and r["explained"] == 0 for r in flat)
    assert sorted(round(abs(r["whitened"]), 9) for r in found if r["n"] == 2) == [1.0, 1.0]
    large = whiten(integer_vectors(table(spark, [(1, [3e38]), (2, [-3e38]), (3, [0.0])]), "id", "v")).collect()
    assert all(r["deviation"] is None for r in large if r["id"] != 3)
