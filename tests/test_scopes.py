import pytest

from helpers import result, results, scope
from tallyloom.operators import results as R
from tallyloom.operators import scopes as P

IDS = ("x-noul", "y-noul", "x-choice", "x-box")


def chosen(spark, **kwargs):
    members, benchmarks = scope(spark, IDS)
    picked = P.select_scope(members, benchmarks, "c", **kwargs)
    P.require_scope(members, picked, "c", kwargs.get("names"))
    return sorted(r["id"] for r in picked.collect())


def test_restrictions_combine(spark):
    assert chosen(spark) == sorted(IDS)
    assert chosen(spark, exclude_box=True, task="noul") == ["x-noul", "y-noul"]
    assert chosen(spark, names=["x-choice", "x-noul"], task="noul") == ["x-noul"]


def test_bad_selections_are_errors(spark):
    with pytest.raises(ValueError, match="not in the category"):
        chosen(spark, names=["x-noul", "zz"])
    with pytest.raises(ValueError, match="No benchmarks"):
        chosen(spark, task="score")
    with pytest.raises(ValueError, match="No benchmarks"):
        chosen(spark, generalization_only=True)


def test_prefix_families_are_a_parameter(spark):
    assert chosen(spark, generalization_only=True, prefixes=("datasets/x-", "datasets/q-")) == [
        "x-box", "x-choice", "x-noul"]


def test_gaps_list_only_what_is_missing(spark):
    members, _ = scope(spark, IDS)
    rows = [result("a", b, 0.5) for b in IDS] + [result("b", "x-noul", 0.5, status="partial")]
    runs = spark.createDataFrame([("a", "c"), ("b", "c"), ("new", "c")], "run_id string, category string")
    missing = {(r["run_id"], r["benchmark_id"]) for r in R.missing_results(results(spark, rows), members, runs).collect()}
    assert missing == {(r, b) for r in ("b", "new") for b in IDS}


def test_all_runs_show_when_none_is_complete(spark):
    members, _ = scope(spark, IDS)
    partial = [result("a", "x-noul", 0.5, status="partial"), result("d", "x-noul", 0.5, provenance="demo")]
    shown = lambda rows, **k: {r["run_id"] for r in P.visible_runs(results(spark, rows), members, **k).collect()}
    assert shown(partial) == {"a", "d"}
    complete = [*partial, result("b", "x-noul", 0.5)]
    assert shown(complete) == {"b"}
    assert shown(complete, include_incomplete=True) == {"a", "b", "d"}
