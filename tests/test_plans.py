"""Shapes of physical plans that matter at scale."""

import os
import re

import pytest

from tallyloom.operators import cases as N
from tallyloom.operators import scoring as J
from tallyloom.plans.evaluation import evaluate
from tallyloom.plans.testbed import Testbed

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tb(spark):
    return Testbed(spark, SMALL)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_one_join_and_one_hash_aggregate(tb):
    shape = plan(J.score_predictions(tb.predictions_of("choice"), tb.decisions_of("choice")))
    assert "SortAggregate" not in shape and "ObjectHashAggregate" not in shape
    assert shape.count("HashAggregate(") == 2
    assert len(re.findall(r"(SortMerge|BroadcastHash|ShuffledHash)Join", shape)) == 1
    assert "BatchEvalPython" not in shape and "ArrowEvalPython" not in shape


def test_the_whole_evaluation_has_no_cartesian_product(tb):
    shape = plan(evaluate(tb.predictions, tb.decisions, tb.benchmarks, tb.runs))
    assert "Cartesian" not in shape and "BroadcastNestedLoopJoin" not in shape
    assert "SortAggregate" not in shape


def test_first_cases_are_limited_before_the_shuffle(tb):
    shape = plan(N.first_cases(tb.decisions_of("choice"), 5))
    assert shape.count("WindowGroupLimit") == 2
    assert shape.rindex("WindowGroupLimit") > shape.index("Exchange")


def test_scans_read_only_needed_columns(tb):
    shape = plan(J.score_predictions(tb.predictions_of("box"), tb.decisions_of("box")))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", shape):
        assert {c.split(":")[0] for c in schema.split(",")} <= {"p_partkey", "p_brand", "p_size"}


def test_exploding_cases_needs_no_shuffle(spark, tmp_path, tb):
    path = str(tmp_path / "cases")
    tb.native_cases.drop("cid", "custkey", "k").write.parquet(path)
    shape = plan(N.decisions_from_cases(spark.read.parquet(path)))
    assert "Exchange" not in shape and "Join" not in shape


def test_no_unbounded_hints_in_the_library():
    for folder, _, names in os.walk(os.path.join(ROOT, "tallyloom")):
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    text = file.read()
                words = ["crossJoin(", "localCheckpoint("]
                # The llm operators broadcast models and fetch samples, each with a documented bound.
                if os.path.basename(folder) != "llm":
                    words += ["broadcast(", ".toPandas("]
                for word in words:
                    assert word not in text, (name, word)
