"""Status by distinct known keys, ranks and positions on hot groups, salted joins."""

import pytest
from pyspark.sql import functions as F

from helpers import answer, decision, decisions, predictions, scope
from tallyloom.operators import overlap as O
from tallyloom.operators.cases import first_cases
from tallyloom.operators.leaderboard import generalization_comparison
from tallyloom.operators.ranking import with_rank
from tallyloom.operators.results import outcome_counts
from tallyloom.operators.scorer import score_cases
from tallyloom.plans.evaluation import evaluate

BENCHMARKS = "id string, task string, dataset string, decision_count bigint"
RUNS = "run_id string, provenance string"


def frames(spark):
    yes = {"true": 0.9, "false": 0.1}
    target = {"true": 1.0, "false": 0.0}
    known = decisions(spark, [decision("b-noul", i, "noul", ("true", "false"), target) for i in range(2)])
    rows = [answer(r, "b-noul", i, yes) for r in ("whole", "copy", "foreign", "part") for i in range(1)]
    rows += [answer("whole", "b-noul", 1, yes), answer("copy", "b-noul", 0, yes), answer("foreign", "b-noul", 7, yes)]
    rows += [answer("double", "b-noul", i, yes) for i in (0, 1, 1)]
    benchmarks = spark.createDataFrame([("b-noul", "noul", "d", 2)], BENCHMARKS)
    runs = spark.createDataFrame([(r, "measured") for r in ("whole", "copy", "foreign", "part", "double")], RUNS)
    return predictions(spark, rows), known, benchmarks, runs


def test_duplicate_and_unknown_keys_are_no_complete_result(spark):
    made, known, benchmarks, runs = frames(spark)
    expected = {"whole": "complete", "copy": "invalid", "foreign": "invalid", "part": "partial", "double": "invalid"}
    counted = {r["run_id"]: r["status"] for r in outcome_counts(made, benchmarks, known).collect()}
    assert counted == expected
    stored = {r["run_id"]: r["status"] for r in evaluate(made, known, benchmarks, runs).collect()}
    assert stored == expected


def test_rank_leaves_rows_without_a_value_alone(spark):
    rows = [("g", 3.0), ("g", 1.0), ("g", 3.0)] + [("g", v) for v in (None, float("nan"), float("inf")) for _ in range(30)]
    ranked = with_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()
    assert len(ranked) == len(rows)
    assert sorted(r["rank"] for r in ranked if r["rank"] is not None) == [1, 1, 3]


def test_first_cases_beyond_the_group_limit(spark):
    cases = spark.range(6000).select(F.lit("b").alias("benchmark_id"), F.col("id").cast("string").alias("case_id"), (-F.col("id")).alias("ordinal"))
    kept = first_cases(cases, 5000)
    assert kept.count() == 5000 and kept.agg(F.min(F.col("case_id").cast("int"))).first()[0] == 1000


def test_salted_joins_on_a_hot_text(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("hot").alias("text"))
    marked = O.reuse_by_content(rows, "text", ["id"])
    assert marked.count() == 500 and marked.where("reused").count() == 449
    training, inputs = rows.withColumn("config", F.lit("c")), rows.where("id in (1, 20)")
    assert O.decontaminated(training, inputs, "text").count() == 49
    assert O.removed_ids(training, inputs, "text").count() == 451
    once = O.computed_once(rows, "text", lambda t: t.select("content_key", F.length("text").alias("n")))
    assert once.count() == 500


def test_two_benchmarks_in_one_cell_are_an_error(spark):
    from helpers import results, result

    members, benchmarks = scope(spark, ["generalization-a-diverse-noul", "generalization-b-diverse-noul"])
    table = results(spark, [result("r", b, 0.5) for b in ("generalization-a-diverse-noul", "generalization-b-diverse-noul")])
    table = table.withColumns({"model_id": F.lit("m"), "eligible": F.lit(True)})
    with pytest.raises(Exception, match="More than one benchmark"):
        generalization_comparison(table, members, benchmarks).collect()


def test_scorer_refuses_invalid_boxes_and_abstentions(spark):
    class Boxes:
        def predict(self, case):
            number = int(case["case_id"])
            box = {"left": 0.1, "top": 0.1, "right": 0.9, "bottom": 0.9}
            box |= {1: {"left": 0.95}, 2: {"bottom": 1.5}, 3: {"top": None}}.get(number, {})
            given = {"abstention": "no idea"} if number == 4 else {"box": box}
            return [{"case_id": case["case_id"], "question_id": "q", **given}]

    questions = [("q", "box", [])]
    cases = spark.createDataFrame(
        [(str(i), questions) for i in range(6)],
        "case_id string, questions array<struct<id:string,task:string,options:array<struct<id:string>>>>",
    )
    rows = {r["case_id"]: r["error"] for r in score_cases(cases, Boxes).collect()}
    assert rows == {"0": None, "1": "ValueError", "2": "ValueError", "3": "ValueError", "4": "ValueError", "5": None}


def test_median_with_an_outlier(spark):
    from tallyloom.operators.baselines import group_medians

    rows = [("g", float(i), 1) for i in range(1000)] + [("g", 1e30, 2), ("h", 2.0, 1), ("h", 5.0, 1)]
    counts = spark.createDataFrame(rows, "k string, v double, c bigint")
    found = {r["k"]: r["median"] for r in group_medians(counts, "k", "v").collect()}
    assert found == {"g": 500.5, "h": 3.5}
