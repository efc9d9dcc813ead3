"""What must hold when one key, range or folder is not as small as the others."""

import re

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import baselines as B
from tallyloom.operators import cases as N
from tallyloom.operators import overlap as O
from tallyloom.operators import results as R
from tallyloom.operators import scoring as J
from tallyloom.operators import snapshot as Z
from tallyloom.plans.testbed import Testbed
from tallyloom.sources import cases as S
from tallyloom.sources import writers as W

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, copies=900, others=100):
    """One text holds nine tenths of all rows."""
    return spark.range(copies + others).selectExpr(
        "id", f"if(id < {copies}, 'hot', concat('text ', id % 40)) text", "if(id % 2 = 0, 'a', 'b') config"
    )


def test_a_hot_text_is_dealt_by_its_own_count(spark):
    rows = texts(spark)
    keyed = rows.withColumn("content_key", F.sha2("text", 256))
    counts = keyed.groupBy("content_key").agg(F.count(F.lit(1)).alias("n"))
    assert [r["_salts"] for r in O.hot_keys(counts, "content_key", 100).collect()] == [9]
    expected = {r["id"]: (0 if r["id"] < 900 else min(i for i in range(900, 1000) if i % 40 == r["id"] % 40)) for r in rows.collect()}
    for per_task in (100, 10**6):
        marked = O.reuse_by_content(rows, "text", ["id"], per_task)
        found = {r["id"]: r["source"]["id"] for r in marked.collect()}
        assert found == expected and marked.count() == 1000
    shape = plan(O.reuse_by_content(rows, "text", ["id"], 100))
    assert "monotonically_increasing_id" not in shape and "xxhash64" in shape


def test_salts_follow_from_the_rows_alone(spark):
    rows = texts(spark).withColumn("content_key", F.sha2("text", 256))
    per_key = rows.select("content_key").distinct().withColumn("v", F.length("content_key"))
    once = O._salted_join(rows, per_key, "content_key", "inner", 50)
    again = O._salted_join(rows.repartition(7, "config").sortWithinPartitions(F.desc("id")), per_key, "content_key", "inner", 50)
    assert once.exceptAll(again).isEmpty() and once.count() == again.count() == 1000


def test_decontamination_of_a_hot_text(spark):
    rows = texts(spark)
    inputs = spark.createDataFrame([("b", "hot", 1), ("b", "text 3", 1)], "benchmark_id string, text string, decisions int")
    left = O.decontaminated(rows, inputs, "text", 100)
    assert left.count() == 100 - sum(1 for i in range(900, 1000) if i % 40 == 3)
    gone = O.removed_ids(rows, inputs, "text", 100)
    assert gone.count() + left.count() == 1000


@pytest.mark.parametrize("scale", [1.0, 1 / 20_000, 1e-12])
def test_medians_of_values_that_lie_close_together(spark, scale):
    """All distinct values inside one bucket of the first cut, around a point of the range."""
    values = [0.5 + scale * (i / 5003 - 0.5) for i in range(5000)]
    rows = spark.createDataFrame([("g", v, 1 + i % 3) for i, v in enumerate(values)] + [("h", 0.25, 4), ("i", 0.1, 1), ("i", 0.3, 1)], "g string, v double, c bigint")
    whole = sorted(v for i, v in enumerate(values) for _ in range(1 + i % 3))
    n = len(whole)
    found = {r["g"]: r["median"] for r in B.group_medians(rows, "g", "v", 0.0, 1.0).collect()}
    assert found == {"g": (whole[(n - 1) // 2] + whole[n // 2]) / 2, "h": 0.25, "i": 0.2}
    assert {r["g"]: r["median"] for r in B.group_medians(rows, "g", "v").collect()} == found


def test_the_second_cut_spreads_what_the_first_left(spark):
    rows = spark.range(5000).selectExpr(
        "'g' g", "0.5D + id * 1e-9D v", "1L c", "0L cell", "0D low", "1D high", "0L before", "cast(null as bigint) r1", "cast(null as bigint) r2"
    )
    one = B._middle_cells(rows, "g")
    assert one.count() == 5000
    assert B._middle_cells(one, "g").count() <= 2


def test_unlisted_files_are_never_opened(spark, tmp_path):
    tb = Testbed(spark, SMALL)
    cases = tb.native_cases.drop("cid", "custkey", "k").limit(5)
    cases.coalesce(1).write.parquet(str(tmp_path / "good"))
    file = next(p for p in (tmp_path / "good").iterdir() if p.suffix == ".parquet")
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 this is no table")
    listed = f"good/{file.name}"
    manifest = spark.createDataFrame([("d", "test", 5, [listed])], "dataset string, split string, cases int, data_files array<string>")
    rows = S.read_manifest(spark, str(tmp_path), manifest)
    assert rows.count() == 5 and {r["entry_dataset"] for r in rows.select("entry_dataset").collect()} == {"d"}
    missing = manifest.withColumn("data_files", F.array(F.lit(listed), F.lit("gone.parquet")))
    with pytest.raises(ValueError, match="gone.parquet: missing"):
        S.read_manifest(spark, str(tmp_path), missing)
    assert S.read_manifest(spark, str(tmp_path), manifest.limit(0)).count() == 0


def test_unsound_cases_are_named_or_end_the_job(spark):
    tb = Testbed(spark, SMALL)
    cases = tb.native_cases.where("cid <= 40")
    odd = cases.withColumn("targets", F.expr("if(cid % 2 = 1, slice(targets, 1, 1), targets)"))
    total, broken = odd.count(), odd.where("cid % 2 = 1").count()
    found = N.accounted_decisions(odd)
    assert found.where("problem is null").count() == 2 * (total - broken)
    assert found.where("problem = 'decision without a target' and question_id is null").count() == broken
    assert N.decisions_from_cases(odd).count() == 2 * (total - broken)
    assert N.quarantined_cases(odd).count() == broken == total - N.questions_view(odd).count()
    with pytest.raises(Exception, match="decision without a target"):
        N.decisions_from_cases(odd, strict=True).collect()
    assert N.decisions_from_cases(cases, strict=True).count() == 2 * total


def test_a_changed_snapshot_is_an_error(spark):
    rows = spark.createDataFrame([("b1", "choice", "r1", 1), ("b2", "noul", "r1", 2), ("b1", "choice", "r2", 3)], "benchmark string, task string, run string, v int")
    rows = rows.withColumnRenamed("benchmark", "bench")
    parts = Z.encode(rows, ["bench", "task"], ["run"])
    stored = Z.digests(*parts)
    assert Z.decode_verified(*parts, stored).count() == 3
    benchmarks, models, facts = parts
    for changed in (
        (benchmarks, models, facts.withColumn("v", F.col("v") + F.when(F.col("v") == 3, 1).otherwise(0))),
        (benchmarks.withColumn("task", F.lit("box")), models, facts),
        (benchmarks, models.limit(1), facts),
    ):
        with pytest.raises(ValueError, match="snapshot (facts|benchmarks|models): (content|row count) differs"):
            Z.decode_verified(*changed, stored)
    with pytest.raises(ValueError, match="no digest"):
        Z.decode_verified(*parts, stored.where("part <> 'facts'"))


def test_bucketed_tables_are_joined_and_counted_without_a_shuffle(spark, tmp_path):
    tb = Testbed(spark, SMALL)
    names = [f"{kind}_{tmp_path.name.replace('-', '_')}" for kind in ("decisions", "predictions")]
    try:
        decisions = W.save_colocated(tb.decisions, names[0], 8, str(tmp_path / "d"))
        predictions = W.save_colocated(tb.predictions, names[1], 8, str(tmp_path / "p"))
        joined = J.join_decisions(predictions, decisions.hint("merge"))
        assert not re.search("Exchange", plan(joined))
        counted = R.key_counts(predictions)
        first = plan(predictions.groupBy("run_id", "benchmark_id", "case_id", "question_id").count())
        assert "Exchange" not in first
        assert counted.agg(F.sum("rows")).first()[0] == tb.predictions.count() == joined.count()
    finally:
        for name in names:
            spark.sql(f"drop table if exists {name}")


def test_a_snapshot_default_stands_in_for_a_result_without_its_own(spark):
    rows = [("r1", "a", True), ("r1", "b", False), ("r2", "a", None), ("r2", "b", None), ("r2", "c", None)]
    results = spark.createDataFrame(rows, "run_id string, benchmark_id string, own_eligible boolean")
    defaults = spark.createDataFrame([("a", False), ("b", True)], "benchmark_id string, eligible boolean")
    found = {(r["run_id"], r["benchmark_id"]): r["eligible"] for r in R.default_eligibility(results, defaults).collect()}
    assert found == {("r1", "a"): True, ("r1", "b"): False, ("r2", "a"): False, ("r2", "b"): True, ("r2", "c"): False}
