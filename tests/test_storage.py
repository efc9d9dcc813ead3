import json
import lzma
import os
import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.scorer import UniformScorer, score_cases
from tallyloom.sources import assets as A
from tallyloom.sources import bundles as B
from tallyloom.sources import definitions as D
from tallyloom.sources import documents as Q
from tallyloom.sources import writers as W
from tallyloom.sources.files import CommitLog
from tallyloom.streaming import ingest as I
from tallyloom.validation import checks as C


def bundle(run, benchmark, **extra):
    return {"format_version": 1, "run_id": run, "benchmark": {"id": benchmark, "task": "noul"},
            "status": "complete", "environment": {"python": "3", "nested": {"a": [1]}},
            "metrics": {"f1": None, "accuracy": 0.5},
            "predictions": [{"case_id": "c", "question_id": "q", "probabilities": {"true": 1, "false": 0}}], **extra}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "m1").mkdir()
    (tmp_path / "m2" / "deep").mkdir(parents=True)
    (tmp_path / "m1" / "metadata.json").write_text("{}")
    packed = lzma.compress(json.dumps(bundle("r1", "b1")).encode())
    (tmp_path / "m1" / "b1.json.xz").write_bytes(packed)
    (tmp_path / "m1" / "b2.json.xz").write_bytes(packed[:-8])
    (tmp_path / "m1" / "b3.json.xz").write_bytes(packed + b"x")
    (tmp_path / "m1" / "b4.json.xz").write_bytes(b"this is no archive at all")
    (tmp_path / "m2" / "deep" / "b1.json").write_text(json.dumps(bundle("r2", "b1")))
    (tmp_path / "m2" / "b5.json").write_text('{"run_id": "r2", "run_id": "r3"}')
    (tmp_path / "m2" / "b6.json").write_text('{"elapsed_seconds": NaN}')
    (tmp_path / "m2" / "b7.json.xz").write_bytes(packed)
    (tmp_path / "m2" / "notes.txt").write_text("skip")
    return tmp_path


def test_bundles_are_read_or_named_as_problems(spark, folder):
    rows = {r["path"].rsplit("/", 2)[-2] + "/" + r["path"].rsplit("/", 1)[-1]: r
            for r in B.read_bundles(spark, str(folder)).collect()}
    problems = {k: r["problem"] for k, r in rows.items()}
    assert problems == {
        "m1/b1.json.xz": None, "m1/b2.json.xz": "truncated stream or trailing data",
        "m1/b3.json.xz": "truncated stream or trailing data", "m1/b4.json.xz": "not an XZ stream",
        "deep/b1.json": None, "m2/b5.json": "invalid JSON", "m2/b6.json": "invalid JSON", "m2/b7.json.xz": None,
    }
    result = rows["m1/b1.json.xz"]["result"]
    assert result["metrics"] == {"f1": None, "accuracy": 0.5}
    assert json.loads(result["environment"]) == {"python": "3", "nested": {"a": [1]}}
    assert result["predictions"][0]["probabilities"] == {"true": 1.0, "false": 0.0}


def test_archives_need_metadata(spark, folder):
    listed = B.list_bundles(spark, str(folder))
    assert listed.count() == 8
    lone = [r["path"].rsplit("/", 1)[-1] for r in B.unpublished_archives(listed).collect()]
    assert lone == ["b7.json.xz"]


def test_documents_are_split_at_any_place():
    document = {"a": [1, {"b": "x]}\\\"" }], "n": -12.5e3, "predictions": [{"p": "é,]"}, 17, [], "s", None], "z": {"predictions": [1]}}
    for text in (json.dumps(document), json.dumps(document, indent=2, ensure_ascii=False) + "\n"):
        for size in (1, 2, 3, 7, 1000):
            parts = list(Q.split_document(text[i : i + size] for i in range(0, len(text), size)))
            assert [json.loads(t) for k, t in parts if k == "prediction"] == document["predictions"]
            assert parts[-1][0] == "head"
            assert json.loads(parts[-1][1]) == {k: v for k, v in document.items() if k != "predictions"}
    assert list(Q.split_document(["{}"])) == [("head", "{}")]
    for bad in ("", "[]", "{", '{"a":1', '{"a" 1}', '{"predictions":[1 2]}', '{"predictions":[1],"predictions":[2]}', "{} x", '{"a":}'):
        with pytest.raises(ValueError, match="invalid JSON"):
            list(Q.split_document([bad]))


def test_read_documents_by_the_rule_of_published_folders(spark, folder):
    (folder / "m1" / "b1.json").write_text(json.dumps(bundle("r1", "b1")))  # a plain copy beside its archive
    (folder / "m2" / "b8.json").write_text(json.dumps(bundle("r2", "b8", predictions=[1])).replace("[1]", '[{"case_id": "a"}, {"case_id": "a", "case_id": "b"}]'))
    files = Q.result_files(spark, [str(folder)])
    heads, predictions = Q.read_documents(files)
    found = {r["path"].rsplit("/", 2)[-2] + "/" + r["path"].rsplit("/", 1)[-1]: r["problem"] for r in heads.collect()}
    assert found == {
        "m1/b1.json.xz": None, "m1/b2.json.xz": "truncated stream or trailing data",
        "m1/b3.json.xz": "truncated stream or trailing data", "m1/b4.json.xz": "not an XZ stream", "deep/b1.json": None,
        "m2/b5.json": "invalid JSON", "m2/b6.json": "invalid JSON", "m2/b7.json.xz": "archive without metadata", "m2/b8.json": "invalid JSON",
    }
    assert sorted((r["run_id"], r["case_id"], r["probabilities"]["true"]) for r in predictions.collect()) == [("r1", "c", 1.0), ("r2", "c", 1.0)]
    assert [(r["source"], r["files"]) for r in Q.source_counts(files).collect()] == [(folder.name, 9)]


@pytest.mark.parametrize("compressed", [True, False])
def test_documents_go_out_and_come_back(spark, tmp_path, compressed):
    heads = spark.createDataFrame([("r", "b", "é"), ("r", "c", "none"), ("s", "b", "x")], "run_id string, benchmark_id string, status string")
    heads = heads.select("run_id", "benchmark_id", F.struct("run_id", F.struct(F.col("benchmark_id").alias("id")).alias("benchmark"), "status").alias("result"))
    rows = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 's', 'r') run_id", "'b' benchmark_id", "cast(id as string) case_id", "'q' question_id",
        "map('true', id / 30000) probabilities", "cast(null as struct<left:double,top:double,right:double,bottom:double>) box",
        "cast(null as string) error", "if(id = 5, 'a\nb', null) abstention",
    )
    for _ in range(2):  # a retried task writes the same documents again
        Q.write_result_documents(heads, rows, str(tmp_path), compressed)
    if compressed:
        for run in "rs":
            (tmp_path / run / "metadata.json").write_text("{}")
    suffix = ".json.xz" if compressed else ".json"
    assert sorted(p.name for p in (tmp_path / "r").glob("*.json*") if p.name != "metadata.json") == ["b" + suffix, "c" + suffix]
    read, predictions = Q.read_documents(Q.result_files(spark, [str(tmp_path)]))
    assert {(r["result"]["run_id"], r["result"]["benchmark"]["id"], r["result"]["status"]) for r in read.collect()} == {("r", "b", "é"), ("r", "c", "none"), ("s", "b", "x")}
    expected = {(r["run_id"], r["case_id"], r["probabilities"]["true"], r["abstention"]) for r in rows.collect()}
    back = [(r["run_id"], r["case_id"], r["probabilities"]["true"], r["abstention"]) for r in predictions.collect()]
    assert len(back) == 30_000 and set(back) == expected
    with pytest.raises(Exception, match="Predictions without a result"):
        Q.write_result_documents(heads.where("run_id = 'r'"), rows, str(tmp_path / "other"), compressed)


def test_documents_of_any_size_are_read():
    large = b"[" + b"1," * (35 << 20) + b"1]"
    assert B.decompress(large, False) == (large.decode(), None)
    assert B.decompress(lzma.compress(large, preset=0), True) == (large.decode(), None)


def test_flat_tables_stop_at_a_broken_bundle(spark, folder):
    bundles = B.read_bundles(spark, str(folder))
    broken = B.bundle_problems(bundles).collect()
    assert broken and {r["check"] for r in broken} == {"bundle"}
    for flat in (B.flat_results, B.flat_predictions):
        with pytest.raises(Exception, match="json"):
            flat(bundles).collect()
        flat(bundles, strict=False).collect()


def test_definitions_registry_and_metadata(spark, tmp_path):
    entry = {"benchmark_id": "b", "relationship": "related_domain", "evidence_url": "https://e.com", "note": "n"}
    (tmp_path / "categories").mkdir()
    (tmp_path / "categories" / "c1.json").write_text(
        json.dumps({"id": "c1", "name": "C", "description": "", "benchmarks": ["b", "a"]}, indent=2))
    (tmp_path / "registry.json").write_text(
        json.dumps({"disclosures": [{"model_ids": ["o__m", "o__n"], "training_exposure": [entry]}]}))
    (tmp_path / "models" / "o__m").mkdir(parents=True)
    (tmp_path / "models" / "o__m" / "metadata.json").write_text(
        json.dumps({"model_id": "o__m", "display_name": "M", "short_name": "M", "total_params": 5}))
    category = D.read_categories(spark, str(tmp_path / "categories")).first()
    assert category["benchmarks"] == ["b", "a"] and category["name_matches"]
    registry = D.read_registry(spark, str(tmp_path / "registry.json")).first()
    assert registry["model_ids"] == ["o__m", "o__n"] and registry["training_exposure"][0]["note"] == "n"
    model = D.read_metadata(spark, str(tmp_path / "models" / "*")).first()
    assert (model["folder"], model["total_params"], model["training_exposure"]) == ("o__m", 5, None)


def test_written_documents_appear_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.json.xz", "é" * 10), ("a/y.json", "plain")], "name string, text string")
    for _ in range(2):  # A retried task writes the same files again.
        W.write_documents(rows, str(tmp_path), "name", "text").write.format("noop").mode("overwrite").save()
    assert lzma.decompress((tmp_path / "a" / "x.json.xz").read_bytes()).decode() == "é" * 10
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["x.json.xz", "y.json"]


def test_existing_results_stay(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("r1", "b1", 1), ("r1", "b2", 2)], "run_id string, benchmark_id string, v int")
    W.write_results(rows, path)
    with pytest.raises(ValueError, match="already exists"):
        W.write_results(rows.limit(1), path)
    with pytest.raises(ValueError, match="conflicting"):
        W.export_results(rows.withColumn("benchmark_id", F.lit("b1")), path, ["v"])
    assert W.read_results(spark, path).count() == 2
    W.write_results(rows.withColumn("run_id", F.lit("r2")), path)
    assert W.read_results(spark, path).count() == 4


def test_one_of_two_writers_of_a_result_wins(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([(f"r{i}", "b", i) for i in range(4)], "run_id string, benchmark_id string, v int")

    def write(i):
        try:
            # All write r0, and one result of their own that must not stay without it.
            W.write_results(rows.where(F.col("v").isin(0, i)).withColumn("v", F.lit(i)), path)
            return True
        except ValueError:
            return False

    with ThreadPoolExecutor(3) as pool:
        won = list(pool.map(write, (1, 2, 3)))
    assert won.count(True) == 1
    winner = won.index(True) + 1
    stored = {(r["run_id"], r["v"]) for r in W.read_results(spark, path).collect()}
    assert stored == {("r0", winner), (f"r{winner}", winner)}
    assert len([n for n in os.listdir(path) if n.startswith("write=")]) == 1


def test_a_writer_looks_again_when_another_was_first(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("r1", "b", 1), ("r2", "b", 2), ("r3", "b", 3)], "run_id string, benchmark_id string, v int")
    commit, tried = CommitLog.commit, []

    def late(log, number, text):
        if not tried:  # between this writer's look and its commit, another one commits
            tried.append(number)
            W.write_results(rows.where("v <> 1"), path)
        return commit(log, number, text)

    monkeypatch.setattr(CommitLog, "commit", late)
    with pytest.raises(ValueError, match="already exists"):
        W.write_results(rows.where("v <> 3"), path)
    tried.clear()
    other = rows.selectExpr("concat('x', run_id) run_id", "benchmark_id", "v")
    tried.append(0)
    W.write_results(other, path)
    assert {r["run_id"] for r in W.read_results(spark, path).collect()} == {"r2", "r3", "xr1", "xr2", "xr3"}


def test_publishers_never_share_a_number(spark, tmp_path):
    none = spark.createDataFrame([], "check string, subject string, detail string")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda i: W.publish_snapshot(spark.range(i), str(tmp_path), f"g{i}", none), range(1, 7)))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    assert W.current_snapshot(spark, str(tmp_path)).count() == numbers.index(6) + 1


def test_a_number_is_created_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.newest() == 0 and log.entries() == []
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: log.commit(1, f"writer {i}"), range(8)))
    assert won.count(True) == 1 and log.entries() == [f"writer {won.index(True)}"]
    assert log.commit(2, "é") and log.entries(1) == ["é"] and log.entry(2) == "é"
    assert sorted(os.listdir(tmp_path / "log")) == [f"{n:020d}" for n in (1, 2)] or all(
        n.isdigit() or n.endswith(".crc") for n in os.listdir(tmp_path / "log")
    )


def test_release_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "ok").write_text("a")
    (tmp_path / "d" / "bad").write_text("b")
    (tmp_path / "d" / "extra").write_text("c")
    good = "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"
    sums = spark.createDataFrame([("d/ok", good), ("d/bad", good), ("d/gone", good), ("/abs", good)], "path string, sha256 string")
    found = {r["subject"]: r["detail"] for r in A.verify_release(spark, str(tmp_path), sums).collect()}
    assert found == {"d/bad": "checksum differs", "d/gone": "missing", "d/extra": "unlisted", "/abs": "unsafe path"}


def test_failures_stay_in_their_case(spark):
    class Picky(UniformScorer):
        case_batch_size = 3

        def predict(self, case):
            assert set(case) == {"case_id", "questions"}
            if case["case_id"] == "3":
                raise KeyError("body of the request")
            answers = super().predict(case)
            if case["case_id"] == "4":
                answers[0]["case_id"] = "5"
            if case["case_id"] == "6":
                return [{"case_id": "6", "question_id": "q", "abstention": "refusal"}]
            if case["case_id"] == "7":
                answers[0]["box"] = {"left": 0.0, "top": 0.0, "right": 1.0, "bottom": 1.0}
            return answers

        def predict_batch(self, cases):
            return [self.predict(c) for c in cases]

    questions = [("q", "choice", [("a",), ("b",)])]
    cases = spark.createDataFrame(
        [(str(i), questions, "bench") for i in range(9)],
        "case_id string, questions array<struct<id:string,task:string,options:array<struct<id:string>>>>, benchmark_id string",
    ).repartition(2)
    rows = {r["case_id"]: r for r in score_cases(cases, Picky, ("benchmark_id",)).collect()}
    assert len(rows) == 9 and {r["benchmark_id"] for r in rows.values()} == {"bench"}
    errors = {k: r["error"] for k, r in rows.items() if r["error"]}
    assert errors == {"3": "KeyError", "4": "ValueError", "7": "ValueError"}
    assert rows["6"]["abstention"] == "refusal" and rows["6"]["probabilities"] is None
    assert rows["0"]["probabilities"] == {"a": 0.5, "b": 0.5}


def deliver(spark, source, rows):
    """(case, p, arrived) rows as one file."""
    table = spark.createDataFrame(rows, "case_id string, p double, arrived string").coalesce(1)
    table.selectExpr(
        "'r' run_id", "'b' benchmark_id", "case_id", "'q' question_id", "map('true', p) probabilities",
        "cast(null as struct<left:double,top:double,right:double,bottom:double>) box", "cast(null as string) error",
        "cast(null as string) abstention", "cast(arrived as timestamp) arrived_at",
    ).write.mode("append").parquet(source)


def test_ingest_resumes_without_repeating(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    # The last rows come two weeks late: the new one is taken, the copy is not.
    days = ("2024-01-20", "2024-01-21", "2024-01-22", "2024-01-06")
    for ids, day in zip((range(5), range(3, 8), range(0), range(7, 9)), days, strict=True):
        deliver(spark, source, [(str(i), 0.5, day) for i in ids])
        I.ingest(spark, source, target, progress).awaitTermination()
    found = sorted(int(r["case_id"]) for r in spark.read.parquet(target).collect())
    assert found == list(range(9))


def test_a_batch_costs_what_it_brings(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    deliver(spark, source, [(str(i), 0.5, "2024-01-01") for i in range(200)])
    I.ingest(spark, source, target, progress).awaitTermination()
    shutil.rmtree(target)  # the keys are state; a batch does not look at the table
    deliver(spark, source, [(str(i), 0.5, "2024-01-02") for i in range(198, 203)])
    run = I.ingest(spark, source, target, progress)
    run.awaitTermination()
    assert sorted(r["case_id"] for r in spark.read.parquet(target).collect()) == ["200", "201", "202"]
    state = run.lastProgress["stateOperators"][0]
    assert state["numRowsUpdated"] == 3 and state["numRowsTotal"] == 203
    assert any("rocksdb" in name.lower() for name in state["customMetrics"])


def test_differing_copies_are_settled_by_rule_and_replay(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    first = [("a", 0.9, "2024-01-03"), ("a", 0.7, "2024-01-02"), ("a", 0.3, "2024-01-02"), ("b", 0.2, None), ("b", 0.8, "2024-01-09")]
    deliver(spark, source, first)
    I.ingest(spark, source, target, progress).awaitTermination()
    deliver(spark, source, [("a", 0.1, "2023-01-01"), ("c", 0.6, "2024-01-01"), ("c", 0.4, "2024-01-01")])
    I.ingest(spark, source, target, progress).awaitTermination()
    value = lambda: {r["case_id"]: r["probabilities"]["true"] for r in spark.read.parquet(target).collect()}
    # Earliest arrival, then smallest content; an earlier batch stays.
    assert value() == {"a": 0.3, "b": 0.8, "c": 0.4}
    # The last batch is replayed after a crash before its commit.
    for name in os.listdir(tmp_path / "progress" / "commits"):
        if name.strip(".").startswith("1"):
            os.remove(tmp_path / "progress" / "commits" / name)
    shutil.rmtree(f"{target}/batch=1")
    I.ingest(spark, source, target, progress).awaitTermination()
    assert value() == {"a": 0.3, "b": 0.8, "c": 0.4}


def test_live_counts_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "COMPACT_EVERY", 3)
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    benchmarks = spark.createDataFrame([("b", 100)], "id string, decision_count bigint")
    for i in range(11):
        deliver(spark, source, [(f"{i}-{j}", 0.5, "2024-01-01") for j in range(i + 1)])
    I.live_counts(spark, source, target, progress, files_per_trigger=1).awaitTermination()
    folders = sorted(n for n in os.listdir(target) if "=" in n)
    assert folders == ["batch=10", "batch=6", "batch=7", "batch=8", "batch=9", "snapshot=5", "snapshot=8"]
    found = I.latest_counts(spark, target, benchmarks).collect()
    assert [(r["recorded"], r["succeeded"], r["coverage"]) for r in found] == [(66, 66, 0.66)]
    # A reader falls back to what the unfinished snapshot is made from; making it again gives the same.
    os.remove(f"{target}/snapshot=8/_SUCCESS")
    assert I.latest_counts(spark, target, benchmarks).first()["recorded"] == 66
    I.compact_counts(spark, target, 8)
    assert I.latest_counts(spark, target, benchmarks).first()["recorded"] == 66


def test_raise_on_names_examples(spark):
    none = spark.createDataFrame([], "check string, subject string, detail string")
    C.raise_on(none)
    with pytest.raises(ValueError, match="box r/b: edge"):
        C.raise_on(spark.createDataFrame([("box", "r/b", "edge")], none.schema))


def test_whole_documents_of_tables(spark, tmp_path):
    rows = [(2, 'say "hi"', "é\nx", "https://a.example/b", ""), (1, "=sum", "p|q", "", "")]
    table = spark.createDataFrame(rows, "k int, Model string, Lang string, url string, huggingface string")
    for name, write in (("csv", W.write_csv), ("md", W.write_markdown)):
        write(table, ["Model", "Lang"], ["k"], str(tmp_path / name))
    read = lambda name: b"".join(p.read_bytes() for p in sorted((tmp_path / name).glob("part-*")))
    csv, markdown = read("csv"), read("md")
    assert csv.startswith(b'"Model","Lang","url","huggingface"\r\n') and csv.endswith(b"\r\n")
    lines = csv.decode().split("\r\n")[1:-1]
    assert len(lines) == 2 and lines[1].startswith('"say ""hi""",')
    assert markdown.startswith(b"| Model | Lang |\n| --- | --- |\n") and markdown.count(b"\n") == 4


def test_rejected_snapshots_leave_nothing(spark, tmp_path):
    bad = spark.createDataFrame([("a", "b", "c")], "check string, subject string, detail string")
    results = spark.range(1)
    with pytest.raises(ValueError):
        W.publish_snapshot(results, str(tmp_path), "one", bad)
    W.publish_snapshot(results, str(tmp_path), "one", bad.limit(0))
    assert W.current_snapshot(spark, str(tmp_path)).count() == 1
