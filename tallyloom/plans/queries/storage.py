"""Sources, sinks, the batch scoring job and the streams. Files go to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.constants import METRICS
from tallyloom.functions.decoding import refusal
from tallyloom.operators import cases as N
from tallyloom.operators import scorer as M
from tallyloom.operators import snapshot as Z
from tallyloom.plans.queries.registry import query, r6
from tallyloom.session import shared_path, written
from tallyloom.sources import assets as A
from tallyloom.sources import bundles as B
from tallyloom.sources import cases as S
from tallyloom.sources import definitions as D
from tallyloom.sources import documents as Q
from tallyloom.sources import writers as W
from tallyloom.streaming import ingest as I
from tallyloom.validation import checks as C


def _native(tb):
    return tb.native_cases.drop("cid", "custkey", "k")


def _two_splits(tb):
    path = shared_path(tb.spark, "cases")
    split = F.when(F.col("case_id").cast("bigint") % 10 == 0, "dev").otherwise("test")
    _native(tb).withColumn("split", split).write.parquet(path)
    return path


@query(
    "read_cases",
    "IO1",
    """select cast(o_orderkey as varchar) case_id, 2 as decisions from orders
       where o_orderkey % 10 <> 0""",
)
def _(tb):
    rows, _ = S.read_cases(tb.spark, _two_splits(tb), "test")
    return rows.select("case_id", F.size("input.decisions").alias("decisions"))


@query(
    "rows_of_other_splits",
    "IO1",
    """select 'split' "check", cast(o_orderkey as varchar) subject, 'row of another split' detail
       from orders where o_orderkey % 10 = 0""",
)
def _(tb):
    return S.read_cases(tb.spark, _two_splits(tb), "test")[1]


@query(
    "read_manifest",
    "IO2",
    """select o_orderpriority dataset,
              count(*) + case when o_orderpriority like '2%' then 1 else 0 end declared,
              count(*) delivered, o_orderpriority not like '2%' matches
       from orders where o_orderpriority not like '5%' group by o_orderpriority""",
)
def _(tb):
    """One file set per order priority; one set is not listed and unreadable, one declares a row too many."""
    root = shared_path(tb.spark, "release")
    priority = tb.table("orders").selectExpr("cast(o_orderkey as string) case_id", "o_orderpriority p")
    named = _native(tb).join(priority, "case_id")
    named.withColumn("folder", F.substring("p", 1, 1)).write.partitionBy("folder").parquet(root)
    written = tb.spark.read.parquet(root).select("p", F.col("_metadata.file_path").alias("f"))
    broken = tb.spark.range(1).selectExpr("'folder=5/broken.parquet' name", "'no table' text")
    W.write_documents(broken, root, "name", "text").write.format("noop").mode("overwrite").save()
    manifest = (
        written.where("p not like '5%'")
        .groupBy(F.col("p").alias("dataset"))
        .agg(
            F.collect_set(F.element_at(F.split("f", root + "/"), -1)).alias("data_files"),
            F.count(F.lit(1)).alias("n"),
        )
        .selectExpr(
            "dataset",
            "'test' split",
            "data_files",
            "n + case when dataset like '2%' then 1 else 0 end cases",
        )
    )
    rows = S.read_manifest(tb.spark, root, manifest)
    return S.manifest_counts(rows, manifest).drop("split")


@query(
    "json_column",
    "IO3",
    """select event_id, case when event_id % 50 <> 0
                 then cast(json_extract(props, '$.k') as bigint) end k,
              event_id % 50 = 0 corrupt from events""",
)
def _(tb):
    """Every 50th text lost its last character."""
    cut_short = F.when(
        F.col("event_id") % 50 == 0, F.expr("left(props, length(props) - 1)")
    ).otherwise(F.col("props"))
    rows = tb.table("events").select("event_id", cut_short.alias("props"))
    schema = T.StructType([T.StructField("k", T.LongType())])
    parsed = S.parse_json_column(rows, "props", schema)
    corrupt = F.col("parsed._corrupt").isNotNull()
    return parsed.select(
        "event_id", F.when(~corrupt, F.col("parsed.k")).alias("k"), corrupt.alias("corrupt")
    )


@query(
    "read_definitions",
    "IO4",
    """select bid benchmark_id, decision_count, bid <> 'price-1-score' name_matches
       from defs""",
)
def _(tb):
    root = shared_path(tb.spark, "definitions")
    files = tb.benchmarks.select(
        F.expr("concat(case when id = 'price-1-score' then 'other' else id end, '.json')").alias(
            "name"
        ),
        F.to_json(F.struct("*")).alias("text"),
    )
    W.write_documents(files, root, "name", "text").write.format("noop").mode("overwrite").save()
    return D.read_benchmarks(tb.spark, root).select(
        F.col("id").alias("benchmark_id"), "decision_count", "name_matches"
    )


def _written(tb, rows, purpose):
    """(name, text) rows as files below a new folder."""
    root = shared_path(tb.spark, purpose)
    W.write_documents(rows, root, "name", "text").write.format("noop").mode("overwrite").save()
    return root


@query(
    "read_categories",
    "IO4",
    """select category id, count(*) benchmarks, string_agg(bid, ',' order by bid) listed,
              category <> 'text-v1' name_matches from members group by category""",
)
def _(tb):
    name = F.expr("concat(case when id = 'text-v1' then 'other' else id end, '.json') name")
    root = _written(tb, tb.categories.select(name, F.to_json(F.struct("*")).alias("text")), "categories")
    return D.read_categories(tb.spark, root).select(
        "id",
        F.size("benchmarks").cast("bigint").alias("benchmarks"),
        F.array_join("benchmarks", ",").alias("listed"),
        "name_matches",
    )


_MODEL_KEY = "concat('org__', replace(lower(s_name), '#', '-'))"


@query(
    "read_metadata",
    "IO4",
    f"""select {_MODEL_KEY} folder, replace({_MODEL_KEY}, '__', '/') model_id,
               case when s_suppkey % 3 <> 2 then (s_suppkey * 370000007) % 41000000000 end total_params from supplier""",
)
def _(tb):
    """One metadata file per model, in the model's folder."""
    fields = ["model_id", "display_name", "short_name", "total_params", "active_params", "parameter_count_method"]
    rows = tb.models.select(F.concat("model_key", F.lit("/metadata.json")).alias("name"), F.to_json(F.struct(*fields)).alias("text"))
    return D.read_metadata(tb.spark, _written(tb, rows, "models") + "/*").select("folder", "model_id", "total_params")


@query(
    "read_registry",
    "IO4",
    f"""select {_MODEL_KEY} model_key, b.v benchmark_id from supplier,
               (values ('quality-en-noul', 2), ('status-F-choice', 3), ('price-9-score', 7)) b(v, n) where s_suppkey % b.n = 0""",
)
def _(tb):
    """A registry of several files, each with the disclosures of one model."""
    group = F.struct(F.array("model_key").alias("model_ids"), "training_exposure")
    disclosed = tb.exposed_models.where("training_exposure is not null")
    text = F.to_json(F.struct(F.array(group).alias("disclosures"))).alias("text")
    root = _written(tb, disclosed.select(F.concat("model_key", F.lit(".json")).alias("name"), text), "registry")
    listed = D.read_registry(tb.spark, root).withColumn("model_key", F.explode("model_ids"))
    return listed.select("model_key", F.explode("training_exposure").alias("e")).select("model_key", "e.benchmark_id")


def _heads(tb):
    """Result documents of all benchmarks without their predictions."""
    return tb.results.select(
        "run_id",
        "benchmark_id",
        F.struct(
            F.lit(1).cast("bigint").alias("format_version"),
            "run_id",
            F.struct(F.col("benchmark_id").alias("id"), "task").alias("benchmark"),
            F.struct(F.col("model_id").alias("id"), "adapter").alias("model"),
            "provenance",
            "status",
            F.struct("cases", "expected", "succeeded", "failed", "abstained").alias("counts"),
            F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))]).alias("metrics"),
        ).alias("result"),
    )


def _published(tb):
    """A folder per run with archives and a metadata file, and for half of them plain copies that do not count."""
    root = shared_path(tb.spark, "documents")
    heads = _heads(tb)
    Q.write_result_documents(heads, tb.predictions, root)
    even = F.substring("run_id", -1, 1).cast("int") % 2 == 0
    Q.write_result_documents(heads.where(even), tb.predictions.where(even), root, compressed=False)
    metadata = heads.select(F.concat("run_id", F.lit("/metadata.json")).alias("name"), F.lit("{}").alias("text")).distinct()
    W.write_documents(metadata, root, "name", "text").write.format("noop").mode("overwrite").save()
    return root


@query(
    "read_bundles",
    "IO5,V18",
    """select run_id, benchmark_id, status, succeeded, round(baseline_adjusted_score, 6) score,
              round(mean_iou, 6) iou, round(binary_brier, 6) brier,
              succeeded + failed + abstained predictions
       from results""",
)
def _(tb):
    heads, predictions = Q.read_documents(Q.result_files(tb.spark, [_published(tb)]))
    flat = B.flat_results(heads)
    counted = predictions.groupBy("run_id", "benchmark_id").agg(F.count(F.lit(1)).alias("predictions"))
    return flat.join(counted, ["run_id", "benchmark_id"], "left").select(
        "run_id",
        "benchmark_id",
        "status",
        "counts.succeeded",
        F.round(F.col("metrics")["baseline_adjusted_score"], 6).alias("score"),
        F.round(F.col("metrics")["mean_iou"], 6).alias("iou"),
        F.round(F.col("metrics")["binary_brier"], 6).alias("brier"),
        F.coalesce("predictions", F.lit(0)).alias("predictions"),
    )


@query(
    "document_predictions",
    "IO5",
    """select 'run-' || cast(m as varchar) run_id, bid benchmark_id, cast(cid as varchar) case_id, q question_id,
              case outcome when 'ok' then 'answer' when 'failed' then 'error' else 'abstention' end outcome
       from (select m, bid, cid, 'status' q, outcome from choice_row union all
             select m, bid, cid, 'price', outcome from score_row union all
             select m, bid, cid, 'quality', outcome from noul_row union all
             select m, bid, cid, 'area', outcome from box_row)""",
)
def _(tb):
    """Every prediction comes back from the documents once, with its outcome."""
    _, predictions = Q.read_documents(Q.result_files(tb.spark, [_published(tb)]))
    kind = F.when(F.col("error").isNotNull(), "error").when(F.col("abstention").isNotNull(), "abstention")
    answered = F.col("probabilities").isNotNull() | F.col("box").isNotNull()
    return predictions.select(
        "run_id", "benchmark_id", "case_id", "question_id", kind.when(answered, "answer").alias("outcome")
    )


@query(
    "source_file_counts",
    "AG27,IO5",
    """select 'published' source, count(*) files from results
       union all select 'plain', count(*) from results""",
)
def _(tb):
    """Result files per source: archives of published folders, and plain files elsewhere."""
    root = shared_path(tb.spark, "sources")
    heads, none = _heads(tb), tb.predictions.limit(0)
    for name, compressed in (("published", True), ("published", False), ("plain", False)):
        Q.write_result_documents(heads, none, f"{root}/{name}", compressed)
    metadata = heads.select(F.concat("run_id", F.lit("/metadata.json")).alias("name"), F.lit("{}").alias("text")).distinct()
    W.write_documents(metadata, f"{root}/published", "name", "text").write.format("noop").mode("overwrite").save()
    return Q.source_counts(Q.result_files(tb.spark, [f"{root}/published", f"{root}/plain"]))


@query(
    "bundle_file_names",
    "V18",
    """select 'file name' "check", concat(run_id, '/', benchmark_id) subject,
              case when run_id = 'run-2' then 'no metadata'
                   when run_id = 'run-3' then 'folder differs from model id'
                   else 'file differs from benchmark id' end detail
       from results
       where run_id in ('run-2', 'run-3') or benchmark_id = 'price-1-score'""",
)
def _(tb):
    root = shared_path(tb.spark, "bundles")
    Q.write_result_documents(_heads(tb), tb.predictions.limit(0), root)
    flat = B.flat_results(B.read_bundles(tb.spark, root))
    described = flat.withColumns(
        {
            "model_id": F.expr(
                "case run_id when 'run-2' then null when 'run-3' then 'other' else run_id end"
            ),
            "key": F.concat_ws("/", "run_id", "benchmark_id"),
            "benchmark_id": F.expr(
                "case when benchmark_id = 'price-1-score' then 'renamed' else benchmark_id end"
            ),
        }
    )
    found = C.file_names(described)
    tail = F.array_join(F.slice(F.split("subject", "/"), -2, 2), "/")
    return found.withColumn("subject", F.replace(tail, F.lit(".json.xz"), F.lit("")))


@query(
    "blob_checks",
    "IO6",
    """select 'blob' "check", sha256(case when doc_id % 20 = 0 then text || '!' else text end)
              subject, 'digest differs' detail from documents where doc_id % 20 = 0
       union all select 'blob', k, 'duplicate' from
         (select sha256(case when doc_id % 20 = 0 then text || '!' else text end) k from documents)
         group by k having count(*) > 1
       union all select 'blob', cast(count(*) as varchar), 'count differs' from documents""",
)
def _(tb):
    blobs = tb.table("documents").select(
        F.col("text").cast("binary").alias("bytes"),
        F.sha2(F.expr("case when doc_id % 20 = 0 then concat(text, '!') else text end"), 256).alias(
            "sha256"
        ),
    )
    return A.verify_blobs(blobs, "bytes", "sha256", declared=1)


@query(
    "release_checks",
    "IO7",
    """select 'release file' "check", case s_suppkey % 5
                when 0 then concat('../n', cast(s_suppkey as varchar), '.txt')
                else concat('data/n', cast(s_suppkey as varchar), '.txt') end subject,
              case s_suppkey % 5 when 0 then 'unsafe path' when 1 then 'unlisted'
                when 2 then 'missing' else 'checksum differs' end detail
       from supplier where s_suppkey % 5 < 4""",
)
def _(tb):
    suppliers = tb.table("supplier")
    root = shared_path(tb.spark, "release")
    written = suppliers.where("s_suppkey % 5 not in (0, 2)").selectExpr(
        "concat('data/n', s_suppkey, '.txt') name", "s_name text"
    )
    W.write_documents(written, root, "name", "text").write.format("noop").mode("overwrite").save()
    listed = suppliers.where("s_suppkey % 5 <> 1").selectExpr(
        "concat(case when s_suppkey % 5 = 0 then '../n' else 'data/n' end, s_suppkey, '.txt') path",
        "sha2(concat(s_name, case when s_suppkey % 5 = 3 then '!' else '' end), 256) sha256",
    )
    return A.verify_release(tb.spark, root, listed)


_KEPT = ("run_id", "benchmark_id", "task", "status", "succeeded")


@query(
    "immutable_results",
    "IO8",
    """select run_id, benchmark_id, status, succeeded from results
       where run_id in ('run-0', 'run-1', 'run-2')""",
)
def _(tb):
    """Two runs are written, then a third; writing one of them again is refused."""
    path = shared_path(tb.spark, "immutable")
    rows = tb.results.select("run_id", "benchmark_id", "status", "succeeded")
    W.write_results(rows.where("run_id in ('run-0', 'run-1')"), path, files_per_result=2)
    try:
        W.write_results(rows.where("run_id in ('run-1', 'run-2')"), path)
        raise AssertionError("an existing result was written again")
    except ValueError:
        pass
    W.write_results(rows.where("run_id = 'run-2'"), path)
    return W.read_results(tb.spark, path).select("run_id", "benchmark_id", "status", "succeeded")


@query(
    "exported_results",
    "IO9",
    """select run_id, benchmark_id, status,
              succeeded + case when task = 'noul' and run_id = 'run-1' then 5 else 0 end succeeded
       from results""",
)
def _(tb):
    """An export replaces the benchmarks it brings and keeps the others."""
    path = shared_path(tb.spark, "export")
    rows = tb.results.select(*_KEPT).drop("task")
    W.export_results(rows, path, ["status", "succeeded"])
    newer = tb.results.where("task = 'noul' and run_id = 'run-1'").selectExpr(
        "run_id", "benchmark_id", "status", "succeeded + 5 succeeded"
    )
    W.export_results(newer.unionByName(newer), path, ["status", "succeeded"])
    return tb.spark.read.parquet(path).select("run_id", "benchmark_id", "status", "succeeded")


@query(
    "published_snapshot",
    "IO10",
    "select run_id, benchmark_id, status, succeeded from results where run_id <> 'run-0'",
)
def _(tb):
    """A second generation replaces the first; a third fails validation and stays invisible."""
    root = shared_path(tb.spark, "snapshots")
    rows = tb.results.select("run_id", "benchmark_id", "status", "succeeded")
    none = C.conflicting_results(rows, ["status", "succeeded"])
    W.publish_snapshot(rows, root, "g1", none)
    W.publish_snapshot(rows.where("run_id <> 'run-0'"), root, "g2", none)
    twice = rows.unionByName(rows.withColumn("succeeded", F.col("succeeded") + 1))
    try:
        W.publish_snapshot(twice, root, "g3", C.conflicting_results(twice, ["succeeded"]))
        raise AssertionError("a generation with conflicts was published")
    except ValueError:
        pass
    return W.current_snapshot(tb.spark, root).select("run_id", "benchmark_id", "status", "succeeded")


_BENCH_DIM, _MODEL_DIM = ["benchmark_id", "task"], ["run_id", "model_id", "provenance"]


def _encoded(tb):
    return Z.encode(tb.results.select(*_BENCH_DIM, *_MODEL_DIM, "status"), _BENCH_DIM, _MODEL_DIM)


@query(
    "encoded_snapshot",
    "IO11",
    """select dense_rank() over (order by benchmark_id, task) - 1 benchmark,
              dense_rank() over (order by run_id, model_id, provenance) - 1 model, status
       from results""",
)
def _(tb):
    return _encoded(tb)[2]


@query(
    "snapshot_digest",
    "IO11",
    """select count(*) as "rows", sha256(concat_ws(':', count(*), sum(a), sum(b))) digest
       from (select cast('0x' || substr(h, 1, 15) as hugeint) a, cast('0x' || substr(h, 16, 15) as hugeint) b
             from (select sha256(concat('{"run_id":"', run_id, '","benchmark_id":"', benchmark_id, '","status":"', status,
                     '","succeeded":', cast(succeeded as bigint), '}')) h from results))""",
)
def _(tb):
    """The digest does not depend on how rows are distributed."""
    columns = ["run_id", "benchmark_id", "status", "succeeded"]
    rows = tb.results.select(*columns)
    both = Z.content_digest(rows, columns).unionByName(
        Z.content_digest(rows.repartition(7, "status"), columns)
    )
    return both.distinct()


@query(
    "decoded_snapshot",
    "IO12",
    "select run_id, model_id, provenance, benchmark_id, task, status from results",
)
def _(tb):
    parts = _encoded(tb)
    return Z.decode_verified(*parts, Z.digests(*parts))


@query(
    "changed_snapshot",
    "IO12",
    """select 'snapshot' "check", 'facts' subject, 'content differs' detail
       where exists (select 1 from results where status = 'complete')
       union all select 'snapshot', 'models', 'row count differs'""",
)
def _(tb):
    """A status in the facts and a model were changed after the digests were stored."""
    benchmarks, models, facts = _encoded(tb)
    stored = Z.digests(benchmarks, models, facts)
    status = F.when(F.col("status") == "complete", "partial").otherwise(F.col("status"))
    return Z.digest_problems(benchmarks, models.where("model > 0"), facts.withColumn("status", status), stored)


@query(
    "reference_problems",
    "IO12",
    """select 'dangling benchmark' problem, dense_rank() over (order by benchmark_id) - 1 as "key"
         from results where benchmark_id = (select min(benchmark_id) from results)
                        and run_id <> 'run-2'
       union all select 'unused model', k from
         (select distinct run_id, dense_rank() over (order by run_id) - 1 k from results)
         where run_id = 'run-2'
       union all select 'duplicate model', 0""",
)
def _(tb):
    """The first benchmark is missing, one model has no facts, one is listed twice."""
    benchmarks, models, facts = _encoded(tb)
    again = models.where("model = 0").withColumn("model", F.lit(99).cast("bigint"))
    used = facts.where("model = 1 and benchmark = 1").withColumn("model", F.lit(99).cast("bigint"))
    return Z.reference_problems(
        benchmarks.where("benchmark > 0"),
        models.unionByName(again),
        facts.where("model <> 2").unionByName(used),
    )


@query(
    "csv_export",
    "IO13",
    """select doc_id, sha256('"' || replace(case when regexp_matches(text, '^\\s*[=+@-]')
                then '''' || text else text end, '"', '""') || '","' || source || '",""') line_sha
       from documents""",
)
def _(tb):
    rows = tb.table("documents").selectExpr("doc_id", "text as Model", "source url", "'' huggingface")
    lines = W.csv_lines(rows, ["Model"])
    return lines.select("doc_id", F.sha2("line", 256).alias("line_sha"))


_ESCAPED = "text"
for _old, _new in (
    ("'&'", "'&amp;'"),
    ("'<'", "'&lt;'"),
    ("'>'", "'&gt;'"),
    ("chr(92)", "chr(92) || chr(92)"),
    ("'|'", "chr(92) || '|'"),
    ("'`'", "chr(92) || '`'"),
    ("'*'", "chr(92) || '*'"),
    ("'_'", "chr(92) || '_'"),
    ("'['", "chr(92) || '['"),
    ("']'", "chr(92) || ']'"),
    ("chr(13) || chr(10)", "'<br>'"),
    ("chr(13)", "'<br>'"),
    ("chr(10)", "'<br>'"),
):
    _ESCAPED = f"replace({_ESCAPED}, {_old}, {_new})"


@query(
    "markdown_export",
    "IO14",
    f"""select doc_id, sha256('| ' || case when doc_id % 3 = 0 then {_ESCAPED}
                when doc_id % 3 = 1 then '[' || {_ESCAPED} || '](https://hub.example/m%28' || source || '%29)'
                else '[' || {_ESCAPED} || '](https://site.example/' || source || ')' end
                || ' | ' || lang || ' |') line_sha
        from documents""",
)
def _(tb):
    rows = tb.table("documents").selectExpr(
        "doc_id",
        "text as Model",
        "lang as Lang",
        "case when doc_id % 3 = 0 then 'ftp://x' else concat('https://site.example/', source) end url",
        "case when doc_id % 3 = 1 then concat('https://hub.example/m(', source, ')') else '' end "
        "huggingface",
    )
    lines = W.markdown_lines(rows, ["Model", "Lang"])
    return lines.select("doc_id", F.sha2("line", 256).alias("line_sha"))


@query(
    "written_table",
    "IO13,IO14",
    "select c_name as line from customer",
)
def _(tb):
    path = shared_path(tb.spark, "lines")
    W.write_lines(tb.table("customer").selectExpr("c_name line", "c_custkey k"), ["k"], path)
    return tb.spark.read.text(path).select(F.col("value").alias("line"))


def _cases(tb):
    return N.inference_view(N.questions_view(tb.native_cases))


@query(
    "scored_cases",
    "U1,RS12",
    """select case_id, question_id, options, round(1 / cast(options as double), 6) p from
         (select cast(o_orderkey as varchar) case_id, 'status' question_id,
                 2 + o_orderkey % 4 options from orders
          union all select cast(o_orderkey as varchar), 'price', 5 from orders)""",
)
def _(tb):
    scored = M.score_cases(_cases(tb), M.UniformScorer)
    values = F.map_values("probabilities")
    return scored.select(
        "case_id",
        "question_id",
        F.size(values).cast("bigint").alias("options"),
        F.round(F.array_max(values), 6).alias("p"),
    )


class FaultyScorer(M.UniformScorer):
    """Fails on fixed cases: raises, forgets a question, or returns a wrong sum."""

    case_batch_size = 16

    def predict(self, case):
        number = int(case["case_id"])
        if number % 50 == 0:
            raise TimeoutError("secret request text")
        answers = super().predict(case)
        if number % 51 == 0:
            answers = answers[:1]
        elif number % 53 == 0:
            answers[1]["probabilities"] = {k: 0.3 for k in answers[1]["probabilities"]}
        return answers

    def predict_batch(self, cases):
        return [self.predict(case) for case in cases]


@query(
    "isolated_failures",
    "U2",
    """select cast(o_orderkey as varchar) case_id, q.v question_id,
              case when o_orderkey % 50 = 0 then 'TimeoutError'
                   when o_orderkey % 51 = 0 or o_orderkey % 53 = 0 then 'ValueError' end error
       from orders, (values ('status'), ('price')) q(v)""",
)
def _(tb):
    return M.score_cases(_cases(tb), FaultyScorer).select("case_id", "question_id", "error")


@query(
    "refused_answers",
    "U3",
    """select event_id, case when event_type = 'error' then 'refusal' end abstention,
              case when event_type <> 'error' then round(event_id % 10 / cast(10 as double), 6) end p
       from events""",
)
def _(tb):
    """Answers of type `error` stand for refusals; the other answers are kept."""
    kind = F.when(F.col("event_type") == "error", "refusal").otherwise("answer")
    rows = tb.table("events").select("event_id", refusal(kind).alias("abstention"))
    p = F.when(F.col("abstention").isNull(), F.round(F.col("event_id") % 10 / F.lit(10.0), 6))
    return rows.select("event_id", "abstention", p.alias("p"))


def _arrivals(tb):
    """All predictions in several files, more as they grow; every 7th case is delivered twice, every 11th two weeks late."""
    source = shared_path(tb.spark, "arrivals")
    number = F.col("case_id").cast("bigint")
    late = F.when(number % 11 == 0, -14 * 86400).otherwise(0)
    stamped = tb.predictions.withColumn(
        "arrived_at", F.timestamp_seconds(F.lit(1704067200) + number % 3600 + late)
    )
    again = stamped.where("cast(case_id as bigint) % 7 = 0")
    written(stamped.unionByName(again).repartition(_files(tb), "case_id"), source)
    return source


def _files(tb):
    return max(4, tb.pieces)


def _ingested(tb):
    target = shared_path(tb.spark, "ingested")
    run = I.ingest(
        tb.spark, _arrivals(tb), target, shared_path(tb.spark, "progress"), files_per_trigger=_files(tb) // 2
    )
    run.awaitTermination()
    return target


@query(
    "ingested_predictions",
    "ST1",
    """select concat('run-', cast(m as varchar)) run_id, bid benchmark_id,
              cast(cid as varchar) case_id, 1 as copies
       from (select m, bid, cid from noul_row union all select m, bid, cid from box_row
             union all select m, bid, cid from choice_row union all select m, bid, cid from score_row)""",
)
def _(tb):
    rows = tb.spark.read.parquet(_ingested(tb))
    return rows.groupBy("run_id", "benchmark_id", "case_id").agg(
        F.count(F.lit(1)).cast("int").alias("copies")
    )


@query(
    "live_counts",
    "ST2",
    """select run_id, benchmark_id, cases recorded, succeeded, failed, abstained,
              round(cases / cast(expected as double), 6) coverage
       from results""",
)
def _(tb):
    target = shared_path(tb.spark, "live")
    run = I.live_counts(
        tb.spark, _ingested(tb), target, shared_path(tb.spark, "progress"), files_per_trigger=2
    )
    run.awaitTermination()
    latest = I.latest_counts(tb.spark, target, tb.benchmarks)
    return latest.select(
        "run_id", "benchmark_id", "recorded", "succeeded", "failed", "abstained", r6("coverage")
    )
