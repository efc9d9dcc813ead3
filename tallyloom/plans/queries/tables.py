"""Cases, labels, disclosures, provenance, snapshots and overlap audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import cases as N
from tallyloom.operators import disclosure as D
from tallyloom.operators import overlap as O
from tallyloom.operators import provenance as V
from tallyloom.operators import results as R
from tallyloom.operators import scopes as P
from tallyloom.operators import snapshot as Z
from tallyloom.plans.queries.registry import query, r6
from tallyloom.sources.assets import subset_owner

_NESTED = """
  select cast(cid as varchar) case_id, 'status' question_id, 0 as place, 'choice' task, bid,
         string_agg(oid, ',' order by pos) options, sum(t * pos) weight
  from fx_choice group by cid, bid
  union all
  select cast(cid as varchar), 'price', 1, 'score', bid,
         string_agg('l' || cast(pos as varchar), ',' order by pos), sum(t * pos)
  from fx_score group by cid, bid"""


def _weight(options, target):
    """Sum of target mass times candidate position: sensitive to order and alignment."""
    terms = F.transform(options, lambda o, i: F.try_element_at(target, o["id"]) * i)
    return F.round(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 6)


@query(
    "exploded_decisions",
    "PF1,J1",
    f"""select case_id, question_id, cast(place as bigint) place, task, options,
               round(weight, 6) weight from ({_NESTED})""",
)
def _(tb):
    rows = N.decisions_from_cases(tb.native_cases)
    return rows.select(
        "case_id",
        "question_id",
        F.col("position").cast("bigint").alias("place"),
        "task",
        F.array_join("options.id", ",").alias("options"),
        _weight(F.col("options"), F.col("target")).alias("weight"),
    )


@query(
    "target_lookup",
    "J1",
    f"""select case_id, true as sound, count(*) n_targets, round(sum(weight), 6) weight
        from ({_NESTED}) group by case_id""",
)
def _(tb):
    lookup = N.target_by_decision(F.col("targets"))
    both = [
        _weight(
            F.col("input.decisions")[i]["criteria"],
            F.map_from_arrays(
                F.try_element_at(lookup, F.lit(q))["ids"],
                F.try_element_at(lookup, F.lit(q))["probabilities"],
            ),
        )
        for i, q in enumerate(("status", "price"))
    ]
    return tb.native_cases.select(
        "case_id",
        N.one_target_each(F.col("input.decisions"), F.col("targets")).alias("sound"),
        F.size(lookup).cast("bigint").alias("n_targets"),
        F.round(both[0] + both[1], 6).alias("weight"),
    )


@query(
    "questions_of_task",
    "PF2",
    """select cast(o_orderkey as varchar) case_id, 1 as questions, 1 as targets, 'price' only_question
       from orders""",
)
def _(tb):
    kept = N.questions_of_task(N.questions_view(tb.native_cases), "score")
    return kept.select(
        "case_id",
        F.size("questions").alias("questions"),
        F.size("targets").alias("targets"),
        F.element_at("questions.id", 1).alias("only_question"),
    )


@query(
    "inference_view",
    "PF3",
    """select cast(o_orderkey as varchar) case_id,
              concat('{"order":', cast(o_orderkey as varchar), '}') state_json,
              'case_id,state,state_json,images,questions' visible, 2 as questions from orders""",
)
def _(tb):
    view = N.inference_view(N.questions_view(tb.native_cases))
    return view.select(
        "case_id",
        "state_json",
        F.lit(",".join(view.columns)).alias("visible"),
        F.size("questions").alias("questions"),
    )


@query(
    "first_cases",
    "PF5",
    """select benchmark_id, case_id from
         (select bid benchmark_id, cast(cid as varchar) case_id,
                 row_number() over (partition by bid order by cid) n
          from (select bid, cid from fx_noul union all select distinct bid, cid from fx_choice
                union all select distinct bid, cid from fx_score
                union all select bid, cid from fx_box)) where n <= 25""",
)
def _(tb):
    return N.first_cases(tb.decisions, 25).select("benchmark_id", "case_id")


@query(
    "parameter_range",
    "PF8",
    """select model_key, total_params from models
       where total_params is not null and total_params >= 800000000
         and total_params <= 50000000 + 950000000 + 4000000000 * cast(0.5 as double)""",
)
def _(tb):
    """From position 15.79 (800M) to position 30 (3B)."""
    low = (800e6 - 50e6) / (1e9 - 50e6) * 20
    return tb.models.where(X.within_parameters(F.col("total_params"), low, 30)).select(
        "model_key", "total_params"
    )


@query(
    "parameter_labels",
    "SC6",
    """select s_suppkey suppkey,
              case when p is null then 'N/A' when p >= 1000000000
                     then format('{:.3f}B', p / 1e9)
                   when p >= 1000000 then format('{:.3f}M', p / 1e6)
                   else format('{:,}', p) end shown,
              case when pos = 0 then '<50M' when pos = 100 then '35B+'
                   when v < 1e9 then concat(cast(cast(floor(v / 1e6 + 0.5) as bigint) as varchar), 'M')
                   else concat(regexp_replace(format('{:.2f}', v / 1e9), '\\.?0+$', ''), 'B') end
                slider
       from (select *, case least(4, pos // 20)
                  when 0 then 5e7 + 9.5e8 * (pos / 20.0)
                  when 1 then 1e9 + 4e9 * (pos / 20.0 - 1)
                  when 2 then 5e9 + 5e9 * (pos / 20.0 - 2)
                  when 3 then 1e10 + 1e10 * (pos / 20.0 - 3)
                  else 2e10 + 1.5e10 * (pos / 20.0 - 4) end v
             from (select s_suppkey, s_suppkey % 101 pos,
                          case when s_suppkey % 7 <> 0 then s_suppkey * s_suppkey * s_suppkey
                            * 40009 end p from supplier))""",
)
def _(tb):
    rows = tb.table("supplier").selectExpr(
        "s_suppkey suppkey",
        "s_suppkey % 101 pos",
        "case when s_suppkey % 7 <> 0 then s_suppkey * s_suppkey * s_suppkey * 40009 end p",
    )
    return rows.select(
        "suppkey",
        X.format_parameters(F.col("p")).alias("shown"),
        X.parameter_label(F.col("pos")).alias("slider"),
    )


@query(
    "model_search",
    "PF9",
    """select model_key from models where lower(model_id) like '%0000003%'
         or lower(short_name) like '%0000003%' or lower(display_name) like '%0000003%'""",
)
def _(tb):
    return P.search_models(tb.models, "  0000003 ").select("model_key")


@query(
    "benchmark_search",
    "PF9,SC2",
    "select bid benchmark_id from defs where lower(bid) like '%brand#1%'",
)
def _(tb):
    return P.search_benchmarks(tb.benchmarks, "BRAND#1").select(F.col("id").alias("benchmark_id"))


@query(
    "exposures_in_scope",
    "PF11",
    """select model_key, benchmark_id, relationship from exposures
       where benchmark_id in (select bid from members where category = 'text-v1')""",
)
def _(tb):
    scope = tb.members.where(F.col("category") == "text-v1")
    return D.exposures_in_scope(D.exposure_bridge(tb.exposed_models), scope).select(
        "model_key", "benchmark_id", "relationship"
    )


@query(
    "exposure_labels",
    "SC7",
    """select m.model_key, case when count(e.benchmark_id) = 0 then 'Unknown'
              when bool_or(e.relationship = 'evaluation_examples') then 'Evaluation examples used'
              else 'Known domain' end exposure
       from models m left join exposures e on e.model_key = m.model_key group by m.model_key""",
)
def _(tb):
    return D.labelled(tb.exposed_models).select("model_key", "exposure")


@query(
    "exposure_coverage",
    "AG28",
    """select category, model_key, count(distinct benchmark_id) known,
              (select count(*) from members x where x.category = m.category) scope_size
       from exposures join members m on m.bid = benchmark_id group by category, model_key""",
)
def _(tb):
    return D.exposure_coverage(tb.exposed_models, tb.members)


# Metadata sets counts for every second model, sometimes only one of the two.
_META = """meta as (select model_key, display_name, short_name,
    case when suppkey % 2 = 0 and suppkey % 4 = 0 then suppkey * 1000 end t,
    case when suppkey % 2 = 0 then suppkey * 900 end a, suppkey from models)"""


def _metadata(tb):
    return tb.exposed_models.selectExpr(
        "model_key",
        "display_name",
        "short_name",
        "case when suppkey % 2 = 0 and suppkey % 4 = 0 then suppkey * 1000 end total_params",
        "case when suppkey % 2 = 0 then suppkey * 900 end active_params",
        "case when suppkey % 2 = 0 then 'non_lookup_parameters_v1' end parameter_count_method",
        "case when suppkey % 3 = 0 then training_exposure end training_exposure",
    )


@query(
    "metadata_join",
    "J5",
    """select m.model_key, m.short_name,
              case when suppkey % 2 = 0 then case when suppkey % 4 = 0 then suppkey * 1000 end
                   else total_params end total_params,
              case when suppkey % 2 = 0 then suppkey * 900 else active_params end active_params,
              (select count(*) from exposures e where e.model_key = m.model_key) exposures
       from models m""",
)
def _(tb):
    joined = D.with_metadata(
        tb.exposed_models.drop("display_name", "short_name"), _metadata(tb)
    )
    return joined.select(
        "model_key",
        "short_name",
        "total_params",
        "active_params",
        F.coalesce(F.size("training_exposure"), F.lit(0)).cast("bigint").alias("exposures"),
    )


@query(
    "registry_fallback",
    "J6",
    """select m.model_key,
              case when exists (select 1 from exposures e where e.model_key = m.model_key)
                     then 'declared'
                   when suppkey % 3 = 1 then 'registered' else 'none' end origin
       from models m""",
)
def _(tb):
    groups = (
        tb.models.where("suppkey % 3 = 1")
        .groupBy(F.expr("suppkey div 10").alias("g"))
        .agg(F.collect_list("model_key").alias("model_ids"))
    )
    entry = tb.exposed_models.schema["training_exposure"].dataType.simpleString()
    registry = groups.select(
        "model_ids",
        F.from_json(
            F.lit('[{"benchmark_id":"quality-fr-noul","relationship":"related_domain"}]'), entry
        ).alias("training_exposure"),
    )
    filled = D.with_registry(tb.exposed_models, registry)
    registered = F.exists("training_exposure", lambda e: e["benchmark_id"] == "quality-fr-noul")
    return filled.select(
        "model_key",
        F.when(F.col("training_exposure").isNull(), "none")
        .when(registered, "registered")
        .otherwise("declared")
        .alias("origin"),
    )


# Measured counts per part; brands are models, sizes make some brands inconsistent.
_MEASURED = """
  select p_brand model_key, cast(1000000 + case when p_brand in ('Brand#3', 'Brand#7') then p_size
                                   else 0 end as bigint) total_params,
         cast(995000 as bigint) active_params from part"""


@query(
    "parameter_reconciliation",
    "AG24",
    f"""select model_key, conflict, case when not conflict then t end total_params,
               case when not conflict then 995000 end active_params,
               not conflict and t - 995000 <= t // 100 recount
        from (select model_key, min(total_params) <> max(total_params)
                and model_key <> 'Brand#7' conflict,
                case when model_key = 'Brand#7' then 2000000 else min(total_params) end t
              from ({_MEASURED}) group by model_key)""",
)
def _(tb):
    measured = tb.table("part").selectExpr(
        "p_brand model_key",
        "1000000L + case when p_brand in ('Brand#3', 'Brand#7') then p_size else 0 end total_params",
        "995000L active_params",
        "'non_lookup_parameters_v1' parameter_count_method",
    )
    metadata = tb.table("part").where("p_brand = 'Brand#7'").selectExpr(
        "p_brand model_key",
        "2000000L total_params",
        "995000L active_params",
        "'non_lookup_parameters_v1' parameter_count_method",
    ).distinct()
    return D.reconciled_counts(measured, metadata)


@query(
    "safe_identifiers",
    "SC1",
    """select distinct p_brand, regexp_full_match(p_brand, '[A-Za-z0-9][A-Za-z0-9._-]*') plain,
              regexp_full_match(replace(p_brand, '#', '.'), '[A-Za-z0-9][A-Za-z0-9._-]*') dotted
       from part""",
)
def _(tb):
    dotted = F.replace("p_brand", F.lit("#"), F.lit("."))
    return tb.table("part").select(
        "p_brand", X.is_safe_id(F.col("p_brand")).alias("plain"), X.is_safe_id(dotted).alias("dotted")
    ).distinct()


@query(
    "benchmark_labels",
    "SC2",
    """select p_partkey, replace(concat(p_type, '-', p_brand), '-', ' ') as label
       from part""",
)
def _(tb):
    rows = tb.table("part").selectExpr(
        "p_partkey", "concat(p_type, '-', p_brand, '-choice-test-v', p_size) id", "'choice' task"
    )
    return rows.select("p_partkey", X.benchmark_label(F.col("id"), F.col("task")).alias("label"))


@query(
    "model_labels",
    "SC3",
    """select c_custkey, case c_custkey % 4
         when 0 then c_name when 1 then concat('Family A · ', c_mktsegment)
         when 2 then concat('Family A · ', c_name) else concat('x/', c_name) end as label
       from customer""",
)
def _(tb):
    rows = tb.table("customer").selectExpr(
        "c_custkey",
        "case when c_custkey % 4 = 0 then c_name end display_name",
        "case when c_custkey % 4 in (1, 2) then 'family-a' else 'local' end adapter",
        "case c_custkey % 4 when 1 then concat('/runs/', c_mktsegment, '/checkpoint') "
        "when 2 then concat('a/', c_name, '/') "
        "else concat('x/someowner/', c_name) end model_id",
    )
    label = X.model_label(
        F.col("display_name"), F.col("adapter"), F.col("model_id"), {"family-a": "Family A · "}, "someowner/"
    )
    return rows.select("c_custkey", label.alias("label"))


# Page links with the host replaced by the hub's for three of four pages.
_LINK = """case page_id % 4
  when 0 then concat('https://huggingface.co/org', cast(page_id as varchar), '/model')
  when 1 then concat('http://huggingface.co/org/m', cast(page_id as varchar), '/tree/main/sub/dir')
  when 2 then concat('https://huggingface.co/datasets/d', cast(page_id as varchar))
  else url end"""


@query(
    "hub_labels",
    "SC4",
    """select page_id, case page_id % 4
         when 0 then concat('org', cast(page_id as varchar), '/model')
         when 1 then concat('org/m', cast(page_id as varchar), '/sub/dir') end as label,
         case when page_id % 4 = 0 then concat('org', cast(page_id as varchar), '/model') end hub_id
       from pages""",
)
def _(tb):
    rows = tb.table("pages").selectExpr("page_id", f"{_LINK.replace('varchar', 'string')} link")
    return rows.select(
        "page_id", X.hub_label(F.col("link")).alias("label"), X.hub_id(F.col("link")).alias("hub_id")
    )


@query(
    "link_rules",
    "SC5",
    """select page_id, page_id % 5 <> 0 as link, page_id % 5 not in (0, 1) as evidence
       from pages""",
)
def _(tb):
    """Every fifth link is no web address, every fifth carries credentials."""
    rows = tb.table("pages").selectExpr(
        "page_id",
        "case page_id % 5 when 0 then replace(replace(url, 'https://', 'ftp://'), 'http://', 'mailto:') "
        "when 1 then regexp_replace(url, '^(https?)://', '$1://user:secret@') else url end u",
    )
    return rows.select(
        "page_id", X.is_link(F.col("u")).alias("link"), X.is_evidence_link(F.col("u")).alias("evidence")
    )


@query(
    "report_cells",
    "SC8",
    """select doc_id, sha256(replace(replace(replace(replace(replace(replace(replace(replace(text,
         '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '|', '&#124;'),
         chr(10), ' '), chr(13), ' ')) cell_sha from documents""",
)
def _(tb):
    return tb.table("documents").select(
        "doc_id", F.sha2(X.report_cell(F.col("text")), 256).alias("cell_sha")
    )


@query(
    "canonical_text",
    "RS14",
    """select event_id, replace(props, ' ', '') compact, event_type verbatim,
              concat('{"a":', replace(props, ' ', ''), ',"b":[1,"', event_type, '"]}') sorted_keys
       from events""",
)
def _(tb):
    nested = F.concat(
        F.lit('{"b": [1, "'), "event_type", F.lit('"], "a": '), "props", F.lit("}")
    )
    return tb.table("events").select(
        "event_id",
        X.canonical_text(F.col("props")).alias("compact"),
        X.canonical_text(F.concat(F.lit('"'), "event_type", F.lit('"'))).alias("verbatim"),
        X.canonical_text(nested).alias("sorted_keys"),
    )


@query(
    "revision_keys",
    "RS15",
    "select o_orderkey, sha256(concat(o_orderpriority, '@', o_orderstatus)) revision_key from orders",
)
def _(tb):
    return tb.table("orders").select(
        "o_orderkey",
        X.revision_key(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("revision_key"),
    )


@query(
    "subset_owners",
    "J7",
    """select c_name subset, case when c_custkey % 5 = 1 then 2 when c_custkey % 5 = 2 then 0
              else 1 end owners,
              case when c_custkey % 5 = 1 then null when c_custkey % 5 = 2 then 'unscoped'
                   else concat(c_mktsegment, cast(c_custkey // 20 as varchar)) end source
       from customer""",
)
def _(tb):
    """Receipts list the subsets they own; some subsets have two owners, some none."""
    customers = tb.table("customer")
    claims = customers.where("c_custkey % 5 <> 2").selectExpr(
        "concat(c_mktsegment, c_custkey div 20) source", "c_name"
    ).unionByName(
        customers.where("c_custkey % 5 = 1").selectExpr(
            "concat('second', c_custkey div 20) source", "c_name"
        )
    )
    receipts = claims.groupBy("source").agg(F.collect_set("c_name").alias("subsets"))
    fallback = customers.agg(F.count(F.lit(1))).select(
        F.lit("unscoped").alias("source"), F.lit(None).cast("array<string>").alias("subsets")
    )
    owned = subset_owner(
        customers.select(F.col("c_name").alias("subset")), receipts.unionByName(fallback)
    )
    return owned.select("subset", F.col("owners").cast("int").alias("owners"), "source")


@query(
    "recorded_revisions",
    "J8",
    """select o_orderkey, r.n targets
       from orders o join (select o_orderstatus s, o_orderpriority p, count(*) n from orders
                           where o_orderpriority not like '5%' group by 1, 2) r
         on r.s = o.o_orderstatus and r.p = o.o_orderpriority""",
)
def _(tb):
    """Results find the targets of the revision they recorded; one revision is not installed."""
    orders = tb.table("orders")
    named = orders.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("subset"),
        F.col("o_orderpriority").alias("revision"),
        F.lit("org/data").alias("repo_id"),
    )
    targets = (
        named.where(~F.startswith("revision", F.lit("5")))
        .groupBy("repo_id", "revision", "subset")
        .agg(F.count(F.lit(1)).alias("targets"))
    )
    return R.at_recorded_revision(named, targets).select("o_orderkey", "targets")


_AFTER = """
  select run_id, benchmark_id,
         case when benchmark_id = 'price-2-score' then 'partial' else status end status,
         succeeded - case when benchmark_id = 'price-3-score' then 1 else 0 end succeeded
  from results where benchmark_id <> 'price-1-score'
  union all select 'run-new', benchmark_id, status, succeeded from results where run_id = 'run-0'"""


def _after(tb):
    kept = tb.results.where("benchmark_id <> 'price-1-score'").selectExpr(
        "run_id",
        "benchmark_id",
        "case when benchmark_id = 'price-2-score' then 'partial' else status end status",
        "succeeded - case when benchmark_id = 'price-3-score' then 1 else 0 end succeeded",
    )
    return kept.unionByName(
        tb.results.where("run_id = 'run-0'").selectExpr(
            "'run-new' run_id", "benchmark_id", "status", "succeeded"
        )
    )


@query(
    "snapshot_diff",
    "J11",
    f"""select coalesce(a.run_id, b.run_id) run_id, coalesce(a.benchmark_id, b.benchmark_id)
               benchmark_id,
               case when a.status is null then 'added' when b.status is null then 'removed'
                    when a.status = 'complete' and b.status <> 'complete' then 'regressed'
                    when b.succeeded < a.succeeded then 'fewer' else 'kept' end change
        from results a full join ({_AFTER}) b
          on a.run_id = b.run_id and a.benchmark_id = b.benchmark_id""",
)
def _(tb):
    return Z.snapshot_diff(tb.results, _after(tb)).select("run_id", "benchmark_id", "change")


@query(
    "reduction_warnings",
    "V19",
    f"""select 'result_removed' warning, concat(run_id, ' / ', benchmark_id) subject
        from results where benchmark_id = 'price-1-score'
        union all select 'completion_lost', concat(run_id, ' / ', benchmark_id)
        from results where benchmark_id = 'price-2-score' and status = 'complete'
        union all select 'fewer_succeeded', concat(run_id, ' / ', benchmark_id)
        from results where benchmark_id = 'price-3-score'
        union all select 'definition_removed', 'price-1-score'
        union all select 'category_removed', 'general-v1'
        union all select 'member_removed', concat(category, ' / price-1-score')
        from members where bid = 'price-1-score' and category <> 'general-v1'""",
)
def _(tb):
    columns = ["run_id", "benchmark_id", "status", "succeeded"]
    members = tb.members
    return Z.reduction_warnings(
        tb.results.select(*columns),
        _after(tb),
        (tb.benchmarks, tb.benchmarks.where("id <> 'price-1-score'")),
        (
            members,
            members.where("category <> 'general-v1' and benchmark_id <> 'price-1-score'"),
        ),
    )


@query(
    "content_shrinkage",
    "V19",
    """select 'content_shrank' warning, concat(cast(o as bigint), ' -> ', cast(n as bigint)) subject
       from (select sum(b) o, sum(case when kept then b else 0 end) n from (
         select length(concat('{"o_orderkey":', o_orderkey, ',"o_orderpriority":"', o_orderpriority, '"}')) b,
                o_orderpriority like '1%' or o_orderpriority like '2%' kept from orders)) where n < 0.8 * o""",
)
def _(tb):
    orders = tb.table("orders").select("o_orderkey", "o_orderpriority")
    kept = orders.where("o_orderpriority like '1%' or o_orderpriority like '2%'")
    return Z.shrink_warning(orders, kept)


@query(
    "content_reuse",
    "J12",
    """select doc_id, min(doc_id) over (partition by text) source_id,
              doc_id <> min(doc_id) over (partition by text) reused from documents""",
)
def _(tb):
    marked = O.reuse_by_content(tb.table("documents").select("doc_id", "text"), "text", ["doc_id"])
    return marked.select("doc_id", F.col("source.doc_id").alias("source_id"), "reused")


@query(
    "computed_once",
    "J12",
    "select doc_id, length(text) text_length from documents",
)
def _(tb):
    docs = tb.table("documents").select("doc_id", "text")

    def measured(distinct):
        return distinct.select("content_key", F.length("text").cast("bigint").alias("text_length"))

    return O.computed_once(docs, "text", measured).select("doc_id", "text_length")


@query(
    "request_usage",
    "AG25",
    """select user_id, count(*) requests, round(sum("value"), 6) tokens from events group by 1""",
)
def _(tb):
    used = tb.table("events").select("user_id", F.col("value").alias("tokens"))
    return R.usage_totals(used, "user_id", ["tokens"]).select("user_id", "requests", r6("tokens"))


@query(
    "cumulative_usage",
    "AG25",
    "select user_id, max(event_id) - min(event_id) requests from events group by 1",
)
def _(tb):
    readings = tb.table("events").select("user_id", F.col("event_id").alias("requests"))
    return R.usage_deltas(readings, "user_id", ["requests"])


@query(
    "task_losses",
    "AG21",
    """select model_key,
         cast(coalesce(sum(abstained) filter (task = 'choice'), 0) as bigint) choice_abstained,
         cast(coalesce(sum(failed) filter (task = 'choice'), 0) as bigint) choice_failed,
         cast(coalesce(sum(abstained) filter (task = 'noul'), 0) as bigint) noul_abstained,
         cast(coalesce(sum(failed) filter (task = 'noul'), 0) as bigint) noul_failed,
         cast(coalesce(sum(abstained) filter (task = 'score'), 0) as bigint) score_abstained,
         cast(coalesce(sum(failed) filter (task = 'score'), 0) as bigint) score_failed
       from results group by model_key""",
)
def _(tb):
    return V.losses_by_task(tb.results)


@query(
    "evidence_tally",
    "AG22",
    """select k.model_key, t.task, count(r.run_id) saved,
              count(r.run_id) filter (r.status = 'complete') complete,
              cast(coalesce(sum(succeeded), 0) as bigint) succeeded,
              cast(coalesce(sum(abstained), 0) as bigint) abstained,
              cast(coalesce(sum(failed), 0) as bigint) failed
       from (select distinct model_key from results) k,
            (values ('choice'), ('noul'), ('score'), ('box')) t(task)
       left join results r on r.model_key = k.model_key and r.task = t.task
         and not (r.model_key like '%00000002' and r.task = 'noul')
       group by k.model_key, t.task""",
)
def _(tb):
    kept = tb.results.where("not (model_key like '%00000002' and task = 'noul')")
    return V.evidence_tally(kept)


@query(
    "distinct_configurations",
    "AG23",
    """select distinct p_brand model_key, 'v1' evaluator_version,
              concat('{"platform":"linux","python":"3.', cast(p_size % 3 as varchar), '"}')
                environment,
              case p_size % 2 when 0 then 'detail-1568,scene-896' else null end policies
       from part""",
)
def _(tb):
    rows = tb.table("part").selectExpr(
        "p_brand model_key",
        "'v1' evaluator_version",
        "concat('{\"python\":\"3.', p_size % 3, '\",\"platform\":\"linux\",\"input_hashes\":{\"c', "
        "p_partkey, '\":\"h\"}', case when p_size % 2 = 0 then "
        "concat(',\"image_preprocessing\":{\"a\":[{\"policy\":\"scene-896\",\"payload_bytes\":', "
        "p_partkey, '},{\"policy\":\"detail-1568\"}],\"b\":[{\"policy\":\"scene-896\"}]}') else '' end, "
        "'}') environment",
    )
    return V.configurations(rows)


@query(
    "snapshot_counts",
    "AG27",
    """select 's1' snapshot_id, count(distinct run_id) models, count(*) results,
              count(*) filter (status = 'complete') complete_results,
              (select count(*) from defs) benchmarks from results""",
)
def _(tb):
    tag = F.lit("s1").alias("snapshot_id")
    return R.snapshot_counts(
        tb.results.select("run_id", "status", tag), tb.benchmarks.select("id", tag)
    )


@query(
    "coverage_gate",
    "V20",
    """select category, model_key, count(*) missing, string_agg(bid, ', ' order by bid) affected
       from (select distinct s.category, s.model_key, m.bid
             from scoped s join members m on m.category = s.category and m.task <> 'box'
             where not exists (select 1 from results r where r.model_key = s.model_key
               and r.benchmark_id = m.bid and r.status = 'complete'
               and r.provenance = 'measured' and r.failed = 0))
       group by category, model_key""",
)
def _(tb):
    return V.coverage_gaps(tb.results, tb.members, tb.benchmarks)


_SHOWN = ", ".join(
    f"""coalesce(format('{{:.2f}}', max(case when {s} and task = '{t}' then value end) * 100), 'N/A')
        {p}{t}"""
    for p, s in (("", "scope = category"), ("gen_", "scope = 'g'"))
    for t in ("noul", "choice", "score", "box")
)


@query(
    "submission_report",
    "IO15",
    f"""select category, run_id as model,
               case when min(total_params) is null then 'N/A'
                    when min(total_params) >= 1000000000
                      then format('{{:.3f}}B', min(total_params) / 1e9)
                    when min(total_params) >= 1000000
                      then format('{{:.3f}}M', min(total_params) / 1e6)
                    else format('{{:,}}', min(total_params)) end total_params, {_SHOWN}
        from (select t.category, t.category scope, t.run_id, t.task, t.value from task_means t
              union all select distinct c.category, 'g', t.run_id, t.task, t.value
              from task_means t, (select distinct category from members) c
              where t.category = 'general-v1')
        join models using (run_id) group by category, run_id""",
)
def _(tb):
    models = tb.models.select(
        "run_id", F.col("run_id").alias("display_name"), "total_params", "active_params"
    )
    return V.report_table(tb.results, tb.members, tb.benchmarks, models).drop("active_params")


@query(
    "coverage_exceptions",
    "IO15",
    """select category, run_id, complete, cast(failed as bigint) failed, required from
         (select s.category, run_id, count(*) filter (status = 'complete'
                   and provenance = 'measured' and failed = 0) complete, sum(failed) failed,
                 (select sum(required) from required q where q.category = s.category
                    and q.task <> 'box') required
          from scoped s where task <> 'box' group by s.category, run_id)
       where complete <> required or failed > 0""",
)
def _(tb):
    return V.coverage_exceptions(tb.results, tb.members, tb.benchmarks)


@query(
    "dataset_set_equality",
    "SO2",
    """select c_name subset, case when c_custkey % 100 = 3 then 'left' else 'right' end only_in
       from customer where c_custkey % 100 in (3, 7)""",
)
def _(tb):
    customers = tb.table("customer").select(F.col("c_name").alias("subset"), "c_custkey")
    return Z.set_difference(
        customers.where("c_custkey % 100 <> 7"), customers.where("c_custkey % 100 <> 3"), ["subset"]
    )


@query(
    "inventory_equality",
    "SO3",
    """select run_id, benchmark_id, 'left' only_in from results where benchmark_id = 'price-1-score'
       union all select 'run-new', benchmark_id, 'right' from results where run_id = 'run-0'""",
)
def _(tb):
    return Z.set_difference(tb.results, _after(tb), ["run_id", "benchmark_id"])


@query(
    "shared_config_names",
    "SO4",
    """select source as name from documents where lang = 'en'
       intersect select source from documents where lang = 'fr'""",
)
def _(tb):
    docs = tb.table("documents").select(F.col("source").alias("name"), "lang")
    return O.shared_configs(docs.where("lang = 'en'"), docs.where("lang = 'fr'"))


def _inputs(tb):
    """Evaluation inputs: documents of even sources, one benchmark per language."""
    return tb.table("documents").selectExpr(
        "doc_id", "text", "concat(lang, '-inputs') benchmark_id", "1 + doc_id % 3 decisions", "source"
    ).where("cast(substr(source, 4) as int) % 2 = 0").drop("source")


def _training(tb):
    return tb.table("documents").selectExpr("doc_id", "text", "source config").where(
        "cast(substr(source, 4) as int) % 2 = 1"
    )


_NORMAL = "sha256(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_AUDIT = f"""
  ev as (select {_NORMAL} k, concat(lang, '-inputs') benchmark_id, count(*) inputs,
                sum(1 + doc_id % 3) decisions from documents
         where cast(substr(source, 4) as int) % 2 = 0 group by 1, 2),
  tr as (select doc_id, {_NORMAL} k, source config from documents
         where cast(substr(source, 4) as int) % 2 = 1)"""


@query(
    "overlap_audit",
    "AU1",
    f"""select config, benchmark_id, cast(sum(n) as bigint) training_rows,
               cast(sum(inputs) as bigint) inputs, cast(sum(decisions) as bigint) decisions
        from (with {_AUDIT} select t.config, e.benchmark_id, t.k, count(*) n,
                min(inputs) inputs, min(decisions) decisions
              from tr t join ev e on e.k = t.k group by t.config, e.benchmark_id, t.k)
        group by config, benchmark_id""",
)
def _(tb):
    return O.overlap_audit(_training(tb), _inputs(tb), "text")


@query(
    "decontamination",
    "AU2",
    f"""with {_AUDIT} select doc_id, config from tr where k not in (select k from ev)""".replace(
        "with", "select * from (with", 1
    )
    + ")",
)
def _(tb):
    return O.decontaminated(_training(tb), _inputs(tb), "text").select("doc_id", "config")


@query(
    "decontamination_receipt",
    "AU2",
    f"""select * from (with {_AUDIT} select config, count(*) before,
          count(*) filter (k in (select k from ev)) removed,
          count(*) filter (k not in (select k from ev)) "after" from tr group by config)""",
)
def _(tb):
    return O.decontamination_receipt(_training(tb), _inputs(tb), "text")


@query(
    "length_audit",
    "AU3",
    """select conv_id, turn, 2 + len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))
                + len(list_filter(regexp_split_to_array(role, '\\s+'), lambda x: x <> '')) required,
              2 + len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))
                + len(list_filter(regexp_split_to_array(role, '\\s+'), lambda x: x <> '')) > 60 overflow
       from conversations""",
)
def _(tb):
    return O.length_audit(tb.table("conversations"), ["role", "text"], 60).select(
        "conv_id", "turn", "required", "overflow"
    )


@query(
    "measured_lengths",
    "AU3",
    """select doc_id, 2 + length(text) + length(source) required,
              2 + length(text) + length(source) > 2000 overflow from documents""",
)
def _(tb):
    @F.pandas_udf("bigint")
    def characters(texts: pd.Series) -> pd.Series:
        return texts.str.len()

    docs = tb.table("documents").select("doc_id", "text", "source")
    return O.measured_lengths(docs, ["doc_id"], ["text", "source"], 2000, characters)


@query(
    "accounted_cases",
    "PF1,PF2",
    """select cast(o_orderkey as varchar) case_id,
              case when o_orderkey % 13 = 0 then 'repeated decision' when o_orderkey % 17 = 0 then 'repeated target'
                   when o_orderkey % 19 = 0 then 'decision without a target'
                   when o_orderkey % 23 = 0 then 'target without a decision'
                   when o_orderkey % 29 = 0 then 'no decisions or targets' end problem,
              case when o_orderkey % 13 = 0 or o_orderkey % 17 = 0 or o_orderkey % 19 = 0 or o_orderkey % 23 = 0
                     or o_orderkey % 29 = 0 then 0 else 2 end decisions
       from orders""",
)
def _(tb):
    """Every case is there in one pass: with its decisions, or with the reason why it has none."""
    damaged = tb.native_cases.withColumns(
        {
            "input": F.col("input").withField(
                "decisions",
                F.expr(
                    "case when cid % 13 = 0 then concat(input.decisions, input.decisions) when cid % 17 = 0 then input.decisions "
                    "when cid % 19 <> 0 and cid % 23 = 0 then slice(input.decisions, 1, 1) else input.decisions end"
                ),
            ),
            "targets": F.expr(
                "case when cid % 13 = 0 then targets when cid % 17 = 0 then concat(targets, targets) "
                "when cid % 19 = 0 then slice(targets, 1, 1) when cid % 23 <> 0 and cid % 29 = 0 then null else targets end"
            ),
        }
    )
    return N.accounted_decisions(damaged).groupBy("case_id", "problem").agg(
        F.count("question_id").cast("int").alias("decisions")
    )
