"""Row scoring, metrics and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.constants import METRICS
from tallyloom.functions import decoding as D
from tallyloom.functions import scoring as S
from tallyloom.operators import baselines as B
from tallyloom.operators import results as R
from tallyloom.operators import scoring as J
from tallyloom.plans.evaluation import metric_table
from tallyloom.plans.queries.registry import query, r6
from tallyloom.plans.testbed import _WEIGHT, RUNS, per_position, weight_total
from tallyloom.session import shared_path
from tallyloom.sources import writers as W

_RUN = "concat('run-', cast(m as varchar)) run_id, bid benchmark_id"
_KEY = _RUN + ", cast(cid as varchar) case_id"


def _rows(tb, task):
    return J.row_scores(J.join_decisions(tb.predictions_of(task), tb.decisions_of(task), tb.pieces_of(task)))


_JOINED = """select concat('run-', cast(m as varchar)) run_id, bid benchmark_id, task,
              count(*) decisions, count(*) filter (outcome = 'ok') answered
       from (select m, bid, 'noul' task, outcome from noul_row
             union all select m, bid, 'choice', outcome from choice_row
             union all select m, bid, 'score', outcome from score_row
             union all select m, bid, 'box', outcome from box_row) group by m, bid, task"""


@query(
    "prediction_decision_join",
    "J2",
    _JOINED,
)
def _(tb):
    joined = J.join_decisions(tb.predictions, tb.decisions, tb.pieces)
    answered = F.col("probabilities").isNotNull() | F.col("box").isNotNull()
    return joined.groupBy("run_id", "benchmark_id", "task").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(answered).alias("answered")
    )


@query(
    "colocated_join",
    "J2",
    _JOINED,
)
def _(tb):
    """Both tables are stored in buckets of the decision key; the join reads them side by side."""
    spark = tb.spark
    path = shared_path(spark, "colocated")
    buckets = max(spark.sparkContext.defaultParallelism, tb.pieces)
    name = path.rsplit("-", 1)[-1]
    decisions = W.save_colocated(tb.decisions, f"decisions_{name}", buckets, f"{path}/decisions")
    predictions = W.save_colocated(tb.predictions, f"predictions_{name}", buckets, f"{path}/predictions")
    joined = J.join_decisions(predictions, decisions.hint("merge"))
    answered = F.col("probabilities").isNotNull() | F.col("box").isNotNull()
    return joined.groupBy("run_id", "benchmark_id", "task").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(answered).alias("answered")
    )


@query(
    "choice_argmax",
    "RS1",
    f"select {_KEY}, oid chosen, pos + 1 as place from choice_row where outcome = 'ok'",
)
def _(tb):
    joined = J.join_decisions(tb.predictions_of("choice"), tb.decisions_of("choice"), tb.pieces_of("choice"))
    o, p = F.col("options"), F.col("probabilities")
    return joined.where(p.isNotNull()).select(
        "run_id",
        "benchmark_id",
        "case_id",
        S.chosen_id(o, S.aligned(o, p)).alias("chosen"),
        S.chosen_position(S.aligned(o, p)).alias("place"),
    )


@query(
    "choice_credit",
    "RS2",
    f"select {_KEY}, round(credit, 6) credit from choice_row where outcome <> 'failed'",
)
def _(tb):
    return _rows(tb, "choice").where(~F.col("failed")).select(
        "run_id", "benchmark_id", "case_id", r6("credit")
    )


@query(
    "binary_brier_rows",
    "RS3",
    f"select {_KEY}, round(brier, 6) brier from noul_row where outcome <> 'failed'",
)
def _(tb):
    return _rows(tb, "noul").where(~F.col("failed")).select(
        "run_id", "benchmark_id", "case_id", r6("brier")
    )


@query(
    "score_error_rows",
    "RS4",
    f"select {_KEY}, round(abs(err), 6) error from score_row where outcome <> 'failed'",
)
def _(tb):
    return _rows(tb, "score").where(~F.col("failed")).select(
        "run_id", "benchmark_id", "case_id", F.round(F.abs("signed_error"), 6).alias("error")
    )


@query(
    "normalized_expectations",
    "RS5",
    """select bid benchmark_id, cast(cid as varchar) case_id, round(v, 6) expectation
       from score_target""",
)
def _(tb):
    options = F.col("options")
    value = S.normalized_expectation(options, S.aligned(options, F.col("target")))
    return tb.decisions_of("score").select(
        "benchmark_id", "case_id", F.round(value, 6).alias("expectation")
    )


@query(
    "box_iou_rows",
    "RS6",
    f"select {_KEY}, round(iou, 6) iou from box_row where outcome <> 'failed'",
)
def _(tb):
    return _rows(tb, "box").where(~F.col("failed")).select(
        "run_id", "benchmark_id", "case_id", r6("iou")
    )


@query(
    "box_restoration",
    "RS7",
    """select bid benchmark_id, cast(cid as varchar) case_id,
              round(greatest(0, least(1, (l * 600 - cid % 30) / (560 - cid % 60))), 6) box_left,
              round(greatest(0, least(1, (t * 500 - 20) / 460)), 6) box_top,
              round(greatest(0, least(1, (r * 600 - cid % 30) / (560 - cid % 60))), 6) box_right,
              round(greatest(0, least(1, (b * 500 - 20) / 460)), 6) box_bottom
       from fx_box""",
)
def _(tb):
    moved = tb.box_base.select(
        F.col("bid").alias("benchmark_id"),
        F.col("cid").cast("string").alias("case_id"),
        S.restored_box(
            F.col("target_box"),
            F.array(F.lit(600), F.lit(500)),
            F.array(F.col("cid") % 30, F.lit(20), 560 - F.col("cid") % 60, F.lit(460)),
        ).alias("box"),
    )
    return moved.select(
        "benchmark_id",
        "case_id",
        *[F.round(F.col(f"box.{e}"), 6).alias(f"box_{e}") for e in ("left", "top", "right", "bottom")],
    )


@query(
    "soft_confusion_rows",
    "RS8",
    f"""select {_KEY}, round(tp, 6) true_positive, round(fp, 6) false_positive,
               round(fn, 6) false_negative, round(tn, 6) true_negative
        from noul_row where outcome <> 'failed'""",
)
def _(tb):
    cells = ("true_positive", "false_positive", "false_negative", "true_negative")
    return _rows(tb, "noul").where(~F.col("failed")).select(
        "run_id", "benchmark_id", "case_id", *[r6(c) for c in cells]
    )


@query(
    "rounded_answers",
    "RS9",
    """select 'run-' || cast(m as varchar) run_id, bid benchmark_id, cast(cid as varchar) case_id,
              sum(rp) > 0 and abs(sum(rp) - 1) <= count(*) * 0.0051 ok,
              case when sum(rp) > 0 and abs(sum(rp) - 1) <= count(*) * (0.005 + 1e-6)
                   then round(max(rp) / sum(rp), 6) end top
       from (select m, bid, cid, round(p, 2) + case when cid % 11 = 0 then 0.04 else 0 end rp
             from choice_p) group by m, bid, cid""",
)
def _(tb):
    runs = tb.choice_base.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))))
    base = runs.withColumn(
        "w", F.expr("transform(sequence(0L, k - 1), pos -> 1 + (cid * 13 + pos * 29 + m * 7) % 10)")
    )
    noisy = base.withColumn(
        "rounded",
        F.expr(
            "map_from_arrays(options.id, transform(w, x -> round(x / aggregate(w, 0L, "
            "(a, y) -> a + y), 2) + case when cid % 11 = 0 then 0.04D else 0D end))"
        ),
    )
    kept = D.renormalized(F.col("rounded"), decimals=2)
    return noisy.select(
        F.concat(F.lit("run-"), F.col("m").cast("string")).alias("run_id"),
        F.col("bid").alias("benchmark_id"),
        F.col("cid").cast("string").alias("case_id"),
        kept.isNotNull().alias("ok"),
        F.round(F.array_max(F.map_values(kept)), 6).alias("top"),
    )


@query(
    "answer_decoding",
    "RS10",
    """select 'choice' task, 'run-' || cast(m as varchar) run_id, bid benchmark_id, cast(cid as varchar) case_id, pos,
              oid option_id, round(p, 6) p from choice_p
       union all select 'score', 'run-' || cast(m as varchar), bid, cast(cid as varchar), pos,
              concat('l', cast(4 - pos as varchar)), round(p, 6) from score_p
       union all select 'noul', 'run-' || cast(m as varchar), bid, cast(cid as varchar), v.pos, v.oid,
              round(case when v.pos = 1 then p else 1 - p end, 6)
       from noul_p, (values (cast(0 as bigint), 'false'), (cast(1 as bigint), 'true')) v(pos, oid)""",
)
def _(tb):
    """Wire answers are rebuilt from the testbed: anonymous choices, level indexes over the
    ascending scale (the stored options are reversed), and a bare p(true)."""

    every_run = F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1)))

    def answers(base, prefix):
        """The weights of every run over their sum as `p`, and as `raw` keyed by position."""
        total = base.withColumn("m", every_run).selectExpr("*", f"{weight_total()} total")
        shares = total.selectExpr("*", f"{per_position(f'({_WEIGHT}) / total')} p")
        keys = per_position(f"'{prefix}{{pos}}'")
        return shares.selectExpr("*", f"map_from_arrays({keys}, p) raw")

    def exploded(rows, task, options, answer):
        # A column of its own: several expressions read it, so it is worked out once per row.
        told = rows.withColumn("answer", answer).withColumn("told", S.aligned(F.col(options), F.col("answer")))
        return told.select(
            F.lit(task).alias("task"),
            F.concat(F.lit("run-"), F.col("m").cast("string")).alias("run_id"),
            F.col("bid").alias("benchmark_id"),
            F.col("cid").cast("string").alias("case_id"),
            "told",
            F.posexplode(F.col(options)["id"]).alias("pos", "option_id"),
        ).select(
            "task",
            "run_id",
            "benchmark_id",
            "case_id",
            F.col("pos").cast("bigint").alias("pos"),
            "option_id",
            F.round(F.get("told", "pos"), 6).alias("p"),
        )

    choice = answers(tb.choice_base, "option_")
    one = exploded(choice, "choice", "options", D.anonymous_answer(F.col("options"), F.col("raw")))
    # Levels reversed in id and value: index i of the ascending scale is option 4 - i.
    reversed_level = "named_struct('id', get(options, 4 - {pos}).id, 'value', 60 - get(options, 4 - {pos}).value)"
    score = answers(tb.score_base, "").selectExpr("*", f"{per_position(reversed_level, '5')} flipped")
    two = exploded(score, "score", "flipped", D.level_answer(F.col("flipped"), F.col("raw"), ascending=True))
    noul = tb.noul_base.withColumn("m", every_run).withColumn(
        "p_true", F.expr("((cid * 31 + m * 17) % 101) / 100D")
    ).withColumn(
        "options", F.expr("array(named_struct('id', 'false'), named_struct('id', 'true'))")
    )
    three = exploded(noul, "noul", "options", D.binary_answer(F.col("p_true")))
    return one.unionByName(two).unionByName(three)


@query(
    "log_probability_softmax",
    "RS11",
    """select bid benchmark_id, cast(cid as varchar) case_id, pos,
              case when cid % 17 = 0 then null else
                round(exp(lp - max(lp) over w) / sum(exp(lp)) over w * exp(max(lp) over w), 6)
              end p
       from (select bid, cid, pos, -((cid * 13 + pos * 29) % 10) / cast(2 as double) lp
             from fx_choice)
       window w as (partition by bid, cid)""",
)
def _(tb):
    """Every 17th answer lacks its last candidate and is therefore rejected."""
    rows = tb.choice_base.select(
        "bid",
        "cid",
        F.col("options.id").alias("ids"),
        F.expr(
            "map_from_arrays(slice(options.id, 1, int(k) - case when cid % 17 = 0 then 1 else 0 end),"
            "slice(transform(sequence(0L, k - 1), pos -> -cast((cid * 13 + pos * 29) % 10 as double)),"
            "1, int(k) - case when cid % 17 = 0 then 1 else 0 end))"
        ).alias("logs"),
    )
    p = D.softmax(F.col("ids"), F.col("logs"), temperature=2.0)
    filled = F.coalesce(p, F.transform("ids", lambda _: F.lit(None).cast("double")))
    return rows.select(
        F.col("bid").alias("benchmark_id"),
        F.col("cid").cast("string").alias("case_id"),
        F.posexplode(filled).alias("pos", "p"),
    ).select("benchmark_id", "case_id", F.col("pos").cast("bigint").alias("pos"), r6("p"))


@query(
    "uniform_scorer",
    "RS12",
    """select bid benchmark_id, cast(cid as varchar) case_id, oid option_id,
              round(1 / cast(k as double), 6) p from fx_choice""",
)
def _(tb):
    return tb.decisions_of("choice").select(
        "benchmark_id",
        "case_id",
        F.explode(D.uniform_answer(F.col("options"))).alias("option_id", "p"),
    ).select("benchmark_id", "case_id", "option_id", r6("p"))


@query(
    "clipped_scores",
    "RS13",
    f"select {_RUN}, round(skill, 6) skill, round(adj, 6) score from joined",
)
def _(tb):
    metrics = metric_table(tb.predictions, tb.decisions, tb.pieces)
    return metrics.select(
        "run_id",
        "benchmark_id",
        r6("baseline_adjusted_skill", "skill"),
        F.round(S.clip_unit(F.col("baseline_adjusted_skill")), 6).alias("score"),
    )


@query(
    "primary_metrics",
    "AG1",
    f"""select {_RUN}, round(acc, 6) metric from choice_m
        union all select {_RUN}, round(brier, 6) from noul_m
        union all select {_RUN}, round(mae, 6) from score_m""",
)
def _(tb):
    metrics = J.score_predictions(tb.predictions, tb.decisions, tb.pieces)
    value = F.coalesce(
        "target_mass_at_prediction", "binary_brier", "normalized_expected_score_mae"
    )
    return metrics.where(F.col("task") != "box").select(
        "run_id", "benchmark_id", F.round(value, 6).alias("metric")
    )


@query(
    "box_metrics",
    "AG2",
    f"select {_RUN}, round(iou, 6) mean_iou, round(hit, 6) accuracy_at_iou_0_5 from box_m",
)
def _(tb):
    return J.score_predictions(tb.predictions_of("box"), tb.decisions_of("box"), tb.pieces_of("box")).select(
        "run_id", "benchmark_id", r6("mean_iou"), r6("accuracy_at_iou_0_5")
    )


@query(
    "noul_diagnostics",
    "AG3",
    f"""select {_RUN}, round(tp, 6) true_positive, round(fp, 6) false_positive,
               round(fn, 6) false_negative, round(tn, 6) true_negative, round(acc, 6) accuracy,
               round(rec, 6) positive_recall, round(spec, 6) specificity,
               round(prec, 6) "precision", round(f1, 6) f1,
               round((rec + spec) / 2, 6) balanced_accuracy from noul_d""",
)
def _(tb):
    names = (
        "true_positive",
        "false_positive",
        "false_negative",
        "true_negative",
        "accuracy",
        "positive_recall",
        "specificity",
        "precision",
        "f1",
        "balanced_accuracy",
    )
    return J.score_predictions(tb.predictions_of("noul"), tb.decisions_of("noul"), tb.pieces_of("noul")).select(
        "run_id", "benchmark_id", *[r6(n) for n in names]
    )


@query(
    "noul_baselines",
    "AG4",
    """select bid benchmark_id, round(prev, 6) positive_prevalence,
              round(greatest(prev, 1 - prev), 6) majority_accuracy_baseline,
              round(cb, 6) constant_brier_baseline from noul_base""",
)
def _(tb):
    return B.noul_baselines(tb.decisions_of("noul")).select(
        "benchmark_id",
        r6("positive_prevalence"),
        r6("majority_accuracy_baseline"),
        r6("constant_brier_baseline"),
    )


@query(
    "brier_skill",
    "AG5",
    f"""select {_RUN}, round(case when cb > 1e-12 then 1 - brier / cb end, 6) brier_skill
        from noul_d""",
)
def _(tb):
    decisions = tb.decisions_of("noul")
    metrics = J.score_predictions(tb.predictions_of("noul"), decisions, tb.pieces_of("noul"))
    others = {c: F.lit(None).cast("double") for c in ("fixed_answer_accuracy_baseline", "constant_mae_baseline")}
    return J.adjusted_metrics(metrics, B.noul_baselines(decisions).withColumns(others)).select(
        "run_id", "benchmark_id", r6("brier_skill")
    )


_CHOICE_BASES = {
    "choice_uniform_baseline": ("AG6", "uniform_accuracy_baseline", "uniform"),
    "choice_fixed_id_baseline": ("AG7", "fixed_id_baseline", "fixed_id"),
    "choice_fixed_position_baseline": ("AG8", "fixed_position_baseline", "fixed_pos"),
}
for _name, (_survey, _column, _sql) in _CHOICE_BASES.items():

    @query(
        _name,
        _survey,
        f"select bid benchmark_id, round({_sql}, 6) baseline from choice_base",
    )
    def _(tb, column=_column):
        return B.choice_baselines(tb.decisions_of("choice")).select(
            "benchmark_id", r6(column, "baseline")
        )


@query(
    "choice_adjusted",
    "AG9",
    f"""select {_RUN}, round(acc, 6) accuracy, round(fixed, 6) baseline,
               round((acc - fixed) / (1 - fixed), 6) skill
        from choice_m join choice_base using (bid)""",
)
def _(tb):
    decisions = tb.decisions_of("choice")
    metrics = J.score_predictions(tb.predictions_of("choice"), decisions, tb.pieces_of("choice"))
    return J.adjusted_metrics(metrics, B.baselines(decisions)).select(
        "run_id",
        "benchmark_id",
        r6("target_mass_at_prediction", "accuracy"),
        r6("fixed_answer_accuracy_baseline", "baseline"),
        r6("baseline_adjusted_skill", "skill"),
    )


@query(
    "score_baselines",
    "AG10",
    """select bid benchmark_id, round(med, 6) constant_score_baseline,
              round(base, 6) constant_mae_baseline from score_base""",
)
def _(tb):
    return B.score_baselines(tb.decisions_of("score")).select(
        "benchmark_id", r6("constant_score_baseline"), r6("constant_mae_baseline")
    )


@query(
    "order_value_medians",
    "AG10",
    """select concat('c', cast(o_custkey % 7 as varchar)) bucket,
              round(median(o_totalprice), 6) median from orders group by 1""",
)
def _(tb):
    """The exact grouped median on many distinct values of an unbounded range."""
    counts = (
        tb.table("orders")
        .selectExpr("concat('c', cast(o_custkey % 7 as string)) grp", "o_totalprice value")
        .groupBy("grp", "value")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    return B.group_medians(counts, "grp", "value").select(
        F.col("grp").alias("bucket"), r6("median")
    )


@query(
    "score_adjusted",
    "AG11",
    f"""select {_RUN}, round(mae, 6) mae, round(rmse, 6) rmse,
               round(case when base > 1e-12 then 1 - mae / base end, 6) skill
        from score_m join score_base using (bid)""",
)
def _(tb):
    decisions = tb.decisions_of("score")
    metrics = J.score_predictions(tb.predictions_of("score"), decisions, tb.pieces_of("score"))
    return J.adjusted_metrics(metrics, B.baselines(decisions)).select(
        "run_id",
        "benchmark_id",
        r6("normalized_expected_score_mae", "mae"),
        r6("normalized_score_rmse", "rmse"),
        r6("baseline_adjusted_skill", "skill"),
    )


@query(
    "outcome_counts",
    "AG12",
    f"""select {_RUN}, cases, decision_count expected, succeeded, failed, abstained,
               case when recorded = decision_count and failed = 0 then 'complete'
                    else 'partial' end status
        from counts join defs using (bid)""",
)
def _(tb):
    return R.outcome_counts(tb.predictions, tb.benchmarks, count=tb.pieces)


_KEYS = """(select m, bid, cid from choice_row union all select m, bid, cid from score_row
  union all select m, bid, cid from noul_row union all select m, bid, cid from box_row)"""


@query(
    "invalid_results",
    "AG12,V7",
    f"""select run_id, benchmark_id, cases,
              case when (run_id = 'run-1' and benchmark_id in (select bid from {_KEYS} where m = 1 and cid % 199 = 0))
                     or (run_id = 'run-2' and benchmark_id in (select bid from {_KEYS} where m = 2 and cid % 211 = 0))
                   then 'invalid' else status end status
       from results""",
)
def _(tb):
    """Run 1 delivers some keys twice, run 2 some that no decision has."""
    unknown = F.expr("run_id = 'run-2' and cast(case_id as bigint) % 211 = 0")
    twice = tb.predictions.where("run_id = 'run-1' and cast(case_id as bigint) % 199 = 0")
    renamed = F.when(unknown, F.concat(F.lit("x"), "case_id")).otherwise(F.col("case_id"))
    rows = tb.predictions.withColumn("case_id", renamed).unionByName(twice)
    return R.outcome_counts(rows, tb.benchmarks, tb.decisions, tb.pieces).select(
        "run_id", "benchmark_id", "cases", "status"
    )


@query(
    "result_eligibility",
    "AG13",
    """select run_id, benchmark_id, eligible,
              case when not eligible then case task
                when 'noul' then 'single_target_class'
                when 'choice' then 'fixed_answer_is_perfect'
                when 'score' then 'constant_targets'
                else 'task_is_not_ranked' end end
              reason from results""",
)
def _(tb):
    return R.with_eligibility(tb.lazy_results).select(
        "run_id", "benchmark_id", "eligible", "reason"
    )


_ALL = ", ".join(f'round("{m}", 6) "{m}"' for m in METRICS)


@query(
    "stored_results",
    "AG1,AG2,AG3,AG4,AG5,AG9,AG11,AG12",
    f"""select run_id, benchmark_id, task, cases, expected, succeeded, failed, abstained, status,
               provenance, {_ALL} from results""",
)
def _(tb):
    return tb.lazy_results.select(
        "run_id",
        "benchmark_id",
        "task",
        "cases",
        "expected",
        "succeeded",
        "failed",
        "abstained",
        "status",
        "provenance",
        *[r6(m) for m in METRICS],
    )
