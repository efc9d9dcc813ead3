"""Task scores, rankings and comparisons over the stored results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import PRIMARY_METRIC
from tallyloom.operators import comparison as C
from tallyloom.operators import leaderboard as L
from tallyloom.operators import ranking as K
from tallyloom.operators import results as R
from tallyloom.operators import scopes as P
from tallyloom.plans.evaluation import rank_runs
from tallyloom.plans.queries.registry import query, r6
from tallyloom.plans.testbed import RUNS

SELECTED = [f"run-{m}" for m in range(RUNS)]


def _means(tb, metric="baseline_adjusted_score"):
    return L.task_means(tb.results, tb.members, tb.benchmarks, metric)


def _cells(tb, adjusted=False):
    return C.compare_runs(tb.results, tb.members, tb.benchmarks, SELECTED, adjusted)


_BORDA = """select b.category, b.run_id, round(t.task_avg, 6) task_avg, round(b.borda, 6) borda
            from borda b join task_avg t on t.category = b.category and t.run_id = b.run_id"""


@query("borda_leaderboard", "AG29,W1,W2,AG15", _BORDA)
def _(tb):
    """The flagship: evaluate everything from the input tables, then rank."""
    ranked = rank_runs(tb.lazy_results, tb.members, tb.benchmarks)
    return ranked.select("category", "run_id", r6("task_avg"), r6("borda"))


@query("borda_scores", "AG29", _BORDA)
def _(tb):
    ranked = L.borda_scores(tb.results, tb.members, tb.benchmarks)
    return ranked.select("category", "run_id", r6("task_avg"), r6("borda"))


@query(
    "borda_points",
    "W1",
    """select category, benchmark_id, run_id, round(r, 6) average_rank,
              round((n - r) / nullif(n - 1, 0), 6) points from points
       where v is not null""",
)
def _(tb):
    ranked = P.ranking_scope(tb.members, tb.benchmarks)
    cohort = L.borda_cohort(tb.results, tb.members, tb.benchmarks)
    entries = L.scoped_results(tb.results, ranked, tb.benchmarks).join(
        cohort.select("category", "run_id"), ["category", "run_id"]
    )
    return L.borda_points(entries).select(
        "category", "benchmark_id", "run_id", r6("average_rank"), r6("points")
    )


@query(
    "borda_cohort",
    "W2",
    """select category, run_id, round(task_avg, 6) task_avg from cohort
       join task_avg using (category, run_id) where task_avg is not null""",
)
def _(tb):
    return L.borda_cohort(tb.results, tb.members, tb.benchmarks).select(
        "category", "run_id", r6("task_avg")
    )


@query(
    "task_scores",
    "AG14",
    """select category, run_id, task, complete, required, round(value, 6) score
       from task_means""",
)
def _(tb):
    return _means(tb).select(
        "category", "run_id", "task", "complete", "required", r6("value", "score")
    )


@query(
    "task_average",
    "AG15",
    "select category, run_id, round(task_avg, 6) task_avg from task_avg",
)
def _(tb):
    return L.task_average(_means(tb)).select("category", "run_id", r6("task_avg"))


_PRIMARY = """case task when 'choice' then target_mass_at_prediction
  when 'noul' then binary_brier when 'score' then normalized_expected_score_mae
  else mean_iou end"""
_RAW = f"""
  select t.category, t.run_id, t.task, min(t.required) total,
         bool_or(a.demo) demo,
         count(s.run_id) filter (s.status = 'complete' and {_PRIMARY.replace('task', 's.task', 1)}
           is not null) complete,
         avg({_PRIMARY.replace('task', 's.task', 1)}) filter (s.status = 'complete') mean
  from run_tasks t
  join (select category, run_id, bool_or(provenance = 'demo') demo from scoped
        group by category, run_id) a on a.category = t.category and a.run_id = t.run_id
  left join scoped s on s.category = t.category and s.run_id = t.run_id and s.task = t.task
  group by t.category, t.run_id, t.task"""
_BOARD = f"""
  select category, run_id, task, demo, complete, total,
         case when complete = total then mean end score from ({_RAW})
  union all
  select a.category, a.run_id, k.task, a.demo, 0, 0, cast(null as double)
  from (select category, run_id, bool_or(provenance = 'demo') demo from scoped group by category, run_id) a,
       (values ('noul'), ('choice'), ('score'), ('box')) k(task)
  where not exists (select 1 from required q where q.category = a.category and q.task = k.task)"""


@query(
    "raw_leaderboard",
    "AG16",
    f"select category, run_id, task, demo, complete, total, round(score, 6) score from ({_BOARD})",
)
def _(tb):
    board = L.raw_leaderboard(tb.results, tb.members, tb.benchmarks)
    return board.select(
        "category",
        "run_id",
        "task",
        "demo",
        F.col("complete").cast("bigint").alias("complete"),
        F.col("total").cast("bigint").alias("total"),
        r6("score"),
    )


@query(
    "leaderboard_positions",
    "W7",
    f"""select category, task, run_id,
          row_number() over (partition by category, task order by demo, score is null,
            case when task = 'choice' then -round(score, 12) else round(score, 12) end, run_id)
            position
        from ({_BOARD})""",
)
def _(tb):
    board = L.raw_leaderboard(tb.results, tb.members, tb.benchmarks)
    board = board.withColumn("score", F.round("score", 12))
    return L.leaderboard_positions(board).select("category", "task", "run_id", "position")


@query(
    "diagnostic_means",
    "AG17",
    """select t.category, t.run_id, t.task,
         round(case when count(*) filter (s.status = 'complete' and s.provenance = 'measured') = min(t.required)
                     and count(s.accuracy) = count(*) then avg(s.accuracy) end, 6) mean
       from run_tasks t left join scoped s on s.category = t.category and s.run_id = t.run_id and s.task = t.task
       group by t.category, t.run_id, t.task""",
)
def _(tb):
    return _means(tb, "accuracy").select("category", "run_id", "task", r6("value", "mean"))


_CELL = """max(case when d.dataset like '%-{f}-{t}' and s.status = 'complete'
  and s.provenance = 'measured' and s.eligible then baseline_adjusted_score end) {f}_{t}"""
_CELLS = ", ".join(
    _CELL.format(f=f, t=t) for f in ("diverse", "contextual") for t in ("noul", "choice", "score")
)
_NAMES = [f"{f}_{t}" for f in ("diverse", "contextual") for t in ("noul", "choice", "score")]


@query(
    "generalization_comparison",
    "AG18",
    f"""select category, run_id, {', '.join(f'round({n}, 6) {n}' for n in _NAMES)},
               round(({' + '.join(_NAMES)}) / 6, 6) average
        from (select category, run_id, {_CELLS}
              from scoped s join defs d on d.bid = s.benchmark_id
              where starts_with(d.dataset, 'datasets/generalization-')
              group by category, run_id)""",
)
def _(tb):
    wide = L.generalization_comparison(tb.results, tb.members, tb.benchmarks)
    return wide.select("category", "run_id", *[r6(n) for n in _NAMES], r6("average"))


@query(
    "radar_profiles",
    "AG19",
    """select category, run_id, round(max(v) filter (axis = 'noul') * 100, 6) noul,
              round(max(v) filter (axis = 'choice') * 100, 6) choice,
              round(max(v) filter (axis = 'score') * 100, 6) score,
              round(max(v) filter (axis = 'general_noul') * 100, 6) general_noul,
              round(max(v) filter (axis = 'general_choice') * 100, 6) general_choice,
              round(max(v) filter (axis = 'general_score') * 100, 6) general_score
       from (select category, run_id, task axis, value v from task_means where task <> 'box'
             union all
             select c.category, g.run_id, 'general_' || g.task, g.value
             from task_means g, (select distinct category from members) c
             where g.category = 'general-v1' and g.task <> 'box')
       group by category, run_id""",
)
def _(tb):
    axes = ("noul", "choice", "score", "general_noul", "general_choice", "general_score")
    wide = L.radar_profiles(tb.results, tb.members, tb.benchmarks)
    return wide.select("category", "run_id", *[r6(a) for a in axes])


@query(
    "category_runs",
    "AG20,J4",
    """select category, run_id, min(model_id) model_id, bool_or(provenance = 'demo') demo,
              count(*) results from scoped group by category, run_id""",
)
def _(tb):
    return R.category_runs(tb.results, tb.members)


@query(
    "membership_semi_join",
    "J4",
    """select run_id, benchmark_id from results
       where benchmark_id in (select bid from members where category = 'general-v1')""",
)
def _(tb):
    scope = tb.members.where(F.col("category") == "general-v1").select("benchmark_id")
    return tb.results.join(scope, "benchmark_id", "left_semi").select("run_id", "benchmark_id")


@query(
    "scope_inventory",
    "AG26",
    """select category, m.task, count(*) benchmarks, cast(sum(case_count) as bigint) cases,
              cast(sum(decision_count) as bigint) decisions
       from members m join defs using (bid) group by category, m.task""",
)
def _(tb):
    return P.scope_inventory(tb.members, tb.benchmarks)


_GRID = f"""
  select m.category, m.bid benchmark_id, m.task, r.run_id, s.status, s.provenance,
         {_PRIMARY.replace('task', 'm.task', 1)} v,
         coalesce(s.status = 'complete' and s.provenance = 'measured', false) ok
  from members m
  join (select distinct category, run_id from scoped) r on r.category = m.category
  left join results s on s.run_id = r.run_id and s.benchmark_id = m.bid"""
_ENDS = f"""
  select g.*, max(v) filter (ok and v is not null)
                over (partition by category, benchmark_id) hi,
         min(v) filter (ok and v is not null) over (partition by category, benchmark_id) lo,
         count(v) filter (ok) over (partition by category, benchmark_id) n
  from ({_GRID}) g"""


@query(
    "comparison_grid",
    "J10",
    f"select category, benchmark_id, task, run_id, status, round(v, 6) \"value\" from ({_GRID})",
)
def _(tb):
    return _cells(tb).select("category", "benchmark_id", "task", "run_id", "status", r6("value"))


@query(
    "best_cells",
    "W4",
    f"""select category, benchmark_id, run_id,
               coalesce(ok and v is not null and n >= 2
                 and v = case when task in ('choice', 'box') then hi else lo end, false) best
        from ({_ENDS})""",
)
def _(tb):
    return C.with_best(_cells(tb)).select("category", "benchmark_id", "run_id", "best")


@query(
    "comparison_spread",
    "W5",
    f"""select distinct category, benchmark_id,
               round(case when n >= 2 then hi - lo end, 6) spread from ({_ENDS})""",
)
def _(tb):
    return C.benchmark_spread(_cells(tb)).select("category", "benchmark_id", r6("spread"))


@query(
    "reference_deltas",
    "W6",
    f"""select g.category, g.benchmark_id, g.run_id,
               round(case when g.ok and b.ok then (g.v - b.v)
                 * case when g.task in ('choice', 'box') then 1 else -1 end end, 6) delta
        from ({_GRID}) g left join ({_GRID}) b
          on b.category = g.category and b.benchmark_id = g.benchmark_id and b.run_id = 'run-1'""",
)
def _(tb):
    return C.with_delta(_cells(tb), "run-1").select(
        "category", "benchmark_id", "run_id", r6("delta")
    )


@query(
    "comparison_positions",
    "W9",
    f"""select category, task, benchmark_id,
               row_number() over (partition by category, task
                 order by coalesce(spread, -1) desc, benchmark_id) position
        from (select distinct category, task, benchmark_id,
                     round(case when n >= 2 then hi - lo end, 9) spread from ({_ENDS}))""",
)
def _(tb):
    spreads = C.benchmark_spread(_cells(tb)).withColumn("spread", F.round("spread", 9))
    return C.comparison_positions(spreads).select("category", "task", "benchmark_id", "position")


_BETTER_HIGH = {"choice": True, "noul": False, "score": False, "box": True}


@query(
    "metric_ranks",
    "W3",
    " union all ".join(
        f"""select benchmark_id, run_id, case when {PRIMARY_METRIC[t]} is not null then
                rank() over (partition by benchmark_id, {PRIMARY_METRIC[t]} is null
                             order by {PRIMARY_METRIC[t]} {"desc" if high else "asc"}) end metric_rank
            from results where task = '{t}'"""
        for t, high in _BETTER_HIGH.items()
    ),
)
def _(tb):
    """Every task by its primary metric."""
    ranked = [
        C.metric_ranks(tb.results.where(F.col("task") == t), ["benchmark_id"], PRIMARY_METRIC[t]).select(
            "benchmark_id", "run_id", F.col("rank").alias("metric_rank")
        )
        for t in _BETTER_HIGH
    ]
    return reduce(DataFrame.unionByName, ranked)


@query(
    "order_total_ranks",
    "W3",
    """select o_custkey % 3 grp, o_orderkey, rank() over (partition by o_custkey % 3
              order by round(o_totalprice / 1000) desc) price_rank from orders""",
)
def _(tb):
    """Competition ranks in three large groups with many ties."""
    rows = tb.table("orders").selectExpr(
        "o_custkey % 3 grp", "o_orderkey", "round(o_totalprice / 1000) price"
    )
    return K.with_rank(rows, ["grp"], "price", name="price_rank").select(
        "grp", "o_orderkey", "price_rank"
    )


@query(
    "order_positions",
    "W7",
    """select o_orderstatus grp, o_orderkey,
              row_number() over (partition by o_orderstatus
                order by o_orderpriority, o_orderkey) position from orders""",
)
def _(tb):
    """Total positions in groups of which one holds about half of all rows."""
    rows = tb.table("orders").select(
        F.col("o_orderstatus").alias("grp"), "o_orderpriority", "o_orderkey"
    )
    order = [F.col("o_orderpriority"), F.col("o_orderkey")]
    return K.with_position(rows, ["grp"], order).select("grp", "o_orderkey", "position")


@query(
    "result_positions",
    "W8",
    " union all ".join(
        f"""select benchmark_id, run_id, row_number() over (partition by benchmark_id
              order by not (status = 'complete' and provenance = 'measured'),
                {PRIMARY_METRIC[t]} is null, {PRIMARY_METRIC[t]} {"desc" if high else "asc"}, run_id) position
            from results where task = '{t}'"""
        for t, high in _BETTER_HIGH.items()
    ),
)
def _(tb):
    """Every task by its primary metric."""
    placed = [
        C.result_positions(tb.results.where(F.col("task") == t), PRIMARY_METRIC[t]).select("benchmark_id", "run_id", "position")
        for t in _BETTER_HIGH
    ]
    return reduce(DataFrame.unionByName, placed)


@query(
    "default_eligibility_scores",
    "AG14,AG13",
    """select category, run_id, task, case when complete = required and counted > 0 and undefined = 0 then round(mean, 6) end value
       from (select m.category, r.run_id, m.task, count(*) filter (status = 'complete' and provenance = 'measured') complete,
                    count(*) filter (e) counted, count(*) filter (e and baseline_adjusted_score is null) undefined,
                    avg(case when e then baseline_adjusted_score end) mean
             from members m join (select *, case when run_id in ('run-0', 'run-2', 'run-4') then eligible
                else coalesce(case when benchmark_id like '%-O-choice' then null else benchmark_id <> 'price-1-score' end, false) end e
                from results) r on r.benchmark_id = m.bid
             where m.task <> 'box' group by m.category, r.run_id, m.task)
       join (select category, task, count(*) required from members group by category, task) using (category, task)""",
)
def _(tb):
    """Odd runs say nothing of their eligibility; the snapshot has defaults for all benchmarks but one."""
    even = F.substring("run_id", -1, 1).cast("int") % 2 == 0
    own = R.with_eligibility(tb.results).withColumn("own_eligible", F.when(even, F.col("eligible"))).drop("eligible", "reason")
    defaults = tb.benchmarks.where("id not like '%-O-choice'").select(
        F.col("id").alias("benchmark_id"), (F.col("id") != "price-1-score").alias("eligible")
    )
    means = L.task_means(R.default_eligibility(own, defaults), tb.members, tb.benchmarks, eligibility=F.col("eligible"))
    return means.where("task <> 'box'").select("category", "run_id", "task", r6("value"))


@query(
    "ranking_scope",
    "PF6",
    "select category, bid benchmark_id from members where task <> 'box'",
)
def _(tb):
    return P.ranking_scope(tb.members, tb.benchmarks).select("category", "benchmark_id")


@query(
    "generalization_scope",
    "PF7",
    """select category, bid benchmark_id from members join defs using (bid)
       where starts_with(dataset, 'datasets/generalization-')""",
)
def _(tb):
    return P.generalization_scope(tb.members, tb.benchmarks).select("category", "benchmark_id")


@query(
    "scope_selection",
    "PF4",
    """select bid benchmark_id, decision_count from members join defs using (bid)
       where category = 'main-v1' and defs.task = 'choice'
         and starts_with(dataset, 'datasets/generalization-')
         and bid in ('status-F-choice', 'status-P-choice', 'price-1-score')""",
)
def _(tb):
    names = ["status-F-choice", "status-P-choice", "price-1-score"]
    chosen = P.select_scope(
        tb.members,
        tb.benchmarks,
        "main-v1",
        names=names,
        task="choice",
        generalization_only=True,
        exclude_box=True,
    )
    P.require_scope(tb.members, chosen, "main-v1", names)
    return chosen.select(F.col("id").alias("benchmark_id"), "decision_count")


@query(
    "visible_runs",
    "PF10",
    """select category, run_id from
         (select *, bool_or(ok) over (partition by category) any_ok from
           (select category, run_id, not bool_or(provenance = 'demo')
                   and bool_or(status = 'complete') ok
            from scoped group by category, run_id))
       where ok or not any_ok""",
)
def _(tb):
    return P.visible_runs(tb.results, tb.members).select("category", "run_id")


@query(
    "merged_categories",
    "SO1",
    """select bid benchmark_id, min(case category when 'text-v1' then 0 else 1 end) first_category
       from members where category in ('text-v1', 'main-v1') group by bid""",
)
def _(tb):
    merged = P.merged_categories(tb.members, ["text-v1", "main-v1"], "all")
    return merged.select(
        "benchmark_id", F.col("category_pos").cast("bigint").alias("first_category")
    )


@query(
    "missing_results",
    "J9",
    """select r.run_id, m.bid benchmark_id from runs r, members m
       where m.category = 'main-v1' and not exists (
         select 1 from results s where s.run_id = r.run_id and s.benchmark_id = m.bid
           and s.status = 'complete' and s.provenance = 'measured')""",
)
def _(tb):
    runs = tb.runs.select("run_id", F.lit("main-v1").alias("category"))
    return R.missing_results(tb.results, tb.members, runs).select("run_id", "benchmark_id")


@query(
    "definition_join",
    "J3",
    """select run_id, benchmark_id,
              case when benchmark_id = 'price-1-score' then 'split' else '' end mismatch
       from results where benchmark_id <> 'status-P-choice'""",
)
def _(tb):
    """One definition is retired and one result was recorded under another split."""
    current = tb.benchmarks.where(F.col("id") != "status-P-choice")
    recorded = tb.benchmarks.select(
        F.col("id").alias("benchmark_id"),
        F.col("task").alias("recorded_task"),
        F.col("dataset").alias("recorded_dataset"),
        F.when(F.col("id") == "price-1-score", "dev")
        .otherwise(F.col("split"))
        .alias("recorded_split"),
        F.col("primary_metric").alias("recorded_primary_metric"),
    )
    rows = tb.results.select("run_id", "benchmark_id").join(recorded, "benchmark_id")
    return R.join_definitions(rows, current).select("run_id", "benchmark_id", "mismatch")
