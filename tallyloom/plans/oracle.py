"""The testbed tables and core metrics stated in plain SQL, for an independent engine."""

from __future__ import annotations

from tallyloom.plans.testbed import DATASET, OUTCOME, RECORDED

_SELECT_RESULT = """
  select concat('run-', cast(x.m as varchar)) run_id, x.bid benchmark_id, x.task, x.cases,
         x.expected, x.succeeded, x.failed, x.abstained,
         case when x.recorded = x.expected and x.failed = 0 then 'complete' else 'partial' end
           status"""

PRELUDE = f"""
runs6 as (select cast(v as bigint) m from (values (0),(1),(2),(3),(4),(5)) x(v)),
pos5 as (select cast(v as bigint) pos from (values (0),(1),(2),(3),(4)) x(v)),
fx_noul as (
  select concat('quality-', d.lang, '-noul') bid, d.doc_id cid,
         case when d.doc_id % 5 = 0 then cast(0.75 as double)
              else cast(l.quality as double) end t
  from documents d join labels l on d.doc_id = l.doc_id),
fx_choice as (
  select concat('status-', o_orderstatus, '-choice') bid, o_orderkey cid,
         2 + o_orderkey % 4 k, pos,
         concat('p', cast((pos + o_custkey) % 5 as varchar)) oid,
         case when o_orderkey % 9 = 0 then
                case when pos in ((o_orderkey * 7) % (2 + o_orderkey % 4),
                                  ((o_orderkey * 7) % (2 + o_orderkey % 4) + 1)
                                    % (2 + o_orderkey % 4))
                     then cast(0.5 as double) else cast(0 as double) end
              when pos = (o_orderkey * 7) % (2 + o_orderkey % 4) then cast(1 as double)
              else cast(0 as double) end t
  from orders, pos5 where pos < 2 + o_orderkey % 4),
fx_score as (
  select concat('price-', substr(o_orderpriority, 1, 1), '-score') bid, o_orderkey cid, pos,
         cast(10 * (pos + 1) as double) val,
         case when o_orderkey % 3 = 0 then
                case when pos = o_custkey % 4 then cast(0.75 as double)
                     when pos = o_custkey % 4 + 1 then cast(0.25 as double)
                     else cast(0 as double) end
              when pos = o_custkey % 5 then cast(1 as double) else cast(0 as double) end t
  from orders, pos5),
fx_box as (
  select concat('area-', p_brand, '-box') bid, p_partkey cid,
         (p_partkey % 50) / cast(100 as double) l, (p_partkey % 40) / cast(100 as double) t,
         (p_partkey % 50 + p_size + 1) / cast(100 as double) r,
         (p_partkey % 40 + 25) / cast(100 as double) b
  from part),
defs as (
  select bid, task, count(distinct cid) case_count, count(*) decision_count, {DATASET} dataset,
         case task when 'choice' then 'target_mass_at_prediction' when 'noul' then 'binary_brier'
                   when 'score' then 'normalized_expected_score_mae' else 'mean_iou' end
           primary_metric
  from (select bid, cid, 'noul' task from fx_noul
        union all select distinct bid, cid, 'choice' from fx_choice
        union all select distinct bid, cid, 'score' from fx_score
        union all select bid, cid, 'box' from fx_box)
  group by bid, task),
listed as (
  select 'main-v1' category, bid, task from defs
  union all select 'text-v1', bid, task from defs where task <> 'box'
  union all select 'general-v1', bid, task from defs
            where starts_with(dataset, 'datasets/generalization-')),
members as (
  select category, bid, task,
         row_number() over (partition by category order by bid) - 1 pos from listed),
runs as (
  select concat('run-', cast(s_suppkey as varchar)) run_id,
         concat('org__', replace(lower(s_name), '#', '-')) model_key,
         concat('org/', replace(lower(s_name), '#', '-')) model_id,
         case when s_suppkey = 4 then 'dummy' else 'local' end adapter,
         case when s_suppkey = 4 then 'demo' else 'measured' end provenance
  from supplier),
models as (
  select concat('run-', cast(s_suppkey as varchar)) run_id,
         concat('org__', replace(lower(s_name), '#', '-')) model_key,
         concat('org/', replace(lower(s_name), '#', '-')) model_id,
         'local' adapter,
         case when s_suppkey % 4 <> 3 then s_name end display_name,
         concat('S', cast(s_suppkey as varchar)) short_name,
         case when s_suppkey % 3 <> 2 then (s_suppkey * 370000007) % 41000000000 end
           total_params,
         case when s_suppkey % 3 = 0 then (s_suppkey * 370000007) % 41000000000
           - s_suppkey * 1000 end active_params,
         case when s_suppkey % 3 = 0 then case when s_suppkey % 2 = 0
           then 'non_lookup_parameters_v1' else 'embedding_excluded_parameters_v1' end end
           parameter_count_method,
         s_suppkey suppkey
  from supplier),
exposures as (
  select model_key, run_id, suppkey, b.bid benchmark_id,
         case when suppkey % 5 = 0 then 'evaluation_examples' else 'same_source_family' end
           relationship,
         case when suppkey % 11 = 0 then 'leaked' else 'public' end dataset_access,
         case when suppkey % 13 = 0 then 'https://u:p@example.com/x'
              else 'https://example.com/x' end evidence_url
  from models, (values ('quality-en-noul', 2), ('status-F-choice', 3), ('price-9-score', 7))
    b(bid, every)
  where suppkey % every = 0),
noul_p as (
  select m, bid, cid, t, {OUTCOME} outcome, ((cid * 31 + m * 17) % 101) / cast(100 as double) p
  from fx_noul, runs6),
choice_p as (
  select m, bid, cid, k, pos, oid, t, {OUTCOME} outcome,
         (1 + (cid * 13 + pos * 29 + m * 7) % 10)
           / cast(sum(1 + (cid * 13 + pos * 29 + m * 7) % 10)
                  over (partition by m, bid, cid) as double) p
  from fx_choice, runs6),
score_p as (
  select m, bid, cid, pos, val, t, {OUTCOME} outcome,
         (1 + (cid * 13 + pos * 29 + m * 7) % 10)
           / cast(sum(1 + (cid * 13 + pos * 29 + m * 7) % 10)
                  over (partition by m, bid, cid) as double) p
  from fx_score, runs6),
box_p as (
  select m, bid, cid, l, t, r, b, {OUTCOME} outcome,
         least(cast(1 as double), l + (m * 3 + cid % 7) / cast(100 as double)) pl,
         least(cast(1 as double), r + (m * 3 + cid % 7) / cast(100 as double)) pr
  from fx_box, runs6 where {RECORDED}),
choice_row as (
  select m, bid, cid, outcome,
         case when outcome = 'abstained' then cast(0 as double)
              when outcome = 'ok' then t end credit, oid, pos
  from (select *, row_number() over (partition by m, bid, cid order by p desc, pos) rn
        from choice_p) where rn = 1),
score_row as (
  select m, bid, cid, outcome,
         case when outcome = 'abstained' then cast(1 as double)
              when outcome = 'ok' then sum(val * (p - t)) / 40 end err
  from score_p group by m, bid, cid, outcome),
box_row as (
  select m, bid, cid, outcome,
         case when outcome = 'abstained' then cast(0 as double)
              when outcome = 'ok' then
                case when u > 0 then i / u else cast(0 as double) end end iou
  from (select *, (r - l) * (b - t) + (pr - pl) * (b - t) - i u
        from (select *, greatest(0, least(r, pr) - greatest(l, pl)) * greatest(0, b - t) i
              from box_p))),
noul_row as (
  select m, bid, cid, t, p, outcome,
         case when outcome = 'abstained' then cast(1 as double)
              when outcome = 'ok' then (p - t) * (p - t) end brier,
         case when outcome = 'ok' and p >= 0.5 then t
              when outcome <> 'failed' then cast(0 as double) end tp,
         case when outcome = 'abstained' or (outcome = 'ok' and p >= 0.5) then 1 - t
              when outcome <> 'failed' then cast(0 as double) end fp,
         case when outcome = 'abstained' or (outcome = 'ok' and p < 0.5) then t
              when outcome <> 'failed' then cast(0 as double) end fn,
         case when outcome = 'ok' and p < 0.5 then 1 - t
              when outcome <> 'failed' then cast(0 as double) end tn
  from noul_p),
counts as (
  select m, bid, count(distinct cid) cases, count(*) recorded,
         count(*) filter (outcome = 'ok') succeeded, count(*) filter (outcome = 'failed') failed,
         count(*) filter (outcome = 'abstained') abstained
  from (select m, bid, cid, outcome from noul_row
        union all select m, bid, cid, outcome from choice_row
        union all select m, bid, cid, outcome from score_row
        union all select m, bid, cid, outcome from box_row) group by m, bid),
noul_base as (
  select bid, avg(t) prev, avg(t * t) - avg(t) * avg(t) cb from fx_noul group by bid),
choice_n as (
  select bid, count(*) n, sum(1 / cast(k as double)) us
  from (select distinct bid, cid, k from fx_choice) group by bid),
choice_id as (
  select bid, max(v) v from (
    select d.bid, i.oid, avg(coalesce(c.t, 1 / cast(d.k as double))) v
    from (select distinct bid, cid, k from fx_choice) d
    join (select distinct bid, oid from fx_choice) i on d.bid = i.bid
    left join fx_choice c on c.bid = d.bid and c.cid = d.cid and c.oid = i.oid
    group by d.bid, i.oid) group by bid),
choice_pos as (
  select bid, max(v) v from (
    select d.bid, i.pos, avg(coalesce(c.t, 1 / cast(d.k as double))) v
    from (select distinct bid, cid, k from fx_choice) d
    join (select distinct bid, pos from fx_choice) i on d.bid = i.bid
    left join fx_choice c on c.bid = d.bid and c.cid = d.cid and c.pos = i.pos
    group by d.bid, i.pos) group by bid),
choice_base as (
  select n.bid, us / n.n uniform, i.v fixed_id, p.v fixed_pos,
         greatest(us / n.n, i.v, p.v) fixed
  from choice_n n join choice_id i on n.bid = i.bid join choice_pos p on n.bid = p.bid),
score_target as (
  select bid, cid, sum((val - 10) / 40 * t) v from fx_score group by bid, cid),
score_med as (select bid, median(v) med from score_target group by bid),
score_base as (
  select s.bid, min(med) med, avg(abs(v - med)) base
  from score_target s join score_med m on s.bid = m.bid group by s.bid),
noul_m as (
  select m, bid, avg(brier) brier, sum(tp) tp, sum(fp) fp, sum(fn) fn, sum(tn) tn,
         count(brier) n from noul_row group by m, bid),
noul_d as (
  select x.*, prev, cb, (tp + tn) / nullif(n, 0) acc,
         case when tp + fn > 1e-12 then tp / (tp + fn) end rec,
         case when tn + fp > 1e-12 then tn / (tn + fp) end spec,
         case when tp + fp > 1e-12 then tp / (tp + fp) end prec,
         case when 2 * tp + fp + fn > 1e-12 then 2 * tp / (2 * tp + fp + fn) end f1
  from noul_m x join noul_base using (bid)),
choice_m as (
  select m, bid, avg(credit) acc from choice_row group by m, bid),
score_m as (
  select m, bid, avg(abs(err)) mae, sqrt(avg(err * err)) rmse from score_row group by m, bid),
box_m as (
  select m, bid, avg(iou) iou,
         avg(case when iou >= 0.5 then cast(1 as double) when iou < 0.5 then cast(0 as double) end)
           hit
  from box_row group by m, bid),
skills as (
  select m, bid, 'noul' task, rec + spec - 1 skill from noul_d
  union all select m, bid, 'choice',
    case when fixed < 1 - 1e-12 then (acc - fixed) / (1 - fixed) end
    from choice_m join choice_base using (bid)
  union all select m, bid, 'score', case when base > 1e-12 then 1 - mae / base end
    from score_m join score_base using (bid)
  union all select m, bid, 'box', cast(null as double) from box_m),
joined as (
  select s.*, c.cases, c.recorded, c.succeeded, c.failed, c.abstained,
         d.decision_count expected, d.case_count, d.dataset,
         case when skill is not null then greatest(0, least(1, skill)) end adj
  from skills s join counts c using (m, bid) join defs d using (bid)),
results as (
{_SELECT_RESULT},
         round(n.brier, 12) binary_brier, round(n.acc, 12) accuracy,
         round(n.rec, 12) positive_recall, round(n.spec, 12) specificity,
         round(n.prec, 12) "precision", round((n.rec + n.spec) / 2, 12) balanced_accuracy,
         round(n.f1, 12) f1, n.tp true_positive, n.fp false_positive, n.fn false_negative,
         n.tn true_negative, round(n.prev, 12) positive_prevalence,
         round(greatest(n.prev, 1 - n.prev), 12) majority_accuracy_baseline,
         round(n.cb, 12) constant_brier_baseline,
         round(case when n.cb > 1e-12 then 1 - n.brier / n.cb end, 12) brier_skill,
         round(c.acc, 12) target_mass_at_prediction,
         round(cb.uniform, 12) uniform_accuracy_baseline,
         round(cb.fixed, 12) fixed_answer_accuracy_baseline,
         round(s.mae, 12) normalized_expected_score_mae, round(s.rmse, 12) normalized_score_rmse,
         round(sb.med, 12) constant_score_baseline, round(sb.base, 12) constant_mae_baseline,
         round(b.iou, 12) mean_iou, round(b.hit, 12) accuracy_at_iou_0_5,
         round(x.skill, 12) baseline_adjusted_skill, round(x.adj, 12) baseline_adjusted_score,
         r.model_key, r.model_id, r.adapter, r.provenance,
         case x.task when 'noul' then n.prev > 1e-12 and n.prev < 1 - 1e-12
                     when 'choice' then cb.fixed < 1 - 1e-12
                     when 'score' then sb.base > 1e-12 else false end eligible
  from joined x
  join runs r on r.run_id = concat('run-', cast(x.m as varchar))
  left join noul_d n on n.m = x.m and n.bid = x.bid
  left join choice_m c on c.m = x.m and c.bid = x.bid
  left join choice_base cb on cb.bid = x.bid
  left join score_m s on s.m = x.m and s.bid = x.bid
  left join score_base sb on sb.bid = x.bid
  left join box_m b on b.m = x.m and b.bid = x.bid),
scoped as (
  select category, r.* from results r join members m on m.bid = r.benchmark_id),
required as (
  select category, task, count(*) required from members group by category, task),
run_tasks as (
  select category, run_id, task, required
  from (select distinct category, run_id from scoped) join required using (category)),
task_means as (
  select t.category, t.run_id, t.task, min(t.required) required,
         count(*) filter (s.status = 'complete' and s.provenance = 'measured') complete,
         case when count(*) filter (s.status = 'complete' and s.provenance = 'measured')
                     = min(t.required)
               and count(*) filter (t.task = 'box' or s.eligible) > 0
               and count(*) filter ((t.task = 'box' or s.eligible)
                     and case when t.task = 'box' then mean_iou
                              else baseline_adjusted_score end is null) = 0
              then avg(case when t.task = 'box' then mean_iou
                            when s.eligible then baseline_adjusted_score end) end value
  from run_tasks t left join scoped s
    on s.category = t.category and s.run_id = t.run_id and s.task = t.task
  group by t.category, t.run_id, t.task),
task_avg as (
  select category, run_id, case when count(value) = 3 then avg(value) end task_avg
  from task_means where task <> 'box' group by category, run_id),
ranked as (select * from scoped where task <> 'box'),
cohort as (
  select category, run_id from ranked join required using (category, task)
  group by category, run_id
  having bool_and(provenance = 'measured')
     and count(*) filter (status = 'complete' and provenance = 'measured')
       = (select sum(required) from required q
          where q.category = ranked.category and q.task <> 'box')),
entries as (
  select r.category, r.run_id, r.benchmark_id, r.baseline_adjusted_score v, r.eligible
  from ranked r join cohort c on c.category = r.category and c.run_id = r.run_id
  join task_avg t on t.category = r.category and t.run_id = r.run_id
  where t.task_avg is not null),
points as (
  select category, run_id, benchmark_id, v,
         rank() over (partition by category, benchmark_id order by v desc)
           + (count(*) over (partition by category, benchmark_id, v) - 1)
             / cast(2 as double) r,
         count(v) over (partition by category, benchmark_id) n
  from entries),
borda as (
  select category, run_id,
         case when (select count(distinct run_id) >= 2 and bool_and(eligible and v is not null)
                    from entries e where e.category = points.category)
              then avg((n - r) / (n - 1)) end borda
  from points group by category, run_id)
"""


def sql(body: str) -> str:
    """A complete statement over the testbed tables."""
    return f"with {PRELUDE.strip()}\n{body.strip()}"
