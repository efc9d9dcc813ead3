"""Decision tables derived from the driver's TPC-H-like tables.

The derivations use integer arithmetic and portable SQL expressions only, so another engine
can state the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.scopes import membership
from tallyloom.plans.evaluation import evaluate
from tallyloom.session import ROWS_PER_TASK, pieces, shared_path

RUNS = 6

# Rows of an input table in one task; each becomes up to 2 * RUNS predictions.
SPREAD_ROWS = 50_000

# Where each application keeps the stored tables of a scale-factor folder.
_STORED: dict[tuple[str, str, str], str] = {}

# Disclosed benchmarks: every n-th model names them; the last one is not defined.
EXPOSED = (("quality-en-noul", 2), ("status-F-choice", 3), ("price-9-score", 7))

# Portable expressions over (m, cid, bid).
OUTCOME = (
    "case when (cid * 7 + m * 13) % 97 = 0 then 'abstained' "
    "when m = 5 and cid % 89 = 0 then 'failed' else 'ok' end"
)
RECORDED = "not (m = 3 and bid = 'area-Brand#7-box')"
DATASET = (
    "case bid when 'quality-en-noul' then 'datasets/generalization-text-diverse-noul' "
    "when 'quality-fr-noul' then 'datasets/generalization-text-contextual-noul' "
    "when 'status-F-choice' then 'datasets/generalization-order-diverse-choice' "
    "when 'status-O-choice' then 'datasets/generalization-order-contextual-choice' "
    "when 'price-1-score' then 'datasets/generalization-price-diverse-score' "
    "when 'price-2-score' then 'datasets/generalization-price-contextual-score' "
    "else concat('datasets/', bid) end"
)
QUESTION = {"noul": "quality", "choice": "status", "score": "price", "box": "area"}

_CHOICE_TARGET = """
    case when cid % 9 = 0 then
           case when {pos} = (cid * 7) % k or {pos} = ((cid * 7) % k + 1) % k
                then 0.5D else 0D end
         when {pos} = (cid * 7) % k then 1D else 0D end"""
_SCORE_TARGET = """
    case when cid % 3 = 0 then
           case when {pos} = custkey % 4 then 0.75D
                when {pos} = custkey % 4 + 1 then 0.25D else 0D end
         when {pos} = custkey % 5 then 1D else 0D end"""
_CHOICE_OPTION = (
    "named_struct('id', concat('p', cast(({pos} + custkey) % 5 as string)), "
    "'value', cast(null as double))"
)
_SCORE_OPTION = "named_struct('id', 'l{pos}', 'value', cast(10 * ({pos} + 1) as double))"
_WEIGHT = "1 + (cid * 13 + {pos}L * 29 + m * 7) % 10"


def per_position(template: str, size: str = "k", most: int = 5) -> str:
    """`template` at positions 0..size-1 as an array; unrolled, so that it is compiled."""
    cells = ", ".join(template.replace("{pos}", str(i)) for i in range(most))
    return f"slice(array({cells}), 1, int({size}))"


def weight_total() -> str:
    terms = (f"case when k > {i} then {_WEIGHT.replace('{pos}', str(i))} else 0 end" for i in range(5))
    return " + ".join(terms)


class Testbed:
    """Lazy DataFrames over one scale-factor folder."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, rows: DataFrame, key: str) -> DataFrame:
        """Deal the rows by key over all cores, and over more tasks as the table grows.

        Deriving predictions multiplies rows; a table delivered as one small file would do
        that in one task, and with as many tasks as cores each would hold more the larger the table is.
        """
        cores = self.spark.sparkContext.defaultParallelism
        return rows.repartition(max(cores, pieces(rows, SPREAD_ROWS)), key)

    def pieces_of(self, task: str) -> int:
        """Tasks for the predictions of all runs."""
        table = {"noul": "labels", "box": "part"}.get(task, "orders")
        return pieces(self.table(table), ROWS_PER_TASK // RUNS)

    @cached_property
    def pieces(self) -> int:
        return sum(self.pieces_of(task) for task in QUESTION)

    # --- decisions ------------------------------------------------------------------

    @cached_property
    def noul_base(self) -> DataFrame:
        labelled = self.table("documents").join(self.table("labels"), "doc_id")
        return labelled.selectExpr(
            "concat('quality-', lang, '-noul') bid",
            "doc_id cid",
            "case when doc_id % 5 = 0 then 0.75D else cast(quality as double) end t",
        )

    @cached_property
    def orders_base(self) -> DataFrame:
        needed = self.table("orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
        )
        return self.spread(needed, "o_orderkey").selectExpr(
            "o_orderkey cid",
            "o_custkey custkey",
            "concat('status-', o_orderstatus, '-choice') status_bid",
            "concat('price-', substr(o_orderpriority, 1, 1), '-score') price_bid",
            "2 + o_orderkey % 4 k",
        )

    @cached_property
    def choice_base(self) -> DataFrame:
        return self.orders_base.selectExpr(
            "status_bid bid",
            "cid",
            "k",
            f"{per_position(_CHOICE_OPTION)} options",
            f"{per_position(_CHOICE_TARGET)} t",
        )

    @cached_property
    def score_base(self) -> DataFrame:
        return self.orders_base.selectExpr(
            "price_bid bid",
            "cid",
            "5L k",
            f"{per_position(_SCORE_OPTION, '5')} options",
            f"{per_position(_SCORE_TARGET, '5')} t",
        )

    @cached_property
    def box_base(self) -> DataFrame:
        return self.table("part").selectExpr(
            "concat('area-', p_brand, '-box') bid",
            "p_partkey cid",
            "named_struct("
            "'left', (p_partkey % 50) / 100D, 'top', (p_partkey % 40) / 100D, "
            "'right', (p_partkey % 50 + p_size + 1) / 100D, "
            "'bottom', (p_partkey % 40 + 25) / 100D) target_box",
        )

    def decisions_of(self, task: str) -> DataFrame:
        no_options = "cast(array() as array<struct<id:string,value:double>>)"
        if task == "noul":
            rows = self.noul_base.selectExpr(
                "bid",
                "cid",
                "array(named_struct('id', 'false', 'value', 0D), "
                "named_struct('id', 'true', 'value', 1D)) options",
                "map('false', 1 - t, 'true', t) target",
                "cast(null as struct<left:double,top:double,right:double,bottom:double>) target_box",
            )
        elif task == "box":
            rows = self.box_base.selectExpr(
                "bid",
                "cid",
                f"{no_options} options",
                "cast(null as map<string,double>) target",
                "target_box",
            )
        else:
            base = self.choice_base if task == "choice" else self.score_base
            rows = base.selectExpr(
                "bid",
                "cid",
                "options",
                "map_from_arrays(options.id, t) target",
                "cast(null as struct<left:double,top:double,right:double,bottom:double>) target_box",
            )
        return rows.selectExpr(
            "bid benchmark_id",
            f"{DATASET} dataset",
            "'test' split",
            "cast(cid as string) case_id",
            f"'{QUESTION[task]}' question_id",
            f"'{task}' task",
            "options",
            "target",
            "target_box",
            "cid ordinal",
            "concat('h', cast(cid as string)) input_hash",
        )

    @cached_property
    def decisions(self) -> DataFrame:
        parts = [self.decisions_of(t) for t in QUESTION]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    # --- predictions ----------------------------------------------------------------

    def predictions_of(self, task: str) -> DataFrame:
        base = {
            "noul": self.noul_base,
            "choice": self.choice_base,
            "score": self.score_base,
            "box": self.box_base,
        }[task]
        runs = base.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))))
        runs = runs.withColumn("outcome", F.expr(OUTCOME)).where(RECORDED)
        no_box = "cast(null as struct<left:double,top:double,right:double,bottom:double>)"
        if task == "noul":
            filled = runs.selectExpr(
                "*", "((cid * 31 + m * 17) % 101) / 100D p_true"
            ).selectExpr("*", "map('false', 1 - p_true, 'true', p_true) answer", f"{no_box} moved")
        elif task == "box":
            filled = runs.selectExpr("*", "(m * 3 + cid % 7) / 100D shift").selectExpr(
                "*",
                "cast(null as map<string,double>) answer",
                "named_struct('left', least(1D, target_box.left + shift), "
                "'top', target_box.top, "
                "'right', least(1D, target_box.right + shift), "
                "'bottom', target_box.bottom) moved",
            )
        else:
            filled = (
                runs.selectExpr("*", f"{weight_total()} total")
                .selectExpr(
                    "*",
                    f"map_from_arrays(options.id, {per_position(f'({_WEIGHT}) / total')}) answer",
                    f"{no_box} moved",
                )
            )
        return filled.selectExpr(
            "concat('run-', cast(m as string)) run_id",
            "bid benchmark_id",
            "cast(cid as string) case_id",
            f"'{QUESTION[task]}' question_id",
            "case when outcome = 'ok' then answer end probabilities",
            "case when outcome = 'ok' then moved end box",
            "case when outcome = 'failed' then 'TimeoutError' end error",
            "case when outcome = 'abstained' then "
            "case when cid % 2 = 0 then 'refusal' else 'cannot_determine' end end abstention",
        )

    @cached_property
    def predictions(self) -> DataFrame:
        parts = [self.predictions_of(t) for t in QUESTION]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    # --- dimensions -----------------------------------------------------------------

    @property
    def benchmarks(self) -> DataFrame:
        """Definitions are authored tables: derived and stored once per application."""
        return self._stored("benchmarks", lambda: self._derived_benchmarks())

    @property
    def categories(self) -> DataFrame:
        return self._stored("categories", lambda: self._derived_categories())

    def _derived_benchmarks(self) -> DataFrame:
        return (
            self.decisions.select("benchmark_id", "task", "dataset", "split", "case_id")
            .groupBy("benchmark_id", "task", "dataset", "split")
            .agg(
                # One decision per case and benchmark in every derived table.
                F.count(F.lit(1)).alias("case_count"),
                F.count(F.lit(1)).alias("decision_count"),
            )
            .selectExpr(
                "benchmark_id id",
                "task",
                "dataset",
                "split",
                "case_count",
                "decision_count",
                "case task when 'choice' then 'target_mass_at_prediction' "
                "when 'noul' then 'binary_brier' "
                "when 'score' then 'normalized_expected_score_mae' else 'mean_iou' end "
                "primary_metric",
                "'ordinary' evaluation_family",
            )
        )

    def _derived_categories(self) -> DataFrame:
        listed = self.benchmarks.selectExpr(
            "id",
            "explode(array_compact(array('main-v1', "
            "case when task <> 'box' then 'text-v1' end, "
            "case when startswith(dataset, 'datasets/generalization-') then 'general-v1' end))) "
            "category",
        )
        return listed.groupBy("category").agg(F.array_sort(F.collect_list("id")).alias("b")).select(
            F.col("category").alias("id"),
            F.initcap(F.replace("category", F.lit("-"), F.lit(" "))).alias("name"),
            F.lit("").alias("description"),
            F.col("b").alias("benchmarks"),
        )

    @cached_property
    def members(self) -> DataFrame:
        return membership(self.categories)

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "concat('run-', cast(s_suppkey as string)) run_id",
            "concat('org__', replace(lower(s_name), '#', '-')) model_key",
            "concat('org/', replace(lower(s_name), '#', '-')) model_id",
            "case when s_suppkey = 4 then 'dummy' else 'local' end adapter",
            "case when s_suppkey = 4 then 'demo' else 'measured' end provenance",
        )

    @cached_property
    def models(self) -> DataFrame:
        """Model metadata: one row per supplier, some without counts."""
        return self.table("supplier").selectExpr(
            "concat('run-', cast(s_suppkey as string)) run_id",
            "concat('org__', replace(lower(s_name), '#', '-')) model_key",
            "concat('org/', replace(lower(s_name), '#', '-')) model_id",
            "'local' adapter",
            "case when s_suppkey % 4 <> 3 then s_name end display_name",
            "concat('S', cast(s_suppkey as string)) short_name",
            "case when s_suppkey % 3 <> 2 then (s_suppkey * 370000007) % 41000000000 end "
            "total_params",
            "case when s_suppkey % 3 = 0 then (s_suppkey * 370000007) % 41000000000 "
            "- s_suppkey * 1000 end active_params",
            "case when s_suppkey % 3 = 0 then case when s_suppkey % 2 = 0 then "
            "'non_lookup_parameters_v1' else 'embedding_excluded_parameters_v1' end end "
            "parameter_count_method",
            "s_suppkey suppkey",
        )

    # --- results --------------------------------------------------------------------

    @cached_property
    def lazy_results(self) -> DataFrame:
        return evaluate(self.predictions, self.decisions, self.benchmarks, self.runs, self.pieces)

    @property
    def results(self) -> DataFrame:
        """The stored result table: written to the shared folder once per application.

        Rankings and checks work on saved results; evaluating is a step before them.
        """
        return self._stored("results", lambda: self.lazy_results)

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            path = shared_path(self.spark, name)
            build().write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    @cached_property
    def exposed_models(self) -> DataFrame:
        """Models with disclosure entries; NULL when there are none."""
        relation = (
            "case when suppkey % 5 = 0 then 'evaluation_examples' else 'same_source_family' end"
        )
        entries = ", ".join(
            f"case when suppkey % {every} = 0 then named_struct('benchmark_id', '{bid}', "
            f"'relationship', {relation}, 'registration_source', 'unknown', "
            "'dataset_access', case when suppkey % 11 = 0 then 'leaked' else 'public' end, "
            "'dataset', concat('org/set', cast(suppkey as string)), "
            "'revision', cast(null as string), 'config', 'main', 'split', 'train', "
            "'evidence_url', case when suppkey % 13 = 0 then 'https://u:p@example.com/x' "
            "else 'https://example.com/x' end, 'note', 'declared') end"
            for bid, every in EXPOSED
        )
        listed = self.models.selectExpr("*", f"array_compact(array({entries})) e")
        return listed.selectExpr(
            *self.models.columns, "case when size(e) > 0 then e end training_exposure"
        )

    # --- nested cases ---------------------------------------------------------------

    @cached_property
    def native_cases(self) -> DataFrame:
        """One nested case per order: a status choice and a price score, targets reversed."""
        joined = self.orders_base.selectExpr(
            "*",
            f"{per_position(_CHOICE_TARGET)} ct",
            f"{per_position(_SCORE_TARGET, '5')} st",
            per_position(
                "named_struct('id', concat('p', cast(({pos} + custkey) % 5 as string)), "
                "'description_json', '\"p{pos}\"', 'value', cast(null as double))"
            )
            + " cc",
            per_position(
                "named_struct('id', 'l{pos}', 'description_json', '{\"level\":{pos}}', "
                "'value', cast(10 * ({pos} + 1) as double))",
                "5",
            )
            + " sc",
        )
        decision = (
            "named_struct('id', '{q}', 'kind', 'judgment', 'type', '{t}', 'system_prompt', '', "
            "'instructions_json', '\"Judge {q}.\"', 'criteria', {c}, "
            "'documents', cast(array() as array<string>), 'scoring', cast(null as string))"
        )
        target = (
            "named_struct('decision_id', '{q}', 'kind', 'judgment_distribution', "
            "'annotation_kind', 'soft', 'ids', {c}.id, 'probabilities', {t}, "
            "'metadata_json', '{{}}')"
        )
        return joined.selectExpr(
            "cast(cid as string) case_id",
            "cast(custkey as string) group_id",
            "concat('h', cast(cid as string)) input_hash",
            "'test' split",
            "'en' language",
            "named_struct('state_json', concat('{\"order\":', cast(cid as string), '}'), "
            "'decisions', array("
            + decision.format(q="status", t="choice", c="cc")
            + ", "
            + decision.format(q="price", t="score", c="sc")
            + ")) input",
            "array("
            + target.format(q="price", c="sc", t="st")
            + ", "
            + target.format(q="status", c="cc", t="ct")
            + ") targets",
            "cid",
            "custkey",
            "k",
        )
