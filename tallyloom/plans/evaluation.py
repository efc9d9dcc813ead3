"""From predictions and decisions to stored results and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyloom.operators.baselines import baselines
from tallyloom.operators.leaderboard import borda_scores
from tallyloom.operators.results import key_counts, stored_results
from tallyloom.operators.scoring import adjusted_metrics, score_predictions
from tallyloom.session import cut, pieces


def metric_table(predictions: DataFrame, decisions: DataFrame, count: int | None = None) -> DataFrame:
    """Metrics, baselines and adjusted scores per (run, benchmark), all benchmarks in one job.

    `count` says over how many tasks the predictions are dealt; without it they are counted.
    """
    metrics = score_predictions(predictions, decisions, pieces(predictions) if count is None else count)
    return adjusted_metrics(metrics, baselines(decisions))


def evaluate(
    predictions: DataFrame, decisions: DataFrame, benchmarks: DataFrame, runs: DataFrame, count: int | None = None
) -> DataFrame:
    """The result table: metrics, outcome counts, status and run identity, in one pass."""
    count = pieces(predictions) if count is None else count
    metrics = metric_table(predictions, decisions, count).join(key_counts(predictions, count), ["run_id", "benchmark_id"])
    return stored_results(metrics, benchmarks, runs)


def rank_runs(results: DataFrame, members: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Borda and Task Avg from a result table, stored once so that ties are well defined."""
    return borda_scores(cut(results), members, benchmarks)
