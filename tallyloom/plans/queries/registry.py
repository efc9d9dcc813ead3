"""Name -> callable, name -> SQL, name -> survey items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.oracle import sql
from tallyloom.plans.testbed import Testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SURVEY: dict[str, str] = {}

DIGITS = 6


def query(name: str, survey: str, oracle: str | None = None):
    """Register a function of the testbed; `oracle` is the body after the shared CTEs."""

    def register(build: Callable[[Testbed], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"Query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Testbed(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        SURVEY[name] = survey
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return build

    return register


def r6(name: str, alias: str | None = None) -> Column:
    return F.round(F.col(name), DIGITS).alias(alias or name)
