"""Registry of runnable queries, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from creditloom.session import tune
from workload import views


class Inputs:
    """The tables of one scale-factor folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return views.view(self.spark, self.sf_dir, name)

    def sql(self, text: str) -> DataFrame:
        return views.sql(self.spark, self.sf_dir, text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(tune(spark), sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = views.oracle(oracle)
        return fn

    return register


def as_double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def as_money(df: DataFrame, *names: str) -> DataFrame:
    """Exact cents, so that sums do not depend on the order of addition."""
    return df.withColumns({n: F.col(n).cast("decimal(18,2)") for n in names})


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round transcendental or averaged doubles, whose last bits differ between engines."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def r(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits)
