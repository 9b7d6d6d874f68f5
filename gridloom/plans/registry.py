"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.views import for_duckdb, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Inputs:
    """Views and base tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, signed: tuple[str, ...] = ()):
    """Registers a function of Inputs; sql is over the shared views. `signed` columns may round
    to minus zero in DuckDB; Spark's round has no minus zero."""

    def add(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql:
            plain = ", ".join(f'CASE WHEN "{c}" = 0 THEN 0.0E0 ELSE "{c}" END AS "{c}"' for c in signed)
            SQL[name] = f"SELECT * REPLACE ({plain}) FROM ({for_duckdb(sql)}) q" if signed else for_duckdb(sql)
        return fn

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded for comparison: sums differ in their last bits."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in columns})


def r6c(c: Column) -> Column:
    return F.round(c, 6)
