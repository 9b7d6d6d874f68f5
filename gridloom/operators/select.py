"""Choosing rows, cells and splits of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def year_range(df: DataFrame, first: int, last: int, year: str = "year") -> DataFrame:
    """Rows of the years first to last, both included; a row without a year isn't there."""
    return df.where(F.col(year).between(first, last))


def year_slice(df: DataFrame, at: int, year: str = "year") -> DataFrame:
    """One year's map: its rows without the year."""
    return df.where(F.col(year) == at).drop(year)


def present_samples(df: DataFrame, target: str, terrain: Sequence[str]) -> DataFrame:
    """Rows whose target and terrain are all there; other columns may be missing."""
    return df.dropna(subset=[target, *terrain])


def chosen(df: DataFrame, classes: Sequence[float] | None = None, years: Sequence[int] | None = None, target: str = "target", year: str = "year") -> DataFrame:
    """Rows of the listed classes and years; a filter that is None takes all."""
    for column, values in ((target, classes), (year, years)):
        if values is not None:
            df = df.where(F.col(column).isin(*values))
    return df


def distinct_splits(df: DataFrame, columns: Sequence[str] = ("year", "fold")) -> DataFrame:
    """The table's splits, each once and in order."""
    return df.select(*columns).distinct().orderBy(*columns)


def shared_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Keys that both tables have, each once."""
    return left.select(*keys).intersect(right.select(*keys))


def missing_keys(wanted: DataFrame, present: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Keys of `wanted` that `present` lacks, each once."""
    return wanted.select(*keys).distinct().join(present.select(*keys), list(keys), "left_anti")


def in_time_order(df: DataFrame, time: str = "time", keys: Sequence[str] = ("row", "col"), name: str = "position") -> DataFrame:
    """df with each row's place (from 1) in its cell's time order; equal times in no order of their own."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(time)).cast("bigint"))
