"""Hot days: from hourly temperatures to the yearly share of unusually hot days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.sized import small
from gridloom.operators.select import year_range

CELL = ("latitude", "longitude")


def daily_statistics(hourly: DataFrame, years: tuple[int, int], value: str = "t2m", keys: Sequence[str] = CELL, leap_from_data: bool = False) -> DataFrame:
    """(keys, year, dayofyear 1..365, max, min): a reading belongs to the day that ends with it,
    so midnight belongs to the day before. In leap years 29 February goes and later days move up.

    Leap years are the calendar's; with `leap_from_data`, those with more than 365 days in the data.
    """
    time = F.col("time") - F.expr("INTERVAL 1 MINUTE")
    t = hourly.select(*keys, F.col(value), F.year(time).alias("year"), F.dayofyear(time).alias("doy")).where(F.col("year").between(*years))
    if leap_from_data:
        long = t.select("year", "doy").distinct().groupBy("year").count().where(F.col("count") > 365).select("year", F.lit(True).alias("leap"))
        t = t.join(small(long), "year", "left").withColumn("leap", F.coalesce("leap", F.lit(False)))
    else:
        y = F.col("year")
        t = t.withColumn("leap", ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0))
    day = F.col("doy") - (F.col("leap") & (F.col("doy") > 60)).cast("int")
    t = t.where(~(F.col("leap") & (F.col("doy") == 60))).withColumn("dayofyear", day)
    return t.groupBy(*keys, "year", "dayofyear").agg(F.max(value).alias(f"{value}_max"), F.min(value).alias(f"{value}_min"))


def climatology(daily: DataFrame, years: tuple[int, int], value: str = "t2m_max", q: float = 0.9, keys: Sequence[str] = CELL) -> DataFrame:
    """(keys, dayofyear, normal, high): mean and quantile over the reference years, in one pass."""
    ref = year_range(daily, *years)
    return ref.groupBy(*keys, "dayofyear").agg(F.avg(value).alias("normal"), F.percentile(value, F.lit(q)).alias("high"))


def with_climatology(daily: DataFrame, normals: DataFrame, years: tuple[int, int], keys: Sequence[str] = CELL) -> DataFrame:
    """Focal days with their day's climatology, missing where there is none."""
    return year_range(daily, *years).join(normals, [*keys, "dayofyear"], "left")


def hot_day_fraction(days: DataFrame, excess: float = 5.0, value: str = "t2m_max", keys: Sequence[str] = CELL) -> DataFrame:
    """(keys, year, fraction_hot_days): the share of days above the normal by more than `excess`
    and above the quantile. A day that can't be compared counts as not hot."""
    hot = (F.col(value) - F.col("normal") > excess) & (F.col(value) > F.col("high"))
    return days.groupBy(*keys, "year").agg(F.avg(F.coalesce(hot, F.lit(False)).cast("double")).alias("fraction_hot_days"))


def heat_index(hourly: DataFrame, reference_years: tuple[int, int], focal_years: tuple[int, int], value: str = "t2m", excess: float = 5.0, q: float = 0.9, keys: Sequence[str] = CELL) -> DataFrame:
    """The whole chain. The daily table is dealt by cell once, so that climatology, join and
    yearly share need no further shuffle."""
    span = (min(reference_years[0], focal_years[0]), max(reference_years[1], focal_years[1]))
    daily = daily_statistics(hourly, span, value, keys).repartition(*keys)
    normals = climatology(daily, reference_years, f"{value}_max", q, keys)
    return hot_day_fraction(with_climatology(daily, normals, focal_years, keys), excess, f"{value}_max", keys)
