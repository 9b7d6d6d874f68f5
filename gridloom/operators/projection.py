"""From projections of several climate models to ensembles and their outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.missing import poison_over, statistic
from gridloom.functions.sized import small
from gridloom.operators.features import survival_share


def labelled(paths_and_frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Members under each other, labelled by their file's base name."""
    out = None
    for path, df in paths_and_frames:
        one = df.withColumn("projection", F.lit(path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("an ensemble needs a member")
    return out


def ensemble(members: DataFrame, specs: Sequence[dict], keys: Sequence[str] = ("row", "col", "year")) -> DataFrame:
    """Statistics across members, missing values left out; specs as in `aggregate_by`."""
    return members.groupBy(*keys).agg(*[statistic(s["statistic"], **s.get("options", {}))(F.col(s["variable"])).alias(s.get("name", s["variable"])) for s in specs])


def accumulated(df: DataFrame, value: str, name: str, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """df with the running sum over years; missing from the first gap on."""
    w = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, poison_over(F.sum, F.col(value), w))


def habitat_survival(df: DataFrame, percent: str, name: str = "survival", keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """df with 100 times the running product of yearly survival; a missing year changes nothing."""
    w = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.product(survival_share(F.col(percent))).over(w), F.lit(1.0)) * 100)


def regional_series(df: DataFrame, value: str, how: str = "median", by: Sequence[str] = ("year",), approximate: bool = False) -> DataFrame:
    """One value a year over all cells. The exact median is found by counts of values in ranges that
    narrow twice, so that no task holds a year's values; `approximate` needs one pass only."""
    if how == "mean":
        return df.groupBy(*by).agg(F.avg(value).alias(value))
    if how != "median":
        raise ValueError("a regional series is a median or a mean")
    if approximate:
        return df.groupBy(*by).agg(F.percentile_approx(value, 0.5, 10_000).alias(value))
    return _exact_median(df, value, list(by))


#: Ranges that a narrowing step counts.
_RANGES = 1 << 16


def _exact_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    v, lo, hi, before = F.col("__v"), F.col("__lo"), F.col("__hi"), F.col("__n") - F.col("count")
    # the middle ranks (one, or two of an even number), each with the range of values that holds it
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    half = F.array_distinct(F.array(F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)))
    ranks = size.select(*by, "__lo", "__hi", F.explode(half).alias("__middle")).withColumn("__k", F.col("__middle"))

    def inside(ranks: DataFrame, part: Column) -> DataFrame:
        """Counts of the ranks' own rows by parts, and the parts that hold the ranks."""
        own = rows.join(small(ranks), by).where(v.between(lo, hi)).groupBy(*by, "__middle", "__k", part.alias("__part"))
        counts = own.agg(F.count(F.lit(1)).alias("count"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        w = Window.partitionBy(*by, "__middle").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
        held = counts.withColumn("__n", F.sum("count").over(w)).where((before <= F.col("__k")) & (F.col("__k") < F.col("__n")))
        return held.select(*by, "__middle", (F.col("__k") - before).alias("__k"), "__lo", "__hi")

    share = F.coalesce((v - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0))
    # infinities are parts of their own at both ends
    part = F.when(v == float("-inf"), -1).when(v == float("inf"), _RANGES).when(share.between(0, 1), F.least(F.floor(share * _RANGES), F.lit(_RANGES - 1))).otherwise(0)
    for _ in range(2):
        ranks = inside(ranks, part)
    exact = inside(ranks, v)
    return exact.groupBy(*by).agg(F.avg("__lo").alias(value))


def predictions_on_grid(grid: DataFrame, predictions: DataFrame, target: str) -> DataFrame:
    """grid with each cell's prediction of the model of its own year, missing where the observed target is."""
    own = predictions.where("train_year = eval_year").select("id", F.col("eval_year").alias("year"), "prediction")
    return grid.join(own, ["id", "year"], "left").withColumn("prediction", F.when(F.col(target).isNotNull(), F.col("prediction")))
