"""Evaluation tables: errors, confusion, importances, densities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.names import feature_parts
from gridloom.functions.sized import small

PAIR = ("train_year", "eval_year")


def split_membership(samples: DataFrame) -> DataFrame:
    """For each (year, fold) split: rows to train on (same year, another fold) and to test on (the
    fold, all years). Counts come from the (year, fold) sizes; samples are not repeated."""
    size = samples.groupBy("year", "fold").count()
    by_year = size.groupBy("year").agg(F.sum("count").alias("in_year"))
    by_fold = size.groupBy("fold").agg(F.sum("count").alias("n_test"))
    splits = by_year.join(small(by_fold), how="cross")
    own = splits.join(size, ["year", "fold"], "left")
    return own.select("year", "fold", (F.col("in_year") - F.coalesce("count", F.lit(0))).alias("n_train"), "n_test")


def dense_predictions(predictions: DataFrame) -> DataFrame:
    """(train_year, eval_year, id) for all combinations of known values, absent ones as 0. For
    small tables; `performance_matrix` counts absent ones without making them."""
    train, evals, ids = (predictions.select(c).distinct() for c in ("train_year", "eval_year", "id"))
    frame = ids.join(small(train), how="cross").join(small(evals), how="cross")
    both = frame.join(predictions, [*PAIR, "id"], "left")
    return both.select(*PAIR, "id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("prediction", "target")])


def performance_matrix(predictions: DataFrame, dense: bool = False, keys: Sequence[str] = PAIR) -> DataFrame:
    """(keys, n, r2, rmse). A constant target has r2 1 if met exactly, else 0. With `dense`, ids
    that a pair of years lacks count as predictions of 0 for 0."""
    p, t = F.col("prediction"), F.col("target")
    g = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((t - p) * (t - p)).alias("sse"), F.sum(t).alias("st"), F.sum(t * t).alias("stt"))
    if dense:
        n_ids = predictions.select("id").distinct().agg(F.count("id").alias("n_ids"))
        g = g.join(F.broadcast(n_ids), how="cross").withColumn("n", F.col("n_ids")).drop("n_ids")
    around = F.col("stt") - F.col("st") * F.col("st") / F.col("n")
    flat = around <= 1e-9 * F.greatest(F.col("stt"), F.lit(1e-300))
    r2 = F.when(flat, F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("sse") / around)
    return g.select(*keys, "n", r2.alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def masked_r2(r2: Column) -> Column:
    """-1 where the model is younger than the year it is held against; -1 and below are not shown."""
    shown = F.when(F.col("train_year") > F.col("eval_year"), F.lit(-1.0)).otherwise(r2)
    return F.when(shown > -1, shown)


def importance_summary(importances: DataFrame, year: int | None = None, low: float = 10**-3.5, high: float = 0.03) -> DataFrame:
    """(index, span, lag, importance): the median over all models, or over the folds of one year,
    kept within [low, high]. Features with other names have no index."""
    rows = importances if year is None else importances.where(F.col("train_year") == year)
    index, span, lag = feature_parts(F.col("feature"))
    m = rows.groupBy("feature").agg(F.median("importance").alias("m"))
    return m.select("feature", index.alias("index"), span.alias("span"), lag.alias("lag"), F.greatest(F.lit(low), F.least(F.lit(high), F.col("m"))).alias("importance"))


def importance_matrix(summary: DataFrame, lags: Sequence[int]) -> DataFrame:
    """One row for each index and span, one column for each lag."""
    return summary.where(F.col("index").isNotNull()).groupBy("index", "span").pivot("lag", list(lags)).agg(F.first("importance")).withColumnsRenamed({str(k): f"lag{k}" for k in lags})


def confusion(df: DataFrame, labels: Sequence[int] = (1, 2, 3, 4, 5), truth: str = "target", guess: str = "prediction") -> DataFrame:
    """(truth, guess, share) for all pairs of labels; shares of all rows with labels."""
    spark = df.sparkSession
    frame = spark.createDataFrame([(a, b) for a in labels for b in labels], "truth int, guess int")
    n = df.groupBy(F.col(truth).cast("int").alias("truth"), F.col(guess).cast("int").alias("guess")).count()
    both = F.broadcast(frame).join(n, ["truth", "guess"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = F.sum("count").over(Window.partitionBy())
    return both.select("truth", "guess", F.when(total > 0, F.col("count") / total).otherwise(0.0).alias("share"))


def balanced_accuracy(df: DataFrame, by: Sequence[str] = (), truth: str = "target", guess: str = "prediction") -> DataFrame:
    """Mean recall over the classes in the truth, adjusted for chance: 0 is guessing, 1 perfect."""
    recall = df.groupBy(*by, truth).agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("r"))
    g = recall.groupBy(*by).agg(F.avg("r").alias("s"), F.count(F.lit(1)).alias("k"))
    return g.select(*by, F.when(F.col("k") > 1, (F.col("s") - 1 / F.col("k")) / (1 - 1 / F.col("k"))).alias("balanced_accuracy"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin from 0, n, cumulative_share): equal bins, the last one closed; values outside are
    left out; empty bins are there."""
    width = (high - low) / bins
    v = F.col(value)
    at = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")
    n = df.where(v.between(low, high)).groupBy(at.alias("bin")).count()
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    both = frame.join(F.broadcast(n), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("cumulative_share", F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy()))


def with_slices(rows: DataFrame, slices: int) -> DataFrame:
    """rows with __slice: the number of the year's id quantiles (of as many as slices) below the id."""
    shares = [k / slices for k in range(1, slices)]
    bounds = rows.groupBy("train_year").agg(F.percentile_approx("id", shares, 50 * slices).alias("__bounds"))
    return rows.join(F.broadcast(bounds), "train_year").withColumn("__slice", F.size(F.filter("__bounds", lambda b: b < F.col("id")))).drop("__bounds")  # one row a year


def systematic_sample(predictions: DataFrame, step: int = 1000, slices: int = 256) -> DataFrame:
    """Every step-th id of each model's own year, with the largest value of the year's sample as limit.

    Ids are numbered within slices of about equal numbers of rows (bounds by a quantile sketch of each year's ids),
    plus the sizes of the slices before: no task sorts all ids of a year, whatever their
    distribution. Equal ids follow one another in no order of their own."""
    own = predictions.where("train_year = eval_year")
    own = with_slices(own, slices)
    upto = Window.partitionBy("train_year").orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    sizes = own.groupBy("train_year", "__slice").count().select("train_year", "__slice", (F.sum("count").over(upto) - F.col("count")).alias("__before"))
    w = Window.partitionBy("train_year", "__slice").orderBy("id")
    numbered = own.withColumn("__n", F.row_number().over(w) - 1).join(F.broadcast(sizes), ["train_year", "__slice"])  # years times slices
    own = numbered.where((F.col("__n") + F.col("__before")) % step == 0).drop("__n", "__slice", "__before")
    return own.withColumn("limit", F.max(F.greatest("prediction", "target")).over(Window.partitionBy("train_year")))
