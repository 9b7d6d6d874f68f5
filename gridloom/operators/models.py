"""Forest models: training grid, scoring, posterior quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.missing import clamp_infinity
from gridloom.functions.sized import small, stored
from gridloom.operators.features import RANGES, complete_rows, positive_targets, severity_midpoint
from gridloom.operators.forests import Forest, extra_trees, from_spark, score, with_prediction
from gridloom.operators.select import distinct_splits


def assembled(df: DataFrame, features: Sequence[str], fill: float | None = None, keep: bool = False) -> DataFrame:
    """df with the vector `features`. Rows with a missing feature go, or with `keep` stay, with NaN
    in the vector. With `fill`, infinities are clamped in the vector alone."""
    plain = {f: f"__f{i}" for i, f in enumerate(features)}
    value = lambda f: F.col(f"`{f}`").cast("double")
    rows = df if keep else df.where(complete_rows(features))
    wide = rows.withColumns({v: value(k) if fill is None else clamp_infinity(value(k), fill) for k, v in plain.items()})
    return VectorAssembler(inputCols=list(plain.values()), outputCol="features", handleInvalid="keep").transform(wide).drop(*plain.values())


def regressor(seed: int = 0, trees: int = 100, depth: int = 5) -> RandomForestRegressor:
    """All features may be tried at each split."""
    return RandomForestRegressor(labelCol="target", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)


def feature_array(features: Sequence[str], fill: float | None = None) -> Column:
    """The features as one array, infinities clamped; null where one is missing."""
    value = lambda f: F.col(f"`{f}`").cast("double")
    return F.when(complete_rows(features), F.array(*[value(f) if fill is None else clamp_infinity(value(f), fill) for f in features]))


def fold_grid(table: DataFrame, features: Sequence[str], fill: float = 100.0, trees: int = 100, threads: int = 4, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(predictions, importances) of one regressor for each (year, fold): trained on the year's other
    folds, applied to all years of the fold. A few models train at a time, on their year's files of the
    stored table; all of them then score their folds in one pass over it."""
    ready = table.where(complete_rows(features)).select("id", "fold", "year", F.col("target").cast("double").alias("target"), feature_array(features, fill).alias("x"))
    ready = stored(ready, "fold-grid", ["year"])
    vectors = ready.select("year", "fold", "target", array_to_vector("x").alias("features"))
    splits = [tuple(r) for r in distinct_splits(ready).collect()]

    def one(split: tuple[int, int]) -> tuple[int, int, Forest, list[float]] | None:
        year, fold = split
        train = vectors.where((F.col("year") == year) & (F.col("fold") != fold))
        if train.isEmpty():
            return None
        model = regressor(seed, trees).fit(train)
        return year, fold, from_spark(model, features), model.featureImportances.toArray().tolist()

    with ThreadPoolExecutor(threads) as pool:
        done = [r for r in pool.map(one, splits) if r]
    if not done:
        raise ValueError("no split has rows to train on")
    by_fold: dict[int, list] = {}
    for year, fold, forest, _ in done:
        by_fold.setdefault(fold, []).append((year, forest))
    predictions = score(ready, by_fold, ["year", "fold", "id", "target"], "fold", "train_year").withColumnRenamed("year", "eval_year")
    rows = [(year, fold, f, v) for year, fold, _, own in done for f, v in zip(features, own, strict=True)]
    return predictions.select("train_year", "eval_year", "fold", "id", "prediction", "target"), table.sparkSession.createDataFrame(rows, "train_year int, fold int, feature string, importance double")


def fit_year(table: DataFrame, features: Sequence[str], year: int, fill: float = 100.0, trees: int = 100) -> PipelineModel:
    """The final regressor, from one year's rows."""
    rows = assembled(table.where(F.col("year") == year), features, fill)
    return Pipeline(stages=[regressor(trees=trees)]).fit(rows)


def _severity_rows(table: DataFrame, features: Sequence[str], fill: float, classes: bool = True) -> DataFrame:
    """(key, year, id, target, features) of positive codes and complete features; the key is of id and year."""
    rows = positive_targets(table).where(complete_rows(features))
    target = F.col("target") if classes else severity_midpoint(F.col("target"))
    clamped = [clamp_infinity(F.col(f"`{f}`").cast("double"), fill).alias(f) for f in features]
    return rows.select((F.col("id") * 10_000 + F.col("year")).alias("key"), F.col("year").alias("__year"), F.col("id").alias("__id"), target.cast("double").alias("__target"), *clamped)


def fit_severity(table: DataFrame, features: Sequence[str], classes: bool = True, fill: float = 100.0, trees: int = 100, seed: int = 0) -> tuple[Forest, dict]:
    """(extremely randomised trees, {features, ranges}): of positive codes, for the classes or for their midpoints."""
    rows = _severity_rows(table, features, fill, classes)
    model = extra_trees(rows, features, classes, trees, seed=seed, target="__target")[None]
    return model, {"features": list(features), "ranges": {str(k): list(v) for k, v in RANGES.items()}}


def class_weights(rows: DataFrame, target: str = "target") -> DataFrame:
    """rows with weight n / (k n_c), so that all classes weigh alike."""
    n = rows.groupBy(target).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    return rows.join(small(n), target).join(F.broadcast(total), how="cross").withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def leave_year_out(table: DataFrame, features: Sequence[str], fill: float = 10.0, trees: int = 100, seed: int = 0) -> DataFrame:
    """(year, id, target, prediction): each year's classes by extremely randomised trees of all other years,
    balanced in each tree's bootstrap. All years' models grow together and score in one pass."""
    rows = _severity_rows(table, features, fill)
    kept = rows.select("key", F.col("__year").cast("int").alias("__year"), "__id", "__target", feature_array(features).alias("x"), *[f"`{f}`" for f in features])
    kept = stored(kept, "leave-year-out")
    if kept.isEmpty():
        raise ValueError("no row has a positive target")
    grown = extra_trees(kept, features, True, trees, seed=seed, balanced=True, hold_out="__year", target="__target")
    scored = score(kept, {year: [(year, forest)] for year, forest in grown.items()}, ["__year", "__id", "__target"], "__year", "model")
    return scored.select(F.col("__year").alias("year"), F.col("__id").alias("id"), F.col("__target").alias("target"), "prediction")


def apply_model(model: PipelineModel | Forest, table: DataFrame, features: Sequence[str], years: tuple[int, int], name: str = "prediction", fill: float = 100.0, probability: str | None = None) -> DataFrame:
    """table's rows of the years [start, end) with the prediction, missing where a feature is; one
    pass, without a shuffle. A column with the prediction's name is replaced. `probability` names a column
    for a forest's class probabilities."""
    kept = [c for c in table.columns if c.lower() not in (name.lower(), "prediction", "features", "rawprediction", "probability", (probability or name).lower())]
    rows = table.where((F.col("year") >= years[0]) & (F.col("year") < years[1]))
    if isinstance(model, Forest):
        if "x" in kept:
            raise ValueError("a forest's table may not have a column x")
        return with_prediction(model, rows.select(*[F.col(f"`{c}`") for c in kept], feature_array(features, fill).alias("x")), name, probability)
    scored = model.transform(assembled(rows.select(*[F.col(f"`{c}`") for c in kept]), features, fill, keep=True))
    return scored.select(*[F.col(f"`{c}`") for c in kept], F.when(complete_rows(features), F.col("prediction")).alias(name))


def posterior_quantile(probabilities: Column, ranges: Sequence[tuple[float, float]], q: float = 0.5) -> Column:
    """The q-quantile of a percentage whose class has the given probabilities, evenly spread
    within a class's range: the first class where the running sum reaches q, and linear inside it."""
    running = F.transform(F.sequence(F.lit(1), F.size(probabilities)), lambda i: F.aggregate(F.slice(probabilities, 1, i), F.lit(0.0), lambda s, x: s + x))
    bounds = F.array(*[F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for lo, hi in ranges])
    parts = F.arrays_zip(probabilities.alias("p"), running.alias("c"), bounds.alias("b"))
    named = F.transform(parts, lambda x: F.struct(x["p"].alias("p"), x["c"].alias("c"), x["b"]["lo"].alias("lo"), x["b"]["hi"].alias("hi")))
    hit = F.element_at(F.filter(named, lambda x: (x["c"] >= q - 1e-12) & (x["p"] > 0)), 1)
    return hit["lo"] + (hit["hi"] - hit["lo"]) * (F.lit(q) - (hit["c"] - hit["p"])) / hit["p"]
