"""Writers of gridded tables, and the metric documents of model runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), tile: int | None = None, codec: str = "zstd") -> None:
    """Parquet, overwritten. With `tile`, rows are dealt by square tiles first, so that a cell's
    history is in one file; with `by`, by these columns' folders."""
    if tile:
        df = df.repartition(F.floor(F.col("row") / tile), F.floor(F.col("col") / tile))
    df.write.mode("overwrite").option("compression", codec).partitionBy(*by).parquet(path)


def unpivoted(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("row", "col", "year")) -> DataFrame:
    """(keys, variable, value)."""
    return df.unpivot(list(keys), list(variables), "variable", "value")


def layer_name(template: str) -> Column:
    """The template with a row's variable and year."""
    named = F.lit(template)
    for c in ("variable", "year"):
        named = F.replace(named, F.lit("{" + c + "}"), F.col(c).cast("string"))
    return named


def export_layers(df: DataFrame, variables: Sequence[str], path: str, template: str = "{variable}_{year}") -> None:
    """One Parquet folder for each variable and year, named by the template (raster files: `sources.geotiff`)."""
    unpivoted(df, variables).withColumn("layer", layer_name(template)).repartition("layer").write.mode("overwrite").partitionBy("layer").parquet(path)


def recompress(spark: SparkSession, source: str, target: str, codec: str = "zstd", files: int | None = None) -> None:
    """A copy with another compression and number of files."""
    df = spark.read.parquet(source)
    (df.repartition(files) if files else df).write.mode("overwrite").option("compression", codec).parquet(target)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(year, run, r2, rmse) of documents {year, r2: [...], rmse: [...]}, one JSON object each."""
    docs = spark.read.schema("year int, r2 array<double>, rmse array<double>").option("multiLine", True).json(path)
    return exploded_metrics(docs)


def exploded_metrics(docs: DataFrame) -> DataFrame:
    each = docs.select("year", F.posexplode(F.arrays_zip("r2", "rmse")).alias("run", "m"))
    return each.select("year", "run", "m.r2", "m.rmse")
