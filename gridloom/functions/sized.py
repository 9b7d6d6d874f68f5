"""Joins with sides of a checked size, and tables that plans are cut at."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers up to which a side is broadcast.
BROADCAST_ROWS = 500_000

_own: list[str] = []


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; else left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='gridloom-')}")
    return _own[0]


def stored(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df, written to the shared folder (in folders of `by`) and read again."""
    path = f"{shared_dir(df.sparkSession)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
