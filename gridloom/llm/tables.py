"""Intermediate tables in the folder that driver and executors share, and size-checked joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from gridloom.functions.sized import BROADCAST_ROWS, shared_dir, small

__all__ = ["BROADCAST_ROWS", "drop", "free_names", "save", "shared_dir", "small"]

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and a lost
    executor costs no more than the tasks that ran on it. While it writes, the session drops
    shuffle files as soon as they have been read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(df: DataFrame) -> None:
    """Removes a table that `save` wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that df doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        new = f"__{name}"
        while new in have:
            new += "_"
        out.append(new)
    return out
