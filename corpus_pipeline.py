"""A corpus from raw documents to packed training bins.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of `docs`, whatever
these are called; columns with the names of an operator's results keep their values:

1. language_id: documents whose language can't be told (no text, no letter, or a posterior below
   `LEAST_SCORE`) go. The model learns from the labelled rows of its input.
2. near_dedup: of each group of linked texts one row stays, that with the smallest id (a row
   with an id before one without). Each row is judged by its own text, so that an id with two
   texts may keep one of them; of equal rows (id and text) one stays.
3. decontaminate: documents that hold a window of the benchmark go.
4. pii: personal data gets surrogates (key: the session's gridloom.pii.key, else a new one);
   n_chars follows the new text.
5. packing: the documents' pieces with their text, their tokens and their bins of `BIN_TOKENS`
   tokens. Equal texts and equal sources don't share a bin.

Null and empty texts go in the first stage; empty tables give empty results. SQL can express
neither the first nor the last two stages; tests/llm/test_tables.py holds all five against
brute-force versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, language_id, near_dedup, packing, pii
from gridloom.llm.tables import drop, free_names, save, shared_dir, small

LEAST_SCORE = 0.5
BIN_TOKENS = 4096


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns of these names renamed, and how they are called then."""
    clash = [c for c in docs.columns if c.lower() in names]
    renamed = dict(zip(clash, free_names(docs, *clash), strict=True))
    return docs.withColumnsRenamed(renamed), renamed


def _back(found: DataFrame, docs: DataFrame, renamed: dict[str, str]) -> DataFrame:
    """The columns of docs, as they were."""
    return found.select(*[F.col(f"`{renamed.get(c, c)}`").alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, renamed = _aside(docs, "lang_pred", "score")
    found = language_id.detect(rows, language_id.learn(docs.where(~language_id.held_out())))
    return _back(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs, renamed)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    found = save(near_dedup.near_duplicates(docs.select(key.alias("key"), "text", "doc_id"), "key", "text", ["doc_id"]).select("key", "component_id", "doc_id"), "row-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"]
    many = found.groupBy("component_id").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = save(found.join(many, "component_id").where("key <> first").select("key").distinct(), "gone")
    repeated = save(found.groupBy("key").count().where("count > 1").select("key"), "repeated")
    drop(found)
    (own,) = free_names(docs, "key")
    kept = docs.withColumn(own, key).join(small(gone.withColumnRenamed("key", own)), own, "left_anti")
    again = repeated.join(gone, "key", "left_anti").withColumnRenamed("key", own)
    if not again.isEmpty():
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0)))  # maps have no order, their JSON has one
        one = kept.join(small(again), own, "left_semi").groupBy(own).agg(F.min_by(whole, others).alias("whole")).select("whole.*")
        return kept.join(small(again), own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, renamed = _aside(docs, "n_words", "hits", "spans", "items")
    found = decontaminate.find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _back(found.where(F.size("hits") == 0), docs, renamed)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (count,) = free_names(docs, "n_entities")
    new = pii.pseudonymise(docs, pii.session_key(spark), count_col=count)
    if "n_chars" in docs.columns:
        changed = F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        new = new.withColumn("n_chars", changed)
    return _back(new, docs, {})


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, capacity=BIN_TOKENS, tokens=True, with_text=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on the table `documents`, each written to the shared folder; a
    stage's table goes when the next one stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_dir(spark)}/gridloom/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        docs.stored_at = path
        if before is not None:
            drop(before)
        before = docs
    return docs
