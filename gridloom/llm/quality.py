"""Quality rules: exact repetition and symbol statistics, and a log-likelihood ratio of n-grams.

Word unigrams and bigrams (A-Z lower-cased) are hashed into `BUCKETS` buckets. Two multinomials
over the buckets are counted over whole tables: one over the trusted texts, one over the raw corpus. A text's
score is the mean log ratio of its n-grams; it fails below a fixed threshold. A text
also fails by the base rules: fewer than 20 words, or over 30 % of its words inside eight-word
windows that occur twice or more.

Null and empty texts have no words and fail. Repeated documents count as often as they stand.
A trusted id that no document has is ignored; a trusted id listed twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tables import small
from gridloom.llm.words import LOWER, NOT_SPACE, Bytes, add_columns, byte_class, column, full, ngrams, prepare, slices

BUCKETS = 1 << 16
#: Least mean log ratio (nats for each n-gram) of a text that is kept.
THRESHOLD = -0.4
#: Share of each multinomial that is spread evenly over all buckets.
SMOOTHING = 0.1
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
NOT_LF = ~byte_class((0x0A, 0x0A))


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of all word unigrams and bigrams."""
    b = Bytes(texts, LOWER)
    start, end, doc = b.runs(NOT_SPACE)
    h = b.hashes(start, end)
    ok = full(doc, 2)
    docs = np.concatenate([doc, doc[: len(ok)][ok]])
    return docs, (np.concatenate([h, ngrams(h, doc, 2)[ok]]) % np.uint64(BUCKETS)).astype(np.int64)


def learn(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio for each bucket of the trusted multinomial to that of all docs. The ids of
    trusted texts are broadcast if they are few, else joined by a shuffle."""
    ids = trusted.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().withColumn("trusted", F.lit(True))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small(ids), "id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                doc, bucket = _buckets(column(part, "text"))
                raw += np.bincount(bucket, minlength=BUCKETS)
                good = np.asarray(column(part, "trusted"))
                target += np.bincount(bucket[good[doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    prepare(docs.sparkSession)
    got = rows.mapInArrow(run, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    out, at = [], got.column("bucket").to_numpy()
    for name in ("target", "raw"):
        count = np.zeros(BUCKETS)
        count[at] = got.column(name).to_numpy()
        out.append(np.log((1 - SMOOTHING) * count / max(1.0, count.sum()) + SMOOTHING / BUCKETS))
    return out[0] - out[1]


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base statistics of each text."""
    b = Bytes(texts)
    start, end, doc = b.runs(NOT_SPACE)
    n_words = np.bincount(doc, minlength=b.n)
    chars = b.chars_before()
    word_chars = np.bincount(doc, weights=(chars[end] - chars[start]).astype(float), minlength=b.n).astype(np.int64)
    sym = np.concatenate([[0], np.cumsum(SYMBOL[b.raw])])
    # lines with a word that equal an earlier one of the text
    ls, le, ld = b.runs(NOT_LF)
    worded = np.searchsorted(start, le) > np.searchsorted(start, ls)
    ls, le, ld = ls[worded], le[worded], ld[worded]
    repeats = np.zeros(b.n, np.int64)
    _, again = _groups(ld, b.hashes(ls, le))
    repeats += np.bincount(ld[again], minlength=b.n)
    # words inside windows that occur twice or more
    h = b.hashes(start, end)
    ok = np.flatnonzero(full(doc, REPEAT_WINDOW))
    twice, _ = _groups(doc[ok], ngrams(h, doc, REPEAT_WINDOW)[ok])
    edge = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, ok[twice], 1)
    np.add.at(edge, ok[twice] + REPEAT_WINDOW, -1)
    inside = np.cumsum(edge)[:-1] > 0
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": sym[b.offs[1:]] - sym[b.offs[:-1]],
        "n_dup_lines": repeats,
        "n_repeat_words": np.bincount(doc[inside], minlength=b.n),
    }


def _groups(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether an entry's value occurs twice or more in its document, whether it is not the first)."""
    twice, again = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    order = np.lexsort((h, doc))  # stable: the earlier entry first
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, again


def judge(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base statistics, llr (mean log ratio, 0 without words), base_failed and kept;
    columns with these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def fn(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        texts, n = column(batch, text_col), batch.num_rows
        out = statistics(texts)
        doc, bucket = _buckets(texts)
        count = np.bincount(doc, minlength=n)
        out["llr"] = np.bincount(doc, weights=shared.value[bucket], minlength=n) / np.maximum(count, 1)
        out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
        out["kept"] = ~out["base_failed"] & (out["llr"] >= threshold)
        return out

    out = {c: "bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return add_columns(docs, text_col, out | {"llr": "double", "base_failed": "boolean", "kept": "boolean"}, fn)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]
    return judge(docs, learn(docs, trusted)).select(*names)
