"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams of 3 to 5 characters (code points) inside its distinct words (A-Z
lower-cased, with a space before and after), hashed into `BUCKETS` buckets; a word counts once however often it stands. Each feature
is scaled by the log ratio of its smoothed frequencies in toxic and clean texts, and a logistic
regression is fitted to the scaled features. The score of a text is a sum over its distinct words, so
a task computes a word once and looks it up from then on.

The classifier is fitted on at most `PER_CLASS` labelled texts of each class, those with the
smallest hash of the id, and on at most `SAMPLE_BYTES` of their texts in that order (the first is
whole, however long); its intercept is then moved to the classes' true shares. Null and
empty texts get the score of a text without features. Without labels of both classes the score is 0.
Labels whose id no document has, or that are null, are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.tables import small
from gridloom.llm.words import LOWER, Bytes, add_columns, byte_class, column, own_store, slices

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
#: Bound of the training sample: labelled texts of each class.
PER_CLASS = 2500
#: And bytes of their texts, which the driver reads.
SAMPLE_BYTES = 64 << 20
SMOOTHING, DECAY, STEPS, RATE = 1.0, 0.03, 200, 0.04
#: Words whose score a task keeps; when they are more, it starts anew.
STORE = 1_000_000
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Bytes]:
    """(document, word) of each document's distinct words, as indexes into the slice's distinct
    words; the hashes of these; and their bytes with a space before and after."""
    b = Bytes(texts, LOWER)
    start, end, doc = b.runs(WORD)
    h, first, word = np.unique(b.hashes(start, end), return_index=True, return_inverse=True)
    pair = np.unique(doc * (len(h) + 1) + word)
    size = (end - start)[first]
    offs = np.concatenate([[0], np.cumsum(size + 2)])
    buf = np.full(offs[-1], 32, dtype=np.uint8)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    buf[np.repeat(offs[:-1] + 1, size) + within] = b.data[np.repeat(start[first], size) + within]
    own = Bytes(pa.array([], pa.binary()))
    own.n, own.raw, own.data, own.offs = len(h), buf, buf, offs
    return pair // (len(h) + 1), pair % (len(h) + 1), h, own


def word_features(own: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all n-grams of the words."""
    words, buckets = [], []
    start = np.flatnonzero((own.data & 0xC0) != 0x80)  # of characters
    end = np.append(start[1:], len(own.data))
    word = np.searchsorted(own.offs, start, side="right") - 1
    for n in SIZES:
        at = np.arange(max(0, len(start) - n + 1))
        at = at[word[at] == word[at + n - 1]]
        words.append(word[at])
        buckets.append((own.hashes(start[at], end[at + n - 1]) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(words), np.concatenate(buckets)


def fit(texts: pa.Array, toxic: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """(weight of each bucket, intercept); `share` is the true share of toxic texts."""
    table, docs, words, done = pa.record_batch([texts], names=["text"]), [], [], 0
    for part in slices(table, "text"):
        d, w, h, _ = distinct_words(column(part, "text"))
        docs.append(d + done)
        words.append(h[w])
        done += part.num_rows
    doc, (vocabulary, word, df) = np.concatenate(docs), np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
    # features of each word once; words of one text alone say nothing of others
    open_, pairs = vocabulary[df > 1], []
    for part in slices(table, "text"):
        _, _, h, own = distinct_words(column(part, "text"))
        new = np.isin(h, open_)
        open_ = open_[~np.isin(open_, h)]
        gw, gb = word_features(own)
        keep = new[gw]
        pairs.append(np.unique(np.searchsorted(vocabulary, h)[gw[keep]] * BUCKETS + gb[keep]))
    pair = np.concatenate(pairs)
    gw, gb = pair // BUCKETS, pair % BUCKETS
    used, gb = np.unique(gb, return_inverse=True)

    def by_bucket(x: np.ndarray) -> np.ndarray:
        each = np.bincount(word, weights=x[doc], minlength=len(vocabulary))
        return np.bincount(gb, weights=each[gw], minlength=len(used))

    p, q = by_bucket(toxic.astype(float)) + SMOOTHING, by_bucket(1.0 - toxic) + SMOOTHING
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    w, b, m, v = np.zeros(len(used)), 0.0, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        each = np.bincount(gw, weights=(w * ratio)[gb], minlength=len(vocabulary))
        z = b + np.bincount(doc, weights=each[word], minlength=len(toxic))
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / len(toxic)
        g = np.append(by_bucket(miss) * ratio + DECAY * w, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weight = np.zeros(BUCKETS)
    weight[used] = w * ratio
    own = toxic.mean()
    return weight, float(b + np.log(share / (1 - share)) - np.log(own / (1 - own)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> tuple[np.ndarray, float] | None:
    """The classifier, from a bounded sample of labelled texts; None without texts of both classes."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    count = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(count) < 2:
        return None
    order = [F.xxhash64("id"), "id"]
    ids = known.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(known.where("toxic = 0").orderBy(*order).limit(per_class))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small(ids), "id").select("id", "toxic", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))
    upto = Window.orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, -1)  # over the sample alone
    bounded = rows.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).where((F.col("before") + F.col("size") <= SAMPLE_BYTES) | (F.col("before") == 0))
    rows = bounded.select("id", "toxic", "text").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    toxic = rows.column("toxic").to_numpy().astype(float)
    if len(set(toxic)) < 2:
        return None
    return fit(rows.column("text").combine_chunks(), toxic, count[1] / (count[0] + count[1]))


def word_scores(own: Bytes, weight: np.ndarray) -> np.ndarray:
    """Scores of the words whose bytes are `own`; an n-gram counts once in a word."""
    gw, gb = word_features(own)
    pair = np.unique(gw * BUCKETS + gb)
    return np.bincount(pair // BUCKETS, weights=weight[pair % BUCKETS], minlength=own.n)


def some_words(own: Bytes, which: np.ndarray) -> Bytes:
    """The chosen words' bytes alone."""
    part, size = Bytes(pa.array([], pa.binary())), np.diff(own.offs)[which]
    part.n, part.offs = len(which), np.concatenate([[0], np.cumsum(size)])
    within = np.arange(size.sum()) - np.repeat(part.offs[:-1], size)
    part.raw = part.data = own.data[np.repeat(own.offs[which], size) + within]
    return part


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on); columns with these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex  # of this model, for the workers' stores

    def fn(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        if shared.value is None:
            return {"score": np.zeros(batch.num_rows), "predicted": np.zeros(batch.num_rows, np.int32)}
        weight, b = shared.value
        doc, word, h, own = distinct_words(column(batch, text_col))
        store = own_store(name, STORE)
        each, missing = store.get(h, 1)
        if len(missing):
            each[missing, 0] = word_scores(some_words(own, missing), weight)
            store.put(h[missing], each[missing])
        z = b + np.bincount(doc, weights=each[word, 0], minlength=batch.num_rows)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return {"score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return add_columns(docs, text_col, {"score": "double", "predicted": "int"}, fn)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels aren't learnt from: crc32 of the id as text is 0 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs, learn(docs, labels.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "score", "predicted")
