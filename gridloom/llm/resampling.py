"""Importance resampling towards a target, with ranks by a distributed radix sort.

Features are the words of a text (runs of digits, letters and non-ASCII characters, A-Z lower-cased),
hashed by crc32 into buckets. Bucket counts of the corpus and of the target give an array of gains
(whole thousandths of a nat, add-one smoothed); a document's weight is the mean of its features' gains,
looked up in that array. A Gumbel number that depends on seed and id alone is added, so that the highest
scores are a sample without replacement with chances in proportion to exp(weight / 1000).

The sample is put in order (score descending, then id ascending) by least-significant-digit radix sort over the
digits of that composite key. Rows stand at positions; a block is a run of positions. A pass counts
(digit, block) pairs, sums the counts before each pair (first over digits, then over the blocks of a
digit), and a row's destination is that sum and its rank among the equal digits of its block, in the order in which
they stood. Each pass is a shuffle by (digit, block), so that a task holds at most a block of one digit,
however often it occurs; nothing is sorted but such groups. Positions are written after each pass. Digits
that all rows share need no pass. Rows that can't be drawn are left out first: the counts of scores say from which
score on the sample is taken. What reaches the driver is bounded by the buckets, the radix and the range of scores.

Null and empty texts have no features and weight 0. Ids are integers; a null id is seeded as '' and stands after
all others. Rows of one id and one score stand by their number of features; repeated rows are drawn each, but sorted as one.
The result has its own columns only. An empty corpus has an empty result, an empty target constant counts.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.tables import drop, save
from gridloom.llm.text_columns import joined_words, split_words

BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Bits of a digit.
RADIX_BITS = 11
#: Rows of a block at least and at most; between them a thousand blocks share the rows.
BLOCK_ROWS = (64, 1 << 14)
#: Scores that are counted together to find where the sample ends.
SCORE_STEP = 16


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(word.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """How often each bucket's features occur in all texts."""
    words = texts.select(joined_words(texts[f"`{text_col}`"]).alias("joined")).select(F.explode(split_words(F.col("joined"))).alias("word"))
    out = [0] * buckets
    for r in words.groupBy(_bucket(F.col("word"), buckets).alias("bucket")).agg(F.count("*").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """The gain of each bucket, in thousandths of a nat."""
    n, s, t = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source, target, strict=True)]


def scored(docs: DataFrame, gain: list[int], seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score) of each row."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of an integer type: its digits are sorted")
    array = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    rows = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("doc_id"), joined_words(docs[f"`{text_col}`"]).alias("joined")).select("doc_id", split_words(F.col("joined")).alias("words"))
    summed = rows.select("doc_id", F.size("words").cast("bigint").alias("n_features"), F.aggregate("words", F.lit(0).cast("bigint"), lambda acc, w: acc + F.get(array, _bucket(w, len(gain)))).alias("total"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("bigint"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    return summed.select("doc_id", "n_features", mean.alias("weight"), gumbel.alias("noise")).select("doc_id", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))


def key_digits(best: int) -> list[Column]:
    """The digits of (score descending, id ascending, null ids last), the least significant first."""
    radix, id_, score = 1 << RADIX_BITS, F.col("doc_id"), F.lit(best) - F.col("score")
    low, high = F.coalesce(id_, F.lit(0)).bitwiseAND(0xFFFFFFFF), F.shiftright(F.coalesce(id_, F.lit(0)), 32) + (1 << 31)
    parts = [(low, 32), (high, 32), (id_.isNull().cast("bigint"), 1), (score, 33)]
    return [F.shiftright(part, at).bitwiseAND(radix - 1).cast("int") for part, bits in parts for at in range(0, bits, RADIX_BITS)]


def radix_ranks(rows: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score) with rank, from 1, by score descending and id ascending. Equal rows
    pass as one with their number, and are told apart at the end."""
    own = ["doc_id", "n_features", "weight", "score"]
    rows = save(rows.groupBy(*own).agg(F.count("*").alias("copies")), "radix-rows")
    n, best = rows.agg(F.count("*"), F.max("score")).first()
    if not n:
        return rows.select(*own, F.lit(None).cast("bigint").alias("rank"))
    digits = key_digits(best)
    ends = rows.agg(*[f(d) for d in digits for f in (F.min, F.max)]).first()
    size = min(max(BLOCK_ROWS[0], n // 1024), BLOCK_ROWS[1])
    block, order = F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // size))), [F.col("n_features"), F.col("doc_id")]
    for digit in [d for k, d in enumerate(digits) if ends[2 * k] != ends[2 * k + 1]] or digits[:1]:
        dealt = rows.withColumn("digit", digit).withColumn("block", block)
        counts = dealt.groupBy("digit", "block").agg(F.sum("copies").alias("n"))
        totals = dict(counts.groupBy("digit").agg(F.sum("n")).collect())  # at most the radix
        begins = [0, *accumulate(totals.get(d, 0) for d in range(1 << RADIX_BITS))]
        start = F.split(F.lit(",".join(map(str, begins))), ",").cast("array<bigint>")
        earlier = lambda by, n, *at: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = counts.select("digit", "block", (F.get(start, F.col("digit")) + earlier(["digit"], "n", "block")).alias("offset"))
        placed = dealt.withColumn("within", earlier(["digit", "block"], "copies", *order)).join(offsets, ["digit", "block"])
        after = save(placed.select(*own, "copies", (F.col("offset") + F.col("within")).alias("position")), "radix-rows")
        drop(rows)
        rows, block, order = after, F.floor(F.col("position") / size), [F.col("position")]
    return rows.select(*own, F.explode(F.sequence(F.col("position") + 1, F.col("position") + F.col("copies"))).alias("rank"))


def importance_sample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs; rank is null for rows that aren't drawn."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    rows = save(scored(docs, gain, seed, id_col, text_col), "scores")
    step = F.floor(F.col("score") / SCORE_STEP)
    able = rows.where(F.col("n_features") >= min_words)
    steps = sorted(able.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True)  # bounded by the scores' range
    draws = percent * sum(r.n for r in steps) // 100
    have, least = 0, None
    for r in steps:
        if have < draws:
            have, least = have + r.n, r.step
    none = F.lit(None).cast("bigint")
    if least is None:
        return rows.withColumn("rank", none)
    chance = (F.col("n_features") >= min_words) & (step >= least)
    ranked = radix_ranks(rows.where(chance)).withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return rows.where(~chance).withColumn("rank", none).unionByName(ranked)


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return importance_sample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) AS v FROM range(256) t(i)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), w AS (SELECT doc_id, unnest(words) AS word FROM d
), v AS (SELECT unnest(words) AS word FROM b
), distinct_words AS (SELECT word, hex(encode(word)) AS bytes FROM (SELECT word FROM w UNION SELECT word FROM v)
), steps AS (
  SELECT word, bytes, 0 AS at_byte, 4294967295::BIGINT AS crc FROM distinct_words
  UNION ALL
  SELECT word, bytes, at_byte + 1, xor(crc >> 8, v)
  FROM steps JOIN crc_table ON i = xor(crc & 255, ('0x' || substr(bytes, 2 * at_byte + 1, 2))::BIGINT)
  WHERE 2 * at_byte < length(bytes)
), hashed AS (SELECT word, xor(crc, 4294967295::BIGINT) % 10000 AS bucket FROM steps WHERE 2 * at_byte = length(bytes)
), s AS (SELECT bucket, count(*) AS n FROM w JOIN hashed USING (word) GROUP BY 1
), t AS (SELECT bucket, count(*) AS n FROM v JOIN hashed USING (word) GROUP BY 1
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
         / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket)
), sums AS (SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY 1
), scores AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN sums USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scores WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= floor(10 * n / 100) THEN r END::BIGINT AS rank
FROM scores LEFT JOIN ranked USING (doc_id)
"""
