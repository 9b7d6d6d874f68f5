"""Substring deduplication: FM-indexes over content-dealt shards, searched backward.

A window is `WINDOW` consecutive words. A word goes if a window that covers it also starts in a
document with a smaller id. Each window has an anchor, its run of `ANCHOR` words with the smallest hash;
consecutive windows with one anchor form a segment. Equal windows have equal anchors, so a window can
only repeat in segments of its anchor:

1. Anchors that stand in one document alone are left out (counts of all anchors).
2. The documents with other anchors give the segments around these; equal segments become one,
   with the smallest id that has it.
3. Segments are dealt to shards by their anchor. A shard is an FM-index of its segments (a wavelet
   matrix, and for each suffix the number of its document), and all segments are streamed
   through it: backward search gives the matching statistic of each word, the length of the
   longest sequence that ends there and occurs more than once, up to the window's length. Where
   it reaches that, the range of suffixes has the smallest id of all occurrences.
   An anchor with more than `HOT` different segments is dealt finer, by single windows, so that no
   shard grows with one passage's surroundings. A window then enters its index with the smallest
   and the largest id that has it, as two texts where these differ; what repeats, and in which
   document first, is found by the same search over the words as for all other anchors.
4. What a shard reports goes back to the documents, whose covered words are removed.

Null and empty texts have no words. Rows with a null id keep all words, and nothing is removed
because of them. Ids may be of any type that has an order. Rows that repeat an id do not count against one another; each is judged by its
own text. All columns of the input but n_words, n_removed and kept stay, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.fm_index import FMIndex
from gridloom.llm.tables import drop, free_names, save
from gridloom.llm.words import NOT_SPACE, Bytes, add_columns, column, emit_rows, full, mix, ngrams, prepare, range_hashes

WINDOW, ANCHOR = 13, 5
#: Words of a shard, and different segments of an anchor from which on it is dealt by windows.
SHARD_WORDS, HOT = 300_000, 400


def _segments(b: Bytes) -> tuple[np.ndarray, ...]:
    """(word starts, word ends, word hashes, first window, windows, document, anchor) of all segments."""
    start, end, doc = b.runs(NOT_SPACE)
    h = b.hashes(start, end)
    ok = full(doc, WINDOW)
    if not ok.any():
        none = np.empty(0, np.int64)
        return start, end, h, none, none, none, none.view(np.uint64)
    # the low bits give way to the position, so that the least value says where it stands
    g = (ngrams(h, doc, ANCHOR) & ~np.uint64(15)) | (np.arange(max(0, len(h) - ANCHOR + 1), dtype=np.uint64) & np.uint64(15))
    for step in (1, 2, 4, 1):  # 2, 4, 8 and at last 9 runs, all that a window holds
        g = np.minimum(g[:-step], g[step:])
    best, at = g >> np.uint64(4), np.arange(len(g))
    at = at + (((g & np.uint64(15)).astype(np.int64) - at) & 15)
    w = np.flatnonzero(ok)
    new = np.concatenate([[True], (at[w][1:] != at[w][:-1]) | (doc[w][1:] != doc[w][:-1])])
    first = w[new]
    count = np.diff(np.append(np.flatnonzero(new), len(w)))
    return start, end, h, first, count, doc[first], best[first]


def _kind(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def _anchors(docs: DataFrame) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        *_, doc, anchor = _segments(Bytes(column(batch, "text")))
        once = np.unique(mix(anchor + mix(doc.astype(np.uint64))), return_index=True)[1]
        return {"id": column(batch, "id").take(pa.array(doc[once])), "anchor": anchor[once].view(np.int64)}

    return emit_rows(docs, "text", f"id {_kind(docs)}, anchor bigint", fn)


def _cut(docs: DataFrame) -> DataFrame:
    """Segments of docs (id, text, anchors) whose anchor is one of `anchors`."""

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array] | None:
        b = Bytes(column(batch, "text"))
        start, end, h, first, count, doc, anchor = _segments(b)
        own = column(batch, "anchors")
        known = mix(own.flatten().to_numpy().view(np.uint64) + np.repeat(np.arange(len(own)), np.asarray(own.value_lengths())).astype(np.uint64))
        keep = np.isin(mix(anchor + doc.astype(np.uint64)), known)
        first, count, doc, anchor = first[keep], count[keep], doc[keep], anchor[keep]
        if not len(first):
            return None
        base = np.searchsorted(start, b.offs[:-1])  # each document's first word
        last = first + count + WINDOW - 1
        raw = b.raw.tobytes()
        return {
            "id": column(batch, "id").take(pa.array(doc)),
            "row": column(batch, "row").take(pa.array(doc)),
            "start": (first - base[doc]).astype(np.int32),
            "anchor": anchor.view(np.int64),
            "low": range_hashes(h, first, last, 0).view(np.int64),
            "high": range_hashes(h, first, last, 1).view(np.int64),
            "words": pa.array([raw[s:e] for s, e in zip(start[first].tolist(), end[last - 1].tolist(), strict=True)], pa.binary()),
        }

    return emit_rows(docs, "text", f"id {_kind(docs)}, row bigint, start int, anchor bigint, low bigint, high bigint, words binary", fn)


def search_shard(ids: np.ndarray, words: pa.Array) -> list[np.ndarray]:
    """For each segment (words; the smallest id that has it) the smallest id of any occurrence of each of its windows."""
    b = Bytes(words)
    start, end, seg = b.runs(NOT_SPACE)
    uniq, symbol = np.unique(b.hashes(start, end), return_inverse=True)
    # a separator, 0, ends each segment
    place = np.arange(len(symbol)) + seg
    text = np.zeros(len(symbol) + b.n, np.int64)
    text[place] = symbol + 1
    owner = np.zeros(len(text), np.int64)
    owner[place] = ids[seg]
    index = FMIndex(text, WINDOW)  # it ends with a separator, which no window holds
    at = place[: max(0, len(seg) - WINDOW + 1)][full(seg, WINDOW)]
    length, low, high = index.matching_statistics(text, at + WINDOW - 1, WINDOW)
    values = owner[at]  # of windows that occur once
    twice = np.flatnonzero(length == WINDOW)
    if len(twice):
        uniq, back = np.unique(low[twice], return_inverse=True)
        stop = np.zeros(len(uniq), np.int64)
        stop[back] = high[twice]
        known, number = np.unique(owner, return_inverse=True)
        by_suffix = np.append(index.in_suffix_order(number.astype(np.int32)), np.int32(len(known)))
        values[twice] = known[np.minimum.reduceat(by_suffix, np.column_stack([uniq, stop]).ravel())[::2][back]]
    of = np.searchsorted(seg[: max(0, len(seg) - WINDOW + 1)][full(seg, WINDOW)], np.arange(b.n + 1))
    return [values[of[i] : of[i + 1]] for i in range(b.n)]


def _search(rows: DataFrame, n_shards: int, shard) -> DataFrame:
    """(low, high, least) of rows (low, high, id, words), once where several ids have the same words:
    the smallest id for each window. Ids of any type that has an order are searched as their ranks in the shard."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = t.column("id").combine_chunks()
        known = ids.unique().sort()
        ranks = pc.index_in(ids, known).to_numpy(zero_copy_only=False).astype(np.int64)
        found = search_shard(ranks, t.column("words").combine_chunks())
        low, high = (t.column(c).to_numpy().view(np.uint64) for c in ("low", "high"))
        once = np.unique(mix(low + mix(high)), return_index=True)[1]
        t, found = t.take(pa.array(once)), [found[i] for i in once]
        sizes = np.cumsum([0, *(len(f) for f in found)])
        flat = np.concatenate(found) if found else np.empty(0, np.int64)
        return pa.table({"low": t.column("low"), "high": t.column("high"), "least": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), known.take(pa.array(flat, pa.int64())))})

    prepare(rows.sparkSession)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(shard), F.lit(n_shards))).select("shard", "low", "high", "id", "words")
    return dealt.groupBy("shard").applyInArrow(run, f"low bigint, high bigint, least array<{_kind(rows)}>")


def _windows(rows: DataFrame) -> DataFrame:
    """Single windows of segments: (seg_low, seg_high, k, low, high, id, words)."""

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        b = Bytes(column(batch, "words"))
        start, end, seg = b.runs(NOT_SPACE)
        at = np.flatnonzero(full(seg, WINDOW))
        h, own, raw = b.hashes(start, end), pa.array(seg[at]), b.raw.tobytes()
        base = np.searchsorted(start, b.offs[:-1])
        return {
            "seg_low": column(batch, "low").take(own),
            "seg_high": column(batch, "high").take(own),
            "k": (at - base[seg[at]]).astype(np.int32),
            "low": range_hashes(h, at, at + WINDOW, 0).view(np.int64),
            "high": range_hashes(h, at, at + WINDOW, 1).view(np.int64),
            "id": column(batch, "id").take(own),
            "words": pa.array([raw[s:e] for s, e in zip(start[at].tolist(), end[at + WINDOW - 1].tolist(), strict=True)], pa.binary()),
        }

    return emit_rows(rows, "words", f"seg_low bigint, seg_high bigint, k int, low bigint, high bigint, id {_kind(rows)}, words binary", fn)


def _least(segments: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(low, high, least) of the distinct segments, and the written tables that it reads."""
    spark = segments.sparkSession
    one = segments.groupBy("low", "high").agg(F.min("id").alias("id"), F.first("anchor").alias("anchor"), F.first("words").alias("words"))
    one = save(one, "distinct-segments")
    hot = one.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    hot = save(hot, "hot")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, -(-one.count() * (WINDOW + 4) // SHARD_WORDS))
    if hot.isEmpty():
        return _search(one, shards, F.col("anchor")), [one, hot]
    plain = _search(one.join(hot, "anchor", "left_anti"), shards, F.col("anchor"))
    single = save(_windows(one.join(hot, "anchor", "left_semi").select("low", "high", "id", "words")), "windows")
    ends = single.groupBy("low", "high").agg(F.array_distinct(F.array(F.min("id"), F.max("id"))).alias("ids"), F.first("words").alias("words"))
    each = ends.select("low", "high", F.explode("ids").alias("id"), "words")
    shards = max(parts, -(-single.count() * (WINDOW + 1) // SHARD_WORDS))
    found = _search(each, shards, F.col("low")).select("low", "high", F.col("least")[0].alias("m"))
    back = single.select("seg_low", "seg_high", "k", "low", "high").join(found, ["low", "high"])
    back = back.groupBy(F.col("seg_low").alias("low"), F.col("seg_high").alias("high")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("least"))
    return plain.unionByName(back), [one, hot, single]


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, starts): the word positions at which windows of a document start that also start in
    a document with a smaller id; row is the hash of the text, for ids that have several."""
    base = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    anchors = _anchors(base)
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
    known = save(anchors.join(shared, "anchor", "left_semi").groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "anchors")
    segments = save(_cut(base.join(known, "id")), "segments")
    drop(known)
    found, read = _least(segments)
    least = save(found, "least")
    for t in read:
        drop(t)
    places = segments.select("id", "row", "start", "low", "high").distinct()
    hits = places.join(least, ["low", "high"]).select("id", "row", F.expr("filter(transform(least, (m, k) -> IF(m < id, start + k, NULL)), x -> x IS NOT NULL)").alias("starts"))
    out = save(hits.where(F.size("starts") > 0).groupBy("id", "row").agg(F.flatten(F.collect_list("starts")).alias("starts")), "hits")
    drop(segments)
    drop(least)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept (the kept words, joined by single spaces); columns
    with these names are replaced."""
    hits = repeated_windows(docs, id_col, text_col)
    h_id, h_row, h_starts = free_names(docs, "id", "row", "starts")
    hits = hits.select(F.col("id").alias(h_id), F.col("row").alias(h_row), F.col("starts").alias(h_starts))
    both = docs.join(hits, (docs[f"`{id_col}`"] == F.col(h_id)) & (F.xxhash64(docs[f"`{text_col}`"]) == F.col(h_row)), "left").drop(h_id, h_row)

    def fn(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
        for text, starts in zip(column(batch, text_col).to_pylist(), column(batch, h_starts), strict=True):
            words = (text or "").encode().split()
            out["n_words"].append(len(words))
            kept = words
            if starts.is_valid:
                edge = np.zeros(len(words) + WINDOW + 1, np.int64)
                at = starts.values.to_numpy()
                at = at[at + WINDOW <= len(words)]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                stay = np.cumsum(edge)[: len(words)] == 0
                kept = [words[i] for i in np.flatnonzero(stay)]
            out["n_removed"].append(len(words) - len(kept))
            out["kept"].append(b" ".join(kept).decode())
        return out

    return add_columns(both, text_col, {"n_words": "bigint", "n_removed": "bigint", "kept": "string"}, fn).drop(h_starts)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (s) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
