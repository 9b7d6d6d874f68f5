"""Benchmark decontamination by one Aho-Corasick automaton over the benchmark's word windows.

Texts and items are normalised alike (A-Z lower-cased, words are runs of ASCII digits, letters
and non-ASCII characters); a window is `window` consecutive words of an item, or the whole item
if it has fewer words. The automaton holds every distinct window once. Each document is scanned
once; a match's offset in the normalised text gives its words, and these give the offsets in
the original text.

Nulls, empty texts and texts without words have no words and no hits. Items without words are
no windows; the windows of an item without an id count as hits, but it is not listed. Repeated
documents are each judged; repeated items share their windows.

An automaton has about 450 bytes for each byte of its items. A benchmark of more than
`BLOCK_BYTES` is dealt by a hash of its items into blocks of about that size (one longer item is
more), and block after block is read, sent to the tasks, scanned for and forgotten, with a
written table in between; what a block finds is added to the result, so that this is the same
for any number of blocks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tables import drop, free_names, save
from gridloom.llm.words import caches, LOWER, add_columns, byte_class, column

WINDOW = 10
#: Bytes of benchmark text that one automaton holds, and that the driver reads and sends at once.
BLOCK_BYTES = 1 << 20
#: Normalisation of bytes: word bytes lower-cased, all others to a space.
WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_NORM = bytes(int(b) if WORD[b] else 32 for b in LOWER)


def normal_words(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return (text or "").encode().translate(_NORM).split()


def windows(words: list[bytes], n: int) -> list[bytes]:
    """The windows of an item, each as its words with single spaces around."""
    last = max(len(words) - n, 0)
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(last + 1)] if words else []


_built: dict[str, object] = {}
caches.append(_built.clear)


def automaton(key: str, items: list[tuple[str | None, str]], n: int) -> tuple[object, list[list[int]]]:
    """Automaton over the distinct windows of the items; a window's value is its number, and
    owners[number] are the indexes of its items. Bytes stand as the characters of their value.
    A worker keeps the automaton with the last key."""
    import ahocorasick

    if key not in _built:
        _built.clear()
        auto, number, owners = ahocorasick.Automaton(), {}, []
        for k, (_, text) in enumerate(items):
            for w in dict.fromkeys(windows(normal_words(text), n)):
                i = number.setdefault(w, len(number))
                if i == len(owners):
                    owners.append([])
                    auto.add_word(w.decode("latin-1"), (i, w.count(b" ") - 1))
                owners[i].append(k)
        auto.make_automaton()
        _built[key] = (auto, owners)
    return _built[key]


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items (item, text) in blocks of a bounded size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text IS NOT NULL").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """docs with n_words, hits (word ranges [start, end) inside windows of the benchmark, merged),
    spans (the same as code points of the original text, end exclusive) and items (ids with
    occurring windows, sorted as strings); columns of docs with these names are replaced."""
    out, blocks, before = docs, _blocks(benchmark), None
    for k, block in enumerate(blocks):
        items = [(r.item, r.text) for r in block.orderBy("item", "text").collect()]
        shared = docs.sparkSession.sparkContext.broadcast(items)
        out = _scan(out, shared, uuid.uuid4().hex, window, text_col, first=k == 0)
        if k + 1 < len(blocks):
            out = save(out, "scanned")
            shared.unpersist()
            if before is not None:
                drop(before)
            before = out
    return out


def _scan(docs: DataFrame, shared, key: str, window: int, text_col: str, first: bool) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        known = shared.value
        auto, owners = automaton(key, known, window)
        texts = column(batch, text_col)
        before = None if first else (column(batch, "hits").to_pylist(), column(batch, "items").to_pylist())
        n_words, hits, spans, found = [], [], [], []
        for i in range(batch.num_rows):
            raw = (texts[i].as_py() or "").encode()
            words = raw.translate(_NORM).split()
            n_words.append(len(words))
            ranges, ids = [], set()
            if len(auto) and words:
                norm = f" {b' '.join(words).decode('latin-1')} "
                got = list(auto.iter(norm))
                if got:
                    at = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)  # at[w]: the space before word w
                    for end, (number, n) in got:
                        last = int(np.searchsorted(at, end))
                        ranges.append((last - n, last))
                        ids.update(known[j][0] for j in owners[number] if known[j][0] is not None)
            if before is not None:
                ranges += [tuple(x.values()) for x in before[0][i]]
                ids.update(before[1][i])
            merged = merge(ranges)
            hits.append([{"start": a, "end": b} for a, b in merged])
            spans.append(_original(raw, merged))
            found.append(sorted(ids))
        return {"n_words": n_words, "hits": hits, "spans": spans, "items": found}

    kind = "array<struct<start:int,end:int>>"
    new = {"n_words": "bigint", "hits": kind, "spans": kind, "items": "array<string>"}
    return (add_columns if first else _replace)(docs, text_col, new, fn)


def _replace(docs: DataFrame, text_col: str, out: dict[str, str], fn) -> DataFrame:
    """add_columns for a function that also reads the columns it replaces."""
    names = dict(zip(out, free_names(docs, *out), strict=True))

    def renamed(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        new = fn(batch)
        return {names[k]: v for k, v in new.items()}

    both = add_columns(docs, text_col, {names[k]: v for k, v in out.items()}, renamed)
    return both.drop(*out).withColumnsRenamed({v: k for k, v in names.items()})


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges, as sorted disjoint ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _original(raw: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as code-point ranges of the original text."""
    if not ranges:
        return []
    data = np.frombuffer(raw, np.uint8)
    m = np.concatenate([[False], WORD[LOWER[data]], [False]])
    starts, ends = np.flatnonzero(m[1:] & ~m[:-1]), np.flatnonzero(m[:-1] & ~m[1:])
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in ranges]


def summary(found: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return summary(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT d.doc_id, d.i, d.n, win.item
  FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)) d
  JOIN win ON win.s = d.s AND win.n = d.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
