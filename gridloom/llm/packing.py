"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Every bin carries its residual capacity and two bitmaps: the sources and the duplicate clusters
that it holds. A document, the longest first, goes to the bin with the smallest residual that
still holds it (the successor of its length in the residual order) and that has neither its
source nor its cluster; the search continues from residual to residual until such a bin is
found, else a new bin is opened. A document longer than a bin is cut into pieces, each as long as
a bin can hold whole characters of it, the last one shorter.

Sizes are bytes of UTF-8; with `tokens` they are tokens of the text's pieces (`token_counts`), and
pieces end where the next character would need a token too many.

A duplicate cluster is a group of linked near copies (`near_dedup`: exact copies too), whatever their
sources. Texts without words link with nothing; of them, equal texts are a cluster.

Documents are dealt by a hash of their id into groups of about `GROUP` and each group is packed by
one task, so bins never span groups: a document goes to the tightest compatible bin of its group,
not of the table, and each group leaves a few bins partly empty. One source or
cluster may hold any share of the rows: its documents are spread over all groups.

Null and empty texts have length 0 and are placed like others; a null source or cluster
conflicts with nothing. Documents of equal length are placed in the order of their ids;
repeated rows are placed each.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import ship_package
from gridloom.llm.near_dedup import near_duplicates
from gridloom.llm.token_counts import PrefixCounter, counter, vocabulary_path
from gridloom.llm.words import add_columns, column

#: Bytes of UTF-8 in a bin, and documents of a group.
CAPACITY = 16_384
GROUP = 4096


def best_fit(pieces: list[tuple[int, int | None, int | None]], capacity: int) -> list[int]:
    """Bin numbers of pieces (length, source, cluster) in the given order; sources and clusters
    are small integers, or None."""
    order: list[tuple[int, int]] = []  # (residual, bin)
    sources, clusters, out = [], [], []
    for size, source, cluster in pieces:
        s = 1 << source if source is not None else 0
        c = 1 << cluster if cluster is not None else 0
        for at in range(bisect_left(order, (size, -1)), len(order)):
            residual, k = order[at]
            if not (sources[k] & s or clusters[k] & c):
                del order[at]
                break
        else:
            residual, k = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[k] |= s
        clusters[k] |= c
        if residual > size:  # a full bin takes nothing more, not even empty documents
            insort(order, (residual - size, k))
        out.append(k)
    return out


def _byte_cuts(text: Column, capacity: int) -> Column:
    """Pieces (start, length, size: bytes) of at most `capacity` bytes, cut between characters."""
    data, size = text.cast("binary"), F.octet_length(text).cast("bigint")

    def inside(at: Column) -> Column:  # a character
        return F.hex(F.substring(data, (at + 1).cast("int"), F.lit(1))).between("80", "BF")

    def after(start: Column) -> Column:
        end = start + capacity
        return F.when(~inside(end), end).when(~inside(end - 1), end - 1).when(~inside(end - 2), end - 2).otherwise(end - 3)

    steps = F.sequence(F.lit(1).cast("bigint"), F.floor((F.greatest(size, F.lit(1)) - 1) / (capacity - 3)) + 1)
    grow = lambda cuts, _: F.when(F.element_at(cuts, -1) + capacity < size, F.array_append(cuts, after(F.element_at(cuts, -1)))).otherwise(cuts)
    starts = F.when(size <= capacity, F.array(F.lit(0).cast("bigint"))).otherwise(F.aggregate(steps, F.array(F.lit(0).cast("bigint")), grow))

    def piece(start: Column, i: Column) -> Column:
        length = F.coalesce(F.get(starts, i + 1), size) - start
        return F.struct(start.alias("start"), length.alias("length"), length.alias("size"))

    return F.transform(starts, piece)


def token_cuts(c: PrefixCounter, text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length: bytes; size: tokens) of a text's pieces; each is found in a window of the rest
    that holds a good many tokens more, so that the work grows with the text."""
    out, at, done = [], 0, 0
    while at < len(text):
        width = 8 * capacity
        while c.total(part := text[at : at + width]) <= capacity + 256 and at + width < len(text):
            width *= 2
        k = len(part) if c.total(part) <= capacity else c.cut(part, *c.units(part), capacity)
        size = len(part[:k].encode())
        out.append((done, size, c.total(part[:k])))
        at, done = at + k, done + size
    return out


def _with_token_cuts(docs: DataFrame, text_col: str, capacity: int) -> DataFrame:
    """docs with __cuts: pieces (start, length: bytes; size: tokens) of at most `capacity` tokens."""
    path = vocabulary_path()

    def fn(batch: pa.RecordBatch) -> dict[str, list]:
        c, out = counter(path), []
        texts = [t or "" for t in column(batch, text_col).to_pylist()]
        for text, n in zip(texts, c.totals(texts), strict=True):
            cuts = [(0, len(text.encode()), n)] if n <= capacity else token_cuts(c, text, capacity)
            out.append([dict(zip(("start", "length", "size"), x, strict=True)) for x in cuts])
        return {"__cuts": out}

    return add_columns(docs, text_col, {"__cuts": "array<struct<start:bigint,length:bigint,size:bigint>>"}, fn, [counter.cache_clear])


def _dense(values: list) -> list[int | None]:
    number: dict = {}
    return [None if v is None else number.setdefault(v, len(number)) for v in values]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", cluster_col: str | None = None, capacity: int = CAPACITY, group: int = GROUP, near: bool = False, tokens: bool = False, with_text: bool = False) -> DataFrame:
    """One row per piece of a document: id_col, piece (from 0), start and length (bytes of the
    text), size (what it takes of its bin: bytes, or with `tokens` tokens), bin_id and position
    (order of placement in the bin). Without cluster_col, equal texts are a cluster; with `near`,
    linked near copies are one (instead of cluster_col). `with_text` adds the pieces' text (not with `near`)."""
    if near and with_text:
        raise ValueError("near copies are packed without their text")
    if capacity < 4:
        raise ValueError("a bin must hold any character: 4 bytes or tokens at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # pieces are at most one for each document and one for each `capacity` bytes, or nearly so
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    groups = max(1, -(-(n_docs + n_bytes // capacity) // group))
    if tokens:
        docs = _with_token_cuts(docs, text_col, capacity)
    base_columns = [
        F.col(id_col).alias("id"),
        (F.col("__cuts") if tokens else _byte_cuts(text, capacity)).alias("cuts"),
        (F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")).alias("source"),
        (F.when(F.col(cluster_col).isNotNull(), F.xxhash64(F.col(cluster_col))) if cluster_col else F.when(text != "", F.xxhash64(text))).alias("cluster"),
    ]
    base = docs.select(*base_columns, *([text.alias("text")] if with_text else []))
    if near:
        # the key is of row and text, so that a null id or an id with two texts has its clusters too
        keyed = docs.select(F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"), F.struct(*base_columns).alias("doc"))
        found = near_duplicates(keyed, "key", "text", ["doc"])
        base = found.select("doc.id", "doc.cuts", "doc.source", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc.cluster")).alias("cluster"))
    kept = ["id", "source", "cluster", *(["text"] if with_text else [])]
    pieces = base.select(*kept, F.posexplode("cuts").alias("piece", "cut")).select(*kept, F.col("piece").cast("bigint").alias("piece"), "cut.start", "cut.length", "cut.size")
    if with_text:
        part = F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
        pieces = pieces.withColumn("text", F.decode(part, "UTF-8"))
    pieces = pieces.withColumn("batch", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("id", "ascending"), ("piece", "ascending"), ("source", "ascending")])
        sizes = t.column("size").to_pylist()
        bins = best_fit(list(zip(sizes, _dense(t.column("source").to_pylist()), _dense(t.column("cluster").to_pylist()), strict=True)), capacity)
        seen: dict[int, int] = {}
        position = []
        for k in bins:
            position.append(seen.get(k, 0))
            seen[k] = position[-1] + 1
        batch = t.column("batch")[0].as_py() if t.num_rows else 0
        own = {"text": t.column("text")} if with_text else {}
        return pa.table(own | {
            "id": t.column("id"), "piece": t.column("piece"), "start": t.column("start"), "length": t.column("length"), "size": t.column("size"),
            "bin_id": pa.array([(batch << 32) + k for k in bins], pa.int64()), "position": pa.array(position, pa.int64()),
        })

    ship_package(docs.sparkSession)
    kind = base.schema["id"].dataType.simpleString()
    packed = pieces.groupBy("batch").applyInArrow(run, ("text string, " if with_text else "") + f"id {kind}, piece bigint, start bigint, length bigint, size bigint, bin_id bigint, position bigint")
    return packed.withColumnRenamed("id", id_col)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), near=True)
