"""Near-duplicate groups by bottom-k sketches of one hash function and exact Jaccard.

A text's set is its distinct shingles of five lower-cased words. One 64-bit hash orders all
shingles; its residues split the universe into parts, and the sketch keeps the `RETAINED`
smallest values of each part (a bottom-k sketch of that part). Inverted lists hold the documents
that retain the same values in a part: lists of single values would be as long as the most
frequent passage. Texts of 177 shingles or more have `PARTS` parts, and a pair of similarity s meets
in a list with probability 1 - (1 - s**4)**40 or more; at the threshold 0.75 one in 4 million
is missed. Shorter texts have parts of about four shingles and so many splits that there are
`PARTS` lists too; their lists belong to a class of sizes, and each text is in the lists of its class
and the next, so that any two sizes within the threshold share one.

Exact copies are one class beforehand and never expanded. Within a list each class is compared
with the list's head: the class whose lists are the longest taken together, which is the text that
the others were made from, if there is one (copies of it may be no near copies of each other). Texts of compared classes give the estimate from the union of the two
sketches, and where it isn't far below the threshold, the exact similarity of the full sets.
Connected lists are done. Where a list still spans several components, the classes outside its
main component are compared with all others of the list, unless something excludes a link for sure:
the sizes, the distances to the head (Jaccard distance is a metric), or the parities of
the two sets' hash counts (each that differs stands for a shingle in one set alone). So no
pair of a list stays undecided between components, and a list of n near copies costs about n
comparisons.

Null and empty texts and texts without words have no shingles and are linked with nothing. Rows
with a null id take no part (their component is null) and are kept. Repeated rows (same id and
text) have the same result. An id that has several texts is one document with all their links:
classes that share an id are connected too. Columns of the input other than the id, the text and those to be carried along aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tables import drop, save, small
from gridloom.llm.words import LOWER, NOT_SPACE, Bytes, add_columns, column, doc_bounds, emit_rows, full, mix, ngrams, stable_order

SHINGLE = 5
#: Similarity of 75 / 100 or more.
PERCENT = 75
PARTS, RETAINED = 40, 4
#: Pairs of one head from which on its key is spread over several tasks.
PAIRS_OF_KEY = 2000
#: Class of sizes from which on all texts have PARTS parts; class c starts at (4/3)**c shingles.
LARGEST = 18
#: The estimate must lie so far below the threshold for a pair to be dropped without the exact
#: similarity (over six standard errors of a sketch of 160 values).
MARGIN = 0.25


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash), sorted and distinct; the hash order within a document is free."""
    b = Bytes(texts, LOWER)
    start, end, doc = b.runs(NOT_SPACE)
    h = b.hashes(start, end)
    ok = full(doc, n)
    docs, vals = [doc[: len(ok)][ok]], [ngrams(h, doc, n)[ok]]
    bounds = doc_bounds(doc, b.n)
    size = np.diff(bounds)
    for m in range(1, n):  # shorter texts: the whole sequence
        short = np.flatnonzero(size == m)
        if len(short):
            docs.append(short)
            vals.append(mix(ngrams(h, doc, m)[bounds[short]] + np.uint64(m)))
    d, v = np.concatenate(docs), np.concatenate(vals)
    order = np.argsort(v)
    order = order[stable_order(d[order])]
    d, v = d[order], v[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return d[new], v[new]


def sketch(d: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, part, value) of the retained values, by document, part and value; v is sorted in each document."""
    part = (mix(v) % np.uint64(PARTS)).astype(np.int64)
    group = d * PARTS + part
    order = stable_order(group)
    group, v = group[order], v[order]
    keep = _starts(group)[1] < RETAINED
    return group[keep] // PARTS, group[keep] % PARTS, v[keep]


def _starts(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index of each run of equal values, rank of each entry in its run)."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
    return first, np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))


def lists(d: np.ndarray, v: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, list) of the inverted lists that hold each document, by document; v is sorted in each document."""
    own = np.floor(np.log(np.maximum(size, 1)) / np.log(4 / 3) + 1e-9).astype(np.int64).clip(0, LARGEST)
    docs, vals, groups = [], [], []
    for c in range(int(own.max(initial=0)) + 2):
        if c > LARGEST:
            break
        inside = (own == c) | (own == c - 1) if c < LARGEST else own >= c - 1
        inside &= size > 2  # sets of one or two shingles have no partner but copies
        if not inside.any():
            continue
        e = np.flatnonzero(inside[d])
        parts = PARTS if c == LARGEST else max(2, round((4 / 3) ** c / RETAINED))
        for split in range(-(-PARTS // parts)):
            docs.append(d[e])
            vals.append(v[e])
            groups.append((c * 64 + split) * 64 + (mix(v[e] + np.uint64(split)) % np.uint64(parts)).astype(np.int64))
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    doc, val, group = np.concatenate(docs), np.concatenate(vals), np.concatenate(groups)
    key = doc * ((LARGEST + 1) * 64 * 64) + group
    order = stable_order(key)  # values stay in order
    doc, val, group, key = doc[order], val[order], group[order], key[order]
    _, rank = _starts(key)
    keep = rank < RETAINED
    doc, val, group, key, rank = doc[keep], val[keep], group[keep], key[keep], rank[keep]
    first, _ = _starts(key)
    return doc[first], mix(np.add.reduceat(mix(val + rank.astype(np.uint64)), first) + group[first].astype(np.uint64))


def parities(d: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each document 256 bits (4 integers): the parities of its shingles' counts by hash."""
    at = (mix(v ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(255)).astype(np.int64)
    odd = (np.bincount(d * 256 + at, minlength=n * 256) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, 4)


def _describe(batch: pa.RecordBatch, text_col: str) -> dict[str, pa.Array]:
    n = batch.num_rows
    d, v = shingle_sets(column(batch, text_col))
    size = np.bincount(d, minlength=n)
    low, high = (_sums(d, x, n) for x in (v, mix(v ^ np.uint64(0x5851F42D4C957F2D))))
    doc, own = lists(d, v, size)
    return {
        "n_shingles": pa.array(size, pa.int64()),
        "low": pa.array(mix(low).view(np.int64)),
        "high": pa.array(mix(high).view(np.int64)),
        "odd": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 4), pa.array(parities(d, v, n).ravel())),
        "lists": pa.ListArray.from_arrays(pa.array(doc_bounds(doc, n).astype(np.int32)), pa.array(own.view(np.int64))),
    }


def _sums(d: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
    at = doc_bounds(d, n)
    return c[at[1:]] - c[at[:-1]]


def _compare(pairs: DataFrame, docs: DataFrame, classes: DataFrame, repeated: bool) -> DataFrame:
    """(a, b, common, total) of the pairs of classes. Where the estimate excludes a link, total is
    below 0: minus a lower bound of the distance, in millionths.

    A class's text is that of one of its rows (`repeated`: which may stand there several times). The second text joins first, by keys that stand in
    few pairs; heads of many pairs get theirs last, spread over copies of the key, so that no
    task has all pairs of one head and no head's text is shuffled with them."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = classes.select("node", "first").join(nodes, "node").select("node", F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"))
    texts = docs.select("id", F.xxhash64("text").alias("text_hash"), F.col("text").alias("t")).join(small(wanted), ["id", "text_hash"])
    texts = save(texts.groupBy("node").agg(F.first("t").alias("t")) if repeated else texts.select("node", "t"), "texts")
    copies = pairs.groupBy("a").agg(F.floor(F.count("*") / PAIRS_OF_KEY).cast("int").alias("more"))
    dealt = pairs.join(copies, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("more") + 1).cast("int")).drop("more")
    dealt = dealt.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    heads = texts.join(copies, texts["node"] == copies["a"]).select("a", F.col("t").alias("ta"), F.explode(F.sequence(F.lit(0), "more")).alias("salt"))
    both = dealt.join(heads, ["a", "salt"])

    def fn(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        a, b = (column(batch, c).to_numpy() for c in "ab")
        heads, at = np.unique(a, return_index=True)
        others, of = np.unique(b, return_index=True)
        of, others = of[new := ~np.isin(others, heads)], others[new]
        texts = pa.concat_arrays([column(batch, "ta").take(pa.array(at)), column(batch, "tb").take(pa.array(of))])
        d, v = shingle_sets(texts)
        nodes = np.concatenate([heads, others])
        order = np.argsort(nodes)
        x, y = (order[np.searchsorted(nodes[order], ids)] for ids in (a, b))
        estimate = union_estimates(*sketch(d, v), len(nodes), x, y)
        low = estimate < PERCENT / 100 - MARGIN
        bounds = doc_bounds(d, len(nodes))
        size = np.diff(bounds)
        common = np.zeros(len(a), np.int64)
        for i in np.flatnonzero(~low):
            common[i] = in_both(v[bounds[x[i]] : bounds[x[i] + 1]], v[bounds[y[i]] : bounds[y[i] + 1]])
        total = np.where(low, -(1e6 * (1 - estimate - MARGIN)).astype(np.int64), size[x] + size[y] - common)
        return {"a": a, "b": b, "common": common, "total": total}

    out = save(emit_rows(both, "ta", "a bigint, b bigint, common bigint, total bigint", fn), "compared")
    drop(texts)
    return out


def union_estimate(sa: np.ndarray, sb: np.ndarray) -> float:
    """Similarity from two sketches: of the values that the union's sketch retains, the share in both."""
    v, n = np.unique(np.concatenate([sa, sb]), return_counts=True)
    _, p, kept = sketch(np.zeros(len(v), np.int64), v)
    both = n[np.searchsorted(v, kept)] == 2
    return float(both.mean()) if len(both) else 0.0


def union_estimates(doc: np.ndarray, part: np.ndarray, value: np.ndarray, n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """union_estimate of the pairs (x, y) of n documents with these sketches (as `sketch` gives them)."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    kept = np.full((n * PARTS, RETAINED), none)
    group = doc * PARTS + part
    kept[group, _starts(group)[1]] = value
    kept = kept.reshape(n, PARTS, RETAINED)
    out = np.empty(len(x))
    for k in range(0, len(x), 512):
        v = np.sort(np.concatenate([kept[x[k : k + 512]], kept[y[k : k + 512]]], axis=2), axis=2)
        again = np.zeros(v.shape, bool)
        again[:, :, 1:] = v[:, :, 1:] == v[:, :, :-1]
        # of each part the smallest different values
        retained = (np.cumsum(~again, axis=2, dtype=np.int8) <= RETAINED) & (v != none)
        both = (again & retained).sum(axis=(1, 2))
        out[k : k + 512] = both / np.maximum((retained & ~again).sum(axis=(1, 2)), 1)
    return out


def in_both(a: np.ndarray, b: np.ndarray) -> int:
    """Values that are in both of two sorted arrays of different values."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    return int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b)) if len(b) else 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ids in edges (a, b): the smallest id that each can reach. Each
    round takes the smallest label around and follows labels' own labels; rounds end when
    nothing changes, after about the logarithm of the longest path."""
    both = save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = save(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(around, "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("to"))
        ahead = labels.select(F.col("id").alias("to"), F.col("component").alias("next"))
        new = save(step.join(ahead, "to").select("id", "was", F.least("to", "next").alias("component")), "labels")
        done = new.where("component <> was").isEmpty()
        drop(labels)
        labels = new
        if done:
            drop(both)
            out = labels.select("id", "component")
            out.stored_at = labels.stored_at
            return out


def merged(comp: DataFrame, more: DataFrame) -> DataFrame:
    """The components when further edges are added: those that they join become one. Only the
    graph of the components themselves is walked again."""
    ends = more.select(F.col("a").alias("id")).unionByName(more.select(F.col("b").alias("id"))).distinct()
    known = comp.unionByName(ends.join(comp, "id", "left_anti").select("id", F.col("id").alias("component")))
    of = lambda end: known.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    joined = more.join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
    up = components(joined)
    out = save(known.join(up.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component")), "labels")
    drop(up)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (smallest id of the group of
    linked texts, its own if it has no link), kept (whether it is that id) and the columns `carry`."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    carried = [F.struct(*carry).alias("carried")] if carry else []
    rows = save(add_columns(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"), *carried), "text", {"n_shingles": "bigint", "low": "bigint", "high": "bigint", "odd": "array<bigint>", "lists": "array<bigint>"}, lambda b: _describe(b, "text")).drop("text"), "sketches")
    classes = rows.where("id IS NOT NULL AND n_shingles > 0").groupBy("low", "high").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.first("n_shingles").alias("size"), F.first("odd").alias("odd"), F.first("lists").alias("lists"))
    node = F.xxhash64("low", "high")
    classes = save(classes.withColumn("node", node), "classes")

    entries = classes.select("node", F.col("first.id").alias("rep"), F.explode("lists").alias("list"))
    long = entries.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    listed = save(entries.join(long, "list"), "listed")
    weight = listed.groupBy("node").agg(F.sum("n").alias("weight"))
    heads = listed.join(weight, "node").groupBy("list").agg(F.min(F.struct(-F.col("weight"), "rep", "node"))["node"].alias("head"))
    members = save(listed.select("list", "node").join(heads, "list"), "lists")
    drop(listed)
    star = members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    repeated = not rows.groupBy("id", "text_hash").count().where("count > 1").isEmpty()
    first = _compare(star, base, classes, repeated)
    linked = F.col("total") > 0
    linked = linked & (100 * F.col("common") >= PERCENT * F.col("total"))
    links = first.where(linked).select("a", "b")
    of_ids = rows.where("id IS NOT NULL AND n_shingles > 0").select("id", node.alias("node")).groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("id", "a")
    of_ids = save(rows.where("n_shingles > 0").select("id", node.alias("b")).join(small(of_ids), "id").where("a <> b").select("a", "b").distinct(), "texts-of-an-id")
    comp = components(links.unionByName(of_ids))

    rest = _undecided(members, first, comp, classes.select("node", "size", "lists", *[F.col("odd")[i].alias(f"o{i}") for i in range(4)]))
    second = None
    if not rest.isEmpty():
        second = _compare(rest, base, classes, repeated)
        more = second.where(linked).select("a", "b")
        if not more.isEmpty():
            first_comp, comp = comp, merged(comp, more)
            drop(first_comp)
    # a component's number is the smallest id of its classes
    group = classes.select("low", "high", "node", F.col("first.id").alias("rep")).join(comp.select(F.col("id").alias("node"), "component"), "node", "left")
    group = group.withColumn("component", F.coalesce("component", "node"))
    number = group.groupBy("component").agg(F.min("rep").alias("number"))
    ids = save(group.join(number, "component").select("low", "high", F.col("number").alias("component")), "numbers")
    for t in (members, first, of_ids, comp, rest, classes, *([second] if second is not None else [])):
        drop(t)
    out = rows.drop("lists", "odd", "text_hash").join(ids, ["low", "high"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), own)
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"), *[F.col("carried")[c].alias(c) for c in carry])


def _undecided(members: DataFrame, compared: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a list that the comparisons with its head leave in different components and
    that neither sizes nor parities nor the distances to the head exclude."""
    exact = F.col("total") > 0
    share = F.col("common") / F.greatest("total", F.lit(1))
    lo = F.when(exact, 1 - share).otherwise(-F.col("total") / 1e6)
    known = compared.select(F.col("a").alias("head"), F.col("b").alias("node"), lo.alias("lo"), F.when(exact, 1 - share).otherwise(1.0).alias("hi"))
    label = comp.select(F.col("id").alias("node"), "component")
    m = members.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    span = m.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("list")
    m = m.join(span, "list").join(known, ["head", "node"], "left").fillna(0.0, ["lo", "hi"])  # the head itself: 0
    heads = comp.select(F.col("id").alias("head"), F.col("component").alias("main"))
    own = ["list", "node", "component", "main", "lo", "hi", "size", "lists", "o0", "o1", "o2", "o3"]
    m = save(m.join(heads, "head", "left").withColumn("main", F.coalesce("main", "head")).join(sets, "node").select(*own), "open")
    x, y = m.where("component <> main").alias("x"), m.alias("y")
    most = 1 - PERCENT / 100 + 1e-9
    near = (F.col("x.lo") - F.col("y.hi") <= most) & (F.col("y.lo") - F.col("x.hi") <= most)
    sizes = 100 * F.least("x.size", "y.size") >= PERCENT * F.greatest("x.size", "y.size")
    alone = sum((F.bit_count(F.col(f"x.o{i}").bitwiseXOR(F.col(f"y.o{i}"))) for i in range(4)), F.lit(0))
    # similarity s of sets with a and b members: (a + b) (1 - s) / (1 + s) members are in one alone
    differ = alone * (100 + PERCENT) <= (100 - PERCENT) * (F.col("x.size") + F.col("y.size"))
    once = (F.col("x.node") < F.col("y.node")) | (F.col("y.component") == F.col("y.main"))
    # near copies share most of their lists: a pair is taken from one of them
    here = F.array_min(F.array_intersect("x.lists", "y.lists")) == F.col("x.list")
    pairs = x.join(y, F.col("x.list") == F.col("y.list")).where((F.col("x.component") != F.col("y.component")) & sizes & near & differ & once & here)
    pairs = pairs.select(F.col("x.node").alias("x"), F.col("y.node").alias("y"))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    done = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    out = save(pairs.join(done, ["a", "b"], "left_anti"), "undecided")
    drop(m)
    return out


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) c
  JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b WHERE 100 * c.c >= 75 * (na.n + nb.n - c.c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""
