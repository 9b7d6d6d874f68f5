"""The registered queries on the generated tables: against their SQL, brute force or labels."""

from __future__ import annotations

import re
import string
import uuid
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    sql = duck.sql(queries.oracle_sql()[name])
    names, want = sql.columns, sql.fetchall()
    got = [tuple(r[c] for c in names) for r in queries.queries()[name](spark, SF).collect()]  # pandas would make integers with nulls floats
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(got) == key(want)


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_held_out_accuracy(spark, duck):
    docs = duck.sql("SELECT doc_id, lang FROM documents").df().set_index("doc_id").lang
    lang = queries.queries()["op10_language_id"](spark, SF).toPandas()
    assert all(lang.held_out == [crc(i, 4) == 2 for i in lang.doc_id])
    held = lang[lang.held_out & (lang.lang_pred != "und")]
    assert (held.lang_pred == docs[held.doc_id].to_numpy()).mean() > 0.95
    toxic = duck.sql("SELECT doc_id, toxic FROM labels").df().set_index("doc_id").toxic
    tox = queries.queries()["op6_toxicity"](spark, SF).toPandas()
    assert all(tox.held_out == [crc(i, 5) == 0 for i in tox.doc_id])
    known = tox[tox.doc_id.isin(toxic.index)]
    assert (known.predicted == toxic[known.doc_id].to_numpy()).mean() > 0.9


def test_contract_columns(spark):
    want = {
        "op1_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op3_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op7_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    }
    for name, columns in want.items():
        df = queries.queries()[name](spark, SF)
        assert df.columns[: len(columns)] == columns and df.count() == 200


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, hits int, n_entities string, lang_pred string, __key string"


@pytest.fixture
def corpus(spark, tmp_path):
    """A small corpus with repeated rows and ids, copies, passages of a benchmark, personal data and
    columns that are called like results; and its rows."""
    rng = np.random.default_rng(41)
    words = {"en": "the of and where house river green walk under letter seven bright".split(), "de": "der und nicht straße über grün fluss wald sieben brief größe haus".split()}
    make = lambda k, n: " ".join(rng.choice([w + x for w in words[k] for x in ("", "ly", "er", "ung")], n))
    t1, t2, t3, bench = make("en", 80), make("de", 80), make("en", 80), make("en", 30)
    texts = [(1, None), (2, ""), (3, "12 34 !"), (4, t1), (9, t1), (9, t2), (9, t2), (10, t3 + " more"), (6, t3), (None, t3), (None, make("de", 30)), (20, make("en", 20) + " " + bench), (30, make("en", 40) + " a@b.org and Mr. John Smith, John Smith")]
    texts += [(100 + i, make("en" if i % 2 else "de", int(rng.integers(15, 60)))) for i in range(60)]
    rows = [(i, t, "en" if k % 2 else "de", f"s{k % 4}", len(t or ""), "own", k, "own", "own", "own") for k, (i, t) in enumerate(texts)]
    for name, lang in (("en", "en"), ("de", "de")):  # labels agree with the words
        rows = [(*r[:2], lang, *r[3:]) if r[1] and any(w in r[1].split() for w in words[name]) else r for r in rows]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q1", bench), ("q2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def links(rows):
    """Root of each row by brute force: rows whose sets of shingles are similar are linked."""
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = []
    for r in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (r[1] or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root = [root[b] if r == root[a] else r for r in root]
    return root


def staged(spark, name, docs, sf_dir):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    out.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}-{uuid.uuid4().hex}")
    return spark.read.parquet(path)


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_pipeline_against_brute_force(spark, corpus):
    sf_dir, rows = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = staged(spark, "language_id", docs, sf_dir)
    # the two languages share no word, so that a text with letters is told
    want = [r for r in rows if re.search("[a-z]", r[1] or "")]
    assert as_rows(told) == Counter(want) and told.columns == docs.columns

    apart = staged(spark, "near_dedup", told, sf_dir)
    root = links(want)
    groups = {}
    for r, k in zip(want, root, strict=True):
        groups.setdefault(k, []).append(r)
    assert max(map(len, groups.values())) == 3
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0, r)) for g in groups.values()]
    assert Counter((r[0], r[1]) for r in kept) == Counter((r.doc_id, r.text) for r in apart.collect())
    assert not as_rows(apart) - Counter(want) and {(6,), (4,)} <= {(r.doc_id,) for r in apart.collect()}
    assert [r.text for r in apart.where("doc_id = 9").collect()] == [rows[5][1]]  # its other text was a copy

    clean = staged(spark, "decontaminate", apart, sf_dir)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id = 'q1'").first().text.split()
    windows = {" ".join(bench[k : k + 10]) for k in range(21)}
    assert as_rows(clean) == Counter(r for r in as_rows(apart).elements() if not any(w in r[1] for w in windows))
    assert clean.where("doc_id = 20").isEmpty()

    safe = staged(spark, "pii", clean, sf_dir)
    before, after = as_rows(clean), as_rows(safe)
    assert [r[0] for r in (before - after).elements()] == [30] and safe.columns == docs.columns
    new = safe.where("doc_id = 30").first()
    assert not re.search("a@b.org|John|Smith", new.text) and new.n_chars == len(new.text) and (new.n_entities, new.score, new["__key"]) == ("own",) * 3

    packed = staged(spark, "packing", safe, sf_dir)
    from test_pipeline_operators import brute_best_fit, library

    t, pieces = library(), []
    for r in safe.collect():
        pieces.append((-len(t.encode(r.text, add_special_tokens=False).ids), r.doc_id is not None, r.doc_id, r.source, r.text))
    pieces.sort(key=lambda p: (p[0], not p[1], p[2] or 0))
    got = packed.orderBy(F.desc("size"), F.col("doc_id").asc_nulls_last()).collect()
    assert [(r.doc_id, r["size"], r.text) for r in got] == [(p[2], -p[0], p[4]) for p in pieces]
    bins = brute_best_fit([(-p[0], p[3], p[4]) for p in pieces], corpus_pipeline.BIN_TOKENS)  # one batch
    number = {}
    assert [number.setdefault(r.bin_id, len(number)) for r in got] == [number_of(bins, k) for k in range(len(bins))]


def number_of(bins, k):
    """Bins numbered by their first piece."""
    return list(dict.fromkeys(bins)).index(bins[k])


def test_pipeline_runs_its_stages(spark, corpus):
    sf_dir, rows = corpus
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.collect()} == {None, 4, 6, 9, 30, *range(100, 160)}
    assert out.groupBy("bin_id").sum("size").where(f"`sum(size)` > {corpus_pipeline.BIN_TOKENS}").isEmpty()


def test_pipeline_on_the_generated_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    kept = queries.queries()["op5_near_dedup"](spark, SF).where("kept").count()
    n = out.select("doc_id").distinct().count()
    assert 0.8 * kept <= n <= kept and out.select("doc_id").exceptAll(docs.select("doc_id")).where("doc_id IS NULL").isEmpty()


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_stage_takes_maps_and_structs(spark, tmp_path):
    prose = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, prose, {"a": 1}, (2, [3])), (1, prose, {"a": 1}, (2, [3])), (2, prose + " more", {"b": 1}, None), (3, "other words of its own", None, None)], "doc_id long, text string, tags map<string,int>, more struct<x:int,y:array<int>>")
    docs.write.parquet(str(tmp_path / "docs"))
    got = corpus_pipeline.near_dedup_stage(spark, spark.read.parquet(str(tmp_path / "docs")), "")
    assert sorted((r.doc_id, r.tags) for r in got.collect()) == [(1, {"a": 1}), (3, None)]
