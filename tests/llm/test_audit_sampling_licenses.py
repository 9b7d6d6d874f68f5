"""The filter audit, the resampling and the license scan against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import filter_audit, licenses, resampling
from gridloom.llm.licenses import TEMPLATES, Template, template_words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LONG = "id long, text string, part string, n long, failed string, digit string"


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


# --- filter audit ---------------------------------------------------------------------------------


def awkward_docs():
    long_text = " ".join(f"w{i}" for i in range(150))
    rows = [(1, None, "en"), (2, "", None), (3, long_text, "en"), (4, long_text, "de"), (5, long_text.upper(), "en"), (6, "a " * 200, ""), (7, "# " + long_text, "fr"), (7, "# " + long_text, "fr"), (7, "other text", "fr"), (None, long_text, "en"), (None, None, "de")]
    return rows + [(100 + i, "copied \t text", "hot") for i in range(40)] + [(200 + i, f"{long_text} {i % 3} {'ABC' * (i % 50)}", "en") for i in range(30)] + [(9, "ÄÖ" * 400 + "\x0b" + long_text, "de")]


def brute_audit(docs, labels):
    first, good, toxic = {}, {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        if i is None:
            continue  # a null id has no labels
        good[i], toxic[i] = max(good.get(i, 0), int(q == 1)), max(toxic.get(i, 0), int(x == 1))
    fails = []
    for i, t, _ in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append({k for k, v in f.items() if v})
    out = {}
    for part in {p or "" for _, _, p in docs}:
        own = [(d[0], f) for d, f in zip(docs, fails, strict=True) if (d[2] or "") == part]
        total = Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                removed = [(i, x) for i, x in own if f in x and not x & before]
                total[f] += len(removed)
                out[part, "".join(order), k + 1] = [sum(not x & (before | {f}) for _, x in own), len(removed), sum(f in x and bool(x & before) for _, x in own), sum(x == {f} for _, x in own), sum(good.get(i, 0) for i, _ in removed), sum(toxic.get(i, 0) for i, _ in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_brute_force(spark):
    docs = awkward_docs()
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, None), (4, None, 1), (7, 1, 1), (101, 0, 1), (102, 1, 0), (9999, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame([(i, t, p, 1, "x", "y") for i, t, p in docs], LONG).repartition(3)
    marks = spark.createDataFrame(labels, "id long, good int, toxic int").fillna(0)
    rows, fails = filter_audit.failing_tables(table, id_col="id", part_col="part")
    assert sorted(fails) == list("ABCDE")
    got = filter_audit.audit(filter_audit.failed_classes(rows, fails, marks), list(fails))
    result = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got.collect()}
    assert result == brute_audit(docs, labels)


def test_audit_of_nothing_and_of_own_filters(spark):
    none = spark.createDataFrame([], LONG)
    no_labels = spark.createDataFrame([], "id long, good int, toxic int")
    rows, fails = filter_audit.failing_tables(none, id_col="id", part_col="part")
    assert filter_audit.audit(filter_audit.failed_classes(rows, fails, no_labels), list(fails)).count() == 0
    own = {"short": lambda text, words: F.size(words) < 2, "again": None}
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x"), (3, "a", "x"), (4, "a", "x")], "id long, text string, part string")
    rows, fails = filter_audit.failing_tables(docs, own, id_col="id", part_col="part")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(filter_audit.failed_classes(rows, fails, no_labels), list(fails)).collect()}
    assert got == {("shortagain", 1): (2, 2, 0, 1, 3), ("shortagain", 2): (1, 1, 1, 1, 3), ("againshort", 1): (2, 2, 0, 1, 3), ("againshort", 2): (1, 1, 1, 1, 3)}


# --- resampling -----------------------------------------------------------------------------------


def brute_sample(docs, target, buckets=10_000, seed=2024, least=20, percent=10):
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = Counter(bucket(w) for _, x in docs for w in words(x)), Counter(bucket(w) for x in target for w in words(x))
    ns, nt, rows = sum(s.values()), sum(t.values()), []
    for i, x in docs:
        own = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in map(bucket, words(x))]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[: len(able) * percent // 100]
    rest = Counter(rows) - Counter(drawn)
    return sorted([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in rest.elements()], key=str)


@pytest.mark.parametrize("percent", [10, 55, 100])
def test_sample_against_brute_force(spark, percent):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(300)] + ["é", "日本", "a1"]
    docs = [(i * 7 - 2**62 if i % 5 else i, " ".join(rng.choice(vocabulary, 10 + i % 40))) for i in range(400)]
    hot = " ".join(rng.choice(vocabulary, 30))
    docs += [(5000, hot)] * 300 + [(5000, hot + " more words"), (None, hot), (None, None), (8, None), (9, ""), (10, "-- !!"), (11, "X" * 5000), (12, " ".join(rng.choice(vocabulary, 30_000)))]
    target = [" ".join(rng.choice(vocabulary[:40], 50)), None, ""]
    table = spark.createDataFrame([(i, t, "p", 1, "x", "y") for i, t in docs], LONG).repartition(5)
    got = resampling.importance_sample(table, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, id_col="id")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_sample(docs, target, percent=percent)


def test_radix_ranks_sort_any_keys(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(n), int(n) - 5, int(s)) for i, n, s in zip(rng.integers(-(2**63), 2**63 - 1, 3000), rng.integers(0, 9, 3000), rng.integers(-40, 40, 3000) ** 3, strict=True)]
    rows += [(2**63 - 1, 1, 0, 64000), (-(2**63), 1, 0, -64000), (0, 1, 0, 64000)]
    got = resampling.radix_ranks(spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(7)).orderBy("rank").collect()
    assert [tuple(r)[:4] for r in got] == sorted(rows, key=lambda r: (-r[3], r[0]))
    assert [r.rank for r in got] == list(range(1, len(rows) + 1))


def test_equal_keys_and_no_rows(spark):
    kind = "doc_id long, n_features long, weight long, score long"
    same = resampling.radix_ranks(spark.createDataFrame([(1, 2, 3, 4)] * 9 + [(1, 1, 3, 4)], kind)).orderBy("rank").collect()
    assert [r.rank for r in same] == list(range(1, 11)) and same[0].n_features == 1
    assert resampling.radix_ranks(spark.createDataFrame([], kind)).count() == 0
    none = spark.createDataFrame([], LONG)
    assert resampling.importance_sample(none, none, id_col="id").count() == 0
    one = spark.createDataFrame([(1, "a " * 30, "p", 1, "x", "y")], LONG)
    assert [r.rank for r in resampling.importance_sample(one, none, id_col="id").collect()] == [None]
    with pytest.raises(TypeError):
        resampling.importance_sample(one, none, id_col="part")


# --- license scan ---------------------------------------------------------------------------------


def brute_licenses(texts, templates=TEMPLATES):
    """Labels, score and base places of each text, by plain loops."""
    own, all_words = [template_words(t.text) for t in templates], [words(t) for t in texts]
    df = Counter(w for ws in all_words for w in set(ws))
    rare = []
    for ws in own:
        ranked = sorted(set(ws), key=lambda w: (df[w], w))
        rare.append(ranked[: min(licenses.INDEXED, max(min(len(ranked), 3), math.ceil(len(ranked) / 2)))])
    longest = max(map(len, own))
    for ws in all_words:
        base = {(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()}
        labels, score = {x for _, x in base}, licenses.BASE_SCORE if base else 0.0
        for template, tw, index in zip(templates, own, rare, strict=True):
            looked = [w for w in index if w in set(ws)][: licenses.LOOKUPS]
            if len(looked) < max(min(2, len(index)), math.ceil(licenses.SHARE * min(licenses.LOOKUPS, len(index)))):
                continue
            whole = sum(w in index[: licenses.LOOKUPS] for w in tw)
            for grid in range(2):
                shift, cells = longest + grid * licenses.DRIFT // 2, {}
                for i, w in enumerate(ws):
                    for p, v in enumerate(tw):
                        if w == v and w in looked:
                            cells.setdefault((i - p + shift) // licenses.DRIFT, set()).add(p)
                for cell, at in cells.items():
                    share = min(1.0, len(at) / whole)
                    first = max(0, cell * licenses.DRIFT - shift - licenses.SLACK)
                    span = " " + " ".join(ws[first : first + len(tw) + licenses.DRIFT + 2 * licenses.SLACK]) + " "
                    if share >= licenses.SHARE and all(f" {m} " in span for m in template.mandatory):
                        labels.add(template.label)
                        score = max(score, share)
        at = sorted(i for i, _ in base)
        yield len(ws), len(base), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score


def license_texts():
    rng = np.random.default_rng(8)
    prose = lambda n: " ".join(rng.choice("the of and copy may file data work any use is in this license version x9 é".split(), n))
    out = [None, "", " - ", "MIT", "MIT license mit-LICENSE", "cc by CC-BY apache\nlicense", prose(3000), "license " * 2000, "GNU general public license " * 3]
    for t in TEMPLATES:
        tw = t.text.split()
        out += [t.text, prose(40) + " " + t.text.upper() + " " + prose(30), " ".join(w for k, w in enumerate(tw) if k % 9 != 8), " ".join(tw[: len(tw) // 2]), " ".join(tw[::-1]), t.text + " ... " + t.text.replace(" ", "\n * ")]
    return out + [" ".join(t.text for t in TEMPLATES)]


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_licenses_against_brute_force(spark):
    texts = license_texts()
    table = spark.createDataFrame([(i, t, "p", i, "x", "y") for i, t in enumerate(texts)], LONG).repartition(3)
    got = {r.id: tuple(r[n] for n in NAMES) for r in licenses.scan(table).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute_licenses(texts))


def test_every_notice_is_found_and_mandatory_phrases_count(spark):
    texts = [f"some words before {t.text} and some after" for t in TEMPLATES] + [t.text.replace("Permission is hereby granted, free of charge", "Permission is hereby refused, at any price") for t in TEMPLATES[:1]]
    rows = licenses.scan(spark.createDataFrame([(i, t, "p", 1, "x", "y") for i, t in enumerate(texts)], LONG)).orderBy("id").collect()
    for t, r in zip(TEMPLATES, rows, strict=False):
        assert t.label in r.labels.split(",") and r.score == 1.0
        assert any(x.label == t.label and abs(x.first_word - 3) <= licenses.DRIFT for x in r.licenses)
    assert rows[-1].labels == "" and rows[-1].score == 0


def test_license_scan_keeps_columns_and_takes_own_templates(spark):
    docs = spark.createDataFrame([(1, "free as in speech, house rules apply", "k", 2), (None, None, "m", 3)], "id long, text string, score string, __words long")
    own = [Template("house", "Free as in speech: house rules apply", ("house rules apply",))]
    got = licenses.scan(docs, templates=own, phrases={"in speech": "said"}).orderBy("__words").collect()
    assert [(r["__words"], r.labels, r.base_labels, r.score) for r in got] == [(2, "house,said", "said", 1.0), (3, "", "", 0.0)]
    empty = spark.createDataFrame([], LONG)
    assert licenses.scan(empty).count() == 0


def test_license_scan_runs_no_python(spark, tmp_path):
    spark.createDataFrame([(1, TEMPLATES[0].text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = licenses.op13_license_scan(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "RDD" not in plan
