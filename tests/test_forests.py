"""Forests: the distributed trainer against a plain one, bootstrap counts, stored models, one-pass scoring."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from gridloom.operators import forests, models
from gridloom.sources import models as sink

NAMES = ["a", "b", "c", "d", "e"]


def sample(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)), 3)
    x[:, 4] = 1.0  # constant
    y = 1 + ((x[:, 0] > 0).astype(int) + 2 * (x[:, 1] + 0.3 * x[:, 2] > 0.5)) % 4
    return x, y.astype(float), rng.integers(0, 3, n)


def table(spark, x, y, year):
    return spark.createDataFrame([(int(i * 7 - 2**40), *map(float, r), float(t), int(g)) for i, (r, t, g) in enumerate(zip(x, y, year, strict=True))], "key long, a double, b double, c double, d double, e double, target double, year int")


def plain_tree(tree, x, y, count, classes, tries, depth, seed, balanced):
    """{node: (feature, threshold, value)} by recursion over one tree's rows."""
    tally = np.array([count[y == c].sum() for c in classes]) if classes is not None else None
    weight = None
    if classes is not None:
        weight = np.array([tally.sum() / ((tally > 0).sum() * t) if t and balanced else float(not balanced or t > 0) for t in tally])
    out = {}

    def impurity(rows):
        if classes is None:
            n = count[rows].sum()
            return n, (count[rows] * y[rows] ** 2).sum() - (count[rows] * y[rows]).sum() ** 2 / n if n else 0.0
        w = np.array([count[rows][y[rows] == c].sum() for c in classes]) * weight
        return w.sum(), w.sum() - (w * w).sum() / w.sum() if w.sum() else 0.0

    def grow(node, rows, level):
        n, impure = impurity(rows)
        value = [(count[rows] * y[rows]).sum() / n] if classes is None else (np.array([count[rows][y[rows] == c].sum() for c in classes]) * weight / n).tolist()
        out[node] = (-1, 0.0, value)
        if level == depth or count[rows].sum() < 2 or impure <= 1e-9 * n:
            return
        able = [f for f in range(x.shape[1]) if x[rows, f].min() < x[rows, f].max()]
        able = sorted(able, key=lambda f: (int(forests.keyed(seed + 1, tree, node, f)), f))[:tries]
        best = None
        for f in sorted(able):
            low, high = x[rows, f].min(), x[rows, f].max()
            bound = low + float(forests.keyed(seed + 2, tree, node, f)) / 2.0**32 * (high - low)
            left, right = rows[x[rows, f] <= bound], rows[x[rows, f] > bound]
            gain = impure - impurity(left)[1] - impurity(right)[1]
            if best is None or gain > best[0] + 1e-9:
                best = gain, f, bound, left, right
        if best:
            out[node] = (best[1], best[2], value)
            grow(2 * node + 1, best[3], level + 1)
            grow(2 * node + 2, best[4], level + 1)

    grow(0, np.flatnonzero(count), 0)
    return out


@pytest.mark.parametrize(("classes", "balanced", "hold"), [(True, False, False), (True, True, True), (False, False, True)])
def test_extra_trees_equal_a_plain_trainer(spark, classes, balanced, hold):
    x, y, year = sample()
    if not classes:
        y = y * 2.5
    key = np.arange(len(y)) * 7 - 2**40
    got = forests.extra_trees(table(spark, x, y, year).repartition(5), NAMES, classes, trees=4, depth=4, seed=9, balanced=balanced, hold_out="year" if hold else None)
    assert sorted(got, key=str) == ([0, 1, 2] if hold else [None])
    known, tries = (np.unique(y), 2) if classes else (None, 5)
    for k, g in enumerate(got):
        for t in range(4):
            count = np.searchsorted(np.array(forests.POISSON, np.uint64), forests.keyed(9, k * 4 + t, key), side="right")
            count[year == g] = 0
            want = plain_tree(k * 4 + t, x, y, count, known, tries, 4, 9, balanced)
            for node, (f, bound, value) in want.items():
                assert (got[g].feature[t, node], got[g].threshold[t, node]) == (f, bound), (g, t, node)
                assert got[g].value[t, node] == pytest.approx(value, abs=1e-9)
            assert (got[g].feature[t] >= 0).sum() == sum(f >= 0 for f, *_ in want.values())


def test_extra_trees_in_rounds_are_the_same_and_learn(spark, monkeypatch):
    x, y, year = sample(600)
    rows = table(spark, x, y, year)
    whole = forests.extra_trees(rows, NAMES, trees=30, depth=6)[None]
    monkeypatch.setattr(forests, "ROUND_BYTES", 40_000)
    parts = forests.extra_trees(rows.repartition(7), NAMES, trees=30, depth=6)[None]
    assert (whole.feature == parts.feature).all() and (whole.threshold == parts.threshold).all() and (whole.value == parts.value).all()
    assert (whole.predictions(whole.outputs(x)) == y).mean() > 0.85


def test_counts_and_weights_are_those_of_the_trainer(spark):
    keys = [0, 1, -5, 2**40 + 3, -(2**63), 2**63 - 1]
    got = spark.createDataFrame([(t, k) for t in range(3) for k in keys], "t int, k long").select("t", "k", forests.keyed_column(4, F.col("t"), F.col("k")).alias("h"), forests.bootstrap_count(4, F.col("t"), F.col("k")).alias("n")).collect()
    for r in got:
        h = int(forests.keyed(4, r.t, r.k))
        assert r.h == h and r.n == sum(h >= c for c in forests.POISSON)
    n = np.searchsorted(np.array(forests.POISSON, np.uint64), forests.keyed(0, 5, np.arange(100_000)), side="right")
    assert abs(n.mean() - 1) < 0.02 and abs(n.var() - 1) < 0.03


def test_spark_forest_as_arrays(spark):
    x, y, year = sample()
    rows = VectorAssembler(inputCols=NAMES, outputCol="features").transform(table(spark, x, y, year))
    model = RandomForestRegressor(labelCol="target", numTrees=7, maxDepth=5, seed=2).fit(rows)
    want = [r.prediction for r in model.transform(rows).orderBy("key").collect()]
    forest = forests.from_spark(model, NAMES)
    assert forest.predictions(forest.outputs(x)) == pytest.approx(want)


def grid(spark):
    x, y, year = sample(240, 3)
    return table(spark, x, y, year + 2000).withColumn("id", F.col("key")).withColumn("fold", F.pmod("key", F.lit(4)).cast("int"))


def test_fold_grid_scores_in_one_pass_as_models_do_one_by_one(spark, monkeypatch):
    rows = grid(spark)
    fitted, of_fold = {}, {}
    arrays, one_pass = models.from_spark, models.score

    def noted(model, features):
        forest = arrays(model, features)
        fitted[id(forest)] = model
        return forest

    monkeypatch.setattr(models, "from_spark", noted)
    monkeypatch.setattr(models, "score", lambda table, by_fold, *rest: of_fold.update(by_fold) or one_pass(table, by_fold, *rest))
    found, importances = models.fold_grid(rows, NAMES, trees=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 0
    got = {(r.train_year, r.fold, r.id, r.eval_year): r.prediction for r in found.collect()}
    ready, seen = models.assembled(rows, NAMES, 100.0), 0
    for fold, own in of_fold.items():
        for year, forest in own[:1]:
            for r in fitted[id(forest)].transform(ready.where(F.col("fold") == fold)).collect():
                assert got[year, fold, r.id, r.year] == pytest.approx(r.prediction)
                seen += 1
    assert seen == rows.count()
    assert len(got) == 3 * rows.count() and importances.count() == 12 * 5
    monkeypatch.setattr(forests, "MODEL_BYTES", 1)
    again, _ = models.fold_grid(rows, NAMES, trees=5)
    assert {(r.train_year, r.fold, r.id, r.eval_year): r.prediction for r in again.collect()}.keys() == got.keys()


def test_stored_models_score_alike_in_another_session(spark, tmp_path):
    rows = grid(spark)
    for classes in (True, False):
        model, extra = models.fit_severity(rows.withColumn("target", F.least("target", F.lit(5.0))), NAMES, classes, trees=6)
        path = str(tmp_path / f"severity-{classes}")
        sink.save_model(model, extra, path)
        sink.save_model(model, extra, path)  # replaces
        again, document = sink.load_model(spark, path)
        assert document == extra and document["features"] == NAMES and document["ranges"]["5"] == [50, 100]
        first, second = (models.apply_model(m, rows, NAMES, (2000, 2002)).orderBy("key").collect() for m in (model, again))
        assert first == second and len(first) > 0
    year = models.fit_year(rows, NAMES, 2001, trees=3)
    sink.save_model(year, {"features": NAMES}, str(tmp_path / "year"))
    want = [r.prediction for r in models.apply_model(year, rows, NAMES, (2000, 2003)).orderBy("key").collect()]
    rows.write.parquet(str(tmp_path / "rows"))
    code = f"""
from pyspark.sql import SparkSession
from gridloom.operators import models
from gridloom.sources import models as sink
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
model, document = sink.load_model(spark, {str(tmp_path / "year")!r})
rows = spark.read.parquet({str(tmp_path / "rows")!r})
print("GOT", [r.prediction for r in models.apply_model(model, rows, document["features"], (2000, 2003)).orderBy("key").collect()])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parent.parent, check=True).stdout
    assert next(line for line in out.split("\n") if line.startswith("GOT")) == f"GOT {want}"


def test_missing_features_and_probabilities(spark):
    rows = grid(spark)
    model, _ = models.fit_severity(rows, NAMES, trees=5)
    holes = rows.withColumn("a", F.when(F.col("key") % 2 == 0, F.col("a")))
    got = models.apply_model(model, holes, NAMES, (2000, 2003), "severity", probability="p").collect()
    assert len(got) == rows.count()
    assert all((r.severity is None) == (r.a is None) == (r.p is None) for r in got)
    assert all(sum(r.p) == pytest.approx(1) and len(r.p) == 4 for r in got if r.p)
