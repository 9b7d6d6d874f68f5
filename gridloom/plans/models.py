"""Queries: training table, forest models, posterior quantiles (SURVEY H)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.functions.grid import with_folds
from gridloom.functions.sized import shared_dir
from gridloom.operators import climate, evaluate, features, forests, models
from gridloom.plans.climate import _ROLLED, YEARS, _rolling_sql
from gridloom.plans.registry import query, r6
from gridloom.plans.tables import SUPPLIERS
from gridloom.sources import models as sink

_YEARS = (1998, 1999, 2000)
_INDEX = ["ppt", "pet"]
_TOPO = ["slope", "elevation"]
_LAGS = 3


def _training(i):
    grid = with_folds(i.mortality, SUPPLIERS, 4)
    return features.training_table(grid, i.annual, i.topo, i.heat, "severity_code", _YEARS, _INDEX, _TOPO, _LAGS)


def _lag_sql() -> tuple[str, str]:
    cols, joins = [], []
    for b in range(6):
        joins.append(f"LEFT JOIN rolled a{b} ON a{b}.row = m.row AND a{b}.col = m.col AND a{b}.year = m.year - {b} LEFT JOIN heat h{b} ON h{b}.row = m.row AND h{b}.col = m.col AND h{b}.year = m.year - {b}")
        cols += [f'CASE WHEN a{b}.{v} = 0 THEN 0.0E0 ELSE a{b}.{v} END AS "{v}-{b + 1}"' for v in _ROLLED] + [f'round(h{b}.fraction_hot_days, 6) AS "fraction_hot_days-{b + 1}"']
    return ", ".join(cols), " ".join(joins)


@query("h01_training_table", f"""
    WITH rolled AS ({_rolling_sql('annual', 'row, col, year')})
    SELECT m.row, m.col, m.year, m.severity_code AS target, CAST(CAST(floor(m.col / 4.0) AS INT) + 3 * CAST(floor(m.row / 4.0) AS INT) AS INT) AS fold, CAST(m.row * 10 + m.col AS BIGINT) AS id, m.northing AS northings, m.easting AS eastings,
           round(t.slope, 6) AS slope, t.elevation, {_lag_sql()[0]}
    FROM mortality m JOIN topo t ON t.row = m.row AND t.col = m.col {_lag_sql()[1]}
    WHERE m.severity_code IS NOT NULL AND t.slope IS NOT NULL AND m.year IN (1998, 1999, 2000) AND a0.year IS NOT NULL AND h0.year IS NOT NULL""")
def _(i):
    grid = with_folds(i.mortality, SUPPLIERS, 4)
    t = features.training_table(grid, climate.rolling_indices(i.annual, years=YEARS), i.topo, i.heat, "severity_code", _YEARS, _ROLLED, _TOPO).drop("northing", "easting")
    return r6(t, "slope", *[c for c in t.columns if "-" in c])


@query("h02_fold_grid")
def _(i):
    t = _training(i)
    found, _ = models.fold_grid(t, features.feature_columns(t))
    return r6(evaluate.performance_matrix(found), "r2", "rmse")


@query("h02_importances")
def _(i):
    t = _training(i)
    _, importances = models.fold_grid(t, features.feature_columns(t))
    return importances


@query("h03_year_model")
def _(i):
    t = _training(i)
    names = features.feature_columns(t)
    return r6(models.apply_model(models.fit_year(t, names, 1999), t, names, (1998, 2001)).select("row", "col", "year", "target", "prediction"), "prediction")


@query("h04_severity_model")
def _(i):
    t = _training(i)
    names = features.feature_columns(t)
    model, _ = models.fit_severity(t, names, classes=False)
    return r6(models.apply_model(model, t, names, (1998, 2001)).select("row", "col", "year", "prediction"), "prediction")


@query("h05_leave_year_out")
def _(i):
    t = _training(i)
    out = models.leave_year_out(t, features.feature_columns(t))
    return r6(evaluate.balanced_accuracy(out, ["year"]), "balanced_accuracy")


@query("h06_apply_model")
def _(i):
    t = _training(i)
    names = features.feature_columns(t)
    path = f"{shared_dir(t.sparkSession)}/gridloom/severity-{uuid.uuid4().hex}"
    sink.save_model(*models.fit_severity(t, names), path)
    model, extra = sink.load_model(t.sparkSession, path)
    yearly = i.annual.join(i.heat, ["row", "col", "year"], "left")
    static = i.topo.withColumns({"eastings": SUPPLIERS.easting(F.col("col")), "northings": SUPPLIERS.northing(F.col("row"))})
    scored = models.apply_model(model, features.by_name(yearly, static, extra["features"], (1998, 2001)), extra["features"], (1998, 2001), "severity")
    return scored.select("row", "col", "year", "severity")




def _keyed_sql(seed: int, *parts: str) -> str:
    """WITH-less SQL: nested selects that carry h through the halves of each part."""
    out = f"SELECT *, {seed}::BIGINT AS h FROM draws"
    for part in parts:
        for half in (f"({part})::BIGINT & 4294967295", f"(({part})::BIGINT >> 32) & 4294967295"):
            out = f"SELECT * REPLACE ((h * 31 + ({half}) + 1) & 4294967295 AS h) FROM ({out}) q"
            for _ in range(2):
                out = f"SELECT * REPLACE ((xor(h, h >> 16) * 73244475) & 4294967295 AS h) FROM ({out}) q"
            out = f"SELECT * REPLACE (xor(h, h >> 16) AS h) FROM ({out}) q"
    return out


@query("h05_balanced_bootstrap", f"""
    WITH draws AS (SELECT t.tree, CAST(id * 10000 + eval_year AS BIGINT) AS key, CAST(floor(target) AS INT) % 5 AS target FROM predictions CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS tree) t),
    hashed AS ({_keyed_sql(0, "tree", "key")}),
    counted AS (SELECT tree, key, target, {" + ".join(f"(h >= {c})::INT" for c in forests.POISSON)} AS n FROM hashed),
    by_class AS (SELECT tree, target, sum(n) AS c FROM counted GROUP BY tree, target HAVING sum(n) > 0),
    weights AS (SELECT tree, target, sum(c) OVER (PARTITION BY tree) / (count(*) OVER (PARTITION BY tree) * c) AS weight FROM by_class)
    SELECT tree, target, count(*) AS rows, sum(n)::BIGINT AS drawn, sum(n * key % 9973)::BIGINT AS checksum, round(max(weight), 6) AS weight FROM counted LEFT JOIN weights USING (tree, target) GROUP BY tree, target""")
def _(i):
    rows = i.predictions.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tree"), (F.col("id") * 10_000 + F.col("eval_year")).cast("bigint").alias("key"), (F.floor("target").cast("int") % 5).alias("target"))
    drawn = forests.balanced_weights(rows)
    return r6(drawn.groupBy("tree", "target").agg(F.count("*").alias("rows"), F.sum("n").alias("drawn"), F.sum(F.col("n") * F.col("key") % 9973).alias("checksum"), F.max("weight").alias("weight")), "weight")


@query("h07_posterior_quantile", """
    WITH n AS (SELECT id, c1 + c2 + c3 + c4 + c5 AS t, * EXCLUDE (id) FROM class_counts),
    p AS (SELECT id, c1 / t AS p1, c2 / t AS p2, c3 / t AS p3, c4 / t AS p4, c5 / t AS p5 FROM n)
    SELECT id, round(CASE WHEN p1 >= 0.5 THEN 1 + 2 * 0.5 / p1 WHEN p1 + p2 >= 0.5 THEN 3 + 7 * (0.5 - p1) / p2 WHEN p1 + p2 + p3 >= 0.5 THEN 10 + 20 * (0.5 - p1 - p2) / p3
           WHEN p1 + p2 + p3 + p4 >= 0.5 THEN 30 + 20 * (0.5 - p1 - p2 - p3) / p4 ELSE 50 + 50 * (0.5 - p1 - p2 - p3 - p4) / p5 END, 6) AS percent FROM p""")
def _(i):
    counts = F.array(*[F.col(f"c{k}") for k in range(1, 6)])
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    p = i.class_counts.select("id", F.transform(counts, lambda c: c / total).alias("p"))
    return r6(p.select("id", models.posterior_quantile(F.col("p"), list(features.RANGES.values())).alias("percent")), "percent")


@query("h05_class_weights", """
    SELECT id, eval_year AS year, round(700.0E0 * 7 / (k * n), 6) AS weight FROM predictions p JOIN (SELECT CAST(floor(target) AS INT) % 5 AS c, count(*) AS n FROM predictions GROUP BY CAST(floor(target) AS INT) % 5) g
    ON g.c = CAST(floor(p.target) AS INT) % 5 CROSS JOIN (SELECT count(DISTINCT CAST(floor(target) AS INT) % 5) AS k FROM predictions) q""".replace("700.0E0 * 7", "(SELECT count(*) FROM predictions)"))
def _(i):
    rows = i.predictions.select("id", F.col("eval_year").alias("year"), (F.floor("target").cast("int") % 5).alias("target"))
    return r6(models.class_weights(rows).select("id", "year", "weight"), "weight")
