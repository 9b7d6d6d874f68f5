"""Operators on hand-made tables: seams, gaps, leap years, clips, terrain, models, sources."""

from __future__ import annotations

import datetime as dt
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import climate, evaluate, features, heat, models, projection, spatial, stdindex, terrain
from gridloom.sources import ascii_grid, tables


def test_water_year_seam_and_poison(spark):
    rows = [(0, 0, dt.datetime(1999, 9, 1), 1.0, 5.0), (0, 0, dt.datetime(1999, 10, 1), 2.0, 3.0), (0, 0, dt.datetime(2000, 1, 1), 4.0, 1.0), (0, 0, dt.datetime(2000, 10, 1), None, 2.0)]
    df = spark.createDataFrame(rows, "row int, col int, time timestamp, ppt double, tmn double")
    got = {r.year: (r.ppt, r.tmn) for r in climate.water_year(df).collect()}
    assert got == {1999: (1.0, 5.0), 2000: (6.0, 1.0), 2001: (None, 2.0)}
    assert {r.ppt for r in climate.water_year(df, expected_months=12).collect()} == {None}


def test_rolling_over_gaps(spark):
    rows = [(0, 0, y, float(y - 1990), 0.0) for y in (1991, 1992, 1994, 1995)] + [(0, 1, y, 1.0, 0.5) for y in range(1991, 1996)]
    df = spark.createDataFrame(rows, "row int, col int, year int, ppt double, pet double")
    got = {(r.col, r.year): r.PR2 for r in climate.rolling_indices(df, spans=(2,)).collect()}
    assert got[0, 1992] == 3.0 and got[0, 1994] is None and got[0, 1995] == 9.0 and got[1, 1993] == 2.0 and got[1, 1991] is None
    with pytest.raises(ValueError, match="unknown index"):
        climate.index_suite(df, (1991, 1993), (1994, 1995), names=("PDSI",))


def test_spi_is_standard_on_its_reference(spark):
    rng = np.random.default_rng(1)
    rows = [(c, 0, 1980 + y, float(v), 0.0) for c in range(40) for y, v in enumerate(rng.gamma(3.0, 20.0, 26))]
    df = spark.createDataFrame(rows, "row int, col int, year int, ppt double, pet double")
    out = climate.index_suite(df, (1980, 2005), (1980, 2005), spans=(1,)).toPandas()
    for c in ("SPI1", "SPEI1"):
        assert abs(out[c].mean()) < 0.1 and abs(out[c].std() - 1) < 0.12
    assert out[["PR1", "SPI1"]].corr(method="spearman").iloc[0, 1] > 0.97


def test_spi_zeros_tails_and_degenerate_fits():
    x = np.array([0.0, 5.0, 1e9, 3.0])
    got = stdindex.gamma_scores(x, np.array([0.5, 0.0, 0.0, 0.0]), np.array([4.0, 4.0, 4.0, np.nan]), np.array([1.0, 1.0, 1.0, np.nan]))
    assert got[0] == 0.0 and 0 < got[1] < 2 and got[2] == np.inf and np.isnan(got[3])


def test_shifted_gamma_fit_beats_other_locations():
    rng = np.random.default_rng(3)
    v = rng.gamma(4.0, 2.0, (5, 30)) - 7
    shape, loc, scale = stdindex.shifted_gamma_fit(v, np.full(5, 30))

    def like(k, at):
        m, ml = v[k].mean() - at, np.log(v[k] - at).mean()
        a = stdindex.gamma_shape(np.array([np.log(m) - ml]))[0]
        return (a - 1) * ml - a - a * np.log(m / a) - stdindex.gammaln(np.array([a]))[0], a

    for k in range(5):
        best = like(k, loc[k])[0]
        for at in v[k].min() - np.geomspace(0.05, 100, 60):
            other, a = like(k, at)
            assert a < 1 or best >= other - 1e-6
    assert np.isnan(stdindex.shifted_gamma_fit(np.ones((1, 5)), np.array([5]))[0]).all()


def test_daily_statistics_midnight_and_leap(spark):
    rows = [(dt.datetime(2000, 1, 1, 0, 0), 1.0), (dt.datetime(2000, 2, 29, 12, 0), 9.0), (dt.datetime(2000, 3, 1, 12, 0), 5.0), (dt.datetime(2001, 3, 1, 12, 0), 6.0), (dt.datetime(2000, 12, 31, 12, 0), 7.0)]
    df = spark.createDataFrame([(0.0, 0.0, *r) for r in rows], "latitude double, longitude double, time timestamp_ntz, t2m double")
    got = {(r.year, r.dayofyear): r.t2m_max for r in heat.daily_statistics(df, (1999, 2001)).collect()}
    assert got == {(1999, 365): 1.0, (2000, 60): 5.0, (2001, 60): 6.0, (2000, 365): 7.0}


def test_hot_days_count_missing_as_not_hot(spark):
    days = spark.createDataFrame([(0, 2000, 30.0, 20.0, 25.0), (0, 2000, 30.0, None, None), (0, 2000, 25.0, 15.0, 25.0), (1, 2000, None, 1.0, 1.0)], "cell int, year int, t2m_max double, normal double, high double")
    got = {r.cell: round(r.fraction_hot_days, 4) for r in heat.hot_day_fraction(days, keys=["cell"]).collect()}
    assert got == {0: 0.3333, 1: 0.0}


def test_point_in_polygon_with_hole_and_concave():
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]
    x, y = np.array([0.5, 2.0, 5.0, 0.0, 4.0]), np.array([0.5, 2.0, 1.0, 2.0, 2.0])
    assert spatial.inside_rings(x, y, [outer, hole]).tolist() == [True, False, False, True, False]
    star = [(0, 0), (4, 0), (2, 1), (4, 4), (0, 4)]
    assert spatial.inside_rings(np.array([3.5, 1.0]), np.array([1.5, 1.0]), [star]).tolist() == [False, True]


def test_clip_default_own_year_and_none(spark):
    df = spark.createDataFrame([(0, c, c + 0.5, -0.5, y, v) for c in (0, 1) for y, v in ((1999, None), (2000, 3.0))], "row int, col int, easting double, northing double, year int, v double")
    kind = "region_id int, year int, rings array<array<struct<x: double, y: double>>>"
    box = lambda a, b: [[(a, -1.0), (b, -1.0), (b, 0.0), (a, 0.0)]]
    regions = spark.createDataFrame([(1, None, box(0.0, 1.0)), (2, 2000, box(1.0, 2.0))], kind)
    got = {(r.col, r.year): r.v for r in spatial.clip(df, regions, ["v"]).collect()}
    assert got == {(0, 1999): 0.0, (1, 1999): None, (0, 2000): None, (1, 2000): 3.0}
    assert spatial.clip(df, spark.createDataFrame([], kind), ["v"]) is df
    again = regions.unionByName(spark.createDataFrame([(1, 2001, box(0.0, 1.0)), (7, 2000, box(0.0, 1.0))], kind))  # one region for several years, a year with several
    assert {(r.col, r.year): r.v for r in spatial.clip(df, again, ["v"]).collect()} == got


def test_regions_by_scanlines_are_regions_by_broadcast(spark):
    kind = "region_id int, rings array<array<struct<x: double, y: double>>>"
    rng = np.random.default_rng(3)
    rings = {k: [[tuple(map(float, p)) for p in rng.integers(0, 41, (rng.integers(3, 9), 2)) * 0.5] for _ in range(rng.integers(1, 4))] for k in range(150)}
    rings[150], rings[151] = [[(-1e6, -1e6), (1e6, -1e6), (1e6, 1e6), (-1e6, 1e6)]], [[(0.0, 0.0), (5.0, 5.0)], []]
    shapes = [(k, r) for k, r in rings.items()]
    dirty = [(150, rings[150]), (152, [[(0.0, 0.0), (float("nan"), 3.0), (9.0, 0.0), (9.0, 9.0), (None, 4.0), (float("inf"), 1.0)]]), (153, None), (154, [])]
    rings[152] = [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)]]
    places = [(r, c, c * 0.25, r * 0.5) for r in range(45) for c in range(85)] + [(90, 0, 1e15, 3.0), (91, 0, 3.0, -1e15), (92, 0, None, 1.0), (93, 0, float("nan"), 1.0), (94, 0, 1.0, float("nan"))]
    cells = spark.createDataFrame(places, "row int, col int, easting double, northing double")
    x, y = (np.array([np.nan if p[k] is None else p[k] for p in places]) for k in (2, 3))
    want = sorted((*places[i][:2], k) for k, r in rings.items() for i in np.flatnonzero(spatial.inside_rings(x, y, [ring for ring in r if ring])))
    regions = spark.createDataFrame(shapes + dirty, kind)
    for limit in (0, 10**6):
        assert sorted(tuple(r) for r in spatial.cells_in_regions(cells, regions, limit).collect()) == want
    for a, b in ((cells.limit(0), regions), (cells, regions.limit(0))):
        assert all(spatial.cells_in_regions(a, b, limit).collect() == [] for limit in (-1, 0, 10**6))


def test_scanline_joins_meet_on_equal_keys(spark):
    square = "array(array(named_struct('x', {0}, 'y', {1}), named_struct('x', {0} + 3D, 'y', {1}), named_struct('x', {0} + 3D, 'y', {1} + 3D), named_struct('x', {0}, 'y', {1} + 3D)))"
    regions = spark.range(20_000).selectExpr("CAST(id AS INT) AS region_id", square.format("CAST(id % 197 AS DOUBLE)", "CAST(id * 7 % 193 AS DOUBLE)") + " AS rings")
    cells = spark.range(40_000).selectExpr("CAST(id / 200 AS INT) AS row", "CAST(id % 200 AS INT) AS col", "id % 200 + 0.5D AS easting", "CAST(id / 200 AS INT) + 0.5D AS northing")
    found = spatial.cells_in_regions(cells, regions)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text
    assert found.count() == 9 * 20_000
    assert found.groupBy("region_id").count().agg(F.min("count"), F.max("count")).first() == (9, 9)


def test_albers_round_trip_and_known_point(spark):
    p = spatial.Albers(lat1=34.0, lat2=40.5, lat0=0.0, lon0=-120.0, false_northing=-4_000_000.0)
    df = spark.createDataFrame([(-120.0, 38.0), (-118.3, 36.6), (-122.9, 41.2)], "lon double, lat double")
    fx, fy = p.forward(F.col("lon"), F.col("lat"))
    out = df.select("lon", "lat", fx.alias("x"), fy.alias("y"))
    bx, by = p.inverse(F.col("x"), F.col("y"))
    for r in out.select("*", bx.alias("lon2"), by.alias("lat2")).collect():
        assert abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-6
    s = spatial.Albers(lat1=29.5, lat2=45.5, lat0=23.0, lon0=-96.0, a=6378206.4, e2=0.00676866)  # Snyder's worked example
    x, y = s.forward(F.lit(-75.0), F.lit(35.0))
    got = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(got.x - 1885472.7) < 0.5 and abs(got.y - 1535925.0) < 0.5


def test_tiled_terrain_equals_whole(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(100, 10, (23, 31))
    z[4, 5] = np.nan
    df = spark.createDataFrame([(int(r), int(c), None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(23) for c in range(31)], "row int, col int, elevation double")
    got = terrain.terrain(df, w=5, radius=3, tile=8).orderBy("row", "col").toPandas()
    want = terrain.metrics(z, terrain.METRICS, 5, 1.0, 3)
    for m in terrain.METRICS:
        assert np.allclose(got[m].to_numpy(dtype=float).reshape(z.shape), want[m], equal_nan=True, atol=1e-8), m
    nulls = terrain.terrain(df, ("tpi",), w=5, tile=8).where("row = 4 AND col = 5 AND tpi IS NULL AND NOT isnan(coalesce(tpi, 0))")
    assert nulls.count() == 1


def test_terrain_on_a_plane():
    r, c = np.indices((15, 15))
    got = terrain.metrics(2.0 * c - 1.0 * r, terrain.METRICS, 5, 1.0, 3)
    mid = np.s_[6:9, 6:9]
    assert np.allclose(got["slope"][mid], np.degrees(np.arctan(np.hypot(2, 1))))
    assert np.allclose(got["vrm"][mid], 0, atol=1e-9) and np.allclose(got["adjsd"][mid], 0, atol=1e-6)
    assert np.allclose(got["sapa"][mid], 1) and np.allclose(got["tpi"][mid], 0)
    assert np.allclose(got["eastness"][mid], -2 / np.sqrt(5)) and np.allclose(got["northness"][mid], -1 / np.sqrt(5))
    flat = terrain.metrics(np.ones((9, 9)), ("slope", "eastness", "northness"), 3, 1.0)
    assert flat["slope"][4, 4] == flat["eastness"][4, 4] == flat["northness"][4, 4] == 0


def test_accumulation_and_survival(spark):
    df = spark.createDataFrame([(0, 0, 1, 10.0), (0, 0, 2, None), (0, 0, 3, 50.0), (0, 0, 4, 120.0), (0, 0, 5, -5.0)], "row int, col int, year int, v double")
    total = [r.t for r in projection.accumulated(df, "v", "t").orderBy("year").collect()]
    share = [round(r.s, 6) for r in projection.habitat_survival(df, "v", "s").orderBy("year").collect()]
    assert total == [10.0, None, None, None, None] and share == [90.0, 90.0, 45.0, 0.0, 0.0]


def test_posterior_quantile(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.2, 0.8],), ([0.0, 1.0],), ([1.0, 0.0],)], "p array<double>")
    got = [r[0] for r in df.select(models.posterior_quantile(F.col("p"), [(1.0, 3.0), (3.0, 10.0)])).collect()]
    assert np.allclose(got, [3.0, 3 + 7 * 0.3 / 0.8, 6.5, 2.0])
    assert np.isclose(df.limit(1).select(models.posterior_quantile(F.col("p"), [(1.0, 3.0), (3.0, 10.0)], 1.0)).first()[0], 10.0)


def test_metrics_of_constant_targets(spark):
    df = spark.createDataFrame([(1, 1, 1, 2.0, 2.0), (1, 1, 2, 2.0, 2.0), (1, 2, 1, 2.0, 3.0), (1, 2, 2, 2.0, 3.0)], "train_year int, eval_year int, id int, target double, prediction double")
    got = {r.eval_year: (r.r2, r.rmse) for r in evaluate.performance_matrix(df).collect()}
    assert got == {1: (1.0, 0.0), 2: (0.0, 1.0)}


def _table(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 3, 2000 + y, float(1 + (i + y) % 5), float(i % 7), float(rng.normal())) for i in range(60) for y in range(2)]
    return spark.createDataFrame(rows, "id long, fold int, year int, target double, `PR1-1` double, slope double")


def test_fold_grid_never_trains_on_its_fold(spark):
    t = _table(spark)
    found, importances = models.fold_grid(t, ["PR1-1", "slope"], trees=3, threads=2)
    p = found.toPandas()
    assert len(p) == 240 and set(p.train_year) == {2000, 2001} and not p.duplicated(["train_year", "eval_year", "id"]).any()
    assert importances.groupBy("train_year", "fold").agg(F.sum("importance").alias("s")).where("abs(s - 1) > 1e-6").isEmpty()


def test_leave_year_out_and_apply(spark):
    t = _table(spark).withColumn("row", F.col("id").cast("int")).withColumn("col", F.lit(0))
    assert models.leave_year_out(t, ["PR1-1", "slope"], trees=3).count() == 120
    model, extra = models.fit_severity(t, ["PR1-1", "slope"], trees=3)
    holes = t.withColumn("slope", F.when(F.col("id") > 5, F.col("slope")))
    out = models.apply_model(model, holes, extra["features"], (2000, 2001))
    assert out.count() == 60 and out.where("prediction IS NULL").count() == 6


def test_severity_tables(spark):
    df = spark.createDataFrame([(float(k),) for k in range(6)], "severity_code double")
    assert [r[0] for r in df.select(features.severity_midpoint(F.col("severity_code"))).collect()] == list(features.MIDPOINTS)


def test_archives(spark, tmp_path):
    grid = "ncols 2\nnrows 2\nxllcorner 100\nyllcorner 200\ncellsize 10\nNODATA_value -9999\n1 2\n3 -9999\n"
    with zipfile.ZipFile(tmp_path / "ppt1999.zip", "w") as z:
        z.writestr("ppt1999oct.asc", grid)
    got = {(r.row, r.col): (r.northing, r.easting, r.value, r.variable, str(r.time)) for r in ascii_grid.read_archives(spark, f"{tmp_path}/*.zip").collect()}
    assert got[0, 0] == (215.0, 105.0, 1.0, "ppt", "1999-10-01") and got[1, 1] == (205.0, 115.0, None, "ppt", "1999-10-01")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("notagrid.asc", grid)
    with pytest.raises(Exception, match="no (variable|month) in notagrid"):
        ascii_grid.read_archives(spark, f"{tmp_path}/bad.zip").collect()
    with pytest.raises(ValueError, match="lacks nodata_value"):
        ascii_grid.parse_grid(grid.replace("NODATA", "X").encode())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 2000, 1.0, 2.0), (0, 1, 2001, 3.0, 4.0)], "row int, col int, year int, a double, b double")
    tables.write_table(df, f"{tmp_path}/t", by=["year"], tile=512)
    tables.recompress(spark, f"{tmp_path}/t", f"{tmp_path}/u", "gzip", 1)
    assert spark.read.parquet(f"{tmp_path}/u").count() == 2
    tables.export_layers(df, ["a", "b"], f"{tmp_path}/layers")
    assert sorted(p.name for p in (tmp_path / "layers").glob("layer=*")) == ["layer=a_2000", "layer=a_2001", "layer=b_2000", "layer=b_2001"]
    (tmp_path / "m.json").write_text('{"year": 1999, "r2": [0.1, 0.2], "rmse": [1.0, 2.0]}')
    assert [tuple(r) for r in tables.read_metrics(spark, f"{tmp_path}/m.json").orderBy("run").collect()] == [(1999, 0, 0.1, 1.0), (1999, 1, 0.2, 2.0)]
