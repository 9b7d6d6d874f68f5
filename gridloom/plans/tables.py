"""Queries: sources, predicates, joins, sets (SURVEY A, B, C, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.grid import GridSpec, rounded, with_folds
from gridloom.functions.missing import aggregate_by, clamp_columns, nodata_to_null
from gridloom.functions.names import feature_parts, member_month, member_variable
from gridloom.operators import align, features, select, spatial
from gridloom.operators.climate import splice
from gridloom.operators.evaluate import dense_predictions, split_membership
from gridloom.operators.projection import labelled, predictions_on_grid
from gridloom.plans.registry import query, r6
from gridloom.sources.tables import exploded_metrics, unpivoted

SUPPLIERS = GridSpec(n_rows=100, n_cols=10, x0=0.0, y0=0.0, dx=270.0, dy=270.0)
PARTS = GridSpec(n_rows=400, n_cols=50, x0=0.0, y0=0.0, dx=270.0, dy=270.0)
COARSE = GridSpec(n_rows=20, n_cols=5, x0=0.0, y0=0.0, dx=1080.0, dy=540.0)

_MONTH = "(strpos('janfebmaraprmayjunjulaugsepoctnovdec', substr(member, 8, 3)) + 2) // 3"


@query("a02_member_names", f"SELECT member, substr(member, 1, 3) AS variable, CAST(make_date(CAST(substr(member, 4, 4) AS INT), CAST({_MONTH} AS INT), 1) AS VARCHAR) AS month FROM archive_index")
def _(i):
    m = F.col("member")
    return i.archive_index.select("member", member_variable(m).alias("variable"), member_month(m).cast("string").alias("month"))


@query("a03_nodata", "SELECT row, col, time, l_linenumber, l_orderkey, CASE WHEN l_quantity = 50 THEN NULL ELSE l_quantity END AS value FROM item")
def _(i):
    return i.item.select("row", "col", "time", "l_linenumber", "l_orderkey", nodata_to_null(F.col("l_quantity"), 50.0).alias("value"))


@query("a04_cell_centres", "SELECT row, col, (col + 0.5) * 270.0 AS easting, -(row + 0.5) * 270.0 AS northing FROM dem".replace("270.0", "270.0E0").replace("0.5", "0.5E0"))
def _(i):
    return i.dem.select("row", "col", PARTS.easting(F.col("col")).alias("easting"), PARTS.northing(F.col("row")).alias("northing"))


@query("a05_missing_periods", """
    SELECT s.l_suppkey, m.time FROM (SELECT DISTINCT l_suppkey FROM item) s CROSS JOIN (SELECT DISTINCT date_trunc('month', time) AS time FROM item) m
    LEFT JOIN (SELECT DISTINCT l_suppkey, date_trunc('month', time) AS time FROM item) p ON p.l_suppkey = s.l_suppkey AND p.time = m.time WHERE p.time IS NULL""")
def _(i):
    return align.missing_pairs(i.item.select("l_suppkey", F.date_trunc("month", "time").cast("timestamp_ntz").alias("time")), "l_suppkey", "time")


@query("a06_last_member", """
    SELECT row, col, month, arg_max(l_quantity, n) AS value, max(n) AS member FROM (SELECT row, col, month, l_quantity, concat(CAST(year AS VARCHAR), '-', lpad(CAST(l_orderkey AS VARCHAR), 9, '0'), '-', CAST(l_linenumber AS VARCHAR), '-', CAST(l_partkey AS VARCHAR)) AS n FROM item) x
    GROUP BY row, col, month""")
def _(i):
    name = F.concat(F.col("year").cast("string"), F.lit("-"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"))
    return align.last_member(i.item.select("row", "col", "month", F.col("l_quantity").alias("value"), name.alias("member")), ["row", "col", "month"])


@query("a06_mixed_archives", "SELECT archive, count(DISTINCT variable) AS variables FROM (SELECT concat('y', substr(archive, 4)) AS archive, variable FROM archive_index) x GROUP BY archive HAVING count(DISTINCT variable) > 1")
def _(i):
    return align.mixed_archives(i.archive_index.withColumn("archive", F.concat(F.lit("y"), F.expr("substr(archive, 4)"))))


@query("a07_merge_variables", "SELECT row, col, time, ppt, round(pet, 6) AS pet, tmn, tmx FROM monthly")
def _(i):
    long = i.monthly.unpivot(["row", "col", "time"], ["ppt", "pet", "tmn", "tmx"], "variable", "value")
    return r6(align.merge_variables(long, ["ppt", "pet", "tmn", "tmx"]), "pet").withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("a08_band_years", "SELECT row, col, CAST(2010 + l_linenumber AS INT) AS year, avg(l_quantity) AS severity FROM item GROUP BY row, col, l_linenumber".replace("avg(l_quantity)", "round(avg(l_quantity), 6)"))
def _(i):
    bands = i.item.groupBy("row", "col", F.col("l_linenumber").alias("band")).agg(F.round(F.avg("l_quantity"), 6).alias("band_data"))
    return align.bands_to_years(bands, list(range(2011, 2018)), "band_data", "severity")


@query("a09_variable_files", """
    SELECT row, col, CAST(2010 + l_linenumber AS INT) AS year, sum(l_quantity) AS area, count(*) AS mortality, min(l_quantity) AS tpa FROM item GROUP BY row, col, l_linenumber""")
def _(i):
    def bands(band, value):  # each file has its own order of bands, its own years and its own name for the value
        return i.item.groupBy("row", "col", band.alias("band")).agg(value.alias("band_data"))

    up, down = list(range(2011, 2018)), list(range(2017, 2010, -1))
    files = [
        (bands(F.col("l_linenumber"), F.sum("l_quantity")), up, "band_data", "area"),
        (bands(8 - F.col("l_linenumber"), F.count(F.lit(1))), down, "band_data", "mortality"),
        (bands(F.col("l_linenumber"), F.min("l_quantity")), up, "band_data", "tpa"),
    ]
    return align.variable_files(files)


@query("a10_missing_years", "SELECT CAST(y AS INT) AS year FROM range(1990, 2006) t(y) WHERE y NOT IN (SELECT DISTINCT year FROM item)")
def _(i):
    return align.missing_years(i.item, 1990, 2004)


@query("a12_export_rows", "SELECT row, col, year, 'ppt' AS variable, ppt AS value FROM annual UNION ALL SELECT row, col, year, 'tmx', tmx FROM annual")
def _(i):
    return unpivoted(i.annual, ["ppt", "tmx"])


@query("a14_metric_documents", """
    SELECT year, CAST(k AS INT) AS run, r2[k + 1] AS r2, rmse[k + 1] AS rmse
    FROM (SELECT year, r2, rmse, unnest(range(0, len(r2))) AS k FROM (SELECT year, list(round(a, 6) ORDER BY n) AS r2, list(round(b, 6) ORDER BY n) AS rmse
          FROM (SELECT year, l_linenumber AS n, avg(l_discount) AS a, avg(l_quantity) AS b FROM item GROUP BY year, l_linenumber) x GROUP BY year) y) z""")
def _(i):
    runs = i.item.groupBy("year", F.col("l_linenumber").alias("n")).agg(F.round(F.avg("l_discount"), 6).alias("a"), F.round(F.avg("l_quantity"), 6).alias("b"))
    lists = runs.groupBy("year").agg(F.array_sort(F.collect_list(F.struct("n", "a", "b"))).alias("m"))
    text = lists.select(F.to_json(F.struct("year", F.col("m.a").alias("r2"), F.col("m.b").alias("rmse"))).alias("j"))
    return exploded_metrics(text.select(F.from_json("j", "year int, r2 array<double>, rmse array<double>").alias("d")).select("d.*"))


@query("a15_statistics", """
    SELECT row, col, year, round(sum(l_quantity), 6) AS q_sum, round(avg(l_extendedprice), 6) AS p_mean, min(l_discount) AS d_min, max(l_discount) AS d_max, count(l_quantity) AS n,
           median(l_quantity) AS q_med, round(stddev_pop(l_quantity), 6) AS q_std, round(var_pop(l_quantity), 6) AS q_var, round(quantile_cont(l_quantity, 0.9), 6) AS q90 FROM item GROUP BY row, col, year""")
def _(i):
    specs = [
        {"variable": "l_quantity", "statistic": "sum", "name": "q_sum"}, {"variable": "l_extendedprice", "statistic": "mean", "name": "p_mean"},
        {"variable": "l_discount", "statistic": "min", "name": "d_min"}, {"variable": "l_discount", "statistic": "max", "name": "d_max"},
        {"variable": "l_quantity", "statistic": "count", "name": "n"}, {"variable": "l_quantity", "statistic": "median", "name": "q_med"},
        {"variable": "l_quantity", "statistic": "std", "name": "q_std"}, {"variable": "l_quantity", "statistic": "var", "name": "q_var"},
        {"variable": "l_quantity", "statistic": "quantile", "name": "q90", "options": {"q": 0.9}, "attrs": {"units": "1"}},
    ]
    return r6(aggregate_by(i.item, ["row", "col", "year"], specs), "q_sum", "p_mean", "q_std", "q_var", "q90")


@query("b01_year_range", "SELECT row, col, year, ppt FROM annual WHERE year >= 1996 AND year <= 1999")
def _(i):
    return select.year_range(i.annual, 1996, 1999).select("row", "col", "year", "ppt")


@query("b02_year_slice", "SELECT row, col, tmx FROM annual WHERE year = 1998")
def _(i):
    return select.year_slice(i.annual.select("row", "col", "year", "tmx"), 1998)


@query("b03_rounded_keys", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice / 7, 4) AS x FROM item")
def _(i):
    return i.item.select("l_orderkey", "l_linenumber", "l_partkey", rounded(F.col("l_extendedprice") / 7).alias("x"))


@query("b04_infinity_clamp", """
    SELECT row, col, year, CASE WHEN ppt > 300 THEN 100.0 WHEN ppt < 50 THEN -100.0 ELSE ppt END AS x FROM annual WHERE ppt IS NOT NULL""".replace("100.0", "100.0E0"))
def _(i):
    inf = F.when(F.col("ppt") > 300, float("inf")).when(F.col("ppt") < 50, float("-inf")).otherwise(F.col("ppt"))
    return clamp_columns(i.annual.where("ppt IS NOT NULL").select("row", "col", "year", inf.alias("x")), ["x"], 100.0)


@query("b05_present_samples", "SELECT m.row, m.col, m.year, severity_code, slope FROM mortality m JOIN topo t ON m.row = t.row AND m.col = t.col WHERE severity_code IS NOT NULL AND slope IS NOT NULL AND elevation IS NOT NULL".replace("slope FROM", "round(slope, 6) AS slope FROM"))
def _(i):
    return r6(select.present_samples(i.mortality.join(i.topo, ["row", "col"]), "severity_code", ["slope", "elevation"]).select("row", "col", "year", "severity_code", "slope"), "slope")


@query("b06_positive_targets", "SELECT row, col, year, severity_code FROM mortality WHERE severity_code > 0")
def _(i):
    return features.positive_targets(i.mortality, "severity_code").select("row", "col", "year", "severity_code")


@query("b07_complete_rows", "SELECT row, col, year, ppt IS NOT NULL AND pet IS NOT NULL AND tmn IS NOT NULL AS scored FROM annual")
def _(i):
    return i.annual.select("row", "col", "year", features.complete_rows(["ppt", "pet", "tmn"]).alias("scored"))


@query("b08_missing_to_zero", "SELECT row, col, year, coalesce(severity_code, 0) AS severity_code FROM mortality")
def _(i):
    return i.mortality.select("row", "col", "year", align.fallback_zero(F.col("severity_code")).alias("severity_code"))


@query("b09_survival_share", "SELECT row, col, year, round(CASE WHEN ppt IS NULL THEN NULL WHEN ppt > 200 THEN 0 ELSE 1 - ppt / 200 END, 6) AS share FROM annual")
def _(i):
    return r6(i.annual.select("row", "col", "year", features.survival_share(F.col("ppt") / 2).alias("share")), "share")


@query("b10_severity_midpoint", "SELECT row, col, year, CASE severity_code WHEN 1 THEN 2.0E0 WHEN 2 THEN 6.5E0 WHEN 3 THEN 20.0E0 WHEN 4 THEN 40.0E0 WHEN 5 THEN 75.0E0 END AS midpoint FROM mortality")
def _(i):
    return i.mortality.select("row", "col", "year", features.severity_midpoint(F.col("severity_code")).alias("midpoint"))


@query("b11_severity_range", """
    SELECT row, col, year, CASE severity_code WHEN 1 THEN 1.0E0 WHEN 2 THEN 3.0E0 WHEN 3 THEN 10.0E0 WHEN 4 THEN 30.0E0 WHEN 5 THEN 50.0E0 END AS low,
           CASE severity_code WHEN 1 THEN 3.0E0 WHEN 2 THEN 10.0E0 WHEN 3 THEN 30.0E0 WHEN 4 THEN 50.0E0 WHEN 5 THEN 100.0E0 END AS high FROM mortality""")
def _(i):
    return features.with_severity_range(i.mortality).select("row", "col", "year", "low", "high")


@query("b12_feature_vector", "SELECT row, col, year, round(ppt, 6) AS f1, round(tmn, 6) AS f2 FROM annual WHERE ppt IS NOT NULL AND tmn IS NOT NULL")
def _(i):
    from pyspark.ml.functions import vector_to_array

    from gridloom.operators.models import assembled

    v = vector_to_array("features")
    return r6(assembled(i.annual, ["ppt", "tmn"]).select("row", "col", "year", v[0].alias("f1"), v[1].alias("f2")), "f1", "f2")


@query("b13_bounding_box", "SELECT DISTINCT row, col FROM monthly WHERE easting BETWEEN 405 AND 1755 AND northing BETWEEN -1755 AND -405")
def _(i):
    return i.monthly.where(spatial.in_box("easting", "northing", 405, 1755, -1755, -405)).select("row", "col").distinct()


@query("b14_class_filter", "SELECT row, col, year, severity_code FROM mortality WHERE severity_code IN (1, 3, 5) AND year IN (1996, 1998)")
def _(i):
    return select.chosen(i.mortality, [1, 3, 5], [1996, 1998], "severity_code").select("row", "col", "year", "severity_code")


@query("b15_feature_names", r"""
    SELECT DISTINCT feature, regexp_extract(feature, '^([A-Z]+)', 1) AS idx, CAST(regexp_extract(feature, '([0-9]+)-', 1) AS INT) AS span, CAST(regexp_extract(feature, '-([0-9]+)$', 1) AS INT) AS lag FROM importances""")
def _(i):
    index, span, lag = feature_parts(F.col("feature"))
    return i.importances.select("feature", index.alias("idx"), span.alias("span"), lag.alias("lag")).distinct()


def _placed(df, shift: float):
    """df by coordinates alone, off by less than the rounding and, in every third column, by more."""
    off = F.when(F.col("col") % 3 == 0, 1e-3).otherwise(shift)
    return df.withColumns({"easting": SUPPLIERS.easting(F.col("col")) + off, "northing": SUPPLIERS.northing(F.col("row")) - shift}).drop("row", "col")


@query("c01_spatial_join", """
    SELECT m.row, m.col, m.year, ppt, round(slope, 6) AS slope, round(fraction_hot_days, 6) AS hot, severity_code
    FROM mortality m JOIN (SELECT *, col * 270.0E0 + 135.0E0 + CASE WHEN col % 3 = 0 THEN 1E-3 ELSE 1E-6 END AS x, -(row * 270.0E0 + 135.0E0) - 1E-6 AS y FROM annual) a
         ON round_even(m.easting, 4) = round_even(a.x, 4) AND round_even(m.northing, 4) = round_even(a.y, 4) AND a.year = m.year
    JOIN heat h ON m.row = h.row AND m.col = h.col AND m.year = h.year JOIN topo t ON m.row = t.row AND m.col = t.col""")
def _(i):
    out = align.spatial_join(i.mortality, _placed(i.annual, 1e-6), ["year"])
    heat = i.heat.withColumns({"easting": SUPPLIERS.easting(F.col("col")) - 2e-5, "northing": SUPPLIERS.northing(F.col("row"))}).drop("row", "col")
    topo = i.topo.withColumns({"easting": SUPPLIERS.easting(F.col("col")), "northing": SUPPLIERS.northing(F.col("row")) + 3e-5}).drop("row", "col")
    out = align.spatial_join(align.spatial_join(out, heat, ["year"]), topo)
    return r6(out.select("row", "col", "year", "ppt", "slope", F.col("fraction_hot_days").alias("hot"), "severity_code"), "slope", "hot")


@query("c02_key_differences", """
    SELECT coalesce(a.row, m.row) AS row, coalesce(a.col, m.col) AS col, coalesce(a.year, m.year) AS year, CASE WHEN m.year IS NULL THEN 'left' ELSE 'right' END AS side
    FROM annual a FULL JOIN mortality m ON a.row = m.row AND a.col = m.col AND a.year = m.year WHERE a.year IS NULL OR m.year IS NULL""")
def _(i):
    return align.key_differences(i.annual, i.mortality, ["row", "col", "year"])


@query("c03_positional_join", "SELECT a.row, a.col, a.time, a.northing, a.ppt, b.tmn FROM monthly a JOIN monthly b ON a.row = b.row AND a.col = b.col AND a.time = b.time")
def _(i):
    other = i.monthly.select("row", "col", "time", "tmn")
    return align.positional_join(i.monthly.drop("tmn"), other, ["row", "col", "time"]).select("row", "col", F.col("time").cast("timestamp_ntz").alias("time"), "northing", "ppt", "tmn")


@query("c04_lags", """
    SELECT a.row, a.col, a.year, a.ppt AS "ppt-1", b.ppt AS "ppt-2", c.ppt AS "ppt-3" FROM annual_part a
    LEFT JOIN annual_part b ON a.row = b.row AND a.col = b.col AND b.year = a.year - 1 LEFT JOIN annual_part c ON a.row = c.row AND a.col = c.col AND c.year = a.year - 2""")
def _(i):
    return align.lagged(i.annual_part.select("row", "col", "year", "ppt"), ["ppt"], 3).drop("ppt")


@query("c05_regrid", """
    SELECT t.row, t.col, s.v FROM dem t LEFT JOIN (SELECT CAST(floor(row / 4.0) AS INT) AS row, CAST(floor(col / 2.0) AS INT) AS col, max(ppt) AS v FROM annual GROUP BY CAST(floor(row / 4.0) AS INT), CAST(floor(col / 2.0) AS INT)) s
    ON s.row = CAST(floor(t.row / 2.0) AS INT) AND s.col = CAST(floor(t.col / 4.0) AS INT) AND s.row < 20 AND s.col < 5""")
def _(i):
    source = i.annual.groupBy(F.floor(F.col("row") / 4).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(F.max("ppt").alias("v"))
    target = i.dem.select("row", "col", PARTS.easting(F.col("col")).alias("easting"), PARTS.northing(F.col("row")).alias("northing"))
    return spatial.regrid(target, source, COARSE).select("row", "col", "v")


#: A projected target grid of cells of 2.7 km, and a source grid in degrees of longitude and latitude.
CALIFORNIA = spatial.Albers(lat1=34.0, lat2=40.5, lat0=0.0, lon0=-120.0, false_northing=-4_000_000.0)
DEGREES = GridSpec(n_rows=20, n_cols=5, x0=-121.0, y0=38.2, dx=0.4, dy=0.5, crs="lonlat")


@query("c05_regrid_projected", """
    WITH p AS (SELECT 6378137.0E0 AS a, 0.00669438002290079E0 AS f, sqrt(0.00669438002290079E0) AS e, sin(radians(34.0E0)) AS s1, sin(radians(40.5E0)) AS s2),
    q AS (SELECT *, (1 - f) * (s1 / (1 - f * s1 * s1) - ln((1 - e * s1) / (1 + e * s1)) / (2 * e)) AS q1, (1 - f) * (s2 / (1 - f * s2 * s2) - ln((1 - e * s2) / (1 + e * s2)) / (2 * e)) AS q2,
          (1 - f) * (1 / (1 - f) - ln((1 - e) / (1 + e)) / (2 * e)) AS pole, (1 - s1 * s1) / (1 - f * s1 * s1) AS m1, (1 - s2 * s2) / (1 - f * s2 * s2) AS m2 FROM p),
    n AS (SELECT *, (m1 - m2) / (q2 - q1) AS n FROM q),
    k AS (SELECT *, m1 + n * q1 AS c, a * sqrt(m1 + n * q1) / n AS r0 FROM n),
    t AS (SELECT d.row, d.col, (d.col + 0.5E0) * 2700 - 67500 AS dx, r0 - (4000000 - (d.row + 0.5E0) * 2700) AS dy, n, c, a, f, pole FROM dem d CROSS JOIN k),
    b AS (SELECT *, asin((c - (dx * dx + dy * dy) * n * n / (a * a)) / n / pole) AS b FROM t),
    g AS (SELECT row, col, -120 + degrees(atan2(dx, dy) / n) AS lon, degrees(b + (f / 3 + 31 * f * f / 180 + 517 * f * f * f / 5040) * sin(2 * b) + (23 * f * f / 360 + 251 * f * f * f / 3780) * sin(4 * b) + 761 * f * f * f / 45360 * sin(6 * b)) AS lat FROM b),
    s AS (SELECT CAST(floor(row / 4.0) AS INT) AS r, CAST(floor(col / 2.0) AS INT) AS k, max(ppt) AS v FROM annual GROUP BY CAST(floor(row / 4.0) AS INT), CAST(floor(col / 2.0) AS INT))
    SELECT g.row, g.col, s.v FROM g LEFT JOIN s ON s.r = floor((38.2E0 - g.lat) / 0.5E0) AND s.k = floor((g.lon + 121) / 0.4E0) AND s.r < 20 AND s.k < 5""")
def _(i):
    source = i.annual.groupBy(F.floor(F.col("row") / 4).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(F.max("ppt").alias("v"))
    target = i.dem.select("row", "col", ((F.col("col") + 0.5) * 2700 - 67500).alias("easting"), (-(F.col("row") + 0.5) * 2700).alias("northing"))
    lon, lat = CALIFORNIA.inverse(F.col("easting"), F.col("northing"))
    return spatial.regrid(target, source, DEGREES, lon, lat).select("row", "col", "v")


#: Beyond the centre of any cell of an INT row and column; a power of two, so that slanted edges between such points are not rounded.
FAR = 2.0**40


def _regions(spark):
    """The SQL's regions, which have no end where it names none: everything west of an easting,
    everything but a hole, and everything above a diagonal."""
    box = lambda x0, x1, y0, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    rows = [
        (1, None, "default", [box(-FAR, 1350.0, -FAR, FAR)]),
        (2, 1997, "with a hole", [box(-FAR, FAR, -FAR, FAR), box(540.0, 1620.0, -1620.0, -540.0)]),
        (3, 1999, "triangle", [[(-FAR, -FAR - 2700.0), (FAR, FAR - 2700.0), (-FAR, FAR - 2700.0)]]),
    ]
    return spark.createDataFrame(rows, "region_id int, year int, name string, rings array<array<struct<x: double, y: double>>>")


@query("c06_clip", """
    SELECT row, col, year, CASE WHEN CASE year WHEN 1997 THEN NOT (easting >= 540 AND easting < 1620 AND northing >= -1620 AND northing < -540) WHEN 1999 THEN northing > easting - 2700 ELSE easting < 1350 END THEN coalesce(severity_code, 0) END AS severity_code
    FROM mortality""")
def _(i):
    return spatial.clip(i.mortality, _regions(i.spark), ["severity_code"]).select("row", "col", "year", "severity_code")


@query("c06_cells_in_regions", """
    SELECT p.row, p.col, c.region_id FROM (SELECT row, col, col * 270.0E0 + 135.0E0 AS x, -(row * 270.0E0 + 135.0E0) AS y FROM dem) p
    JOIN (SELECT CAST(c_custkey AS INT) AS region_id, CAST(c_custkey * 89 % 13500 AS DOUBLE) AS x0, CAST(-(c_custkey * 7919 % 108000) AS DOUBLE) AS y0, 300.0E0 + c_custkey % 7 * 250 AS side FROM {customer}) c
    ON y >= y0 AND y < y0 + side AND x >= x0 AND x < x0 + side - (y - y0)
       AND NOT (y >= y0 + 50 AND y < y0 + 120 AND x >= x0 + 50 AND x < x0 + 120)""")
def _(i):
    """A triangle with a square hole for each customer."""
    corner = i.table("customer").selectExpr("CAST(c_custkey AS INT) AS region_id", "CAST(c_custkey * 89 % 13500 AS DOUBLE) AS x0", "CAST(-(c_custkey * 7919 % 108000) AS DOUBLE) AS y0", "300.0D + c_custkey % 7 * 250 AS side")
    point = lambda dx, dy: f"named_struct('x', x0 + {dx}, 'y', y0 + {dy})"
    outline, hole = (", ".join(point(*p) for p in ring) for ring in ([(0, 0), ("side", 0), (0, "side")], [(50, 50), (120, 50), (120, 120), (50, 120)]))
    regions = corner.selectExpr("region_id", f"array(array({outline}), array({hole})) AS rings")
    cells = i.dem.selectExpr("row", "col", "col * 270.0D + 135 AS easting", "-(row * 270.0D + 135) AS northing")
    return spatial.cells_in_regions(cells, regions, broadcast_points=0)


@query("c07_predictions_on_grid", """
    SELECT m.row, m.col, m.year, round(CASE WHEN severity_code IS NOT NULL THEN prediction END, 6) AS prediction
    FROM mortality m LEFT JOIN (SELECT id, eval_year, prediction FROM predictions WHERE train_year = eval_year) p ON p.id = m.row * 10 + m.col AND p.eval_year = m.year""")
def _(i):
    grid = i.mortality.withColumn("id", SUPPLIERS.cell_id(F.col("row"), F.col("col")))
    return r6(predictions_on_grid(grid, i.predictions, "severity_code").select("row", "col", "year", "prediction"), "prediction")


@query("c09_split_membership", """
    SELECT y.year, f.fold, CAST(count(CASE WHEN p.train_year = y.year AND p.fold <> f.fold THEN 1 END) AS BIGINT) AS n_train, CAST(count(CASE WHEN p.fold = f.fold THEN 1 END) AS BIGINT) AS n_test
    FROM (SELECT DISTINCT train_year AS year FROM predictions) y CROSS JOIN (SELECT DISTINCT fold FROM predictions) f CROSS JOIN predictions p GROUP BY y.year, f.fold""")
def _(i):
    return split_membership(i.predictions.withColumnRenamed("train_year", "year"))


@query("c10_dense_scaffold", """
    SELECT t.train_year, e.eval_year, d.id, round(coalesce(p.prediction, 0), 6) AS prediction, round(coalesce(p.target, 0), 6) AS target
    FROM (SELECT DISTINCT train_year FROM sparse) t CROSS JOIN (SELECT DISTINCT eval_year FROM sparse) e CROSS JOIN (SELECT DISTINCT id FROM sparse) d
    LEFT JOIN sparse p ON p.train_year = t.train_year AND p.eval_year = e.eval_year AND p.id = d.id""")
def _(i):
    return r6(dense_predictions(i.sparse), "prediction", "target")


@query("c11_splice", """
    WITH r AS (SELECT row, col, year, ppt FROM annual_part WHERE year BETWEEN 1995 AND 1997), f AS (SELECT row, col, year, ppt FROM annual_part WHERE year BETWEEN 2000 AND 2001 AND ppt > 20)
    SELECT * FROM r WHERE EXISTS (SELECT 1 FROM f WHERE f.row = r.row AND f.col = r.col) UNION ALL SELECT * FROM f WHERE EXISTS (SELECT 1 FROM r WHERE f.row = r.row AND f.col = r.col)""")
def _(i):
    part = i.annual_part.select("row", "col", "year", "ppt")
    return splice(part, part.where("ppt > 20"), (1995, 1997), (2000, 2001))


@query("f01_folds_and_ids", """
    SELECT row, col, year, CAST(CAST(floor(col / 4.0) AS INT) + 3 * CAST(floor(row / 4.0) AS INT) AS INT) AS fold, CAST(row * 10 + col AS BIGINT) AS id, northing AS northings, easting AS eastings FROM mortality""")
def _(i):
    return with_folds(i.mortality, SUPPLIERS, 4).select("row", "col", "year", "fold", "id", "northings", "eastings")


@query("f04_shuffled_folds", """
    SELECT fold, count(*) AS n FROM (SELECT CAST(floor(col / 8.0) AS INT) + 7 * CAST(floor(row / 8.0) AS INT) AS fold FROM dem) x GROUP BY fold""")
def _(i):
    from gridloom.functions.grid import shuffled_folds

    cells = i.dem.select(PARTS.cell_id(F.col("row"), F.col("col")).alias("id"), PARTS.block_fold(F.col("row"), F.col("col"), 8).alias("fold"))
    return shuffled_folds(cells, seed=0).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("j01_concatenate", "SELECT CAST(p AS VARCHAR) AS projection, row, col, year, ppt FROM (SELECT 'GCM_a' AS p, * FROM annual WHERE year < 1999 UNION ALL SELECT 'GCM_b' AS p, * FROM annual WHERE year >= 1998) x")
def _(i):
    a = i.annual
    return labelled([("/runs/GCM_a.parquet", a.where("year < 1999")), ("/runs/GCM_b.parquet", a.where("year >= 1998"))]).select("projection", "row", "col", "year", "ppt")


@query("j02_shared_cells", "SELECT row, col FROM (SELECT DISTINCT row, col FROM annual_part WHERE year = 1995 INTERSECT SELECT DISTINCT row, col FROM annual_part WHERE year = 2001) x")
def _(i):
    p = i.annual_part
    return select.shared_keys(select.year_slice(p, 1995), select.year_slice(p, 2001))


@query("j03_missing_cells", "SELECT row, col FROM dem EXCEPT SELECT row, col FROM annual_part WHERE year = 1998")
def _(i):
    return select.missing_keys(i.dem, select.year_slice(i.annual_part, 1998))


@query("j04_time_order", "SELECT row, col, time, row_number() OVER (PARTITION BY row, col ORDER BY time) AS position FROM monthly")
def _(i):
    return select.in_time_order(i.monthly.select("row", "col", F.col("time").cast("timestamp_ntz").alias("time")))
