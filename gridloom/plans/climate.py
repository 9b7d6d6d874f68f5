"""Queries: aggregates, windows, standardised indices, heat, ensembles (SURVEY D, E, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.sized import stored
from gridloom.operators import climate, evaluate, heat, projection, stdindex
from gridloom.operators.select import distinct_splits, year_range
from gridloom.plans.registry import query, r6

_HEAT_SPAN = "year BETWEEN 1995 AND 1998"
_CLIM = f"SELECT latitude, longitude, dayofyear, avg(t2m_max) AS normal, quantile_cont(t2m_max, 0.9) AS high FROM daily WHERE {_HEAT_SPAN} GROUP BY latitude, longitude, dayofyear"


@query("d01_water_year", "SELECT row, col, year, ppt, round(pet, 6) AS pet, tmn, tmx FROM annual")
def _(i):
    return r6(climate.water_year(i.monthly), "pet").select("row", "col", "year", "ppt", "pet", "tmn", "tmx")


@query("d02_daily_statistics", "SELECT latitude, longitude, year, CAST(dayofyear AS INT) AS dayofyear, t2m_max, t2m_min FROM daily")
def _(i):
    return heat.daily_statistics(i.hourly, (1995, 2001))


@query("d03_leap_years", """
    WITH t AS (SELECT CAST(year(time - INTERVAL '1' MINUTE) AS INT) AS year, CAST(dayofyear(time - INTERVAL '1' MINUTE) AS INT) AS doy FROM hourly),
    long AS (SELECT year, count(DISTINCT doy) > 365 AS leap FROM t GROUP BY year)
    SELECT t.year, CAST(max(CASE WHEN leap AND doy > 60 THEN doy - 1 ELSE doy END) AS INT) AS last_day, count(DISTINCT CASE WHEN leap AND doy > 60 THEN doy - 1 ELSE doy END) AS days
    FROM t JOIN long ON long.year = t.year WHERE t.year BETWEEN 1995 AND 2001 AND NOT (leap AND doy = 60) GROUP BY t.year""")
def _(i):
    d = heat.daily_statistics(i.hourly, (1995, 2001), leap_from_data=True)
    return d.groupBy("year").agg(F.max("dayofyear").alias("last_day"), F.count_distinct("dayofyear").alias("days"))


@query("d04_climatology", f"SELECT latitude, longitude, CAST(dayofyear AS INT) AS dayofyear, round(normal, 6) AS normal, round(high, 6) AS high FROM ({_CLIM}) c")
def _(i):
    return r6(heat.climatology(heat.daily_statistics(i.hourly, (1995, 1998)), (1995, 1998)), "normal", "high")


@query("d05_day_quantile", "SELECT dayofyear, round(quantile_cont(t2m_max, 0.9), 6) AS high FROM (SELECT CAST(dayofyear AS INT) AS dayofyear, t2m_max FROM daily WHERE year BETWEEN 1995 AND 1998) x GROUP BY dayofyear")
def _(i):
    d = heat.daily_statistics(i.hourly, (1995, 1998))
    return r6(heat.climatology(d, (1995, 1998), keys=()).select("dayofyear", "high"), "high")


@query("c08_focal_days", f"""
    SELECT d.latitude, d.longitude, d.year, CAST(d.dayofyear AS INT) AS dayofyear, t2m_max, round(normal, 6) AS normal, round(high, 6) AS high
    FROM daily d LEFT JOIN ({_CLIM}) c ON c.latitude = d.latitude AND c.longitude = d.longitude AND c.dayofyear = d.dayofyear WHERE d.year BETWEEN 1999 AND 2001""")
def _(i):
    d = heat.daily_statistics(i.hourly, (1995, 2001))
    out = heat.with_climatology(d, heat.climatology(d, (1995, 1998)), (1999, 2001))
    return r6(out, "normal", "high").select("latitude", "longitude", "year", "dayofyear", "t2m_max", "normal", "high")


@query("d06_hot_day_fraction", f"""
    SELECT d.latitude, d.longitude, d.year, round(avg(CASE WHEN t2m_max - normal > 500 AND t2m_max > high THEN 1.0E0 ELSE 0.0E0 END), 6) AS fraction_hot_days
    FROM daily d LEFT JOIN ({_CLIM}) c ON c.latitude = d.latitude AND c.longitude = d.longitude AND c.dayofyear = d.dayofyear WHERE d.year BETWEEN 1999 AND 2001 GROUP BY d.latitude, d.longitude, d.year""")
def _(i):
    return r6(heat.heat_index(i.hourly, (1995, 1998), (1999, 2001), excess=500.0), "fraction_hot_days")


@query("d07_ensemble", "SELECT row, col, year, round(median(tpa_projection), 6) AS tpa_median, round(stddev_pop(tpa_projection), 6) AS tpa_std FROM projection GROUP BY row, col, year")
def _(i):
    specs = [{"variable": "tpa_projection", "statistic": "median", "name": "tpa_median"}, {"variable": "tpa_projection", "statistic": "std", "name": "tpa_std"}]
    return r6(projection.ensemble(i.projection, specs), "tpa_median", "tpa_std")


@query("d08_regional_median", "SELECT year, round(median(tpa_projection), 6) AS tpa_projection FROM projection GROUP BY year")
def _(i):
    return r6(projection.regional_series(i.projection, "tpa_projection"), "tpa_projection")


@query("d09_regional_mean", "SELECT year, round(avg(tpa_projection), 6) AS tpa_projection FROM projection GROUP BY year")
def _(i):
    return r6(projection.regional_series(i.projection, "tpa_projection", "mean"), "tpa_projection")


@query("d10_performance_matrix", """
    WITH g AS (SELECT train_year, eval_year, count(*) AS n, sum((target - prediction) * (target - prediction)) AS sse, var_pop(target) * count(*) AS around FROM predictions GROUP BY train_year, eval_year)
    SELECT train_year, eval_year, n, round(CASE WHEN around = 0 THEN CASE WHEN sse = 0 THEN 1 ELSE 0 END ELSE 1 - sse / around END, 6) AS r2, round(sqrt(sse / n), 6) AS rmse,
           round(CASE WHEN train_year <= eval_year AND 1 - sse / around > -1 THEN 1 - sse / around END, 6) AS shown FROM g""")
def _(i):
    m = evaluate.performance_matrix(i.predictions)
    return r6(m.withColumn("shown", evaluate.masked_r2(F.col("r2"))), "r2", "rmse", "shown")


@query("d10_dense_matrix", """
    WITH p AS (SELECT * FROM sparse),
    s AS (SELECT t.train_year, e.eval_year, coalesce(p.prediction, 0) AS prediction, coalesce(p.target, 0) AS target FROM (SELECT DISTINCT train_year FROM p) t CROSS JOIN (SELECT DISTINCT eval_year FROM p) e CROSS JOIN (SELECT DISTINCT id FROM p) d
          LEFT JOIN p ON p.train_year = t.train_year AND p.eval_year = e.eval_year AND p.id = d.id)
    SELECT train_year, eval_year, count(*) AS n, round(1 - sum((target - prediction) ** 2) / (var_pop(target) * count(*)), 6) AS r2, round(sqrt(avg((target - prediction) ** 2)), 6) AS rmse FROM s GROUP BY train_year, eval_year""")
def _(i):
    return r6(evaluate.performance_matrix(i.sparse, dense=True), "r2", "rmse")


@query("d11_importances", """
    SELECT feature, regexp_extract(feature, '^([A-Z]+)', 1) AS idx, CAST(regexp_extract(feature, '([0-9]+)-', 1) AS INT) AS span, CAST(regexp_extract(feature, '-([0-9]+)$', 1) AS INT) AS lag,
           round(greatest(power(10, -3.5), least(0.03, median(importance))), 6) AS importance FROM importances GROUP BY feature""")
def _(i):
    return r6(evaluate.importance_summary(i.importances), "importance").withColumnRenamed("index", "idx")


@query("d11_importance_matrix", """
    WITH s AS (SELECT regexp_extract(feature, '^([A-Z]+)', 1) AS idx, CAST(regexp_extract(feature, '([0-9]+)-', 1) AS INT) AS span, CAST(regexp_extract(feature, '-([0-9]+)$', 1) AS INT) AS lag, greatest(power(10, -3.5), least(0.03, median(importance))) AS m FROM importances WHERE train_year = 1998 GROUP BY feature)
    SELECT idx, span, """ + ", ".join(f"round(max(CASE WHEN lag = {k} THEN m END), 6) AS lag{k}" for k in range(1, 7)) + " FROM s GROUP BY idx, span")
def _(i):
    m = evaluate.importance_matrix(evaluate.importance_summary(i.importances, 1998), range(1, 7))
    return r6(m, *[f"lag{k}" for k in range(1, 7)]).withColumnRenamed("index", "idx")


_CLASSES = "SELECT id, eval_year AS year, train_year, CAST(CAST(floor(target) AS INT) % 5 + 1 AS INT) AS target, CAST(CAST(floor(prediction) AS INT) % 5 + 1 AS INT) AS prediction FROM predictions"


def _classes(i):
    to = lambda c: (F.floor(c).cast("int") % 5 + 1).alias(c)
    return i.predictions.select("id", F.col("eval_year").alias("year"), "train_year", to("target"), to("prediction"))


@query("d12_confusion", f"""
    WITH c AS ({_CLASSES}) SELECT CAST(t.k AS INT) AS truth, CAST(g.k AS INT) AS guess, round(count(c.id) / (SELECT count(*) FROM c), 6) AS share
    FROM range(1, 6) t(k) CROSS JOIN range(1, 6) g(k) LEFT JOIN c ON c.target = t.k AND c.prediction = g.k GROUP BY t.k, g.k""")
def _(i):
    return r6(evaluate.confusion(_classes(i)), "share")


@query("d13_balanced_accuracy", f"""
    WITH c AS ({_CLASSES}), r AS (SELECT year, target, avg(CASE WHEN target = prediction THEN 1.0E0 ELSE 0.0E0 END) AS r FROM c GROUP BY year, target)
    SELECT year, round((avg(r) - 1.0E0 / count(*)) / (1 - 1.0E0 / count(*)), 6) AS balanced_accuracy FROM r GROUP BY year""")
def _(i):
    return r6(evaluate.balanced_accuracy(_classes(i), ["year"]), "balanced_accuracy")


@query("d13_overall_accuracy", f"""
    WITH c AS ({_CLASSES}), r AS (SELECT target, avg(CASE WHEN target = prediction THEN 1.0E0 ELSE 0.0E0 END) AS r FROM c GROUP BY target)
    SELECT round((avg(r) - 1.0E0 / count(*)) / (1 - 1.0E0 / count(*)), 6) AS balanced_accuracy FROM r""")
def _(i):
    return r6(evaluate.balanced_accuracy(_classes(i)), "balanced_accuracy")


@query("d14_histogram", """
    WITH v AS (SELECT least(CAST(floor((l_discount * 2 - 0.1 + 1) / 0.1) AS INT), 19) AS b FROM item WHERE l_discount * 2 - 0.1 BETWEEN -1 AND 1)
    SELECT CAST(k AS INT) AS bin, count(b) AS n, round(sum(count(b)) OVER (ORDER BY k) / sum(count(b)) OVER (), 6) AS cumulative_share FROM range(0, 20) t(k) LEFT JOIN v ON v.b = k GROUP BY k""".replace("l_discount * 2 - 0.1", "(l_quantity - 25) / 25").replace(" / 0.1)", " / 0.1E0)"))
def _(i):
    return r6(evaluate.histogram(i.item.select(((F.col("l_quantity") - 25) / 25).alias("v")), "v", -1.0, 1.0, 20), "cumulative_share")


@query("d15_distinct_splits", "SELECT DISTINCT train_year AS year, fold FROM predictions ORDER BY 1, 2")
def _(i):
    return distinct_splits(i.predictions.withColumnRenamed("train_year", "year"))


@query("d16_fit_statistics", """
    SELECT row, col, count(ppt) AS ppt_n, round(avg(CASE WHEN ppt IS NULL THEN NULL WHEN ppt = 0 THEN 1.0E0 ELSE 0.0E0 END), 6) AS ppt_p0, round(avg(CASE WHEN ppt > 0 THEN ppt END), 6) AS ppt_mean, round(avg(CASE WHEN ppt > 0 THEN ln(ppt) END), 6) AS ppt_meanlog
    FROM (SELECT row, col, year, CASE WHEN ppt < 20 THEN 0 ELSE ppt END AS ppt FROM annual_part) x WHERE year BETWEEN 1995 AND 1999 GROUP BY row, col""")
def _(i):
    part = i.annual_part.withColumn("ppt", F.when(F.col("ppt") < 20, 0.0).otherwise(F.col("ppt")))
    return r6(stdindex.fit_statistics(part, ["ppt"], (1995, 1999)), "ppt_p0", "ppt_mean", "ppt_meanlog")


def _rolling_sql(table: str, columns: str) -> str:
    out = []
    for s in range(1, 7):
        for name, v in (("PR", "ppt"), ("PRET", "ppt - pet")):
            w = f"(PARTITION BY row, col ORDER BY year RANGE BETWEEN {s - 1} PRECEDING AND CURRENT ROW)"
            out.append(f"round(CASE WHEN count({v}) OVER {w} = {s} THEN sum({v}) OVER {w} END, 6) AS {name}{s}")
    return f"SELECT {columns}, {', '.join(out)} FROM {table}"


#: The water years of the views.
YEARS = range(1995, 2003)
_ROLLED = [f"{n}{s}" for s in range(1, 7) for n in ("PR", "PRET")]


@query("e01_rolling_sums", _rolling_sql("annual_part", "row, col, year"), signed=tuple(_ROLLED))
def _(i):
    return r6(climate.rolling_indices(i.annual_part, years=YEARS).select("row", "col", "year", *_ROLLED), *_ROLLED)


@query("e02_water_year_indices", _rolling_sql("annual", "row, col, year"), signed=tuple(_ROLLED))
def _(i):
    return r6(climate.rolling_indices(climate.water_year(i.monthly), years=YEARS).select("row", "col", "year", *_ROLLED), *_ROLLED)


@query("e03_accumulated", """
    SELECT projection, row, col, year, round(CASE WHEN count(tpa_projection) OVER w = count(*) OVER w THEN sum(tpa_projection) OVER w END, 6) AS total FROM projection
    WINDOW w AS (PARTITION BY projection, row, col ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(i):
    return r6(projection.accumulated(i.projection, "tpa_projection", "total", ["projection", "row", "col"]).drop("tpa_projection"), "total")


@query("e04_habitat_survival", """
    SELECT projection, row, col, year, round(100 * coalesce(product(CASE WHEN tpa_projection IS NULL THEN NULL ELSE greatest(0, least(1, 1 - tpa_projection / 50)) END) OVER w, 1), 6) AS survival FROM projection
    WINDOW w AS (PARTITION BY projection, row, col ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(i):
    p = i.projection.withColumn("pct", F.col("tpa_projection") * 2)
    return r6(projection.habitat_survival(p, "pct", keys=["projection", "row", "col"]).drop("tpa_projection", "pct"), "survival")


@query("e05_index_lags", """
    SELECT a.row, a.col, a.year, round(b.pet, 6) AS "pet-2", round(c.pet, 6) AS "pet-6", b.ppt AS "ppt-2" FROM annual a
    LEFT JOIN annual b ON a.row = b.row AND a.col = b.col AND b.year = a.year - 1 LEFT JOIN annual c ON a.row = c.row AND a.col = c.col AND c.year = a.year - 5""")
def _(i):
    from gridloom.operators.align import lagged

    out = lagged(i.annual.select("row", "col", "year", "ppt", "pet"), ["ppt", "pet"], 6)
    return r6(out.select("row", "col", "year", "`pet-2`", "`pet-6`", "`ppt-2`"), "pet-2", "pet-6")


@query("e06_systematic_sample", """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY train_year ORDER BY id) - 1 AS k FROM predictions WHERE train_year = eval_year)
    SELECT train_year, eval_year, fold, id, round(prediction, 6) AS prediction, round(target, 6) AS target, round(max(greatest(prediction, target)) OVER (PARTITION BY train_year), 6) AS "limit" FROM n WHERE k % 10 = 0""")
def _(i):
    return r6(evaluate.systematic_sample(i.predictions, 10), "prediction", "target", "limit")


#: All years of the tables: the sums over six years have two values at most there.
_REFERENCE = (1995, 2001)


_SPANS = ", ".join(map(str, climate.SPANS))
#: The psi function and its derivative at a, by their asymptotic series six steps on.
_UP, _BACK, _BACK2 = "(a + 6)", " - ".join(f"1 / (a + {k})" for k in range(6)), " + ".join(f"1 / (a + {k}) ** 2" for k in range(6))
_PSI = f"(ln({_UP}) - 0.5E0 / {_UP} - 1 / (12 * {_UP} ** 2) + 1 / (120 * {_UP} ** 4) - 1 / (252 * {_UP} ** 6) + 1 / (240 * {_UP} ** 8) - 1 / (132 * {_UP} ** 10) - {_BACK})"
_PSI1 = f"(1 / {_UP} + 0.5E0 / {_UP} ** 2 + 1 / (6 * {_UP} ** 3) - 1 / (30 * {_UP} ** 5) + 1 / (42 * {_UP} ** 7) - 1 / (30 * {_UP} ** 9) + {_BACK2})"
#: The lower incomplete gamma function P(a, x) as its power series, whose terms are all positive.
_P = "list_sum(list_transform(range(0, CAST(greatest(x - a, 0) + 14 * sqrt(x + a) + 80 AS BIGINT)), lambda n: exp((a + n) * ln(x) - x - lgamma(a + n + 1))))"
#: The inverse normal distribution function by Acklam's rational approximation (relative error 1.2e-9); fixed values.
_PPF = """CASE WHEN p <= 0 THEN CAST('-inf' AS DOUBLE) WHEN p >= 1 THEN CAST('inf' AS DOUBLE)
    WHEN least(p, 1 - p) < 0.02425E0 THEN (CASE WHEN p < 0.5E0 THEN 1 ELSE -1 END) * (((((-7.784894002430293E-03 * t - 3.223964580411365E-01) * t - 2.400758277161838E+00) * t - 2.549732539343734E+00) * t + 4.374664141464968E+00) * t + 2.938163982698783E+00)
         / ((((7.784695709041462E-03 * t + 3.224671290700398E-01) * t + 2.445134137142996E+00) * t + 3.754408661907416E+00) * t + 1)
    ELSE m * (((((-3.969683028665376E+01 * m * m + 2.209460984245205E+02) * m * m - 2.759285104469687E+02) * m * m + 1.383577518672690E+02) * m * m - 3.066479806614716E+01) * m * m + 2.506628277459239E+00)
         / (((((-5.447609879822406E+01 * m * m + 1.615858368580409E+02) * m * m - 1.556989798598866E+02) * m * m + 6.680131188771972E+01) * m * m - 1.328068155288572E+01) * m * m + 1) END"""


def _spi_sql(annual: str, reference: tuple[int, int], focal: str) -> str:
    """row, col, year and SPI of all spans for the focal years, fitted on the reference years; rounded to 3 places."""
    return f"""
    WITH r AS ({_rolling_sql(annual, "row, col, year")}),
    v AS (SELECT row, col, year, unnest([{_SPANS}]) AS s, unnest([{", ".join(f"PR{k}" for k in climate.SPANS)}]) AS v FROM r),
    f AS (SELECT row, col, s, avg(CASE WHEN v = 0 THEN 1.0E0 WHEN v IS NOT NULL THEN 0.0E0 END) AS p0, avg(CASE WHEN v > 0 THEN v END) AS mean, ln(avg(CASE WHEN v > 0 THEN v END)) - avg(CASE WHEN v > 0 THEN ln(v) END) AS gap
          FROM v WHERE year BETWEEN {reference[0]} AND {reference[1]} GROUP BY row, col, s),
    g AS (SELECT *, CASE WHEN gap > 1E-12 THEN list_reduce(list_prepend((3 - gap + sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap), [0.0E0 for k in range(12)]), lambda a, k: a - (ln(a) - {_PSI} - gap) / (1 / a - {_PSI1})) END AS a FROM f),
    x AS (SELECT row, col, year, s, v, p0, a, v * a / mean AS x FROM v LEFT JOIN g USING (row, col, s) WHERE {focal}),
    p AS (SELECT row, col, year, s, CASE WHEN a IS NULL OR v IS NULL THEN NULL WHEN v = 0 THEN p0 ELSE least(1, p0 + (1 - p0) * {_P}) END AS p FROM x),
    m AS (SELECT *, p - 0.5E0 AS m, sqrt(-2 * ln(greatest(least(p, 1 - p), 1E-300))) AS t FROM p),
    z AS (SELECT row, col, year, s, {_PPF} AS z FROM m)
    SELECT row, col, year, {", ".join(f"round(max(z) FILTER (s = {k}), 3) AS SPI{k}" for k in climate.SPANS)} FROM z GROUP BY row, col, year"""


@query("g01_spi", _spi_sql("annual_part", _REFERENCE, "year BETWEEN 1998 AND 2001"), signed=tuple(f"SPI{s}" for s in climate.SPANS))
def _(i):
    df = stored(climate.rolling_indices(i.annual_part, names=("PR",), years=YEARS), "rolled")
    names = {f"PR{s}": f"SPI{s}" for s in climate.SPANS}
    out = stdindex.standardised(df, year_range(df, 1998, 2001), names, _REFERENCE, "gamma").select("row", "col", "year", *names.values())
    return out.withColumns({c: F.round(c, 3) for c in names.values()})


@query("g02_spei")
def _(i):
    df = stored(climate.rolling_indices(i.annual_part, names=("PRET",), years=YEARS), "rolled")
    names = {f"PRET{s}": f"SPEI{s}" for s in climate.SPANS}
    return r6(stdindex.standardised(df, year_range(df, 1998, 2001), names, _REFERENCE, "shifted_gamma").select("row", "col", "year", *names.values()), *names.values())


@query("g03_index_suite")
def _(i):
    return climate.index_suite(i.annual_part, _REFERENCE, (1998, 2001), years=YEARS)


@query("g03_suite_sums", "SELECT * FROM (" + _rolling_sql("annual", "row, col, year") + ") x WHERE year BETWEEN 1998 AND 2001", signed=tuple(_ROLLED))
def _(i):
    return r6(climate.index_suite(i.annual, (1995, 1999), (1998, 2001), names=("PR", "PRET"), years=YEARS).select("row", "col", "year", *_ROLLED), *_ROLLED)


@query("g04_spliced_sums", "WITH j AS (SELECT * FROM annual WHERE year BETWEEN 1996 AND 1998 UNION ALL SELECT row, col, year, ppt * 2 AS ppt, pet, tmn, tmx FROM annual WHERE year BETWEEN 1999 AND 2001) SELECT * FROM (" + _rolling_sql("j", "row, col, year") + ") x WHERE year BETWEEN 1999 AND 2001", signed=tuple(_ROLLED))
def _(i):
    future = i.annual.withColumn("ppt", F.col("ppt") * 2)
    out = climate.index_suite(future, (1996, 1998), (1999, 2001), names=("PR", "PRET"), reference=i.annual, years=range(1996, 2002))
    return r6(out.select("row", "col", "year", *_ROLLED), *_ROLLED)
