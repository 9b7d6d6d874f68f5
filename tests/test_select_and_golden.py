"""Selections, joins by rounded coordinates, exact medians and samples, and golden values of the
standardised indices and of the forest models, each against plain Python."""

from __future__ import annotations

import math
from statistics import NormalDist, median

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.sized import shared_dir
from gridloom.operators import align, climate, evaluate, features, models, projection, select, stdindex


def test_selections(spark):
    df = spark.createDataFrame([(0, 0, 1999, 1.0, None), (0, 1, 2000, None, 2.0), (0, 2, None, 3.0, 1.0), (0, 0, 2001, 3.0, 1.0)], "row int, col int, year int, target double, slope double")
    assert {r.year for r in select.year_range(df, 1999, 2000).collect()} == {1999, 2000}
    assert select.year_slice(df, 2001).columns == ["row", "col", "target", "slope"] and select.year_slice(df, 2001).count() == 1
    assert select.present_samples(df, "target", ["slope"]).count() == 2
    assert select.chosen(df, [3.0]).count() == 2 and select.chosen(df, None, [1999, 2001]).count() == 2 and select.chosen(df).count() == 4
    assert [r.year for r in select.distinct_splits(df.dropna(subset=["year"]), ["year"]).collect()] == [1999, 2000, 2001]
    assert {tuple(r) for r in select.shared_keys(df, df.where("col < 2")).collect()} == {(0, 0), (0, 1)}
    assert {tuple(r) for r in select.missing_keys(df, df.where("col < 2")).collect()} == {(0, 2)}
    assert [r.position for r in select.in_time_order(df, "year").where("col = 0").orderBy("year").collect()] == [1, 2]


def test_join_on_rounded_coordinates(spark):
    kind = "easting double, northing double, year int, {} double"
    left = spark.createDataFrame([(405.0, -135.0, 1999, 1.0), (675.00004, -135.0, 1999, 2.0), (945.0, -135.0, 2000, 3.0), (None, -135.0, 1999, 4.0)], kind.format("v"))
    right = spark.createDataFrame([(405.00003, -135.00004, 1999, 10.0), (675.0, -135.0, 1999, 20.0), (945.0002, -135.0, 2000, 30.0), (None, -135.0, 1999, 40.0)], kind.format("w"))
    got = align.spatial_join(left, right, ["year"])
    assert got.columns == ["year", "easting", "northing", "v", "w"] and {(r.v, r.w, r.easting) for r in got.collect()} == {(1.0, 10.0, 405.0), (2.0, 20.0, 675.00004)}
    static = align.spatial_join(left, right.drop("year"))
    assert {(r.v, r.w) for r in static.collect()} == {(1.0, 10.0), (2.0, 20.0)}


def test_variable_files_have_years_and_names_of_their_own(spark):
    a = spark.createDataFrame([(0, 0, b, float(b)) for b in (1, 2)], "row int, col int, band int, x double")
    b = spark.createDataFrame([(0, 0, b, float(10 * b)) for b in (1, 2)], "row int, col int, band int, x double")
    got = align.variable_files([(a, [2001, 2002], "x", "area"), (b, [2002, 2001], "x", "tpa")])
    assert {(r.year, r.area, r.tpa) for r in got.collect()} == {(2001, 1.0, 20.0), (2002, 2.0, 10.0)}
    with pytest.raises(ValueError, match="keys differ"):
        align.variable_files([(a, [2001, 2002], "x", "area"), (b, [2002, 2003], "x", "tpa")])


def test_missing_pairs_of_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "a"), (1, None)], "x int, y string")
    assert {tuple(r) for r in align.missing_pairs(df, "x", "y").collect()} == {(1, "b"), (2, "a")}


def test_features_by_name(spark):
    yearly = spark.createDataFrame([(0, 0, y, float(y), float(-y)) for y in (1998, 1999, 2000)], "row int, col int, year int, PR1 double, hot double")
    static = spark.createDataFrame([(0, 0, 7.0, 135.0)], "row int, col int, slope double, eastings double")
    names = ["hot-2", "slope", "PR1-1", "eastings", "PR1-3"]
    got = features.by_name(yearly, static, names, (1999, 2001)).orderBy("year").collect()
    assert [tuple(r) for r in got] == [(0, 0, 1999, -1998.0, 7.0, 1999.0, 135.0, None), (0, 0, 2000, -1999.0, 7.0, 2000.0, 135.0, 1998.0)]
    with pytest.raises(ValueError, match="no table has the feature 'PR9-1'"):
        features.by_name(yearly, static, ["PR9-1"], (1999, 2001))


@pytest.mark.parametrize("case", ["spread", "ties", "tail", "infinite", "even"])
def test_exact_regional_median(spark, case):
    rng = np.random.default_rng(3)
    values = {
        "spread": rng.normal(size=4001), "ties": rng.integers(0, 3, 4000).astype(float), "tail": np.exp(rng.normal(size=2001) * 30),
        "infinite": np.append(rng.normal(size=50), [np.inf] * 20 + [-np.inf] * 31), "even": np.array([1.0, 4.0]),
    }[case]
    rows = [(y, float(v * y)) for y in (1, 2) for v in values] + [(1, None), (3, None)]
    df = spark.createDataFrame(rows, "year int, v double")
    got = {r.year: r.v for r in projection.regional_series(df, "v").collect()}
    assert got == {y: median((values * y).tolist()) for y in (1, 2)}


def test_systematic_sample_is_every_step_th(spark):
    rng = np.random.default_rng(0)
    ids = sorted(rng.choice(5000, 700, replace=False).tolist())
    df = spark.createDataFrame([(y, y, i, float(i), float(-i)) for y in (1, 2) for i in ids] + [(1, 2, 1, 0.0, 0.0)], "train_year int, eval_year int, id long, prediction double, target double")
    got = evaluate.systematic_sample(df, 50, slices=16).collect()
    assert sorted((r.train_year, r.id) for r in got) == [(y, i) for y in (1, 2) for i in ids[::50]]
    assert {r.limit for r in got} == {float(ids[::50][-1])}


# --- golden values: gamma fits by bisection, distribution functions by quadrature


def golden_cdf(x, a, scale):
    """Gamma distribution function by Simpson's rule in u, with t = u**4 (smooth at 0 for shapes over 1/4)."""
    if x <= 0:
        return 0.0
    top, n = (x / scale) ** 0.25, 4000
    f = lambda u: 4 * u ** (4 * a - 1) * math.exp(-(u**4)) if u else 0.0
    s = f(0.0) + f(top) + sum((4 if k % 2 else 2) * f(top * k / n) for k in range(1, n))
    return s * top / n / 3 / math.gamma(a)


def golden_shape(values):
    gap = math.log(sum(values) / len(values)) - sum(map(math.log, values)) / len(values)
    digamma = lambda a: (math.lgamma(a * (1 + 1e-5)) - math.lgamma(a * (1 - 1e-5))) / (2e-5 * a)
    lo, hi = 1e-3, 1e4
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if math.log(mid) - digamma(mid) > gap else (lo, mid)
    return lo


def test_spi_golden_values_over_six_spans(spark):
    rng = np.random.default_rng(11)
    rain = np.where(rng.random((2, 30)) < 0.15, 0.0, rng.gamma(2.0, 30.0, (2, 30)))
    df = spark.createDataFrame([(c, 0, 1980 + y, float(rain[c, y]), 0.0) for c in range(2) for y in range(30)], "row int, col int, year int, ppt double, pet double")
    got = {(r.row, r.year): r for r in climate.index_suite(df, (1980, 2003), (2000, 2009), names=("SPI",)).collect()}
    for c in range(2):
        for s in range(1, 7):
            sums = {1980 + y: float(rain[c, y - s + 1 : y + 1].sum()) for y in range(s - 1, 30)}
            ref = [v for y, v in sums.items() if y <= 2003]
            wet = [v for v in ref if v > 0]
            a, p0 = golden_shape(wet), 1 - len(wet) / len(ref)
            for y in range(2000, 2010):
                p = p0 if sums[y] == 0 else p0 + (1 - p0) * golden_cdf(sums[y], a, sum(wet) / len(wet) / a)
                z = got[c, y][f"SPI{s}"]
                assert (z == -math.inf and p == 0) or abs(z - NormalDist().inv_cdf(p)) < 1e-4, (c, s, y)


def test_spei_golden_values(spark):
    rng = np.random.default_rng(12)
    water = rng.gamma(5.0, 10.0, (2, 40)) - 80
    df = spark.createDataFrame([(c, 0, 1970 + y, float(water[c, y]), 0.0) for c in range(2) for y in range(40)], "row int, col int, year int, ppt double, pet double")
    got = {(r.row, r.year): r for r in climate.index_suite(df, (1970, 2009), (2000, 2009), names=("SPEI",)).collect()}
    for c in range(2):
        for s in (1, 3, 6):
            sums = {1970 + y: float(water[c, y - s + 1 : y + 1].sum()) for y in range(s - 1, 40)}
            ref = np.array(list(sums.values()))

            def best(loc):
                v = (ref - loc).tolist()
                a = max(1.0, golden_shape(v))
                scale = sum(v) / len(v) / a
                return sum((a - 1) * math.log(x) - x / scale for x in v) - len(v) * (a * math.log(scale) + math.lgamma(a)), a, scale

            lo, hi = math.log(ref.std() * 1e-3), math.log(ref.std() * 200)
            grid = [lo + (hi - lo) * k / 60 for k in range(61)]
            at = max(range(61), key=lambda k: best(ref.min() - math.exp(grid[k]))[0])
            lo, hi = grid[max(0, at - 1)], grid[min(60, at + 1)]
            for _ in range(60):
                a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
                lo, hi = (lo, b) if best(ref.min() - math.exp(a))[0] > best(ref.min() - math.exp(b))[0] else (a, hi)
            loc = ref.min() - math.exp((lo + hi) / 2)
            _, shape, scale = best(loc)
            if shape > 150:  # quadrature with math.gamma ends there
                continue
            for y in range(2000, 2010):
                z = NormalDist().inv_cdf(golden_cdf(sums[y] - loc, shape, scale))
                assert abs(got[c, y][f"SPEI{s}"] - z) < 2e-3, (c, s, y)


def test_fits_skip_missing_years(spark):
    df = spark.createDataFrame([(0, y, None if y % 5 == 0 else float(y % 7 + 1)) for y in range(1980, 2010)] + [(1, y, None) for y in range(1980, 2010)], "cell int, year int, v double")
    got = {r.cell: r for r in stdindex.shifted_gamma_parameters(df, ["v"], (1980, 2009), ["cell"]).collect()}
    assert got[0].v_shape >= 1 and got[1].v_shape is None


# --- models, held against forests that are trained and applied one by one


def _table(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 0, i, i % 3, 2000 + y, float(1 + (i + y) % 5), float(i % 7) if i % 11 else None, float(rng.normal()) if i % 13 else math.inf) for i in range(80) for y in range(3)]
    return spark.createDataFrame(rows, "row int, col int, id long, fold int, year int, target double, `PR1-1` double, slope double")


def _plain(df, names):
    from pyspark.ml.feature import VectorAssembler

    whole = df.dropna(subset=names).withColumns({"f0": F.col(f"`{names[0]}`"), "f1": F.when(F.col(names[1]) == math.inf, 100.0).otherwise(F.col(names[1]))})
    return VectorAssembler(inputCols=["f0", "f1"], outputCol="features").transform(whole)


def test_fold_grid_equals_models_trained_one_by_one(spark):
    t, names = _table(spark), ["PR1-1", "slope"]
    found, _ = models.fold_grid(t, names, trees=20)
    got = {(r.train_year, r.eval_year, r.id): r.prediction for r in found.collect()}
    whole = _plain(t, names)
    assert len(got) == 3 * whole.count()
    means = {}
    for year in (2000, 2001, 2002):
        for fold in range(3):
            train = whole.where((F.col("year") == year) & (F.col("fold") != fold))
            model = models.regressor(0, 20).fit(train)
            for r in model.transform(whole.where(F.col("fold") == fold)).collect():
                means[year, r.year, r.id] = r.prediction
    diff = np.array([abs(got[k] - means[k]) for k in means])
    assert set(got) == set(means) and np.median(diff) < 0.5  # bootstraps depend on how rows lie in partitions


def test_year_model_severity_and_scoring(spark):
    t, names = _table(spark), ["PR1-1", "slope"]
    easy = t.withColumn("target", F.when(F.col("`PR1-1`") > 3, 5.0).otherwise(1.0))
    model = models.fit_year(easy, names, 2001)
    out = models.apply_model(model, easy, names, (2000, 2002)).collect()
    assert {r.year for r in out} == {2000, 2001} and len(out) == 160
    for r in out:
        assert (r.prediction is None) == (r["PR1-1"] is None)
        assert r.prediction is None or abs(r.prediction - r.target) < 0.2
    assert any(r.slope == math.inf and r.prediction is not None for r in out)  # clamped in the vector only
    kinds, extra = models.fit_severity(easy, names)
    got = models.apply_model(kinds, easy.withColumn("severity", F.lit("x")), extra["features"], (2000, 2001), "severity").collect()
    assert all(r.severity is None or r.severity == r.target for r in got)
    middle, _ = models.fit_severity(easy, names, classes=False)
    # thresholds of extremely randomised trees are drawn, so a few trees split beside the step
    found = [r for r in models.apply_model(middle, easy, names, (2000, 2001)).collect() if r.prediction is not None]
    assert found and all(abs(r.prediction - (75 if r.target == 5 else 2)) < 3 for r in found)


def test_leave_year_out_learns_from_other_years_only(spark):
    t = _table(spark).withColumn("target", F.when((F.col("`PR1-1`") > 3) != (F.col("year") == 2002), 5.0).otherwise(1.0))
    got = models.leave_year_out(t, ["PR1-1", "slope"], trees=20).collect()
    wrong = [r.prediction != r.target for r in got if r.year == 2002]
    assert np.mean(wrong) > 0.9 and len(wrong) > 50  # the other years say the contrary


def test_shared_folder_is_named(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
