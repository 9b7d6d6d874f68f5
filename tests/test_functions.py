"""Missing values, names, grids and special functions on hand-made values."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import missing, names, special
from gridloom.functions.grid import GridSpec, rounded, shuffled_folds
from gridloom.operators import align


def test_poison_and_skip(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, v double")
    got = {r.k: (r.p, r.s) for r in df.groupBy("k").agg(missing.poison(F.sum, F.col("v")).alias("p"), F.sum("v").alias("s")).collect()}
    assert got == {"a": (None, 1.0), "b": (5.0, 5.0)}


def test_unknown_statistic():
    with pytest.raises(ValueError, match="unknown statistic"):
        missing.statistic("mode")


def test_clamp(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.5,)], "v double")
    assert sorted(r.v for r in missing.clamp_columns(df, ["v"], 10.0).collect()) == [-10.0, 1.5, 10.0]
    with pytest.raises(Exception, match="missing value in v"):
        missing.clamp_columns(spark.createDataFrame([(None,)], "v double"), ["v"], 10.0).collect()


def test_member_names(spark):
    df = spark.createDataFrame([("PPT1999Oct.asc",), ("ppt1999xyz.asc",), ("7up.asc",)], "m string")
    got = [(r[0], r[1] and str(r[1])) for r in df.select(names.member_variable(F.col("m")), names.member_month(F.col("m"))).collect()]
    assert got == [("ppt", "1999-10-01"), ("ppt", None), (None, None)]
    with pytest.raises(Exception, match="no month in"):
        df.select(names.checked(names.member_month(F.col("m")), F.col("m"), "month")).collect()


def test_rounding_is_half_even(spark):
    got = spark.range(1).select(rounded(F.lit(0.00005)).alias("a"), rounded(F.lit(0.00015)).alias("b")).first()
    assert (got.a, got.b) == (0.0, 0.0002)


def test_block_folds_and_ids(spark):
    g = GridSpec(5, 5, 0.0, 0.0, 1.0, 1.0)
    df = spark.range(25).select((F.col("id") / 5).cast("int").alias("r"), (F.col("id") % 5).cast("int").alias("c"))
    folds = [[x.f for x in df.where(f"r = {r}").orderBy("c").select(g.block_fold(F.col("r"), F.col("c"), 2).alias("f")).collect()] for r in range(5)]
    assert folds == [[0, 0, 1, 1, 2]] * 2 + [[3, 3, 4, 4, 5]] * 2 + [[6, 6, 7, 7, 8]]


def test_shuffled_folds_keep_sizes(spark):
    cells = spark.range(500).select("id", (F.col("id") / 37).cast("int").alias("fold"))
    one, two, other = (shuffled_folds(d, seed).collect() for d, seed in ((cells, 1), (cells.repartition(7), 1), (cells, 2)))
    assert sorted(r.fold for r in one) == sorted(r.fold for r in cells.collect())
    assert sorted(r.id for r in one) == list(range(500))
    assert sorted(one) == sorted(two) != sorted(other)


def test_special_functions():
    assert np.allclose(special.gammaln(np.array([0.3, 1.0, 5.0, 100.5])), [1.0957979948180756, 0.0, np.log(24), 361.43554046777774], atol=1e-9)
    assert np.allclose(special.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649015329, -1.9635100260214235, 2.251752589066721])
    assert np.allclose(special.trigamma(np.array([1.0, 0.5])), [np.pi**2 / 6, np.pi**2 / 2])
    x = np.linspace(0, 30, 7)
    assert np.allclose(special.gammainc(np.ones(7), x), 1 - np.exp(-x))
    a, top = 2.7, 4.2
    grid = np.linspace(1e-9, top, 400_001)
    f = grid ** (a - 1) * np.exp(-grid)
    assert np.isclose(special.gammainc(np.array([a]), np.array([top]))[0], np.trapezoid(f, grid) / np.exp(special.gammaln(a)), atol=1e-7)
    p = np.array([1e-9, 1e-4, 0.02, 0.3, 0.5, 0.9, 0.9999, 1 - 1e-9])
    assert np.allclose(special.norm_ppf(p), [NormalDist().inv_cdf(v) for v in p], atol=1e-8)
    assert special.norm_ppf(np.array([0.0, 1.0])).tolist() == [-np.inf, np.inf]
    assert np.isnan(special.norm_ppf(np.array([np.nan, 1.5]))).all()


def test_exact_join_and_completeness(spark):
    a, b = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, x double"), spark.createDataFrame([(1, 5.0)], "k int, y double")
    with pytest.raises(ValueError, match="keys differ"):
        align.exact_join(a, b, ["k"])
    assert align.exact_join(a.where("k = 1"), b, ["k"]).count() == 1
    with pytest.raises(ValueError, match="missing: v 2"):
        align.require_complete(spark.createDataFrame([("u", 1), ("u", 2), ("v", 1)], "a string, b int"), "a", "b")


def test_incomplete_gamma_of_large_shapes():
    """Against the power series, summed in full; its first term by Stirling's formula, as logarithms of 1e8 cancel badly."""

    def brute(a, x):
        mu = (x - a) / a
        term = total = math.exp(-a * (mu - math.log1p(mu)) - 1 / (12 * a)) / math.sqrt(2 * math.pi * a)
        for n in range(1, int(max(x - a, 0) + 12 * (x + a) ** 0.5 + 80)):
            term *= x / (a + n)
            total += term
        return total

    for a in (19_000.0, 20_000.0, 60_000.0, 1e6, 2e7):
        x = a + np.array([-8.0, -5.0, -2.0, -0.5, -1e-3, 0.0, 1e-3, 0.5, 2.0, 5.0]) * np.sqrt(a)
        got = special.gammainc(np.full(len(x), a), x)
        assert np.allclose(got, [brute(a, v) for v in x], rtol=0, atol=1e-9 if a < special.LARGE_SHAPE else 1e-11), a
    far = special.gammainc(np.array([2e4, 2e4, 2e4]), np.array([1e-3, 1e3, 1e6]))
    assert far.tolist() == [0.0, 0.0, 1.0]
    two = special.gammainc(np.array([1e9, 1e9, 1e9]), np.array([1e9 - 1e9**0.5, 1e9, 1e9 + 1e9**0.5]))
    assert np.allclose(special.norm_ppf(two), [-1, 0, 1], atol=2e-5)
