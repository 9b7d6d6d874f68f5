"""Standardised indices: a gamma distribution fitted per cell, mapped to normal scores.

SPI: a two-parameter gamma on the non-zero values of the reference years, with the share of
zeros in front; the fit needs only counts, means and mean logarithms, which plain aggregates
give for all spans in one pass. SPEI: a three-parameter gamma; its likelihood needs the values
themselves, a few dozen for each cell, which are packed into one array. Numerical work is done
for whole Arrow batches of cells at once; a NaN that it leaves becomes NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import ship_package
from gridloom.functions.special import digamma, gammainc, gammaln, norm_ppf, trigamma
from gridloom.operators.select import year_range


def fit_statistics(df: DataFrame, columns: Sequence[str], reference_years: tuple[int, int], keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Per cell and column c over the reference years: c_n, c_p0 (share of zeros), c_mean and
    c_meanlog (of the positive values)."""
    ref = year_range(df, *reference_years)
    out = []
    for c in columns:
        v = F.col(c)
        positive = F.when(v > 0, v)
        out += [F.count(v).alias(f"{c}_n"), F.avg((v == 0).cast("double")).alias(f"{c}_p0"), F.avg(positive).alias(f"{c}_mean"), F.avg(F.log(positive)).alias(f"{c}_meanlog")]
    return ref.groupBy(*keys).agg(*out)


def gamma_shape(gap: np.ndarray) -> np.ndarray:
    """Shape a with log a - digamma(a) = gap, by Newton's method; NaN where gap <= 0."""
    gap = np.where(gap > 1e-12, gap, np.nan)
    a = (3 - gap + np.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(12):
        step = (np.log(a) - digamma(a) - gap) / (1 / a - trigamma(a))
        a = np.where(step < a, a - step, a / 2)
    return a


def gamma_scores(x: np.ndarray, p0: np.ndarray, mean: np.ndarray, meanlog: np.ndarray) -> np.ndarray:
    """Normal scores of x under the mixture of zeros and a gamma distribution."""
    with np.errstate(all="ignore"):
        a = gamma_shape(np.log(mean) - meanlog)
        cdf = np.where(x == 0, p0, p0 + (1 - p0) * gammainc(a, x * a / mean))
        return norm_ppf(np.where(np.isnan(a), np.nan, np.minimum(cdf, 1.0)))


def shifted_gamma_fit(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape, location, scale) for each row of v, whose first n entries count (rows x years).

    The likelihood is maximised over the location by golden section on log(least value -
    location), with the two-parameter fit inside; shapes stay at 1 or more, where the likelihood
    is bounded. Values with negative skew get a far location and a large shape: nearly a normal distribution.
    """
    on = np.arange(v.shape[1]) < n[:, None]
    low = np.where(on, v, np.inf).min(axis=1)
    mean = np.where(on, v, 0).sum(axis=1) / np.maximum(n, 1)
    sd = np.sqrt(np.where(on, (v - mean[:, None]) ** 2, 0).sum(axis=1) / np.maximum(n, 1))
    good = (n >= 3) & (sd > 0)
    low, mean, sd = (np.where(good, x, y) for x, y in ((low, 0.0), (mean, 1.0), (sd, 1.0)))

    def at(logd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = np.exp(logd)
        loc = low - d
        m = mean - loc
        ml = np.where(on, np.log(np.maximum(v - loc[:, None], 1e-300)), 0).sum(axis=1) / np.maximum(n, 1)
        a = np.maximum(gamma_shape(np.log(m) - ml), 1.0)
        a = np.where(np.isnan(a), 1e6, a)
        like = (a - 1) * ml - a - a * np.log(m / a) - gammaln(a)
        return like, a, loc

    lo, hi = np.log(sd * 1e-4), np.log(sd * 200)
    ratio = (np.sqrt(5) - 1) / 2
    with np.errstate(all="ignore"):
        grid = [lo + (hi - lo) * k / 24 for k in range(25)]
        likes = np.stack([at(g)[0] for g in grid])
        best = np.nanargmax(np.where(np.isfinite(likes), likes, -np.inf), axis=0)
        step = (hi - lo) / 24
        a, b = lo + (best - 1) * step, lo + (best + 1) * step
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        of_c, of_d = at(c)[0], at(d)[0]
        for _ in range(30):
            left = of_c > of_d
            a, b = np.where(left, a, c), np.where(left, d, b)
            new = np.where(left, b - ratio * (b - a), a + ratio * (b - a))
            of_new = at(new)[0]  # the other inner point is one of the two before
            c, d = np.where(left, new, d), np.where(left, c, new)
            of_c, of_d = np.where(left, of_new, of_d), np.where(left, of_c, of_new)
        _, shape, loc = at((a + b) / 2)
    scale = (mean - loc) / shape
    return tuple(np.where(good, x, np.nan) for x in (shape, loc, scale))


def shifted_gamma_scores(x: np.ndarray, shape: np.ndarray, loc: np.ndarray, scale: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return norm_ppf(np.where(np.isnan(shape), np.nan, gammainc(shape, (x - loc) / scale)))


def shifted_gamma_parameters(df: DataFrame, columns: Sequence[str], reference_years: tuple[int, int], keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Per cell and column c: c_shape, c_loc, c_scale, fitted on the reference years. Projections
    of several models share them."""
    ref = year_range(df, *reference_years)
    packed = ref.groupBy(*keys).agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in columns])
    ship_package(df.sparkSession)

    @F.arrow_udf("shape double, loc double, scale double")
    def fit(values: pa.Array) -> pa.Array:
        n = np.asarray(values.value_lengths().fill_null(0))
        v = np.zeros((len(n), max(1, int(n.max(initial=0)))))
        v[np.arange(v.shape[1]) < n[:, None]] = values.flatten().to_numpy()
        out = shifted_gamma_fit(v, n)
        return pa.StructArray.from_arrays([pa.array(x, from_pandas=True) for x in out], names=["shape", "loc", "scale"])

    fitted = packed.select(*keys, *[fit(c).alias(c) for c in columns])
    return fitted.select(*keys, *[F.col(f"{c}.{p}").alias(f"{c}_{p}") for c in columns for p in ("shape", "loc", "scale")])


FIELDS = {"gamma": ("p0", "mean", "meanlog"), "shifted_gamma": ("shape", "loc", "scale")}


def fit_parameters(df: DataFrame, columns: Sequence[str], reference_years: tuple[int, int], kind: str, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Per cell what `standardised` needs of each column: c_p0, c_mean, c_meanlog (gamma) or c_shape, c_loc, c_scale."""
    if kind not in FIELDS:
        raise ValueError(f"unknown distribution {kind!r}")
    make = fit_statistics if kind == "gamma" else shifted_gamma_parameters
    return make(df, columns, reference_years, keys)


def store_parameters(parameters: DataFrame, table: str, keys: Sequence[str] = ("row", "col"), buckets: int = 64) -> DataFrame:
    """The parameters as a table that is bucketed and sorted by cell, read again: a join with it moves
    the projections' rows alone, however many projections there are."""
    parameters.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(table)
    return parameters.sparkSession.table(table)


def standardised(
    df: DataFrame | None, focal: DataFrame, names: dict[str, str], reference_years: tuple[int, int] | None, kind: str, keys: Sequence[str] = ("row", "col"), parameters: DataFrame | None = None,
) -> DataFrame:
    """focal with a standardised column for each of `names` (source: new name), fitted on df's
    reference years, or by the `parameters` of an earlier fit (df and the years aren't looked at then); NULL
    where the value or the fit is missing."""
    ship_package(focal.sparkSession)
    if kind not in FIELDS:
        raise ValueError(f"unknown distribution {kind!r}")
    if parameters is None:
        parameters = fit_parameters(df, list(names), reference_years, kind, keys)
    make = gamma_scores if kind == "gamma" else shifted_gamma_scores

    @F.pandas_udf("double")
    def score(x: pd.Series, first: pd.Series, second: pd.Series, third: pd.Series) -> pd.Series:
        return pd.Series(make(*(s.to_numpy(dtype=float) for s in (x, first, second, third))))

    both = focal.join(parameters, list(keys), "left")
    new = {to: score(F.col(c), *[F.col(f"{c}_{f}") for f in FIELDS[kind]]) for c, to in names.items()}
    return both.withColumns(new).select(*focal.columns, *names.values())
