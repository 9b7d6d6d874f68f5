"""Special functions on numpy arrays: what the gamma and normal distributions need."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.vectorize(math.erfc, otypes=[float])

# Lanczos approximation, g = 7, n = 9.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def gammaln(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0."""
    x = np.asarray(x, dtype=float)
    small = x < 0.5
    z = np.where(small, 1 - x, x) - 1
    s = np.full_like(z, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        s = s + c / (z + i)
    t = z + 7.5
    big = 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(s)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(small, np.log(np.pi / np.abs(np.sin(np.pi * x))) - big, big)


def _shifted(x: np.ndarray, term) -> tuple[np.ndarray, np.ndarray]:
    """(x moved to 6 or more, sum of term(x) over the steps)."""
    x, total = np.array(x, dtype=float), np.zeros(np.shape(x))
    for _ in range(6):
        low = x < 6
        total = np.where(low, total + term(np.where(low, x, 1.0)), total)
        x = np.where(low, x + 1, x)
    return x, total


def digamma(x: np.ndarray) -> np.ndarray:
    y, back = _shifted(x, lambda v: 1 / v)
    r = 1 / (y * y)
    return np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))) - back


def trigamma(x: np.ndarray) -> np.ndarray:
    y, back = _shifted(x, lambda v: 1 / (v * v))
    r = 1 / (y * y)
    return 1 / y + r / 2 + r / y * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30))) + back


#: Shape from which on the incomplete gamma function is taken from its uniform expansion: the series and the
#: continued fraction need about nine times the square root of the shape of steps.
LARGE_SHAPE = 20_000.0


def _gammainc_large(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Uniform asymptotic expansion (Temme 1979), two terms: a normal distribution and its correction."""
    with np.errstate(all="ignore"):
        mu = x / a - 1
        eta = np.sign(mu) * np.sqrt(np.maximum(2 * (mu - np.log1p(mu)), 0))
        near = np.abs(eta) < 0.05
        c0 = np.where(near, -1 / 3 + eta * (1 / 12 - eta * (2 / 135 - eta * (1 / 864 + eta / 2835))), 1 / mu - 1 / eta)
        c1 = np.where(near, -1 / 540 - eta / 288, 1 / eta**3 - 1 / mu**3 - 1 / mu**2 - 1 / (12 * mu))
        z = eta * np.sqrt(a / 2)
        return np.clip(0.5 * _erfc(-z) - np.exp(-z * z) / np.sqrt(2 * np.pi * a) * (c0 + c1 / a), 0.0, 1.0)


def gammainc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function; 0 for x <= 0, 1 for x = inf."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.where(x == np.inf, 1.0, 0.0)
    ok = (x > 0) & np.isfinite(x) & (a > 0)
    out = np.where(np.isnan(a) | np.isnan(x), np.nan, out)
    large = ok & (a >= LARGE_SHAPE)
    if large.any():
        out[large] = _gammainc_large(a[large], x[large])
    series, tail = ok & ~large & (x < a + 1), ok & ~large & (x >= a + 1)
    if series.any():
        p, q = a[series], x[series]
        term = total = 1 / p
        for n in range(1, 2000):
            term = term * q / (p + n)
            total = total + term
            if np.all(term < total * 1e-16):
                break
        out[series] = total * np.exp(p * np.log(q) - q - gammaln(p))
    if tail.any():
        p, q = a[tail], x[tail]
        b = q + 1 - p  # continued fraction by Lentz
        c, d = np.full_like(b, 1e300), 1 / b
        h = d
        for n in range(1, 2000):
            an = -n * (n - p)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out[tail] = 1 - h * np.exp(p * np.log(q) - q - gammaln(p))
    return out


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """Inverse of the standard normal distribution; -inf and inf at 0 and 1, NaN outside.

    Acklam's rational approximation, refined by Halley's method.
    """
    # Acklam's coefficients.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
    p = np.asarray(p, dtype=float)
    q = np.clip(np.nan_to_num(p, nan=0.5), 1e-300, 1 - 1e-16)
    tail = np.minimum(q, 1 - q)
    t = np.sqrt(-2 * np.log(np.clip(tail, 1e-300, 0.5)))
    outer = np.where(q < 0.5, 1, -1) * np.polyval(c, t) / np.polyval(d, t)
    m = q - 0.5
    x = np.where(tail < 0.02425, outer, m * np.polyval(a, m * m) / np.polyval(b, m * m))
    tails = 0.5 * _erfc(np.where(q < 0.5, -x, x) / 2**0.5)
    u = np.where(q < 0.5, tails - q, (1 - q) - tails) * np.sqrt(2 * np.pi) * np.exp(np.minimum(x * x / 2, 700))
    x = x - u / (1 + x * u / 2)
    return np.select([p == 0, p == 1, ~((p > 0) & (p < 1))], [-np.inf, np.inf, np.nan], x)
