"""Terrain metrics of an elevation grid in moving windows.

Cells are grouped into square tiles with a halo of neighbours (a cell is sent to every tile whose
halo it lies in), and each tile is worked on as an array. Missing cells are left out of
windows. A window has w x w cells, w odd; at the grid's border it is cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import ship_package

TILE = 256
METRICS = ("slope", "eastness", "northness", "vrm", "tpi", "rie", "sapa", "dmv", "adjsd")


def _shift(z: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """z at (row + dr, col + dc); NaN outside."""
    out = np.full_like(z, np.nan)
    h, w = z.shape
    r0, r1, c0, c1 = max(0, -dr), min(h, h - dr), max(0, -dc), min(w, w - dc)
    if r0 < r1 and c0 < c1:
        out[r0:r1, c0:c1] = z[r0 + dr : r1 + dr, c0 + dc : c1 + dc]
    return out


def _box(z: np.ndarray, radius: int) -> np.ndarray:
    """Sums over the square window of the radius, by prefix sums; z has no NaN."""
    for axis in (0, 1):
        p = np.concatenate([np.zeros_like(np.take(z, [0], axis)), np.cumsum(z, axis=axis)], axis=axis)
        n = z.shape[axis]
        at = np.arange(n)
        z = np.take(p, np.minimum(at + radius + 1, n), axis) - np.take(p, np.maximum(at - radius, 0), axis)
    return z


def focal_mean(z: np.ndarray, radius: int) -> np.ndarray:
    ok = ~np.isnan(z)
    base = np.nanmean(z) if ok.any() else 0.0
    n = _box(ok.astype(float), radius)
    with np.errstate(all="ignore"):
        return np.where(n > 0, base + _box(np.where(ok, z - base, 0.0), radius) / n, np.nan)


def focal_sd(z: np.ndarray, radius: int) -> np.ndarray:
    """Sample standard deviation over the window."""
    ok = ~np.isnan(z)
    base = np.nanmean(z) if ok.any() else 0.0
    d = np.where(ok, z - base, 0.0)
    n, s, q = _box(ok.astype(float), radius), _box(d, radius), _box(d * d, radius)
    with np.errstate(all="ignore"):
        return np.where(n > 1, np.sqrt(np.maximum(q - s * s / n, 0) / (n - 1)), np.nan)


def gradient(z: np.ndarray, w: int, res: float) -> tuple[np.ndarray, np.ndarray]:
    """(dz/dx eastwards, dz/dy northwards) from the window's outer columns and rows, weighted
    1, 2, ..., 2, 1 as in Horn's method, to which it comes down for w = 3."""
    r = w // 2
    weight = [1.0] + [2.0] * (w - 2) + [1.0]
    gx = sum(k * (_shift(z, d, r) - _shift(z, d, -r)) for k, d in zip(weight, range(-r, r + 1), strict=True))
    gy = sum(k * (_shift(z, -r, d) - _shift(z, r, d)) for k, d in zip(weight, range(-r, r + 1), strict=True))
    by = 2.0 * (w - 1) * (w - 1) * res
    return gx / by, gy / by


def slope_aspect(z: np.ndarray, w: int, res: float) -> dict[str, np.ndarray]:
    gx, gy = gradient(z, w, res)
    steep = np.hypot(gx, gy)
    with np.errstate(all="ignore"):
        return {
            "slope": np.degrees(np.arctan(steep)),
            "eastness": np.where(steep == 0, 0.0, -gx / steep),  # the aspect faces downhill
            "northness": np.where(steep == 0, 0.0, -gy / steep),
        }


def ruggedness(z: np.ndarray, w: int, res: float) -> np.ndarray:
    """Vector ruggedness: 1 - length of the mean of the window's unit normals."""
    gx, gy = gradient(z, 3, res)
    norm = np.sqrt(1 + gx * gx + gy * gy)
    ok, r = ~np.isnan(norm), w // 2
    n = _box(ok.astype(float), r)
    sums = [_box(np.where(ok, c / norm, 0.0), r) for c in (-gx, -gy, np.ones_like(gx))]
    with np.errstate(all="ignore"):
        return np.where(n > 0, 1 - np.sqrt(sum(s * s for s in sums)) / n, np.nan)


def position(z: np.ndarray, w: int) -> np.ndarray:
    """z minus the mean of the window without its centre."""
    ok, r = ~np.isnan(z), w // 2
    n = _box(ok.astype(float), r) - ok
    base = np.nanmean(z) if ok.any() else 0.0
    d = np.where(ok, z - base, 0.0)
    with np.errstate(all="ignore"):
        return np.where(ok & (n > 0), d - (_box(d, r) - d) / n, np.nan)


def surface_ratio(z: np.ndarray, w: int, res: float, slope_correction: bool = True) -> np.ndarray:
    """Surface to planar area: of each cell, eight triangles to its neighbours (halved edges, Jenness
    2004), summed over the window; the planar area is that of the window, by its slope if corrected."""
    ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    area = np.zeros_like(z)
    for (ar, ac), (br, bc) in zip(ring, ring[1:] + ring[:1], strict=True):
        za, zb = _shift(z, ar, ac), _shift(z, br, bc)
        a = np.sqrt((res * np.hypot(ar, ac)) ** 2 + (za - z) ** 2) / 2
        b = np.sqrt((res * np.hypot(br, bc)) ** 2 + (zb - z) ** 2) / 2
        c = np.sqrt(res**2 + (za - zb) ** 2) / 2
        s = (a + b + c) / 2
        area = area + np.sqrt(np.maximum(s * (s - a) * (s - b) * (s - c), 0))
    ok, r = ~np.isnan(area), w // 2
    n = _box(ok.astype(float), r)
    flat = n * res * res
    if slope_correction:
        gx, gy = gradient(z, w, res)
        flat = flat * np.sqrt(1 + gx * gx + gy * gy)  # 1 / cos(slope)
    with np.errstate(all="ignore"):
        return np.where(n > 0, _box(np.where(ok, area, 0.0), r) / flat, np.nan)


def deviation(z: np.ndarray, radius: int, stand: str = "range") -> np.ndarray:
    """z minus the mean over a circle, divided by the circle's range or sd, or not at all."""
    around = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    n, s, q = np.zeros_like(z), np.zeros_like(z), np.zeros_like(z)
    lo, hi = np.full_like(z, np.inf), np.full_like(z, -np.inf)
    base = np.nanmean(z) if (~np.isnan(z)).any() else 0.0
    for i, j in around:
        v = _shift(z, i, j) - base
        ok = ~np.isnan(v)
        d = np.where(ok, v, 0.0)
        n, s, q = n + ok, s + d, q + d * d
        lo, hi = np.where(ok, np.minimum(lo, v), lo), np.where(ok, np.maximum(hi, v), hi)
    with np.errstate(all="ignore"):
        over = {"none": 1.0, "range": hi - lo, "sd": np.sqrt(np.maximum(q - s * s / n, 0) / (n - 1))}[stand]
        out = (z - base - s / n) / over
        return np.where(np.isfinite(out), out, np.nan)


def adjusted_sd(z: np.ndarray, w: int, res: float) -> np.ndarray:
    """Standard deviation of the residuals of the window's least-squares plane (n - 3 degrees of freedom)."""
    r, base = w // 2, np.nanmean(z) if (~np.isnan(z)).any() else 0.0
    m = {k: np.zeros_like(z) for k in ("n", "x", "y", "z", "xx", "yy", "xy", "xz", "yz", "zz")}
    for i in range(-r, r + 1):
        for j in range(-r, r + 1):
            v = _shift(z, i, j) - base
            ok = (~np.isnan(v)).astype(float)
            d = np.where(ok > 0, v, 0.0)
            for k, t in (("n", ok), ("x", j * ok), ("y", i * ok), ("z", d), ("xx", j * j * ok), ("yy", i * i * ok), ("xy", i * j * ok), ("xz", j * d), ("yz", i * d), ("zz", d * d)):
                m[k] += t
    with np.errstate(all="ignore"):
        c = {k: m[k] - m[k[0]] * m[k[1]] / m["n"] for k in ("xx", "yy", "xy", "xz", "yz", "zz")}
        det = c["xx"] * c["yy"] - c["xy"] ** 2
        b1 = (c["xz"] * c["yy"] - c["yz"] * c["xy"]) / det
        b2 = (c["yz"] * c["xx"] - c["xz"] * c["xy"]) / det
        left = np.maximum(c["zz"] - b1 * c["xz"] - b2 * c["yz"], 0)
        return np.where((m["n"] > 3) & (det > 1e-9), np.sqrt(left / (m["n"] - 3)), np.nan)


def metrics(z: np.ndarray, names: tuple[str, ...], w: int, res: float, radius: int = 9, stand: str = "range") -> dict[str, np.ndarray]:
    """The named metrics of one array."""
    out: dict[str, np.ndarray] = {}
    if {"slope", "eastness", "northness"} & set(names):
        out |= slope_aspect(z, w, res)
    makers = {
        "vrm": lambda: ruggedness(z, w, res),
        "tpi": lambda: position(z, w),
        "rie": lambda: focal_sd(z - focal_mean(z, w // 2), w // 2),
        "sapa": lambda: surface_ratio(z, w, res),
        "dmv": lambda: deviation(z, radius, stand),
        "adjsd": lambda: adjusted_sd(z, w, res),
    }
    out |= {k: make() for k, make in makers.items() if k in names}
    return {k: np.where(np.isnan(z), np.nan, out[k]) for k in names}


def terrain(dem: DataFrame, names: tuple[str, ...] = METRICS, w: int = 9, res: float = 1.0, radius: int = 9, stand: str = "range", value: str = "elevation", tile: int = TILE) -> DataFrame:
    """(row, col, value, metrics) of the cells of dem (row, col, value). Cells whose window has too
    few values are missing there; a cell without elevation has no metrics."""
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"unknown metric {unknown[0]!r}; known are {', '.join(METRICS)}")
    if w % 2 == 0 or w < 3:
        raise ValueError("the window must have an odd number of cells, 3 or more")
    r = w // 2
    halo = max(2 * r, radius, r + 2)  # a residual's window of windows, the circle, a ring around the window
    near = F.sequence(F.floor((F.col("row") - halo) / F.lit(tile)), F.floor((F.col("row") + halo) / F.lit(tile)))
    across = F.sequence(F.floor((F.col("col") - halo) / F.lit(tile)), F.floor((F.col("col") + halo) / F.lit(tile)))
    dealt = dem.select("row", "col", F.col(value).cast("double").alias("z")).withColumn("tr", F.explode(near)).withColumn("tc", F.explode(across))
    ship_package(dem.sparkSession)

    def one(key: tuple[int, int], cells: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[0] * tile - halo, key[1] * tile - halo
        z = np.full((tile + 2 * halo, tile + 2 * halo), np.nan)
        rows, cols = cells["row"].to_numpy() - r0, cells["col"].to_numpy() - c0
        z[rows, cols] = cells["z"].to_numpy(dtype=float)
        own = (rows >= halo) & (rows < halo + tile) & (cols >= halo) & (cols < halo + tile)
        out = {"row": cells["row"].to_numpy()[own], "col": cells["col"].to_numpy()[own], value: cells["z"].to_numpy(dtype=float)[own]}
        # the array ends where the grid does, so that border windows are cut, not padded
        used = np.s_[rows.min() : rows.max() + 1, cols.min() : cols.max() + 1]
        made = metrics(z[used], names, w, res, radius, stand)
        return pd.DataFrame(out | {k: m[rows[own] - rows.min(), cols[own] - cols.min()] for k, m in made.items()})

    schema = f"row int, col int, {value} double, " + ", ".join(f"{n} double" for n in names)
    return dealt.withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")}).groupBy("tr", "tc").applyInPandas(one, schema)
