"""Between grids and regions: regridding, map projection, clipping by polygons."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import ship_package
from gridloom.functions.grid import GridSpec
from gridloom.functions.sized import stored

#: Rows up to which the source of a regridding is broadcast.
BROADCAST_CELLS = 500_000
#: Points of polygons up to which tasks get all of them.
BROADCAST_POINTS = 1_000
#: Parts of about equal numbers of cells in which scanlines meet edges, and spans meet cells.
BANDS, STRETCHES = 4096, 256
#: Years that a list of clipping regions may name.
BROADCAST_YEARS = 10_000


@dataclass(frozen=True)
class Albers:
    """Albers equal-area conic projection on an ellipsoid (Snyder 1987), as column expressions."""

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    false_easting: float = 0.0
    false_northing: float = 0.0
    a: float = 6378137.0
    e2: float = 0.00669438002290079

    def _q(self, sine: float) -> float:
        e = math.sqrt(self.e2)
        return (1 - self.e2) * (sine / (1 - self.e2 * sine**2) - math.log((1 - e * sine) / (1 + e * sine)) / (2 * e))

    def _constants(self) -> tuple[float, float, float]:
        """(cone constant n, C, radius of the origin)."""
        s1, s2, s0 = (math.sin(math.radians(x)) for x in (self.lat1, self.lat2, self.lat0))
        m1, m2 = (math.cos(math.radians(x)) / math.sqrt(1 - self.e2 * s**2) for x, s in ((self.lat1, s1), (self.lat2, s2)))
        n = s1 if self.lat1 == self.lat2 else (m1**2 - m2**2) / (self._q(s2) - self._q(s1))
        c = m1**2 + n * self._q(s1)
        return n, c, self.a * math.sqrt(c - n * self._q(s0)) / n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, c, r0 = self._constants()
        e, s = math.sqrt(self.e2), F.sin(F.radians(lat))
        q = (1 - self.e2) * (s / (1 - self.e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        r = self.a * F.sqrt(c - n * q) / n
        theta = n * F.radians(lon - self.lon0)
        return self.false_easting + r * F.sin(theta), self.false_northing + r0 - r * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        n, c, r0 = self._constants()
        dx, dy = x - self.false_easting, F.lit(r0) - (y - self.false_northing)
        sign = 1.0 if n > 0 else -1.0
        r = F.sqrt(dx * dx + dy * dy)
        theta = F.atan2(sign * dx, sign * dy)
        q = (c - r * r * (n * n / self.a**2)) / n
        full = self._q(1.0)
        beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / full)))
        e2, e4, e6 = self.e2, self.e2**2, self.e2**3
        lat = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + (761 * e6 / 45360) * F.sin(6 * beta)
        return F.lit(self.lon0) + F.degrees(theta / n), F.degrees(lat)


def nearest_cells(target: DataFrame, source: GridSpec, x: Column, y: Column) -> DataFrame:
    """target with src_row and src_col: the source cell that holds each target centre; NULL outside.
    The mapping is per cell and serves all years."""
    row, col = source.row_at(y), source.col_at(x)
    ok = source.inside(row, col)
    return target.withColumns({"src_row": F.when(ok, row), "src_col": F.when(ok, col)})


def regrid(target: DataFrame, source: DataFrame, grid: GridSpec, x: Column | None = None, y: Column | None = None, values: list[str] | None = None) -> DataFrame:
    """target cells with the source's values at the nearest cell (missing outside); x and y are the
    target centres in the source's coordinates. The source has row and col; other columns than
    `values` (a year, say) are kept as they are, one result row for each source row of the cell."""
    mapped = nearest_cells(target, grid, F.col("easting") if x is None else x, F.col("northing") if y is None else y)
    keep = values or [c for c in source.columns if c not in ("row", "col", "easting", "northing")]
    src = source.select(F.col("row").alias("src_row"), F.col("col").alias("src_col"), *keep)
    if src.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        src = F.broadcast(src)
    return mapped.join(src, ["src_row", "src_col"], "left").drop("src_row", "src_col")


def inside_rings(x: np.ndarray, y: np.ndarray, rings: list[list[tuple[float, float]]]) -> np.ndarray:
    """Even-odd rule over all rings (holes and several parts are further rings); an edge counts
    from its lower end on, without its upper end."""
    out = np.zeros(len(x), dtype=bool)
    for ring in rings:
        px, py = (np.array([p[k] for p in ring], dtype=float) for k in (0, 1))
        qx, qy = np.roll(px, -1), np.roll(py, -1)
        for ax, ay, bx, by in zip(px, py, qx, qy, strict=True):
            if ay != by:
                cross = (ay <= y) != (by <= y)
                out ^= cross & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return out


def cells_in_regions(cells: DataFrame, regions: DataFrame, broadcast_points: int = BROADCAST_POINTS) -> DataFrame:
    """(row, col, region_id) of the cells (row, col, easting, northing) whose centre is in a region
    (region_id, rings), by the even-odd rule; regions may overlap.

    The polygons of a region_id's different rows count as one shape. Points with a missing or infinite
    coordinate are left out of their ring; cells without a centre are in no region. Lists of up to
    `broadcast_points` points go to the tasks, which try each cell against them without a shuffle;
    longer ones are joined by scanlines (`_by_scanlines`).
    """
    usable = lambda p: (F.abs(p["x"]) < math.inf) & (F.abs(p["y"]) < math.inf)
    shapes = regions.select("region_id", "rings").distinct().select("region_id", F.explode("rings").alias("ring"))
    shapes = shapes.select("region_id", F.filter("ring", usable).alias("ring")).where(F.size("ring") > 2)
    points = shapes.select(F.sum(F.size("ring"))).first()[0] or 0
    return _by_broadcast(cells, shapes) if points <= broadcast_points else _by_scanlines(cells, shapes)


def _by_broadcast(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """Each task has all shapes; a cell is tried against those whose bounding box holds it."""
    found_rings: dict[int, list[list[tuple[float, float]]]] = {}
    for r in shapes.collect():  # at most BROADCAST_POINTS points
        found_rings.setdefault(r["region_id"], []).append([(p["x"], p["y"]) for p in r["ring"]])
    boxes = [(k, rings, min(p[0] for r in rings for p in r), max(p[0] for r in rings for p in r), min(p[1] for r in rings for p in r), max(p[1] for r in rings for p in r)) for k, rings in found_rings.items()]
    ship_package(cells.sparkSession)

    @F.pandas_udf("array<int>")
    def found(x: pd.Series, y: pd.Series) -> pd.Series:
        px, py = x.to_numpy(dtype=float), y.to_numpy(dtype=float)
        out: list[list[int]] = [[] for _ in px]
        for k, rings, x0, x1, y0, y1 in boxes:
            near = np.flatnonzero((px >= x0) & (px <= x1) & (py >= y0) & (py <= y1))
            for i in near[inside_rings(px[near], py[near], rings)]:
                out[i].append(k)
        return pd.Series(out)

    return cells.select("row", "col", F.explode(found("easting", "northing")).alias("region_id"))


def _slots(bounds: list[float]) -> Callable[..., Column]:
    """The number of bounds at or below a value, as a column function."""
    edges = np.array(sorted(set(bounds)))

    @F.pandas_udf("int")
    def slot(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, v.to_numpy(dtype=float), side="right").astype("int32"))

    return slot


def _by_scanlines(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """Each row of cell centres (a scanline) meets the edges of its band; the crossings of a region
    with it, in order, bound the spans that lie inside; cells meet the spans of their stretch of
    the row. Interiors are spans, whatever their width, so work grows with the outlines' length in rows.

    Bands and stretches hold about equal numbers of cells (`BANDS` and `STRETCHES` quantiles, the only
    numbers that reach the driver), so neither the unit of the coordinates nor far outliers matter.
    All joins are equi-joins on them, with the exact test beside.
    """
    cells = stored(cells.select("row", "col", "easting", "northing").where("easting IS NOT NULL AND northing IS NOT NULL AND NOT isnan(easting) AND NOT isnan(northing)"), "clip-cells")
    sketch = lambda c, n: F.percentile_approx(c, [k / n for k in range(1, n)], 10 * n)
    ys, xs = cells.agg(sketch("northing", BANDS), sketch("easting", STRETCHES)).first()
    band, stretch = _slots(ys or []), _slots(xs or [])

    lines = cells.select("northing").distinct().withColumn("band", band("northing"))
    ring = F.col("ring")
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    edges = shapes.select("region_id", F.explode(F.arrays_zip(ring.alias("a"), following.alias("b"))).alias("e"))
    edges = edges.selectExpr("region_id", "e.a.x AS ax", "e.a.y AS ay", "e.b.x AS bx", "e.b.y AS by").where("ay <> by")
    edges = edges.withColumns({"low": band(F.least("ay", "by")), "high": band(F.greatest("ay", "by"))}).withColumn("band", F.explode(F.sequence("low", "high")))

    crossed = edges.join(lines, "band").where("(ay <= northing) <> (by <= northing)")
    crossings = crossed.selectExpr("region_id", "northing", "ax + (northing - ay) * (bx - ax) / (by - ay) AS x")
    ordered = crossings.groupBy("region_id", "northing").agg(F.sort_array(F.collect_list("x")).alias("x"))  # closed rings cross a line an even number of times
    pairs = ordered.select("region_id", "northing", F.explode(F.expr("transform(sequence(1, size(x) div 2), k -> struct(x[2 * k - 2] AS x0, x[2 * k - 1] AS x1))")).alias("s"))
    spans = pairs.select("region_id", "northing", "s.x0", "s.x1").where("x0 < x1")
    spans = spans.withColumns({"low": stretch("x0"), "high": stretch("x1")}).withColumn("stretch", F.explode(F.sequence("low", "high")))
    placed = cells.withColumn("stretch", stretch("easting"))
    return placed.join(spans.drop("low", "high"), ["northing", "stretch"]).where("easting >= x0 AND easting < x1").select("row", "col", "region_id")


def clip(df: DataFrame, regions: DataFrame, values: list[str], fill: float | None = 0.0) -> DataFrame:
    """df (row, col, easting, northing, year, values) clipped by each year's region, or by the default
    one (region year NULL) in years without: inside, a missing value becomes `fill`; outside, all
    are missing. Of several regions of one year (or several defaults) the smallest id counts.
    Without regions df is returned unchanged."""
    years = regions.where("region_id IS NOT NULL").groupBy("year").agg(F.min("region_id").alias("__region"))
    listed = years.limit(BROADCAST_YEARS + 1).collect()
    if not listed:
        return df
    if len(listed) > BROADCAST_YEARS:
        raise ValueError(f"regions name over {BROADCAST_YEARS} years")
    named = {r["year"]: r["__region"] for r in listed if r["year"] is not None}
    default = next((r["__region"] for r in listed if r["year"] is None), None)
    region = F.lit(default).cast("int")
    if named:
        of_year = F.create_map(*[F.lit(v) for pair in named.items() for v in pair])
        region = F.coalesce(of_year[F.col("year")], region)
    cells = df.select("row", "col", "easting", "northing").distinct()
    used = regions.where(F.col("region_id").isin([r["__region"] for r in listed]))
    member = cells_in_regions(cells, used).withColumnRenamed("region_id", "__region").withColumn("__in", F.lit(True))
    both = df.withColumn("__region", region).join(member, ["row", "col", "__region"], "left")

    def one(c: str) -> Column:
        v = F.coalesce(F.col(c), F.lit(fill)) if fill is not None else F.col(c)
        free = F.col("__region").isNull()  # a year with neither a region of its own nor a default
        return F.when(free, F.col(c)).when(F.col("__in"), v)

    return both.withColumns({c: one(c) for c in values}).select(*df.columns)


def in_box(x: str, y: str, west: float, east: float, south: float, north: float) -> Column:
    """Closed bounding box."""
    return F.col(x).between(west, east) & F.col(y).between(south, north)
