"""Queries: terrain metrics and their regridding (SURVEY I)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gridloom.operators.spatial import regrid
from gridloom.operators.terrain import terrain
from gridloom.plans.registry import query, r6
from gridloom.plans.tables import PARTS

_RES = 10.0
#: Neighbours of each cell within a square window, cut at the grid's border.
_NEAR = "FROM dem c JOIN dem n ON n.row BETWEEN c.row - {r} AND c.row + {r} AND n.col BETWEEN c.col - {r} AND c.col + {r}"


def _metric(i, *names: str, **options):
    out = terrain(i.dem, names, res=_RES, tile=64, **options)
    return r6(out.select("row", "col", *names), *names)


@query("i01_elevation", "SELECT row, col, elevation FROM dem")
def _(i):
    return terrain(i.dem, ("tpi",), res=_RES, tile=64).select("row", "col", "elevation")


def _edge(axis: str, side: int, w: int) -> str:
    """Weighted sum over the outer column or row of the window: 1, 2, ..., 2, 1."""
    r, other = w // 2, "row" if axis == "col" else "col"
    return f"sum(CASE WHEN n.{axis} = c.{axis} + ({side * r}) THEN n.elevation * CASE WHEN abs(n.{other} - c.{other}) = {r} THEN 1 ELSE 2 END END)"


def _slope_sql(w: int) -> str:
    r, by = w // 2, 2.0 * (w - 1) ** 2 * _RES
    return f"""
        WITH g AS (SELECT c.row, c.col, count(*) AS n, ({_edge('col', 1, w)} - {_edge('col', -1, w)}) / {by}E0 AS gx, ({_edge('row', -1, w)} - {_edge('row', 1, w)}) / {by}E0 AS gy
                   {_NEAR.format(r=r)} GROUP BY c.row, c.col)
        SELECT row, col, CASE WHEN n = {w * w} THEN round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) END AS slope,
               CASE WHEN n = {w * w} THEN round(CASE WHEN gx = 0 AND gy = 0 THEN 0 ELSE -gx / sqrt(gx * gx + gy * gy) END, 6) END AS eastness,
               CASE WHEN n = {w * w} THEN round(CASE WHEN gx = 0 AND gy = 0 THEN 0 ELSE -gy / sqrt(gx * gx + gy * gy) END, 6) END AS northness FROM g"""


@query("i02_slope_aspect", _slope_sql(9), signed=("eastness", "northness"))
def _(i):
    return _metric(i, "slope", "eastness", "northness")


@query("i02_slope_aspect_3x3", _slope_sql(3), signed=("eastness", "northness"))
def _(i):
    return _metric(i, "slope", "eastness", "northness", w=3)


def _gradient_sql(w: int) -> str:
    """(row, col, n, gx, gy): the gradient of each cell and how many cells of its window there are."""
    r, by = w // 2, 2.0 * (w - 1) ** 2 * _RES
    return f"""SELECT c.row, c.col, count(*) AS n, ({_edge('col', 1, w)} - {_edge('col', -1, w)}) / {by}E0 AS gx, ({_edge('row', -1, w)} - {_edge('row', 1, w)}) / {by}E0 AS gy
        {_NEAR.format(r=r)} GROUP BY c.row, c.col"""


@query("i03_ruggedness", f"""
    WITH u AS (SELECT row, col, -gx / sqrt(1 + gx * gx + gy * gy) AS x, -gy / sqrt(1 + gx * gx + gy * gy) AS y, 1 / sqrt(1 + gx * gx + gy * gy) AS z FROM ({_gradient_sql(3)}) g WHERE n = 9)
    SELECT d.row, d.col, v.vrm FROM dem d LEFT JOIN (
        SELECT c.row, c.col, round(1 - sqrt(sum(n.x) * sum(n.x) + sum(n.y) * sum(n.y) + sum(n.z) * sum(n.z)) / count(*), 6) AS vrm {_NEAR.format(r=4).replace('dem n', 'u n')} GROUP BY c.row, c.col) v
    ON v.row = d.row AND v.col = d.col""")
def _(i):
    return _metric(i, "vrm")


@query("i04_position", f"SELECT c.row, c.col, round(any_value(c.elevation) - (sum(n.elevation) - any_value(c.elevation)) / (count(*) - 1), 6) AS tpi {_NEAR.format(r=4)} GROUP BY c.row, c.col", signed=("tpi",))
def _(i):
    return _metric(i, "tpi")


@query("i05_residual_sd", f"""
    WITH m AS (SELECT c.row, c.col, any_value(c.elevation) - avg(n.elevation) AS elevation {_NEAR.format(r=4)} GROUP BY c.row, c.col)
    SELECT c.row, c.col, round(stddev_samp(n.elevation), 6) AS rie {_NEAR.format(r=4).replace('dem', 'm')} GROUP BY c.row, c.col""")
def _(i):
    return _metric(i, "rie")


#: Neighbours around a cell, in order: two that follow each other and the cell make a triangle.
_RING = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))


def _triangles_sql() -> str:
    """(row, col, area) of the cells with all neighbours: eight triangles with halved edges, by Heron's formula."""
    near = ", ".join(f"sum(CASE WHEN n.row = c.row + ({i}) AND n.col = c.col + ({j}) THEN n.elevation END) AS z{k}" for k, (i, j) in enumerate(_RING))
    areas = []
    for k, (i, j) in enumerate(_RING):
        m, (p, q) = (k + 1) % 8, _RING[(k + 1) % 8]
        a, b, c = (f"sqrt({d}E0 + ({u} - {v}) * ({u} - {v})) / 2" for d, u, v in ((_RES**2 * (i * i + j * j), f"z{k}", "z"), (_RES**2 * (p * p + q * q), f"z{m}", "z"), (_RES**2, f"z{k}", f"z{m}")))
        s = f"(({a} + {b} + {c}) / 2)"
        areas.append(f"sqrt(greatest({s} * ({s} - {a}) * ({s} - {b}) * ({s} - {c}), 0))")
    return f"SELECT row, col, {' + '.join(areas)} AS area FROM (SELECT c.row, c.col, any_value(c.elevation) AS z, {near} {_NEAR.format(r=1)} GROUP BY c.row, c.col HAVING count(*) = 9) t"


@query("i06_surface_ratio", f"""
    WITH t AS ({_triangles_sql()}), g AS ({_gradient_sql(9)}),
    s AS (SELECT c.row, c.col, sum(n.area) AS area, count(*) AS n {_NEAR.format(r=4).replace('dem n', 't n')} GROUP BY c.row, c.col)
    SELECT g.row, g.col, CASE WHEN g.n = 81 THEN round(s.area / (s.n * {_RES**2}E0 * sqrt(1 + gx * gx + gy * gy)), 6) END AS sapa FROM g LEFT JOIN s ON s.row = g.row AND s.col = g.col""")
def _(i):
    return _metric(i, "sapa")


@query("i07_deviation", """
    SELECT c.row, c.col, round((any_value(c.elevation) - avg(n.elevation)) / (max(n.elevation) - min(n.elevation)), 6) AS dmv
    FROM dem c JOIN dem n ON n.row BETWEEN c.row - 9 AND c.row + 9 AND n.col BETWEEN c.col - 9 AND c.col + 9 AND (n.row - c.row) * (n.row - c.row) + (n.col - c.col) * (n.col - c.col) <= 81 GROUP BY c.row, c.col""", signed=("dmv",))
def _(i):
    return _metric(i, "dmv")


@query("i08_adjusted_sd", f"""
    WITH g AS (SELECT c.row, c.col, count(*) AS n, var_pop(n.elevation) AS zz, var_pop(n.col - c.col) AS xx, var_pop(n.row - c.row) AS yy, covar_pop(n.col - c.col, n.row - c.row) AS xy,
                      covar_pop(n.col - c.col, n.elevation) AS xz, covar_pop(n.row - c.row, n.elevation) AS yz {_NEAR.format(r=4)} GROUP BY c.row, c.col)
    SELECT row, col, round(sqrt(greatest(n * (zz - ((xz * yy - yz * xy) * xz + (yz * xx - xz * xy) * yz) / (xx * yy - xy * xy)), 0) / (n - 3)), 5) AS adjsd FROM g""")
def _(i):
    out = terrain(i.dem, ("adjsd",), res=_RES, tile=64)
    return out.select("row", "col", F.round("adjsd", 5).alias("adjsd"))


@query("i09_terrain_on_grid", f"""
    WITH t AS (SELECT c.row, c.col, round(any_value(c.elevation) - (sum(n.elevation) - any_value(c.elevation)) / (count(*) - 1), 6) AS tpi {_NEAR.format(r=4)} GROUP BY c.row, c.col)
    SELECT d.row, d.col, d.year, t.tpi, e.elevation FROM annual d LEFT JOIN t ON t.row = d.row * 2 + 1 AND t.col = d.col * 2 + 1 LEFT JOIN dem e ON e.row = d.row * 2 + 1 AND e.col = d.col * 2 + 1""", signed=("tpi",))
def _(i):
    made = _metric(i, "tpi").join(i.dem, ["row", "col"])
    target = i.annual.select("row", "col", "year", ((F.col("col") * 2 + 1.5) * 270.0).alias("easting"), (-(F.col("row") * 2 + 1.5) * 270.0).alias("northing"))
    return regrid(target, made, replace(PARTS, open=True), values=["tpi", "elevation"]).select("row", "col", "year", "tpi", "elevation")
