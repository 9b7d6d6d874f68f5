"""Queries that write files into the shared folder and read them again."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import ship_package
from gridloom.functions.grid import GridSpec
from gridloom.functions.names import MONTHS
from gridloom.functions.sized import shared_dir
from gridloom.plans.registry import query
from gridloom.sources import ascii_grid, geotiff, tables
from gridloom.sources.files import located

SIDE, MISSING = 270.0, -9999.0


def _folder(i, name: str) -> str:
    return f"{shared_dir(i.spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def _grid_text(cells: pd.DataFrame, rows: int, cols: int) -> str:
    values = cells.pivot(index="row", columns="col", values="value").reindex(index=range(rows), columns=range(cols)).fillna(MISSING)
    head = f"ncols {cols}\nnrows {rows}\nxllcorner 0\nyllcorner {-rows * SIDE}\ncellsize {SIDE}\nNODATA_value {MISSING}\n"
    return head + "\n".join(" ".join(map(repr, r)) for r in values.to_numpy().tolist()) + "\n"


def _write_archives(df: DataFrame, path: str) -> int:
    """An archive of monthly grids for each variable and year of df (variable, year, month, row, col, value); returns their number."""
    ship_package(df.sparkSession)
    system, base = located(path)
    system.create_dir(base)

    def archive(part: pd.DataFrame) -> pd.DataFrame:
        name = f"{part['variable'].iloc[0]}{part['year'].iloc[0]}"
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for month, cells in part.groupby("month"):
                z.writestr(f"{name}{MONTHS[month - 1]}.asc", _grid_text(cells, part["row"].max() + 1, part["col"].max() + 1))
        there, at = located(path)
        with there.open_output_stream(f"{at}/{name}.zip", compression=None) as out:
            out.write(packed.getvalue())
        return pd.DataFrame({"archive": [name]})

    return df.groupBy("variable", "year").applyInPandas(archive, "archive string").count()


@query("a01_archives", """
    SELECT concat(v, CAST(year(time) AS VARCHAR), '.zip') AS archive, concat(v, CAST(year(time) AS VARCHAR), substr('janfebmaraprmayjunjulaugsepoctnovdec', month(time) * 3 - 2, 3), '.asc') AS member,
           v AS variable, CAST(CAST(time AS DATE) AS VARCHAR) AS time, row, col, northing, easting, value
    FROM (SELECT *, 'ppt' AS v, CAST(ppt AS DOUBLE) AS value FROM monthly UNION ALL SELECT *, 'tmx', CAST(tmx AS DOUBLE) FROM monthly) m
    WHERE value IS NOT NULL AND time >= DATE '1994-05-01'""")  # fmt: skip
def _(i):
    long = i.monthly.selectExpr("row", "col", "CAST(time AS DATE) AS time", "CAST(ppt AS DOUBLE) AS ppt", "CAST(tmx AS DOUBLE) AS tmx").unpivot(["row", "col", "time"], ["ppt", "tmx"], "variable", "value")
    path = _folder(i, "archives")
    _write_archives(long.selectExpr("variable", "year(time) AS year", "month(time) AS month", "row", "col", "value"), path)
    found = ascii_grid.read_archives(i.spark, path).where("time >= DATE'1994-05-01' AND value IS NOT NULL")
    return found.withColumn("time", F.col("time").cast("string"))


@query("a11_dataset_sink", "SELECT * FROM annual")
def _(i):
    path = _folder(i, "annual")
    tables.write_table(i.annual, path, by=["year"], tile=16)
    return i.spark.read.parquet(path).select(*i.annual.columns)


@query("a12_raster_layers", """
    SELECT concat(v, '_', CAST(year AS VARCHAR)) AS layer, row, col, -(row * 270.0E0 + 135.0E0) AS northing, col * 270.0E0 + 135.0E0 AS easting, value
    FROM (SELECT row, col, year, 'ppt' AS v, CAST(ppt AS DOUBLE) AS value FROM annual UNION ALL SELECT row, col, year, 'tmx', CAST(tmx AS DOUBLE) FROM annual) a WHERE value IS NOT NULL""")  # fmt: skip
def _(i):
    path, rows = _folder(i, "layers"), i.annual.agg(F.max("row")).first()[0]
    annual = i.annual.selectExpr("row", "col", "year", "CAST(ppt AS DOUBLE) AS ppt", "CAST(tmx AS DOUBLE) AS tmx")
    geotiff.write_geotiffs(annual, ["ppt", "tmx"], path, GridSpec(n_rows=(rows or 0) + 1, n_cols=10, x0=0.0, y0=0.0, dx=SIDE, dy=SIDE))
    return geotiff.read_geotiffs(i.spark, path).where("value IS NOT NULL")


@query("a13_recompress", "SELECT * FROM annual")
def _(i):
    path = _folder(i, "annual")
    tables.write_table(i.annual, path, tile=16)
    tables.recompress(i.spark, path, f"{path}-gzip", "gzip", 2)
    return i.spark.read.parquet(f"{path}-gzip")
