"""Archives read by members, and raster files written and read back."""

from __future__ import annotations

import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.grid import GridSpec
from gridloom.sources import ascii_grid, geotiff

MONTHS = ("oct", "nov", "dec")


def grid(value, rows=2, cols=2):
    return f"ncols {cols}\nnrows {rows}\nxllcorner 100\nyllcorner 200\ncellsize 10\nNODATA_value -9999\n" + "\n".join(" ".join([str(value)] * cols) for _ in range(rows)) + "\n"


@pytest.fixture
def archives(tmp_path):
    for v in ("ppt", "tmx"):
        with zipfile.ZipFile(tmp_path / f"{v}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("inner/", "")
            for y in (1999, 2000):
                for m in MONTHS:
                    z.writestr(f"inner/{v}{y}{m}.asc", grid(y))
    return tmp_path


def test_a_task_for_each_member(spark, archives):
    df = ascii_grid.read_archives(spark, str(archives))
    assert df.rdd.getNumPartitions() == 12 and df.count() == 48
    assert ascii_grid.read_archives(spark, f"file:{archives}/p*.zip").select("archive").distinct().collect() == [("ppt.zip",)]
    assert ascii_grid.read_archives(spark, f"file://{archives}/tmx.zip").count() == 24


def test_a_filter_opens_its_members_only(spark, archives):
    for m in ("jan", "feb"):  # no grids: opening one is an error
        with zipfile.ZipFile(archives / f"bad{m}.zip", "w") as z:
            z.writestr(f"bad1998{m}.asc", "nothing")
    df = ascii_grid.read_archives(spark, str(archives))
    with pytest.raises(Exception, match="bad1998(jan|feb).asc lacks"):
        df.collect()
    some = df.where("variable = 'ppt' AND time >= DATE'2000-11-01' AND value > 0")
    assert some.rdd.getNumPartitions() == 2 and {r.member for r in some.collect()} == {"ppt2000nov.asc", "ppt2000dec.asc"}
    for text, n in (("variable IN ('tmx', 'run')", 6), ("time < DATE'1999-11-01' AND variable <> 'bad' AND archive = 'tmx.zip'", 1), ("variable = 'none'", 0), ("time IS NULL", None), ("variable <=> 'ppt'", 6)):
        found = df.where(text)
        assert n is None or found.select("member").distinct().count() == n


def test_large_members_come_in_batches_and_bad_files_are_named(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ppt1999oct.asc", grid(3, 700, 311))
    got = ascii_grid.read_archives(spark, f"{tmp_path}/big.zip")
    assert got.count() == 700 * 311 and got.agg(F.max("row"), F.max("col"), F.min("northing"), F.countDistinct("row", "col")).first() == (699, 310, 205.0, 700 * 311)
    (tmp_path / "none.zip").write_text("no archive")
    with pytest.raises(Exception, match="none.zip is no zip archive"):
        ascii_grid.read_archives(spark, str(tmp_path)).collect()


SPEC = GridSpec(n_rows=700, n_cols=900, x0=-5000.0, y0=3000.5, dx=10.0, dy=20.0)


def cells(spark, n=700):
    df = spark.range(n * 900).selectExpr("CAST(id / 900 AS INT) AS row", "CAST(id % 900 AS INT) AS col", "CAST(2000 + id % 3 AS INT) AS year", "CASE WHEN id % 7 > 0 THEN id / 3D END AS a", "-id AS b")
    return df.where("row % 290 <> 1")


def test_rasters_are_read_as_written(spark, tmp_path, monkeypatch):
    df = cells(spark)
    geotiff.write_geotiffs(df, ["a", "b"], f"file://{tmp_path}/out", SPEC, epsg=3310)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{v}_{y}.tif" for v in "ab" for y in (2000, 2001, 2002))
    back = geotiff.read_geotiffs(spark, f"{tmp_path}/out")
    assert back.count() == 6 * 700 * 900
    keys = ["layer", "row", "col", "value"]
    want = df.selectExpr("concat('a_', year) AS layer", "row", "col", "a AS value").union(df.selectExpr("concat('b_', year)", "row", "col", "CAST(b AS DOUBLE)")).where("value IS NOT NULL")
    have = back.where("value IS NOT NULL").select(keys)
    assert have.exceptAll(want).isEmpty() and want.exceptAll(have).isEmpty()
    assert back.where("northing <> 3000.5D - (row + 0.5D) * 20 OR easting <> -5000 + (col + 0.5D) * 10").isEmpty()
    geotiff.write_geotiffs(df.where("year = 2000"), ["a"], f"{tmp_path}/out", SPEC)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a_2000.tif"]
    geotiff.write_geotiffs(df.where("year = 2001"), ["a"], f"{tmp_path}/out", SPEC, mode="append")
    with pytest.raises(Exception, match="layers of these names are there"):
        geotiff.write_geotiffs(df.where("year = 2001"), ["a"], f"{tmp_path}/out", SPEC, mode="append")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".tif") == ["a_2000.tif", "a_2001.tif"]


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    df = cells(spark, 30)
    bad = df.union(df.where("row = 5 AND year = 2001"))
    with pytest.raises(Exception, match="has a cell twice"):
        geotiff.write_geotiffs(bad, ["a"], f"{tmp_path}/out", SPEC)
    with pytest.raises(Exception, match="outside of the grid"):
        geotiff.write_geotiffs(df.withColumn("col", F.col("col") + 1), ["a"], f"{tmp_path}/out", SPEC)
    with pytest.raises(Exception, match="no file name"):
        geotiff.write_geotiffs(df, ["a"], f"{tmp_path}/out", SPEC, template="../{variable}_{year}")
    assert list((tmp_path / "out").iterdir()) == []


def test_layout_of_a_file(spark, tmp_path):
    """Header, order of tags, geographic keys and strips, by the format's description."""
    small = GridSpec(n_rows=2, n_cols=3, x0=-120.0, y0=38.0, dx=0.5, dy=0.25)
    geotiff.write_geotiffs(spark.createDataFrame([(0, 0, 1999, 1.5), (1, 2, 1999, None)], "row int, col int, year int, v double"), ["v"], f"{tmp_path}/g", small, epsg=4326, geographic=True)
    data = (tmp_path / "g" / "v_1999.tif").read_bytes()
    assert data[:16] == b"II" + struct.pack("<HHHQ", 43, 8, 0, 16)
    n = struct.unpack_from("<Q", data, 16)[0]
    tags = [struct.unpack_from("<HHQ", data, 24 + 20 * k) for k in range(n)]
    assert [t[0] for t in tags] == sorted(t[0] for t in tags) and struct.unpack_from("<Q", data, 24 + 20 * n) == (0,)
    at = {t[0]: struct.unpack_from("<Q", data, 24 + 20 * k + 12)[0] for k, t in enumerate(tags)}
    assert (at[256], at[257], at[259]) == (3, 2, 8)
    assert struct.unpack_from("<16H", data, at[34735]) == (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)
    assert struct.unpack_from("<3d", data, at[33550]) == (0.5, 0.25, 0.0) and struct.unpack_from("<6d", data, at[33922])[3:5] == (-120.0, 38.0)
    import zlib

    values = np.frombuffer(zlib.decompress(data[at[273] : at[273] + at[279]]))
    assert values[0] == 1.5 and np.isnan(values[1:]).all() and at[273] + at[279] == len(data)
