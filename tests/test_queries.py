"""Every registered query of the gridded operators against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from gridloom.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v != v:
            return "missing"
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF).toPandas()
    want = duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def shifted(folder, **keys):
    """The smallest tables, of which some are repeated with a key shifted (table=(key, shifts)); and DuckDB on them."""
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        key, shifts = keys.get(p.stem, (None, ()))
        if key:
            con.execute(f"COPY (SELECT * REPLACE ({key} + s AS {key}) FROM '{p}', (SELECT unnest({list(shifts)}::BIGINT[]) AS s) x) TO '{folder / p.name}' (FORMAT parquet)")
        else:
            (folder / p.name).symlink_to(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{folder / p.name}'")
    return con


def test_clip_has_no_end_where_sql_has_none(spark, tmp_path):
    con = shifted(tmp_path, lineitem=("l_suppkey", (-4000, 0, 4000, 600_000, 21_474_836_470)))  # rows on both sides of 0, and up to the last INT
    got = queries.queries()["c06_clip"](spark, str(tmp_path)).toPandas()
    want = con.sql(queries.oracle_sql()["c06_clip"]).df()
    assert got["row"].min() == -400 and got["row"].max() == 2**31 - 1
    assert rows(got) == rows(want)


def test_terrain_on_grid_takes_any_cell_with_elevation(spark, tmp_path):
    con = shifted(tmp_path, lineitem=("l_suppkey", (-4000, 0, 4000, 600_000)), part=("p_partkey", (-40_000, 0, 40_000, 6_000_000)))  # parts' rows from -800, 0, 800 and 120,000 on
    got = queries.queries()["i09_terrain_on_grid"](spark, str(tmp_path)).toPandas()
    want = con.sql(queries.oracle_sql()["i09_terrain_on_grid"]).df()
    assert set(got.loc[got["elevation"].notna(), "row"]) == {-400, 0, 400, 60_000}
    assert rows(got) == rows(want)


def test_lags_and_rolling_share_one_shuffle(spark):
    plan = queries.queries()["c04_lags"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # the view's aggregate, and the frames' cells


@pytest.mark.parametrize("name", ["h02_fold_grid", "h02_importances"])
def test_fold_grid_queries_use_all_folds_and_trees(spark, monkeypatch, name):
    from gridloom.plans import models

    class Called(Exception):
        pass

    def fold_grid(table, features, **options):
        raise Called({r.fold for r in table.select("fold").distinct().collect()}, options)

    monkeypatch.setattr(models.models, "fold_grid", fold_grid)
    with pytest.raises(Called) as found:
        queries.queries()[name](spark, SF)
    assert found.value.args == ({0, 1, 2}, {})
