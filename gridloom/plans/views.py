"""Gridded tables as views of the test tables, in SQL that Spark and DuckDB share.

Cells are suppliers (row = key div 10, col = key mod 10) or parts (row = key div 50, col = key
mod 50); time is the ship date. Hourly temperatures are whole hundredths of a degree, so that their
sums are exact in any order. {table} stands for a base table; views may use earlier views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "item": """
        SELECT CAST(floor(l_suppkey / 10.0) AS INT) AS row, CAST(l_suppkey % 10 AS INT) AS col, l_suppkey, l_partkey, l_linenumber, l_orderkey,
               l_shipdate AS time, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, l_quantity, l_discount, l_extendedprice
        FROM {lineitem}""",
    "monthly": """
        SELECT row, col, -(row * 270.0E0 + 135.0E0) AS northing, col * 270.0E0 + 135.0E0 AS easting, date_trunc('month', time) AS time,
               CASE WHEN sum(l_quantity) % 17 = 0 THEN NULL ELSE sum(l_quantity) END AS ppt, sum(l_quantity * l_discount) * 20 AS pet,
               min(l_extendedprice) / 1000 AS tmn, max(l_extendedprice) / 1000 AS tmx
        FROM item GROUP BY row, col, date_trunc('month', time)""",
    "annual": """
        SELECT row, col, CAST(year(time) + CASE WHEN month(time) >= 10 THEN 1 ELSE 0 END AS INT) AS year,
               CASE WHEN count(ppt) = count(*) THEN sum(ppt) END AS ppt, CASE WHEN count(pet) = count(*) THEN sum(pet) END AS pet,
               CASE WHEN count(tmn) = count(*) THEN min(tmn) END AS tmn, CASE WHEN count(tmx) = count(*) THEN max(tmx) END AS tmx
        FROM monthly GROUP BY row, col, CAST(year(time) + CASE WHEN month(time) >= 10 THEN 1 ELSE 0 END AS INT)""",
    "annual_part": """
        SELECT CAST(floor(l_partkey / 50.0) AS INT) AS row, CAST(l_partkey % 50 AS INT) AS col, year, sum(l_quantity) AS ppt, sum(l_quantity * l_discount) * 20 AS pet
        FROM item GROUP BY CAST(floor(l_partkey / 50.0) AS INT), CAST(l_partkey % 50 AS INT), year""",
    "archive_index": """
        SELECT DISTINCT concat(v, CAST(year AS VARCHAR(4)), substr('janfebmaraprmayjunjulaugsepoctnovdec', month * 3 - 2, 3), '.asc') AS member,
               concat(v, CAST(year AS VARCHAR(4)), '.zip') AS archive, v AS variable
        FROM (SELECT year, month, CASE l_linenumber WHEN 1 THEN 'ppt' WHEN 2 THEN 'pet' WHEN 3 THEN 'tmn' WHEN 4 THEN 'tmx' WHEN 5 THEN 'aet' WHEN 6 THEN 'cwd' ELSE 'run' END AS v FROM item) x""",
    "hourly": """
        SELECT CAST(row AS DOUBLE) AS latitude, CAST(col AS DOUBLE) AS longitude, time, CAST(floor(l_extendedprice / 50) AS DOUBLE) AS t2m FROM item""",
    "daily": """
        SELECT latitude, longitude, year, CASE WHEN leap AND doy > 60 THEN doy - 1 ELSE doy END AS dayofyear, max(t2m) AS t2m_max, min(t2m) AS t2m_min
        FROM (SELECT latitude, longitude, t2m, year, doy, (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 AS leap
              FROM (SELECT latitude, longitude, t2m, CAST(year(time - INTERVAL '1' MINUTE) AS INT) AS year, CAST(dayofyear(time - INTERVAL '1' MINUTE) AS INT) AS doy FROM hourly) a) b
        WHERE NOT (leap AND doy = 60) AND year BETWEEN 1995 AND 2001
        GROUP BY latitude, longitude, year, CASE WHEN leap AND doy > 60 THEN doy - 1 ELSE doy END""",
    "heat": """
        SELECT CAST(latitude AS INT) AS row, CAST(longitude AS INT) AS col, year, avg(CASE WHEN t2m_max > 1800 THEN 1.0E0 ELSE 0.0E0 END) AS fraction_hot_days
        FROM daily GROUP BY latitude, longitude, year""",
    "mortality": """
        SELECT DISTINCT row, col, -(row * 270.0E0 + 135.0E0) AS northing, col * 270.0E0 + 135.0E0 AS easting, year,
               CASE WHEN (l_suppkey * 7 + year * 3) % 11 = 0 THEN NULL ELSE CAST((l_suppkey * 5 + year) % 6 AS DOUBLE) END AS severity_code
        FROM item""",
    "dem": """
        SELECT CAST(floor(p_partkey / 50.0) AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, CAST(p_retailprice + p_size AS DOUBLE) AS elevation FROM {part}""",
    "topo": """
        SELECT CAST(floor(p_partkey % 1000 / 10.0) AS INT) AS row, CAST(p_partkey % 10 AS INT) AS col, avg(CASE WHEN p_partkey % 100 = 37 THEN NULL ELSE p_size END) AS slope, max(p_retailprice) AS elevation
        FROM {part} GROUP BY CAST(floor(p_partkey % 1000 / 10.0) AS INT), CAST(p_partkey % 10 AS INT)""",
    "projection": """
        SELECT CAST(l_linenumber AS VARCHAR(2)) AS projection, row, col, year, CASE WHEN sum(l_quantity) % 13 = 0 THEN NULL ELSE avg(l_quantity) END AS tpa_projection
        FROM item GROUP BY l_linenumber, row, col, year""",
    "predictions": """
        SELECT t.year AS train_year, e.year AS eval_year, CAST(e.row % 3 AS INT) AS fold, CAST(e.row * 10 + e.col AS BIGINT) AS id, t.m AS prediction, e.m AS target
        FROM (SELECT row, col, year, avg(l_quantity) AS m FROM item GROUP BY row, col, year) e
        JOIN (SELECT row, col, year, avg(l_quantity) AS m FROM item GROUP BY row, col, year) t ON t.row = e.row AND t.col = e.col""",
    "sparse": """
        SELECT t.year AS train_year, e.year AS eval_year, CAST(e.row * 50 + e.col AS BIGINT) AS id, t.ppt AS prediction, e.ppt AS target
        FROM annual_part e JOIN annual_part t ON t.row = e.row AND t.col = e.col""",
    "importances": """
        SELECT year AS train_year, CAST(row % 3 AS INT) AS fold,
               concat(CASE col % 4 WHEN 0 THEN 'PR' WHEN 1 THEN 'PRET' WHEN 2 THEN 'SPI' ELSE 'SPEI' END, CAST(l_linenumber % 6 + 1 AS VARCHAR(2)), '-', CAST(month % 6 + 1 AS VARCHAR(2))) AS feature,
               avg(l_discount) / 4 AS importance
        FROM item GROUP BY year, row % 3, col % 4, l_linenumber % 6, month % 6""",
    "class_counts": """
        SELECT CAST(row * 10 + col AS BIGINT) AS id, CAST(sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS c1, CAST(sum(CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS c2,
               CAST(sum(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) AS DOUBLE) AS c3, CAST(sum(CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END) AS DOUBLE) AS c4, CAST(sum(CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END) AS DOUBLE) AS c5
        FROM item GROUP BY row, col""",
}


def _needed(sql: str) -> list[str]:
    """Views that the SQL uses, directly or not, in order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(VIEWS[name])
    return [v for v in VIEWS if v in found]


def _expanded(sql: str) -> str:
    views = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in _needed(sql))
    sql = sql.strip()
    if not views:
        return sql
    if sql[:5].upper() == "WITH ":
        return f"WITH {views},\n{sql[5:]}"
    return f"WITH {views}\n{sql}"


def for_duckdb(sql: str) -> str:
    """SQL over views and tables, complete for DuckDB."""
    out = _expanded(sql)
    for t in TABLES:
        out = out.replace("{" + t + "}", t)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    out = _expanded(f"SELECT * FROM {name}")
    for t in TABLES:
        out = out.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(out)
