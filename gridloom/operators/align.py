"""Joins and checks between tables on one grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.grid import rounded
from gridloom.functions.sized import small


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with the column `side`."""
    a, b = (d.select(*keys).distinct().withColumn(f"__{s}", F.lit(True)) for d, s in ((left, "left"), (right, "right")))
    both = a.join(b, list(keys), "full")
    return both.where("__left IS NULL OR __right IS NULL").select(*keys, F.when(F.col("__left"), "left").otherwise("right").alias("side"))


def exact_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of tables that must have the same keys; else an error."""
    odd = key_differences(left, right, keys).limit(1).collect()
    if odd:
        raise ValueError(f"the tables' keys differ: {odd[0].asDict()}")
    return left.join(right, list(keys))


def positional_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Inner join by position; of columns that both have besides, the left one's stay."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in keys]), list(keys))


def spatial_join(left: DataFrame, right: DataFrame, also: Sequence[str] = (), x: str = "easting", y: str = "northing", places: int = 4) -> DataFrame:
    """Inner join on coordinates that are equal when rounded (ties to even), and on the columns
    `also`; static tables have no year among these. Coordinates and other shared columns are the
    left one's. A row without coordinates meets none."""
    keys = [f"__{x}", f"__{y}"]
    a, b = (d.withColumns({keys[0]: rounded(F.col(x), places), keys[1]: rounded(F.col(y), places)}) for d in (left, right))
    return positional_join(a, b, [*keys, *also]).drop(*keys)


def variable_files(files: Sequence[tuple[DataFrame, Sequence[int], str, str]], keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """One table of files that hold one variable each: (bands, the years of the file's bands,
    the value's name there, its new name); all must have the same cells and years."""
    out = None
    for bands, years, value, name in files:
        one = bands_to_years(bands.select(*keys, "band", value), years, value, name)
        out = one if out is None else exact_join(out, one, [*keys, "year"])
    if out is None:
        raise ValueError("a table needs a file")
    return out


def missing_pairs(present: DataFrame, first: str, second: str) -> DataFrame:
    """Pairs of known values of two columns that do not occur together (a null is no value)."""
    pairs = present.select(first, second).distinct()
    every = pairs.select(second).where(F.col(second).isNotNull()).distinct()
    return pairs.select(first).where(F.col(first).isNotNull()).distinct().join(small(every), how="cross").join(pairs, [first, second], "left_anti")


def require_complete(present: DataFrame, first: str, second: str) -> None:
    """An error that lists missing pairs, if there are any."""
    gaps = missing_pairs(present, first, second).limit(20).collect()
    if gaps:
        raise ValueError("missing: " + ", ".join(f"{g[0]} {g[1]}" for g in gaps))


def missing_years(present: DataFrame, first: int, last: int, year: str = "year") -> DataFrame:
    """Years from first to last + 1 that the table lacks."""
    span = present.sparkSession.range(first, last + 2).select(F.col("id").cast("int").alias(year))
    return span.join(present.select(F.col(year).cast("int").alias(year)).distinct(), year, "left_anti")


def merge_variables(long: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("row", "col", "time")) -> DataFrame:
    """Long rows (keys, variable, value) to one wide row for each key; one shuffle."""
    return long.groupBy(*keys).pivot("variable", list(variables)).agg(F.first("value", ignorenulls=True))


def last_member(rows: DataFrame, keys: Sequence[str], value: str = "value", name: str = "member") -> DataFrame:
    """One row for each key: the value of the last name in sort order."""
    return rows.groupBy(*keys).agg(F.max_by(value, name).alias(value), F.max(name).alias(name))


def mixed_archives(index: DataFrame, archive: str = "archive", variable: str = "variable") -> DataFrame:
    """Archives whose members have more than one variable."""
    return index.groupBy(archive).agg(F.count_distinct(variable).alias("variables")).where("variables > 1")


def bands_to_years(bands: DataFrame, years: Sequence[int], value: str, name: str) -> DataFrame:
    """The i-th band (from 1) gets the i-th year; the value is renamed."""
    year = F.element_at(F.array(*map(F.lit, years)), F.col("band"))
    return bands.where(F.col("band").between(1, len(years))).withColumn("year", year).withColumnRenamed(value, name).drop("band")


def lagged(df: DataFrame, columns: Sequence[str], lags: int, keys: Sequence[str] = ("row", "col"), year: str = "year") -> DataFrame:
    """df with {c}-{b + 1}: the value of c b years before, by the year's value, so that an absent
    year gives a missing one. All frames share one sort."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(year)

    def at(c: str, b: int) -> Column:
        return F.first(F.col(f"`{c}`")).over(w.rangeBetween(-b, -b))

    return df.select(*df.columns, *[at(c, b).alias(f"{c}-{b + 1}") for c in columns for b in range(lags)])


def fallback_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))
