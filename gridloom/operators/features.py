"""The training table: targets with lagged climate and heat and static terrain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.align import lagged
from gridloom.operators.select import present_samples

#: Severity codes 0 to 5 as percentages, the midpoints and ranges of their classes.
MIDPOINTS = (None, 2.0, 6.5, 20.0, 40.0, 75.0)
RANGES = {1: (1.0, 3.0), 2: (3.0, 10.0), 3: (10.0, 30.0), 4: (30.0, 50.0), 5: (50.0, 100.0)}
NOT_FEATURES = ("row", "col", "id", "fold", "easting", "northing", "year", "target")


def severity_midpoint(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m).cast("double") for m in MIDPOINTS]), (code + 1).cast("int"))


def with_severity_range(df: DataFrame, code: str = "severity_code") -> DataFrame:
    """df with low and high percent of its class; missing for other codes."""
    table = df.sparkSession.createDataFrame([(k, *v) for k, v in RANGES.items()], "__code int, low double, high double")
    return df.join(F.broadcast(table), F.col(code) == F.col("__code"), "left").drop("__code")


def positive_targets(df: DataFrame, target: str = "target") -> DataFrame:
    return df.where(F.col(target) > 0)


def training_table(
    mortality: DataFrame, climate: DataFrame, topo: DataFrame, heat: DataFrame, target: str, years: Sequence[int],
    indices: Sequence[str], topo_columns: Sequence[str], lags: int = 6, heat_column: str = "fraction_hot_days", keys: Sequence[str] = ("row", "col"),
) -> DataFrame:
    """One row for each cell and listed year whose target and terrain are present: id, fold,
    coordinates, year, target, lagged climate and heat, terrain. Climate and heat may be missing
    where their rows exist. Cells without a target go before the lags are made."""
    k = list(keys)
    wanted = mortality.where(F.col("year").isin(*years) & F.col(target).isNotNull()).withColumnRenamed(target, "target")
    cells = wanted.select(*k).distinct()
    c = lagged(climate.join(cells, k, "left_semi").select(*k, "year", *indices), indices, lags, k).drop(*indices)
    h = lagged(heat.join(cells, k, "left_semi").select(*k, "year", heat_column), [heat_column], lags, k).drop(heat_column)
    joined = wanted.join(c, [*k, "year"]).join(h, [*k, "year"]).join(topo.select(*k, *topo_columns), k)
    return present_samples(joined, "target", topo_columns)


def by_name(yearly: DataFrame, static: DataFrame, names: Sequence[str], years: tuple[int, int], keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """(keys, year, names): the features that a model's configuration names, for the years
    [start, end). {column}-{lag} is a yearly column so many years back less one, other names are
    columns of the static table (terrain, coordinates). A value that isn't there is missing; a
    name that neither table can give is an error."""
    k, lags, plain = list(keys), {}, []
    for n in names:
        base, _, lag = n.rpartition("-")
        if lag.isdigit() and int(lag) > 0 and base in yearly.columns:
            lags[n] = (base, int(lag))
        elif n in static.columns and n not in k:
            plain.append(n)
        else:
            raise ValueError(f"no table has the feature {n!r}")
    columns = sorted({c for c, _ in lags.values()})
    out = lagged(yearly.select(*k, "year", *columns), columns, max((b for _, b in lags.values()), default=0), k)
    out = out.where((F.col("year") >= years[0]) & (F.col("year") < years[1])).select(*k, "year", *[F.col(f"`{n}`") for n in lags])
    return out.join(static.select(*k, *plain), k, "left").select(*k, "year", *[F.col(f"`{n}`") for n in names])


def feature_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in NOT_FEATURES]


def complete_rows(columns: Sequence[str]) -> Column:
    """Whether no feature is missing; other rows are not scored."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(f"`{c}`").isNotNull()
    return ok


def survival_share(percent: Column) -> Column:
    """1 - percent / 100, kept within 0 and 1; missing stays missing."""
    return F.when(percent.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - percent / 100)))
