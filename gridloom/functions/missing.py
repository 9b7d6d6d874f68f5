"""Missing values: NULL only, in two modes, and statistics by name.

`poison`: one missing value makes the result missing. `skip`: missing values are left out, which
is what Spark's aggregates do. NaN never enters a table; infinities are values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

Aggregate = Callable[[Column], Column]


def poison(fn: Aggregate, value: Column) -> Column:
    """fn over the group, NULL if any value is NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), fn(value))


def poison_over(fn: Aggregate, value: Column, window: WindowSpec, rows: int | None = None) -> Column:
    """fn over a window frame, NULL if a value in it is NULL or if it has fewer than `rows` rows."""
    whole = F.count(F.lit(1)).over(window) if rows is None else F.lit(rows)
    return F.when(F.count(value).over(window) == whole, fn(value).over(window))


#: Statistics that configurations name.
STATISTICS: dict[str, Aggregate] = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "median": F.median,
    "std": F.stddev_pop,
    "var": F.var_pop,
}


def statistic(name: str, **options: float) -> Aggregate:
    """The aggregate of a configured name; `quantile` takes q."""
    if name == "quantile":
        return lambda v: F.percentile(v, F.lit(float(options["q"])))
    if name not in STATISTICS:
        raise ValueError(f"unknown statistic {name!r}; known are quantile and {', '.join(sorted(STATISTICS))}")
    return STATISTICS[name]


def aggregate_by(df: DataFrame, keys: Sequence[str], specs: Sequence[dict], poisoned: bool = False) -> DataFrame:
    """Grouped statistics from a list of {variable, statistic, name, options, attrs}; attrs
    become the column's metadata."""
    out = []
    for s in specs:
        fn, v = statistic(s["statistic"], **s.get("options", {})), F.col(s["variable"])
        value = poison(fn, v) if poisoned else fn(v)
        out.append(value.alias(s.get("name", s["variable"]), metadata=s.get("attrs", {})))
    return df.groupBy(*keys).agg(*out)


def clamp_infinity(value: Column, fill: float) -> Column:
    """+inf to fill, -inf to -fill; other values, NULL included, stay."""
    return F.when(value == float("inf"), F.lit(fill)).when(value == float("-inf"), F.lit(-fill)).otherwise(value)


def clamp_columns(df: DataFrame, columns: Sequence[str], fill: float, strict: bool = True) -> DataFrame:
    """The columns clamped; with strict, a missing value is an error when the row is computed."""

    def one(c: str) -> Column:
        v = clamp_infinity(F.col(f"`{c}`"), fill)
        return F.when(F.col(f"`{c}`").isNull(), F.raise_error(F.lit(f"missing value in {c}"))).otherwise(v) if strict else v

    return df.withColumns({c: one(c) for c in columns})


def nodata_to_null(value: Column, nodata: float) -> Column:
    """Exact equality with the grid's missing-data value becomes NULL."""
    return F.nullif(value, F.lit(nodata))
