"""From monthly rasters to water years, rolling sums and the suite of drought indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.missing import poison, statistic
from gridloom.functions.sized import stored
from gridloom.operators.select import year_range

#: How each monthly variable becomes an annual one.
WATER_YEAR = {v: "sum" for v in ("aet", "cwd", "pck", "pet", "ppt", "rch", "run", "str")} | {"tmn": "min", "tmx": "max"}
INDICES = ("PR", "PRET", "SPI", "SPEI")
SPANS = (1, 2, 3, 4, 5, 6)


def water_year_of(time: Column) -> Column:
    """October to December belong to the next year."""
    return (F.year(time) + (F.month(time) >= 10).cast("int")).cast("int")


def water_year(monthly: DataFrame, keys: Sequence[str] = ("row", "col"), how: dict[str, str] | None = None, expected_months: int | None = None) -> DataFrame:
    """Annual table (keys, year, variables): sums, or the extremes of temperatures.

    A variable with a missing month is missing; partial first and last years stay. With
    `expected_months`, a year with fewer rows is missing too. One shuffle, after partial aggregation.
    """
    how = {c: f for c, f in (how or WATER_YEAR).items() if c in monthly.columns}
    out = []
    for c, name in how.items():
        value = poison(statistic(name), F.col(c))
        if expected_months:
            value = F.when(F.count(F.lit(1)) == expected_months, value)
        out.append(value.alias(c))
    return monthly.groupBy(*keys, water_year_of(F.col("time")).alias("year")).agg(*out)


def with_year_index(annual: DataFrame, year: str = "year", years: Sequence[int] | None = None) -> DataFrame:
    """annual with year_index: the place of the year among `years`, so that frames over it count a cell's
    absent years as missing ones. Rows of other years go. Without `years`, they are all years of the
    table, which is stored once, so that they are found without a second run of what makes it."""
    if years is None:
        annual = stored(annual, "annual")
        years = [r[0] for r in annual.where(F.col(year).isNotNull()).select(year).distinct().collect()]  # calendar years
    years = sorted(set(years))
    at = F.array_position(F.array(*[F.lit(int(y)).cast("bigint") for y in years]), F.col(year).cast("bigint")) if years else F.lit(0)
    return annual.withColumn("year_index", at.cast("int")).where(F.col("year_index") > 0)


def rolling_sum(value: Column, span: int, keys: Sequence[str], order: str = "year_index") -> Column:
    """Sum over `span` consecutive years; missing unless all of them are there."""
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(-(span - 1), 0)
    return F.when(F.count(value).over(w) == span, F.sum(value).over(w))


def rolling_indices(annual: DataFrame, spans: Sequence[int] = SPANS, keys: Sequence[str] = ("row", "col"), names: Sequence[str] = ("PR", "PRET"), years: Sequence[int] | None = None) -> DataFrame:
    """annual with PR{s} (sums of ppt) and PRET{s} (sums of ppt - pet); all frames share one sort. With
    `years` (see with_year_index) annual is read once, and nothing runs before the result does."""
    source = {"PR": F.col("ppt"), "PRET": F.col("ppt") - F.col("pet")}
    unknown = [n for n in names if n not in source]
    if unknown:
        raise ValueError(f"unknown index {unknown[0]!r}; known are {', '.join(source)}")
    df = with_year_index(annual, years=years)
    return df.withColumns({f"{n}{s}": rolling_sum(source[n], s, keys) for s in spans for n in names}).drop("year_index")


def splice(reference: DataFrame, focal: DataFrame, reference_years: tuple[int, int], focal_years: tuple[int, int], keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Reference years of one table before focal years of another, for cells that both have."""
    ref, foc = (year_range(d, *y) for d, y in ((reference, reference_years), (focal, focal_years)))
    cells = list(keys)
    return ref.join(foc.select(*cells).distinct(), cells, "left_semi").unionByName(foc.join(ref.select(*cells).distinct(), cells, "left_semi"))


def index_suite(annual: DataFrame, reference_years: tuple[int, int], focal_years: tuple[int, int], spans: Sequence[int] = SPANS, names: Sequence[str] = INDICES, keys: Sequence[str] = ("row", "col"), reference: DataFrame | None = None, years: Sequence[int] | None = None, parameters: dict[str, DataFrame] | None = None) -> DataFrame:
    """Focal rows of annual with the indices of all spans.

    SPI{s} and SPEI{s} are fitted per cell on PR{s} and PRET{s} of the reference years. With
    `reference`, these years come from that table; both are cut to their years before the sums, so
    the first windows of the focal years cross the seam. `parameters` ({"SPI": table, "SPEI": table}, of
    stdindex.fit_parameters) stand for the fits: projections with one reference share them. `years` as
    in with_year_index.
    """
    from gridloom.operators.stdindex import standardised

    unknown = [n for n in names if n not in INDICES]
    if unknown:
        raise ValueError(f"unknown index {unknown[0]!r}; known are {', '.join(INDICES)}")
    if reference is not None:
        annual = splice(reference, annual, reference_years, focal_years, keys)
    original = annual.columns
    base = [n for n, needs in (("PR", {"PR", "SPI"}), ("PRET", {"PRET", "SPEI"})) if needs & set(names)]
    df = rolling_indices(annual, spans, keys, base, years)
    given = parameters or {}
    if set(names) & {"SPI", "SPEI"} - set(given):
        df = stored(df, "rolled")  # read by the fits and by what they are applied to
    focal = year_range(df, *focal_years)
    for name, source, kind in (("SPI", "PR", "gamma"), ("SPEI", "PRET", "shifted_gamma")):
        if name in names:
            focal = standardised(df, focal, {f"{source}{s}": f"{name}{s}" for s in spans}, reference_years, kind, keys, given.get(name))
    return focal.select(*original, *[f"{n}{s}" for s in spans for n in names])
