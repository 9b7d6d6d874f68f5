"""Names that carry data: raster members and feature columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed format of member names: three letters, a year, a month's English abbreviation.
MEMBER = r"^([a-z]{3})([0-9]{4})([a-z]{3})"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Fixed format of index features: name, years summed, lag.
FEATURE = r"^([A-Z]+)([0-9]+)-([0-9]+)$"


def member_variable(name: Column) -> Column:
    """The variable of a member; NULL for other names."""
    return F.nullif(F.regexp_extract(F.lower(name), MEMBER, 1), F.lit(""))


def member_month(name: Column) -> Column:
    """The first day of a member's month; NULL for other names."""
    low = F.lower(name)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, MEMBER, 3))
    year = F.regexp_extract(low, MEMBER, 2)
    return F.when((year != "") & (number > 0), F.make_date(year.try_cast("int"), number.cast("int"), F.lit(1)))


def checked(parsed: Column, name: Column, what: str) -> Column:
    """parsed, or an error that shows the name."""
    return F.when(parsed.isNull(), F.raise_error(F.concat(F.lit(f"no {what} in "), name))).otherwise(parsed)


def feature_parts(name: Column) -> tuple[Column, Column, Column]:
    """(index, years summed, lag) of a feature name; NULLs for other names."""
    index = F.nullif(F.regexp_extract(name, FEATURE, 1), F.lit(""))
    return index, F.regexp_extract(name, FEATURE, 2).try_cast("int"), F.regexp_extract(name, FEATURE, 3).try_cast("int")
