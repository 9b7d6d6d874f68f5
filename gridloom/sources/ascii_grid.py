"""Zipped ASCII grids as rows.

A member is one task, however large its archive: tasks are planned from the archives' central
directories, and each opens its archive at its member alone. Filters on archive, member, variable and time
are applied while planning, so that other members are never opened. A member that is no grid, or whose name
has no variable and month, is an error that names it; so is a file that is no archive.
"""

from __future__ import annotations

import datetime as dt
import operator
import re
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gridloom.cluster import ship_package
from gridloom.functions.missing import nodata_to_null
from gridloom.functions.names import MEMBER, MONTHS
from gridloom.sources.files import listed, located

HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")
#: Cells of an Arrow batch.
BATCH_CELLS = 65_536
#: Archives whose directories are read at once.
LISTERS = 16

FIELDS = pa.schema([
    ("archive", pa.string()), ("member", pa.string()), ("variable", pa.string()), ("time", pa.date32()), ("row", pa.int32()), ("col", pa.int32()),
    ("northing", pa.float64()), ("easting", pa.float64()), ("value", pa.float64()), ("nodata", pa.float64()),
])
_COMPARISONS = {EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def parse_grid(data: bytes, name: str = "grid") -> tuple[dict[str, float], np.ndarray]:
    """(header, values by row and column) of an ASCII grid."""
    lines = data.decode("ascii").split("\n", len(HEADER))
    head = {}
    for line in lines[: len(HEADER)]:
        key, _, value = line.strip().partition(" ")
        if key.lower() in HEADER:
            head[key.lower()] = float(value)
    if set(HEADER) - set(head):
        raise ValueError(f"{name} lacks {', '.join(sorted(set(HEADER) - set(head)))}")
    values = np.array(lines[len(HEADER)].split(), dtype=float)
    shape = int(head["nrows"]), int(head["ncols"])
    if values.size != shape[0] * shape[1]:
        raise ValueError(f"{name} has {values.size} values, not {shape[0]} x {shape[1]}")
    return head, values.reshape(shape)


@dataclass
class Member(InputPartition):
    """One grid of an archive, with what its name says."""

    path: str
    name: str
    archive: str
    member: str
    variable: str
    time: dt.date


def members_of(path: str, system) -> list[Member]:
    """The members in an archive's central directory, by name."""
    archive = path.rsplit("/", 1)[-1]
    try:
        with system.open_input_file(path) as file, zipfile.ZipFile(file) as z:
            names = sorted(i.filename for i in z.infolist() if not i.is_dir())
    except (zipfile.BadZipFile, pa.ArrowInvalid) as bad:  # Arrow refuses to seek before a short file
        raise ValueError(f"{archive} is no zip archive") from bad
    out = []
    for name in names:
        member = name.rsplit("/", 1)[-1]
        parts = re.match(MEMBER, member.lower())
        if not parts:
            raise ValueError(f"no variable in {member} of {archive}")
        if parts[3] not in MONTHS or parts[2] == "0000":
            raise ValueError(f"no month in {member} of {archive}")
        out.append(Member(path, name, archive, member, parts[1], dt.date(int(parts[2]), MONTHS.index(parts[3]) + 1, 1)))
    return out


class GridReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Notes what a member's name can decide; Spark applies all filters again to the rows."""
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if column in ("archive", "member", "variable", "time") and isinstance(f, (In, *_COMPARISONS)) and f.value is not None:
                self.tests.append((column, type(f).__name__, f.value))
            yield f

    def partitions(self) -> list[Member]:
        system, paths = listed(self.path, ".zip")
        with ThreadPoolExecutor(LISTERS) as pool:
            found = [m for members in pool.map(lambda p: members_of(p, system), paths) for m in members]
        compare = {c.__name__: test for c, test in _COMPARISONS.items()} | {"In": lambda have, values: have in values}
        return [m for m in found if all(compare[kind](getattr(m, column), value) for column, kind, value in self.tests)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no member is left: Spark reads one empty partition
            return
        system, _ = located(self.path.rstrip("/").rpartition("/")[0] or "/")
        with system.open_input_file(partition.path) as file, zipfile.ZipFile(file) as z:
            head, values = parse_grid(z.read(partition.name), partition.name)
        (rows, cols), size = values.shape, head["cellsize"]
        top, at_once = head["yllcorner"] + size * rows, max(1, BATCH_CELLS // max(1, cols))
        for first in range(0, rows, at_once):
            part = values[first : first + at_once]
            row, col = (a.ravel() for a in np.indices(part.shape, dtype="int32"))
            row = row + np.int32(first)
            n = part.size
            named = [pa.array([v] * n, FIELDS.field(k).type) for k, v in enumerate((partition.archive, partition.member, partition.variable, partition.time))]
            yield pa.record_batch([*named, pa.array(row), pa.array(col), pa.array(top - (row + 0.5) * size), pa.array(head["xllcorner"] + (col + 0.5) * size), pa.array(part.ravel()), pa.array(np.full(n, head["nodata_value"]))], schema=FIELDS)


class ZippedGrids(DataSource):
    """`spark.read.format("zipped_grids").load(path)`."""

    @classmethod
    def name(cls) -> str:
        return "zipped_grids"

    def schema(self) -> str:
        return "archive string, member string, variable string, time date, row int, col int, northing double, easting double, value double, nodata double"

    def reader(self, schema) -> GridReader:
        return GridReader(self.options["path"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, variable, time, row, col, northing, easting, value) of all zip files of
    a folder, or that a pattern in the last part of the path matches; the grid's missing-data value becomes NULL.

    Switches on the session's filter push-down for Python sources, and registers `zipped_grids`."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZippedGrids)
    rows = spark.read.format("zipped_grids").load(path)
    return rows.withColumn("value", nodata_to_null(F.col("value"), F.col("nodata"))).drop("nodata")
