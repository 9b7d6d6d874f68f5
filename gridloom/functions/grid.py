"""Grid geometry as column arithmetic: coordinates, identifiers, tiles and folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.sized import small


@dataclass(frozen=True)
class GridSpec:
    """A regular grid: row 0 is the northernmost, (x0, y0) its north-western corner. `open` grids have
    rows and columns beyond n_rows and n_cols and below 0, as far as a table has cells."""

    n_rows: int
    n_cols: int
    x0: float
    y0: float
    dx: float
    dy: float
    crs: str = "plain"
    open: bool = False

    def easting(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + 0.5) * self.dx

    def northing(self, row: Column) -> Column:
        return F.lit(self.y0) - (row + 0.5) * self.dy

    def col_at(self, easting: Column) -> Column:
        return F.floor((easting - self.x0) / self.dx).cast("int")

    def row_at(self, northing: Column) -> Column:
        return F.floor((F.lit(self.y0) - northing) / self.dy).cast("int")

    def inside(self, row: Column, col: Column) -> Column:
        return F.lit(True) if self.open else row.between(0, self.n_rows - 1) & col.between(0, self.n_cols - 1)

    def cell_id(self, row: Column, col: Column) -> Column:
        return row.cast("long") * self.n_cols + col

    def block_fold(self, row: Column, col: Column, size: int) -> Column:
        """Number of the square block of `size` cells; the last blocks of a row or column may be smaller."""
        across = (self.n_cols - 1) // size + 1
        return (F.floor(col / F.lit(size)) + across * F.floor(row / F.lit(size))).cast("int")


def rounded(value: Column, places: int = 4) -> Column:
    """Coordinates as join keys: rounded, ties to even."""
    return F.bround(value, places)


def with_folds(df: DataFrame, grid: GridSpec, size: int) -> DataFrame:
    """df with fold, id and copies of the coordinates as feature columns."""
    return df.withColumns({
        "fold": grid.block_fold(F.col("row"), F.col("col"), size),
        "id": grid.cell_id(F.col("row"), F.col("col")),
        "northings": F.col("northing"),
        "eastings": F.col("easting"),
    })


def shuffled_folds(cells: DataFrame, seed: int = 0, slices: int = 64) -> DataFrame:
    """Cells (id, fold) with their folds permuted: each fold keeps its number of cells, and which
    cells are in it depends on a hash of id and seed alone.

    Cells are numbered in the order of the hash and of the fold; equal numbers meet. Numbers are
    running within hash slices (and folds) plus the sizes of those before, so no task holds all cells.
    """
    mixed = F.xxhash64("id", F.lit(seed))
    c = cells.select("id", "fold", mixed.alias("h")).withColumn("slice", F.shiftright("h", 64 - (slices - 1).bit_length()))

    def numbered(df: DataFrame, part: list[str], order: list[str], name: str) -> DataFrame:
        sizes = df.groupBy(*part).count()
        before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
        own = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        return df.withColumn("own", own).join(small(before), part).withColumn(name, F.col("own") + F.col("before"))

    by_hash = numbered(c, ["slice"], ["h", "id"], "n").select("id", "n")
    by_fold = numbered(c, ["fold", "slice"], ["id"], "n").select("fold", "n")
    return by_hash.join(by_fold, "n").select("id", "fold")
