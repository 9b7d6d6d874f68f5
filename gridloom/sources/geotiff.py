"""Georeferenced raster files, one for each layer.

Files are BigTIFF (no limit of 4 GB) with deflated strips of doubles, pixel scale, tie point and coordinate system;
missing is NaN. A task gets a layer's cells in order of rows and holds one strip of it, and the compressed
strips before. Files appear under their names when all tasks have ended; what a lost or failed task has
written stays in a folder of the job that goes with the commit or the abort.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gridloom.cluster import ship_package
from gridloom.functions.grid import GridSpec
from gridloom.sources.files import listed, located
from gridloom.sources.tables import layer_name, unpivoted

#: Pixels of a strip, about.
STRIP_PIXELS = 262_144

# Fixed values of the TIFF and GeoTIFF formats: tag numbers, and the types' codes with their layouts.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
TYPES = {2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}
ASCII, SHORT, LONG, DOUBLE, LONG8 = TYPES
DEFLATE, IEEE_FLOAT = 8, 3
PROJECTED, GEOGRAPHIC = 3072, 2048


def tiff_bytes(strips: Sequence[bytes], grid: GridSpec, rows_per_strip: int, epsg: int | None, geographic: bool) -> Iterator[bytes]:
    """A file's bytes: header, directory, long values, strips."""
    keys = [(1024, 2 if geographic else 1), (1025, 1)] + ([(GEOGRAPHIC if geographic else PROJECTED, epsg)] if epsg else [])
    directory = [1, 1, 0, len(keys)] + [x for k, v in keys for x in (k, 0, 1, v)]
    entries = [
        (WIDTH, LONG, [grid.n_cols]), (LENGTH, LONG, [grid.n_rows]), (BITS, SHORT, [64]), (COMPRESSION, SHORT, [DEFLATE]), (PHOTOMETRIC, SHORT, [1]),
        (STRIP_OFFSETS, LONG8, [0] * len(strips)), (SAMPLES, SHORT, [1]), (ROWS_PER_STRIP, LONG, [rows_per_strip]), (STRIP_SIZES, LONG8, [len(s) for s in strips]),
        (SAMPLE_FORMAT, SHORT, [IEEE_FLOAT]), (PIXEL_SCALE, DOUBLE, [grid.dx, grid.dy, 0.0]), (TIE_POINT, DOUBLE, [0.0, 0.0, 0.0, grid.x0, grid.y0, 0.0]),
        (GEO_KEYS, SHORT, directory), (NODATA, ASCII, [b"nan\0"]),
    ]
    after = 16 + 8 + 20 * len(entries) + 8
    long_size = sum(s for _, kind, values in entries if (s := len(_packed(kind, values))) > 8)
    at = after + long_size
    for k in range(len(strips)):
        entries[5][2][k] = at
        at += len(strips[k])
    table, long_values = [], b""
    for tag, kind, values in entries:
        data = _packed(kind, values)
        count = len(data) if kind == ASCII else len(values)
        if len(data) > 8:
            table.append(struct.pack("<HHQQ", tag, kind, count, after + len(long_values)))
            long_values += data
        else:
            table.append(struct.pack("<HHQ", tag, kind, count) + data.ljust(8, b"\0"))
    yield struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(entries)) + b"".join(table) + struct.pack("<Q", 0) + long_values
    yield from strips


def _packed(kind: int, values: Sequence) -> bytes:
    return values[0] if kind == ASCII else struct.pack(f"<{len(values)}{TYPES[kind]}", *values)


def read_directory(file: pa.NativeFile, name: str) -> dict[int, tuple]:
    """The values of a file's tags."""
    head = file.read(16)
    if head[:8] != struct.pack("<2sHHH", b"II", 43, 8, 0):
        raise ValueError(f"{name} is no BigTIFF file of this layout")
    file.seek(struct.unpack("<Q", head[8:])[0])
    entries = file.read(20 * struct.unpack("<Q", file.read(8))[0])
    out = {}
    for k in range(0, len(entries), 20):
        tag, kind, count = struct.unpack_from("<HHQ", entries, k)
        layout = f"<{count}{TYPES[kind]}"
        size, data = struct.calcsize(layout), entries[k + 12 : k + 20]
        if size > 8:
            file.seek(struct.unpack("<Q", data)[0])
            data = file.read(size)
        out[tag] = struct.unpack_from(layout, data)
    return out


@dataclass
class Written(WriterCommitMessage):
    layers: list[tuple[str, str]]


class LayerWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        number = lambda k: float(options[k])
        self.grid = GridSpec(int(options["n_rows"]), int(options["n_cols"]), number("x0"), number("y0"), number("dx"), number("dy"))
        self.epsg, self.geographic = int(options["epsg"]) if options.get("epsg") else None, options.get("geographic", "false") == "true"
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, f"_job-{uuid.uuid4().hex}"
        self.rows_per_strip = max(1, min(self.grid.n_rows, STRIP_PIXELS // self.grid.n_cols))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = located(self.path)
        system.create_dir(f"{base}/{self.job}")
        done: list[tuple[str, str]] = []
        layer, strips, strip = None, [], None

        def finish() -> None:
            while len(strips) * self.rows_per_strip < self.grid.n_rows:
                add(None)
            at = f"{base}/{self.job}/{uuid.uuid4().hex}"
            with system.open_output_stream(at, compression=None) as out:
                for part in tiff_bytes(strips, self.grid, self.rows_per_strip, self.epsg, self.geographic):
                    out.write(part)
            done.append((layer, at))

        def add(values: np.ndarray | None) -> None:
            rows = min(self.rows_per_strip, self.grid.n_rows - len(strips) * self.rows_per_strip)
            cells = np.full((rows, self.grid.n_cols), np.nan) if values is None else values[:rows]
            strips.append(zlib.compress(cells.astype("<f8").tobytes()))

        for batch in iterator:
            names, row, col, value = (batch.column(c) for c in ("layer", "row", "col", "value"))
            row, col, value = (a.to_numpy(zero_copy_only=False) for a in (row, col, value))
            if len(row) and not (((row >= 0) & (row < self.grid.n_rows) & (col >= 0) & (col < self.grid.n_cols)).all()):
                raise ValueError(f"cells of {names[0]} lie outside of the grid")
            names = np.asarray(names.to_pylist(), dtype=object)
            number = row // self.rows_per_strip
            starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (number[1:] != number[:-1])]) if len(row) else []
            for a, b in zip(starts, [*starts[1:], len(row)], strict=True):
                if names[a] != layer:
                    if layer is not None:
                        add(strip)
                        finish()
                    layer, strips, strip, seen = names[a], [], None, None
                    current = -1
                if number[a] != current:
                    if strip is not None:
                        add(strip)
                    while len(strips) < number[a]:
                        add(None)
                    strip, current = np.full((self.rows_per_strip, self.grid.n_cols), np.nan), number[a]
                    seen = np.zeros(strip.shape, dtype=bool)
                at = row[a:b] - current * self.rows_per_strip, col[a:b]
                if seen[at].any() or len(np.unique(at[0].astype("int64") * self.grid.n_cols + at[1])) < b - a:
                    raise ValueError(f"{layer} has a cell twice")
                seen[at], strip[at] = True, value[a:b]
        if layer is not None:
            add(strip)
            finish()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = located(self.path)
        done = [d for m in messages if m for d in m.layers]
        if len({layer for layer, _ in done}) < len(done):
            raise ValueError("a layer was written by two tasks; deal the rows by layer")
        system.create_dir(base)
        before = [f.path for f in system.get_file_info(fs.FileSelector(base)) if f.path.endswith(".tif")]
        if self.overwrite:
            for path in before:
                system.delete_file(path)
        elif {f"{base}/{layer}.tif" for layer, _ in done} & set(before):
            raise ValueError("layers of these names are there")
        for layer, at in done:
            system.move(at, f"{base}/{layer}.tif")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        system, base = located(self.path)
        if system.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.job}")


@dataclass
class Strips(InputPartition):
    path: str
    first: int
    last: int


class LayerReader(DataSourceReader):
    def __init__(self, path: str, at_once: int = 64):
        self.path, self.at_once = path, at_once

    def partitions(self) -> list[Strips]:
        system, paths = listed(self.path, ".tif")
        out = []
        for path in paths:
            with system.open_input_file(path) as file:
                n = len(read_directory(file, path)[STRIP_OFFSETS])
            out += [Strips(path, k, min(n, k + self.at_once)) for k in range(0, n, self.at_once)]
        return out

    def read(self, partition: Strips) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = located(self.path.rstrip("/").rpartition("/")[0] or "/")
        layer = partition.path.rsplit("/", 1)[-1].removesuffix(".tif")
        with system.open_input_file(partition.path) as file:
            tags = read_directory(file, layer)
            cols, high = tags[WIDTH][0], tags[ROWS_PER_STRIP][0]
            (dx, dy, _), (x0, y0) = tags[PIXEL_SCALE], tags[TIE_POINT][3:5]
            for k in range(partition.first, partition.last):
                file.seek(tags[STRIP_OFFSETS][k])
                values = np.frombuffer(zlib.decompress(file.read(tags[STRIP_SIZES][k])), dtype="<f8")
                row = np.repeat(np.arange(len(values) // cols, dtype="int32") + np.int32(k * high), cols)
                col = np.tile(np.arange(cols, dtype="int32"), len(values) // cols)
                yield pa.record_batch({"layer": pa.array([layer] * len(row)), "row": row, "col": col, "northing": y0 - (row + 0.5) * dy, "easting": x0 + (col + 0.5) * dx, "value": pa.array(values, from_pandas=True)})


class Layers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff_layers"

    def schema(self) -> str:
        return "layer string, row int, col int, northing double, easting double, value double"

    def reader(self, schema) -> LayerReader:
        return LayerReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> LayerWriter:
        return LayerWriter(dict(self.options), overwrite)


def write_geotiffs(df: DataFrame, variables: Sequence[str], path: str, grid: GridSpec, template: str = "{variable}_{year}", epsg: int | None = None, geographic: bool = False, mode: str = "overwrite") -> None:
    """One file for each variable and year of df (row, col, year, variables), named by the template.
    Cells that are absent or NULL are missing; a cell outside of the grid, or twice in a layer, is an error.
    Mode `overwrite` replaces the folder's files, `append` adds to them."""
    ship_package(df.sparkSession)
    df.sparkSession.dataSource.register(Layers)
    named = unpivoted(df, variables).select(layer_name(template).alias("layer"), "row", "col", F.col("value").cast("double"))
    named = named.withColumn("layer", F.when(F.col("layer").rlike(r"^[^/\\.][^/\\]*$"), F.col("layer")).otherwise(F.raise_error(F.concat(F.lit("no file name: "), F.col("layer")))))
    options = {k: repr(getattr(grid, k)) for k in ("n_rows", "n_cols", "x0", "y0", "dx", "dy")} | {"geographic": str(geographic).lower()} | ({"epsg": str(epsg)} if epsg else {})
    named.repartition("layer").sortWithinPartitions("layer", "row", "col").write.format("geotiff_layers").mode(mode).options(**options).save(path)


def read_geotiffs(spark: SparkSession, path: str) -> DataFrame:
    """(layer, row, col, northing, easting, value) of the files that `write_geotiffs` wrote; a task reads up to 64 strips."""
    ship_package(spark)
    spark.dataSource.register(Layers)
    return spark.read.format("geotiff_layers").load(path)
