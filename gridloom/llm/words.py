"""Word arrays over Arrow text batches: offsets, 64-bit word hashes and word n-gram hashes.

Everything works on the UTF-8 bytes of a small slice of a batch at once, so that a task
holds a few tens of MB whatever the table's size. Null texts count as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from gridloom.cluster import ship_package

#: Bytes of text that are worked on at once (one longer document is a slice of its own).
SLICE_BYTES = 1 << 20
#: Rows of a slice at most, and of an Arrow batch that a Python worker gets.
SLICE_ROWS = 2048
#: Bytes whose running sums are made at once.
SUM_BYTES = 1 << 14

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the usual length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, dtype=_U)
        have[0] = 1
        have = np.cumprod(have, dtype=_U)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is True at the bytes of the given inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Bytes of words that white space ends (space, tab, LF, VT, FF, CR).
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: A-Z to a-z, the other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for bytes and a table of 256 bytes or truth values."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


class Bytes:
    """UTF-8 bytes of a slice of documents: `data`, and `offs` with n + 1 entries."""

    def __init__(self, texts: pa.Array, fold: np.ndarray | None = None):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        n = len(texts)
        offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offs[0] : offs[-1]] if n and raw is not None else np.empty(0, np.uint8)
        self.n, self.raw, self.offs = n, data, offs - offs[0] if n else np.zeros(1, np.int64)
        self.data = data if fold is None else mapped(data, fold)
        self._sums: np.ndarray | None = None

    def doc(self, i: int) -> bytes:
        return self.raw[self.offs[i] : self.offs[i + 1]].tobytes()

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of maximal runs of bytes that `inside` marks."""
        m = mapped(self.data, inside)
        before = np.empty_like(m)
        before[:1], before[1:] = False, m[:-1]
        after = np.empty_like(m)
        after[-1:], after[:-1] = False, m[1:]
        cut = self.offs[(self.offs > 0) & (self.offs < len(m))]
        before[cut] = False
        after[cut - 1] = False
        starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
        return starts, ends, np.repeat(np.arange(self.n), np.diff(np.searchsorted(starts, self.offs)))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges, equal for equal bytes wherever they stand."""
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, dtype=_U)
            power = _power(_P, len(self.data))
            for k in range(0, len(self.data), SUM_BYTES):  # what stays in the processor's cache
                part = _TABLE[self.data[k : k + SUM_BYTES]] * power[k : k + SUM_BYTES]
                part[:1] += self._sums[k : k + 1]
                np.cumsum(part, dtype=_U, out=self._sums[k + 1 : k + 1 + len(part)])
        h = (self._sums[ends] - self._sums[starts]) * _power(_P_INV, len(self.data) + 1)[starts]
        return mix(h + (ends - starts).astype(_U))

    def chars_before(self) -> np.ndarray:
        """Code points before each byte offset (n bytes + 1 entries)."""
        out = np.zeros(len(self.raw) + 1, dtype=np.int64)
        np.cumsum((self.raw & 0xC0) != 0x80, out=out[1:])
        return out


def stable_order(key: np.ndarray) -> np.ndarray:
    """Indexes that sort keys of 0 or more, equal ones in their order: one sort of numbers where
    key and index fit into one."""
    n = len(key)
    if n and n < 1 << 24 and int(key.max()) < 1 << 39:
        return np.sort((key.astype(np.int64) << 24) | np.arange(n)) & ((1 << 24) - 1)
    return np.argsort(key, kind="stable")


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Hash of words i..i+n-1 for each i (meaningful where `full` says so)."""
    out = np.zeros(max(0, len(h) - n + 1), dtype=_U)
    for j in range(n):
        out = out * _U(_P) + h[j : j + len(out)]
    return mix(out)


def range_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the sequence h[start:end] for each range; seeds give independent hashes."""
    v = mix(h ^ _U(0xA0761D6478BD642F * (seed + 1) & (1 << 64) - 1))
    c = np.zeros(len(v) + 1, dtype=_U)
    np.cumsum(v * _power(_P, len(v)), dtype=_U, out=c[1:])
    return mix((c[ends] - c[starts]) * _power(_P_INV, len(v) + 1)[starts] + (ends - starts).astype(_U))


def full(doc: np.ndarray, n: int) -> np.ndarray:
    """Whether words i..i+n-1 are of one document."""
    m = max(0, len(doc) - n + 1)
    return doc[:m] == doc[n - 1 : n - 1 + m]


def doc_bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets into arrays that are ordered by document index."""
    return np.searchsorted(doc, np.arange(n + 1))


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of at most `limit` bytes of text (at least one row each)."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0)
    ends, i = np.cumsum(np.asarray(size, dtype=np.int64)), 0
    while i < batch.num_rows:
        base = ends[i - 1] if i else 0
        j = min(max(i + 1, int(np.searchsorted(ends, base + limit, side="right"))), i + SLICE_ROWS)
        yield batch.slice(i, j - i)
        i = j


def prepare(spark: SparkSession) -> None:
    """Batches of texts hold fewer rows than Spark's default, for the workers' memory."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > SLICE_ROWS:
        spark.conf.set(name, SLICE_ROWS)


def add_columns(
    df: DataFrame, text_col: str, out: dict[str, str], fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], done: Sequence[Callable[[], object]] = ()
) -> DataFrame:
    """df with columns that fn computes from slices of its rows; no shuffle. Caches that `done` empties don't outlive
    a task: Spark may keep more worker processes than tasks run at once.

    `out` maps new columns to their Spark types. A column of df with one of these names is
    replaced. fn gets record batches with df's columns and returns one array per new column.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    rest = [c for c in df.columns if c.lower() not in {o.lower() for o in out}]
    df = df.select(*[df[f"`{c}`"] for c in rest])
    added = T._parse_datatype_string(", ".join(f"`{k}` {t}" for k, t in out.items()))
    schema = T.StructType([*df.schema.fields, *added.fields])
    kinds = {f.name: f.type for f in to_arrow_schema(added)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(fn.__module__)
        for batch in batches:
            for part in slices(batch, text_col):
                new = fn(part)
                cols = [*part.columns, *(pa.array(new[k], type=kinds[k]) if not isinstance(new[k], pa.Array) else new[k].cast(kinds[k]) for k in out)]
                yield pa.RecordBatch.from_arrays(cols, names=[*part.schema.names, *out])
        batch = part = new = cols = None
        empty(done)

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def emit_rows(df: DataFrame, text_col: str, schema: str, fn: Callable[[pa.RecordBatch], dict[str, np.ndarray] | None]) -> DataFrame:
    """Rows that fn makes from slices of df's rows (any number per document); no shuffle."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(fn.__module__)
        for batch in batches:
            for part in slices(batch, text_col):
                new = fn(part)
                if new is not None:
                    yield pa.RecordBatch.from_arrays([new[f.name] if isinstance(new[f.name], pa.Array) else pa.array(new[f.name], type=f.type) for f in arrow], schema=arrow)
        batch = part = new = None
        empty()

    prepare(df.sparkSession)
    return df.mapInArrow(run, kind)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Table:
    """Lookup of 64-bit keys (unique) in bulk: an open-addressed table with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(len(keys) * 4 - 1).bit_length())
        self.mask = _U(size - 1)
        self.keys, self.values = np.zeros(size, dtype=_U), np.full(size, -1, dtype=np.int32)
        at, left = (mix(keys) & self.mask).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.values[at[left]] < 0
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(np.where(free, at[left], -1), return_index=True)[1]] = True
            put = left[free & first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = left[~(free & first)]
            at[left] = (at[left] + 1) & (size - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for unknown keys."""
        at = (mix(keys) & self.mask).astype(np.int64)
        got = self.values[at]
        other = np.flatnonzero((got >= 0) & (self.keys[at] != keys))
        while len(other):
            at[other] = (at[other] + 1) & int(self.mask)
            got[other] = self.values[at[other]]
            other = other[(got[other] >= 0) & (self.keys[at[other]] != keys[other])]
        return got


class Store:
    """Values of hashes that a task has computed, some numbers for each: a table, and a list of newer ones."""

    def __init__(self, limit: int):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.known, self.values = np.empty(0, np.uint64), None
        self.table, self.tabled = Table(self.known, np.empty(0, np.int32)), 0

    def get(self, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(values: hashes x width, indexes of the hashes that aren't there)."""
        if self.values is None:
            self.values = np.empty((0, width))
        at = self.table.get(h)
        out = np.zeros((len(h), width))
        have = np.flatnonzero(at >= 0)
        out[have] = self.values[at[have]]
        return out, np.flatnonzero(at < 0)

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """A store that would have more than its limit is emptied first."""
        if len(self.known) + len(h) > self.limit:
            self._clear()
            self.values = np.empty((0, values.shape[1]))
        self.known, self.values = np.concatenate([self.known, h]), np.concatenate([self.values, values])
        if len(self.known) > 1.25 * self.tabled + 8000:
            self.known, first = np.unique(self.known, return_index=True)
            self.values = self.values[first]
            self.table, self.tabled = Table(self.known, np.arange(len(self.known), dtype=np.int32)), len(self.known)


_stores: dict[str, Store] = {}

#: What empties a module's caches in this worker process.
caches: list[Callable[[], object]] = [_powers.clear, _stores.clear]
_running: list[str] = [""]


def keep_only(module: str) -> None:
    """A worker process that Spark uses again for another operator drops what the last one kept, so that the
    stages of a pipeline don't add up in memory."""
    if _running[0] != module:
        if _running[0]:
            empty(caches)
        _running[0] = module


def empty(held: Sequence[Callable[[], object]] = ()) -> None:
    """Empties caches. What they and a task have freed goes back to the system, as far as Arrow's pool and the C
    library can: a worker process waits for its next task with what they keep."""
    for clear in held:
        clear()
    if held:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def drop_stores() -> None:
    _stores.clear()


def own_store(name: str, limit: int) -> Store:
    """This worker process' store for one model; another model's store goes."""
    if name not in _stores:
        _stores.clear()
        _stores[name] = Store(limit)
    return _stores[name]
