"""Arrow batches as numpy buffers, cut so that memory stays bounded by bytes and not by rows."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `column` holds at most `limit` bytes (or a single row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Has the allocators return what a task has freed: workers are kept, and between their tasks the executor's memory belongs to the joins."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets, from 0; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is empty."""
    return [x or "" for x in column.to_pylist()]


def packed(docs: DataFrame) -> DataFrame:
    """The same rows with `text` compressed (binary), for a shuffle: a third less than what the shuffle's own codec makes of it."""
    names = docs.columns
    schema = StructType([StructField(f.name, BinaryType() if f.name == "text" else f.dataType) for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            small = pa.array([None if x is None else press(x) for x in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([small if n == "text" else batch.column(n) for n in names], names)

    return docs.mapInArrow(run, schema)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of packed rows, some at a time, with their texts as strings again."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, limit=1 << 20):
        full = pa.array([None if x is None else expand(x) for x in batch.column("text").to_pylist()], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([full if n == "text" else batch.column(n) for n in batch.schema.names], batch.schema.names)


def widened(schema: StructType, **more: str) -> StructType:
    """The schema with further columns (name=type)."""
    out = StructType(list(schema.fields))
    for name, kind in more.items():
        out.add(name, kind)
    return out


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where `docs` has such a column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


STEP = 0x9E3779B97F4A7C15
# Range hashes are polynomials modulo a prime: modulo a power of two, long texts of two symbols exist that collide for every base.
PRIME = np.uint64((1 << 61) - 1)
BASE = 0x1D2C6F3A5B9E8471 % int(PRIME)
BACK = pow(BASE, -1, int(PRIME))
VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP)) >> np.uint64(35)  # 29 bits
PART = 1 << 20  # powers that are kept; those beyond are products


def folded(x: np.ndarray) -> np.ndarray:
    """Below 2**61 + 7 and equal modulo PRIME."""
    return (x & PRIME) + (x >> np.uint64(61))


def reduced(x: np.ndarray) -> np.ndarray:
    """The remainder modulo PRIME."""
    x = folded(x)
    return np.where(x >= PRIME, x - PRIME, x)


def scaled(x: np.ndarray, small: np.ndarray) -> np.ndarray:
    """x * small modulo PRIME, for x below 2**61 and small below 2**29; not fully reduced."""
    high = (x >> np.uint64(32)) * small
    return folded((x & np.uint64(0xFFFFFFFF)) * small + (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)))


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo PRIME, both below 2**61."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    a, b, c, d = x >> half, x & low, y >> half, y & low
    middle = a * d + b * c
    return reduced(folded(b * d) + ((a * c) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = times(out[:more], np.full(1, pow(base, done, int(PRIME)), np.uint64))
        done += more
    return out


@functools.cache
def kept_powers(base: int) -> np.ndarray:
    return powers(base, PART)


class RangeHash:
    """Hashes of any ranges of a sequence from one prefix sum; equal ranges have equal hashes."""

    def __init__(self, data: np.ndarray, values: np.ndarray = VALUE):
        """Of bytes, each standing for one of 256 values of up to 29 bits."""
        self._add(len(data), lambda a, b, power: scaled(power, values[data[a:b]]))

    def _add(self, n: int, terms: Callable[[int, int, np.ndarray], np.ndarray]) -> None:
        self.sums = np.zeros(n + 1, np.uint64)
        low = np.uint64((1 << 31) - 1)
        for a in range(0, n, PART):
            b = min(n, a + PART)
            power = kept_powers(BASE)[: b - a]
            if a:
                power = times(power, np.full(1, pow(BASE, a, int(PRIME)), np.uint64))
            term = terms(a, b, power)
            # sums of both halves stay below 2**61
            high = np.cumsum(term >> np.uint64(31))
            self.sums[a + 1 : b + 1] = reduced(np.cumsum(term & low) + (high >> np.uint64(30)) + ((high & np.uint64((1 << 30) - 1)) << np.uint64(31)) + self.sums[a])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of [start:end], below 2**61; ranges of different lengths may agree."""
        out = times(reduced(self.sums[end] + (PRIME - self.sums[start])), kept_powers(BACK)[start & (PART - 1)])
        if len(self.sums) > PART:
            out = times(out, powers(pow(BACK, PART, int(PRIME)), len(self.sums) // PART + 1)[start >> 20])
        return out

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of [start:end], mixed with the length, in 64 bits."""
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * M2)
