"""Words and their hashes over whole Arrow text columns, with numpy and no Python object for a word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame

from tessera.runtime import ship

#: Bytes of text that are handled at once; a longer text is cut between words. Kernels take 50 to 60 bytes for each, most of which a worker then keeps.
STEP = 256 << 10

#: [\x20\x09-\x0D]
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_UNBASE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the result."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, STEP + (1 << 16))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _UNBASE)]
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the offsets of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return bytes_, offs - offs[0]


def steps(offs: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of rows of up to size bytes, STEP if none is given, one row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + (size or STEP), "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offs: np.ndarray, blank: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data, and the number of words of each row. offs: offsets of the rows in data, from 0."""
    inside = ~blank[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; data of any length is read STEP bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + STEP, "right")))
        part = data[lo : int(ends[j - 1])]
        up, down = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODE[part] * up[: len(part)], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _ODD)
        i = j
    return out


def grams(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; row borders are the caller's to mask."""
    if len(hashed) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashed) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + hashed[k : k + len(out)]
    return mix(out)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column as Python strings; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)
