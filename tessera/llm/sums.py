"""Arrays of counters that every task fills for its rows and that are added up in slices, by a tree: no task meets more than a share of the arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessera.llm import scan
from tessera.runtime import input_bytes

SLICE = 1 << 15
#: Groups of tasks whose arrays meet first: the root of the number of tasks as estimated by the input's size, within these.
GROUPS = 8, 1024
TASK_BYTES = 64 << 20
#: Tasks of the second step.
MOST_TASKS = 16
SCHEMA = "slice int, part int, counts binary"


def groups_of(df: DataFrame) -> int:
    """From the optimizer's estimate of the input's bytes; no job is run."""
    size = input_bytes(df)
    return GROUPS[0] * 8 if size is None else int(min(max((size / TASK_BYTES) ** 0.5, GROUPS[0]), GROUPS[1]))


def add_up(df: DataFrame, size: int, fill: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """fill(batch, counters) adds a batch of df to the task's int64 counters, `size` of them. Returns their sum over all tasks.

    A task sends its counters as compressed slices. The arrays of a group of tasks meet in one task, as a stream of which only the sum is held;
    then the groups' sums meet by slice. With as many groups as the root of the number of tasks, no task reads more arrays than that root."""
    slices, groups = -(-size // SLICE), groups_of(df)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(size, np.int64)
        for batch in batches:
            fill(batch, counters)
        parts = [(k, counters[k * SLICE : (k + 1) * SLICE]) for k in range(slices)]
        parts = [(k, x) for k, x in parts if x.any()]
        yield _rows([k for k, _ in parts], TaskContext.get().partitionId() % groups, [_packed(x) for _, x in parts])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = _unpacked(blob)
                sums[k] = sums[k] + x if k in sums else x
        yield _rows(list(sums), 0, [_packed(x) for x in sums.values()])

    parts = scan.map_batches(scan.map_batches(df, count, SCHEMA).repartitionById(groups, F.col("part")), total, SCHEMA)
    parts = scan.map_batches(parts.repartitionById(min(slices, MOST_TASKS), F.col("slice")), total, SCHEMA)
    out = np.zeros(size, np.int64)
    for row in parts.collect():  # size numbers
        out[row.slice * SLICE : (row.slice + 1) * SLICE] = _unpacked(row.counts)
    return out


def _packed(x: np.ndarray) -> bytes:
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if x.max(initial=0) <= np.iinfo(t).max and x.min(initial=0) >= np.iinfo(t).min)
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[blob[0]]).astype(np.int64)


def _rows(keys: list[int], part: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([part] * len(keys), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "part", "counts"])
