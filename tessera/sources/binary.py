"""Binary sequence and count files: an indexed sequence (header, then letters) and four counts for each place. Little-endian.

Sequence file: magic, number of sequences, for each its name, 64-bit size and 32-bit checksum; then the letters of all. Count file: the same with a width code
(0, 1, 2 or 4 bytes for a count; 0 for all zero) instead of the checksum; then the counts by place, a, c, g, t. A name is its length and its bytes with a
NUL. Spark reads the header once on the driver (as small as the number of sequences) and places by task through ranged reads of pyarrow.fs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SEQUENCE, COUNTS = 0x62617332, 0x62616631
#: Places of one task.
STEP = 1 << 20


@dataclass
class Entry:
    index: int
    name: str
    size: int
    code: int
    at: int


def _open(path: str):
    where, p = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_file(p)


def header(path: str) -> tuple[int, list[Entry]]:
    """Magic and entries of a file, with the place of each sequence's data."""
    with _open(path) as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic not in (SEQUENCE, COUNTS):
            raise ValueError(f"{path}: not a sequence or count file")
        raw = []
        for _ in range(n):
            (length,) = struct.unpack("<i", f.read(4))
            name = f.read(length + 1)[:-1].decode()
            raw.append((name, *struct.unpack("<qI", f.read(12))))
        at, out = f.tell(), []
    for k, (name, size, code) in enumerate(raw):
        out.append(Entry(k + 1, name, size, code, at))
        at += size if magic == SEQUENCE else size * 4 * code
    return magic, out


def _head(magic: int, rows: list[tuple[str, int, int]]) -> bytes:
    out = [struct.pack("<II", magic, len(rows))]
    for name, size, code in rows:
        raw = name.encode()
        out.append(struct.pack("<i", len(raw)) + raw + b"\0" + struct.pack("<qI", size, code))
    return b"".join(out)


def write_sequences(path: str, seqs: list[tuple[str, str]]) -> None:
    """A sequence file of (name, letters)."""
    with open(path, "wb") as f:
        f.write(_head(SEQUENCE, [(n, len(s), zlib.crc32(s.encode()) if s else 0) for n, s in seqs]))
        for _, s in seqs:
            f.write(s.encode())


def width_of(counts: np.ndarray) -> int:
    """Bytes that the largest count needs; all counts are looked at."""
    top = int(counts.max(initial=0))
    return 0 if top == 0 else 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4


def write_counts(path: str, seqs: list[tuple[str, np.ndarray]]) -> None:
    """A count file of (name, places x 4)."""
    widths = [width_of(c) for _, c in seqs]
    with open(path, "wb") as f:
        f.write(_head(COUNTS, [(n, len(c), w) for (n, c), w in zip(seqs, widths, strict=True)]))
        for (_, c), w in zip(seqs, widths, strict=True):
            if w:
                f.write(c.astype(f"<u{w}").tobytes())


@dataclass
class Part(InputPartition):
    index: int
    first: int
    last: int
    at: int
    width: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, magic: int):
        self.path, self.magic = path, magic

    def partitions(self) -> list[Part]:
        magic, entries = header(self.path)
        if magic != self.magic:
            raise ValueError(f"{self.path}: another kind of file")
        width = lambda e: 1 if magic == SEQUENCE else 4 * e.code
        return [Part(e.index, a, min(e.size, a + STEP - 1), e.at + (a - 1) * width(e), width(e)) for e in entries for a in range(1, e.size + 1, STEP) if width(e)] or [Part(0, 1, 0, 0, 1)]

    def read(self, part: Part) -> Iterator[tuple]:
        n = part.last - part.first + 1
        if n <= 0:
            return
        with _open(self.path) as f:
            f.seek(part.at)
            raw = f.read(n * part.width)
        if self.magic == SEQUENCE:
            yield part.index, part.first, raw.decode()
            return
        counts = np.frombuffer(raw, f"<u{part.width // 4}").reshape(n, 4)
        for k in np.flatnonzero(counts.any(1)).tolist():
            yield (part.index, part.first + k, *map(int, counts[k]))


class SequenceSource(DataSource):
    """chr, from and part: the letters from there on. Option path."""

    @classmethod
    def name(cls) -> str:
        return "tessera_sequence"

    def schema(self) -> str:
        return "chr int, `from` long, part string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], SEQUENCE)


class CountSource(DataSource):
    """chr, pos, a, c, g, t of places with any count. Option path."""

    @classmethod
    def name(cls) -> str:
        return "tessera_counts"

    def schema(self) -> str:
        return "chr int, pos long, a long, c long, g long, t long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], COUNTS)


def register(spark) -> None:
    spark.dataSource.register(SequenceSource)
    spark.dataSource.register(CountSource)
