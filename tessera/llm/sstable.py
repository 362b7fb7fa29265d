"""Sorted-string-table shards of token ids.

A shard holds documents in ascending order of their keys:

    blocks   entries, then a restart table; compressed with zstd, about BLOCK bytes each before that
    filter   Bloom filter over the keys
    index    for each block: its last key, offset, length, and the number of ids before it in the shard
    footer   FOOTER: offsets and lengths of filter and index, counts, id width, version, magic

An entry is three varints (bytes of the key shared with the entry before, further bytes of the key, bytes of ids), the key's further bytes and
the ids, little-endian, two bytes each where the vocabulary allows it. Every RESTART-th entry shares nothing, and the restart table has
their offsets, so an entry is found by binary search over the index, then over the restarts. Keys sort as bytes: a flag for null, the id with its sign
flipped, big-endian, and a number that tells rows of the same id apart.

Shards are ranges of the ids, and of their texts' hashes where very many rows have one id, as many as the input's size asks for, written by one task each into the shared folder under names of their own; the list of those that count goes into
manifest.json when all are there, so that a task that runs twice does no harm. Files are reached with pyarrow.fs by the folder's URI.

Defined results: null and empty texts have the end id alone; a null doc_id sorts first; rows that share a doc_id are all kept, ordered by
their texts' hashes; a text of any length is one entry, in a block of its own if need be; an empty table gives a manifest without shards; further columns are
ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm import bpe, scan, vocab
from tessera.runtime import text_bytes

VOCABULARY, END_ID = "word_bpe_49k.json", 1
BLOCK, RESTART = 64 << 10, 16
BITS_PER_KEY, PROBES = 10, 7
#: Bytes of input for a shard, and for one of a small input.
SHARD, SMALL = 128 << 20, 8 << 20
#: filter's offset and length, index's offset and length, documents, ids, bytes of an id, version, magic
FOOTER = struct.Struct("<QQQQQQHH8s")
MAGIC, VERSION = b"TSRSSTBL", 1
FIELDS = "path string, part long, first_id long, last_id long, n_docs long, n_ids long, n_bytes long"


def key_of(doc_id: int | None, copy: int = 0) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")) + copy.to_bytes(4, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:9], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [((a + k * b) & ((1 << 64) - 1)) % bits for k in range(PROBES)]


class Writer:
    """Writes one shard; add() takes keys in ascending order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashed: list[bytes] = []
        self.n_ids = self.block_ids = 0
        self._begin()

    def _begin(self) -> None:
        self.block, self.restarts, self.entries, self.last, self.block_start = bytearray(), [], 0, b"", self.n_ids

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.entries += 1
        self.last = key
        self.n_ids += len(ids)
        self.hashed.append(key[:9])
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            raw = bytes(self.block) + np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
            packed = self.pack(raw)
            self.out.write(packed)
            self.index.append((self.last, self.at, len(packed), self.block_start))
            self.at += len(packed)
        self._begin()

    def finish(self) -> int:
        """Writes what follows the blocks; the file's size."""
        self._flush()
        bits = max(64, -(-BITS_PER_KEY * len(self.hashed) // 8) * 8)
        table = bytearray(bits // 8)
        for key in self.hashed:
            for p in _probes(key, bits):
                table[p >> 3] |= 1 << (p & 7)
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQQ", *rest) for k, *rest in self.index)
        footer = FOOTER.pack(self.at, len(table), self.at + len(table), len(index), len(self.hashed), self.n_ids, self.width, VERSION, MAGIC)
        self.out.write(bytes(table) + index + footer)
        return self.at + len(table) + len(index) + len(footer)


class Reader:
    """Reads one shard through a random-access file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        f = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if f[8] != MAGIC or f[7] != VERSION:
            raise ValueError("not a shard of this format")
        self.n_docs, self.n_ids, self.width = f[4], f[5], f[6]
        self.filter = self._at(f[0], f[1])
        raw, at = self._at(f[2], f[3]), 0
        self.index: list[tuple[bytes, int, int, int]] = []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QQQ", raw, at + n)))
            at += n + 24
        self.lasts = [k for k, *_ in self.index]

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def block(self, k: int) -> tuple[bytes, np.ndarray, int]:
        """A block's entries, its restarts, and the number of ids before it."""
        _, offset, n, start = self.index[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(offset, n))
        count = int.from_bytes(raw[-4:], "little")
        return raw[: len(raw) - 4 - 4 * count], np.frombuffer(raw, "<u4", count, len(raw) - 4 - 4 * count), start

    def _entries(self, data: bytes, at: int, key: bytes = b"") -> Iterator[tuple[bytes, np.ndarray]]:
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, np.frombuffer(data, f"<u{self.width}", n // self.width, at)
            at += n

    def scan(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """Key, number of ids before it in the shard, and ids of each document."""
        for k in range(len(self.index)):
            data, _, start = self.block(k)
            for key, ids in self._entries(data, 0):
                yield key, start, ids
                start += len(ids)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of a document, the first of those that share the id."""
        key = key_of(doc_id)
        bits = 8 * len(self.filter)
        if not all(self.filter[p >> 3] >> (p & 7) & 1 for p in _probes(key[:9], bits)):
            return None
        k = bisect_left(self.lasts, key)
        if k == len(self.index):
            return None
        data, restarts, _ = self.block(k)
        first = bisect_left(restarts, True, key=lambda at: next(self._entries(data, int(at)))[0] > key) - 1
        for found, ids in self._entries(data, int(restarts[max(0, first)])):
            if found >= key:
                return ids if found[:9] == key[:9] else None
        return None


def shard_count(docs: DataFrame, text: str) -> int:
    """By the input's bytes, as estimated or counted: a shard for each SHARD of them, and for small inputs as many as there are shuffle partitions, of SMALL each at least."""
    size = text_bytes(docs, text)
    return max(1, -(-size // SHARD), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SMALL)))


def write_shards(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end_id: int | None = END_ID) -> list[dict]:
    """Encodes the texts and writes the shards; one record for each shard (as many as tasks), in order, with start, the ids before it."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("said"), F.col(text).alias("text"))
    order = ["doc_id", "said", "text"]
    rows = rows.repartitionByRange(shard_count(docs, text), "doc_id", "said").sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocab.once("encoder", vocabulary, lambda _: bpe.encoder(vocabulary))
        width = 2 if max(vocab.tokenizer(vocabulary).get_vocab_size() - 1, end_id or 0) < 1 << 16 else 4
        tail = b"" if end_id is None else bpe._packed([end_id])
        where, root = fs.FileSystem.from_uri(folder)
        writer = None
        last, copy, first = None, 0, None
        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    where.create_dir(root)
                    path, held = f"{root}/{uuid.uuid4().hex}.sst", f"{root}/_{uuid.uuid4().hex}"
                    out = where.open_output_stream(held)
                    writer, first = Writer(out, width), i
                copy = copy + 1 if writer.hashed and i == last else 0
                last = i
                writer.add(key_of(i, copy), np.frombuffer(encode(value.as_py() or "") + tail, "<u4"))
        if writer is not None:
            n = writer.finish()
            out.close()
            where.move(held, path)
            cols = [path.rpartition("/")[2], TaskContext.get().partitionId(), first, last, len(writer.hashed), writer.n_ids, n]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.string() if k == 0 else pa.int64()) for k, c in enumerate(cols)], [f.split()[0] for f in FIELDS.split(", ")])

    shards = [r.asDict() for r in scan.map_batches(rows, run, FIELDS).collect()]
    shards.sort(key=lambda s: s["part"])
    start = 0
    for s in shards:
        s["start"] = start
        start += s["n_ids"]
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root)
    with where.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"vocabulary": vocabulary, "end_id": end_id, "shards": shards}).encode())
    return shards


def manifest(folder: str) -> list[dict]:
    where, root = fs.FileSystem.from_uri(folder)
    with where.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())["shards"]


def read_shards(spark: SparkSession, folder: str, f=None, schema: str = "ids array<int>") -> DataFrame:
    """doc_id, start, and f(ids) as a tuple of values of schema, for each document of the shards, one task for a shard or several."""
    shards = manifest(folder)
    f = f or (lambda ids: (ids.astype("<i4").tolist(),))
    kinds = to_arrow_schema(T._parse_datatype_string(f"doc_id long, start long, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    with where.open_input_file(f"{root}/{path}") as source:
                        for key, start, ids in Reader(source).scan():
                            yield (id_of(key), base + start, *f(ids))

        part: list[tuple] = []
        for row in rows():
            part.append(row)
            if len(part) == 1000:
                yield batch_of(part)
                part = []
        if part:
            yield batch_of(part)

    def batch_of(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), kinds, strict=True)], kinds.names)

    listed = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start long").repartition(max(1, len(shards)))
    return scan.map_batches(listed, run, f"doc_id long, start long, {schema}")


def lookup(folder: str, doc_id: int | None) -> np.ndarray | None:
    """Ids of one document, by binary search over the shards' ranges and then within a shard."""
    where, root = fs.FileSystem.from_uri(folder)
    order = lambda x: (x is not None, x or 0)
    shards = manifest(folder)
    k = bisect_left(shards, order(doc_id), key=lambda s: order(s["last_id"]))
    if k == len(shards) or order(shards[k]["first_id"]) > order(doc_id):
        return None
    with where.open_input_file(f"{root}/{shards[k]['path']}") as source:
        return Reader(source).get(doc_id)


def checksum(ids: np.ndarray) -> tuple[int, int]:
    """Number of ids, and the CRC-32 of them as little-endian 32-bit numbers."""
    return len(ids), zlib.crc32(ids.astype("<u4").tobytes())
