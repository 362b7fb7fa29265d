"""BPE encoding and decoding with a distinct-word table.

Texts are cut into words in Spark. A task numbers the distinct words of a stretch of its texts, writes the texts as numbers to the shared folder, and
hands on the stretch's words, each once, packed by their hash. All words of one hash class meet in one task, where every distinct word of all documents
is encoded once, and its ids go back to all stretches that have it, joined by the word's number there. A stretch's ids are then those at its
numbers, by position. Decoding joins each id with its piece and puts the pieces' bytes together.

A word of all texts comes once for each stretch, not for each place, so frequent words are no hot keys; a task holds the words of one stretch, or the
distinct words of one class, of which there are more the larger the input is. The stretches' words are a written table, so that a task that runs
again finds the same stretches.

Defined results: null and empty texts have no ids and decode to ''; special strings inside texts become special tokens, as the library does by
default, and are words of their own; a text of any length and script is one row, all of whose words are in the table; repeated rows give repeated
results; further columns are ignored, and those to keep must not be named as the result's.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm import scan, units, vocab
from tessera.runtime import Kept, spread, text_bytes

VOCABULARY = "byte_bpe_50k.json"
#: Characters of a stretch, one text at least, and of what is handled at once within it.
STRETCH, STEP = 32 << 20, 1 << 20
#: Least and largest number of classes of words, and bytes of input for each.
CLASSES, CLASS_BYTES = (8, 8192), 8 << 20
#: Of a stretch's words of one class: their bytes, sizes in bytes, and how far each number is from the last one's; or the name of the stretch's file, of class -1.
WORDS = "class int, stretch long, name string, words binary, sizes binary, numbers binary"
#: Of the same words: the steps between numbers, how many ids each has, and the ids; or the name.
ENCODED = "stretch long, name string, numbers binary, sizes binary, ids binary"


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Numbers(dict):
    """Numbers for the distinct words of a stretch, in the order in which they are met."""

    def __init__(self, own: units.Tokenizer):
        super().__init__()
        self.own = own
        self.other = units.Memo(lambda unit: [self[k] for k in own.keys(unit)], 16 << 20)

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        return out

    def of(self, text: str) -> list[int]:
        parts, plain = self.own.units(text)
        return [*map(self.__getitem__, parts)] if plain else [n for p in parts for n in self.other[p]]


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, their bytes of equal place together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unplaned(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()


def split_words(docs: DataFrame, folder: str, vocabulary: str, classes: int, stretch: int = STRETCH) -> DataFrame:
    """docs: columns to keep, and the text last. WORDS of each stretch. Its file in folder has batches of the kept
    columns, the number of words of each row, and, in the first row, all words' numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, where = units.tokenizer(vocabulary), fs.FileSystem.from_uri(folder)
        part, k = TaskContext.get().partitionId(), 0
        steps = (s for batch in batches for s in _steps(batch, min(STEP, stretch)))
        step = next(steps, None)
        while step is not None:
            numbers, size, name = Numbers(own), 0, uuid.uuid4().hex
            where[0].create_dir(where[1])
            kinds = pa.schema([*list(step[0].schema)[:-1], pa.field("__n", pa.int32()), pa.field("__numbers", pa.binary())])
            with where[0].open_output_stream(f"{where[1]}/{name}") as out, pa.ipc.new_stream(out, kinds) as writer:
                while step is not None and (size == 0 or size + step[1] <= stretch):
                    rows, size = step[0], size + step[1]
                    found = [numbers.of(x.as_py() or "") for x in rows.column(rows.num_columns - 1)]
                    blob = _planes(np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in found)]))
                    cols = [*rows.columns[:-1], pa.array([len(x) for x in found], pa.int32()), pa.array([blob] + [None] * (len(found) - 1), pa.binary())]
                    writer.write_batch(pa.RecordBatch.from_arrays(cols, schema=kinds))
                    step = next(steps, None)
            yield _by_class(pa.array([*numbers], pa.large_string()), (k << 32) + part, name, classes)
            k += 1

    return scan.map_batches(docs, run, WORDS)


def _steps(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Slices of up to so many bytes of text, one row at least, and their bytes."""
    offs = scan.buffers(batch.column(batch.num_columns - 1))[1]
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), int(offs[j] - offs[i]) + 1
        i = j


def _by_class(words: pa.Array, stretch: int, name: str, classes: int) -> pa.RecordBatch:
    data, offs = scan.buffers(words)
    of = (scan.hashes(data, offs[:-1], offs[1:]) % np.uint64(classes)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(classes + 1))
    pack, rows = zstandard.ZstdCompressor(level=1).compress, [(-1, stretch, name, None, None, None)]
    for c in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[c] : cuts[c + 1]]
        own, sizes = _taken(data, offs, at)
        rows.append((c, stretch, None, pack(own.tobytes()), _planes(sizes), _planes(np.diff(at, prepend=0))))
    return _rows(rows, WORDS)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    of = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def encode_words(words: DataFrame, vocabulary: str, classes: int, encode: Callable[[str], list[int]] | None = None) -> DataFrame:
    """ENCODED of WORDS. A class is one task's, which encodes each word when it first comes. encode: in place of the vocabulary's own model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, unpack = encode or units.tokenizer(vocabulary).key_ids, zstandard.ZstdDecompressor().decompress

        class Table(dict):
            def __missing__(self, word: bytes) -> bytes:
                out = self[word] = _packed(ids_of(word.decode()))
                return out

        of_class: dict[int, Table] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["class"] not in of_class:
                    of_class = {row["class"]: Table()}
                raw, cuts = unpack(row["words"]), _cuts(_unplaned(row["sizes"])).tolist()
                found = [of_class[row["class"]][raw[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                ids = np.frombuffer(b"".join(found), "<u4")
                yield _rows([(row["stretch"], None, row["numbers"], _planes(np.array([len(x) // 4 for x in found])), _planes(ids))], ENCODED)

    dealt = words.where("class >= 0").repartitionById(classes, "class").sortWithinPartitions("class")
    names = words.where("class < 0").select("stretch", "name", *[F.lit(None).cast("binary").alias(c) for c in ("numbers", "sizes", "ids")])
    return scan.map_batches(dealt, run, ENCODED).unionByName(names)


def class_count(docs: DataFrame, text: str) -> int:
    """By the input's bytes, as estimated or counted."""
    size = text_bytes(docs, text)
    return min(max(-(-size // CLASS_BYTES), CLASSES[0]), CLASSES[1])


def _cuts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _taken(data: np.ndarray, cuts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of data between cuts at the given places, one after the other, and their sizes."""
    size = cuts[at + 1] - cuts[at]
    first = np.cumsum(size) - size
    return data[np.repeat(cuts[at] - first, size) + np.arange(size.sum())], size


class Pieces:
    """The bytes of each id: those that its letters stand for, or the characters' own where a letter stands for none."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        of_letter = {c: bytes([b]) for b, c in enumerate(units.byte_letters())}
        ids = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
        out = [b""] * (max(ids.values()) + 1)
        for word, i in ids.items():
            out[i] = b"".join(of_letter[c] for c in word) if all(c in of_letter for c in word) else word.encode()
        self.table = pa.array(out, pa.large_binary())

    def texts(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The texts of runs of ids: each id is joined with its piece, and a run's pieces are put together."""
        if not len(ids):
            return [""] * (len(cuts) - 1)
        joined = pc.take(self.table, pa.array(ids))
        _, offsets, data = joined.buffers()
        at = np.frombuffer(offsets, np.int64)[joined.offset + cuts]
        raw = memoryview(data) if data is not None else b""
        return [str(raw[a:b], "utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def pieces(vocabulary: str) -> Pieces:
    return vocab.once("pieces", vocabulary, Pieces)


Made = Callable[[np.ndarray, np.ndarray, Pieces], list[pa.Array]]


def map_ids(docs: DataFrame, f: Made, schema: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", vocabulary: str = VOCABULARY, stretch: int = STRETCH) -> DataFrame:
    """The columns of keep, and f(ids, cuts, pieces) as a list of columns of schema: ids of some texts one after the other, and where each text's begin and the last's end."""
    if clash := [c for c in keep if c in T._parse_datatype_string(schema).names]:
        raise ValueError(f"columns {clash} would be hidden by the result's own")
    rows = spread(docs.select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(keep)], docs[text].alias("__text")))
    kept = Kept(docs.sparkSession, "bpe")
    folder = f"{kept.root}/texts"
    classes = class_count(docs, text)
    words = kept.put("words", split_words(rows, folder, vocabulary, classes, stretch))
    encoded = encode_words(words, vocabulary, classes)
    n = max(1, words.where("class < 0").count())
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, *T._parse_datatype_string(schema).names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, known = fs.FileSystem.from_uri(folder), pieces(vocabulary)

        def finish(parts: list[dict]) -> Iterator[pa.RecordBatch]:
            """parts: ENCODED of one stretch."""
            name, parts = next(p["name"] for p in parts if p["name"]), [p for p in parts if not p["name"]]
            number = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_unplaned(p["numbers"])) for p in parts)])
            size, ids = (np.concatenate([np.zeros(0, np.int64), *(_unplaned(p[c]) for p in parts)]) for c in ("sizes", "ids"))
            table, size = _taken(ids, _cuts(size), np.argsort(number))
            cuts = _cuts(size)
            with where[0].open_input_stream(f"{where[1]}/{name}") as source, pa.ipc.open_stream(source) as texts:
                for batch in texts:
                    words_of = _cuts(batch.column(len(keep)).to_numpy())
                    got, size = _taken(table, cuts, _unplaned(batch.column(len(keep) + 1)[0].as_py()))
                    cols = f(got, _cuts(size)[words_of], known)
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=names)

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["stretch"] != row["stretch"]:
                    yield from finish(held)
                    held = []
                held.append(row)
        if held:
            yield from finish(held)

    # a task for each stretch: stretches are numbered by task and within it
    to = F.pmod(F.shiftright("stretch", 32) * 7919 + F.col("stretch").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(n)).cast("int")
    return scan.map_batches(encoded.repartitionById(n, to).sortWithinPartitions("stretch"), run, f"{own}, {schema}" if keep else schema)


def digests(ids: np.ndarray, cuts: np.ndarray, known: Pieces) -> list[pa.Array]:
    """Number of ids, and digests of the ids and of the text decoded from them."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B") if len(ids) else b""
    return [
        pa.array(np.diff(cuts), pa.int64()),
        pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in known.texts(ids, cuts)], pa.string()),
    ]


def lists(ids: np.ndarray, cuts: np.ndarray, known: Pieces) -> list[pa.Array]:
    """The ids themselves."""
    return [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))]


def digests_and_lists(ids: np.ndarray, cuts: np.ndarray, known: Pieces) -> list[pa.Array]:
    return digests(ids, cuts, known) + lists(ids, cuts, known)


def encode_texts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of keep, and ids array<int>."""
    return map_ids(docs, lists, "ids array<int>", keep, text, vocabulary)


def decode_ids(df: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY, out: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids; null for null."""
    if out in df.columns:
        raise ValueError(f"column {out} would be hidden by the decoded text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(vocabulary)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            texts = known.texts(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), _cuts(sizes))
            texts = pa.array([t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return scan.map_batches(df, run, f"{kind}, `{out}` string")


def encoder(vocabulary: str) -> Callable[[str], bytes]:
    """A function from one text to its ids as little-endian 32-bit numbers, for operators that encode as they go."""
    own = units.tokenizer(vocabulary)
    words = units.Memo(lambda w: _packed(own.word_ids(w)))
    others = units.Memo(lambda u: _packed(own.unit_ids(u)))

    def encode(text: str) -> bytes:
        parts, plain = own.units(text)
        return b"".join(map((words if plain else others).__getitem__, parts))

    return encode
