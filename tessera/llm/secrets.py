"""Secret scans with a token-efficiency test.

Base spans come from three patterns. The method adds spans of kind `random`: unbroken runs of 16 or more characters of base64 or
identifier alphabets whose characters for each token of a tiktoken vocabulary are `max_ratio` at most. A vocabulary learnt from
language packs words into few tokens and random strings into many. Runs that are digests of the usual lengths, UUIDs, plain numbers, or
identifiers made of words are excluded before; a run of letters that could be one word must have `word_ratio` characters a token or fewer, as rare words
have few too. Where a run doesn't stand out as a whole, its parts between `/`, `_` and `-` are tested alike, so that a key within a path is found. Spans are kind:start:end in code points, end exclusive.

Defined results: null and empty texts have no spans; the whole of a text of any length is scanned; repeated rows give repeated results;
spans at the same start stand in the order of KINDS; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame

from tessera.llm import scan, vocab
from tessera.runtime import spread

VOCABULARY = "byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
MAX_RATIO = 2.0
#: For letters that look like words: of 1,111 such runs of 16 letters or more in a corpus of invented words one has a ratio of 1.7 or less and 1 in 100 of 2.0; of random letters three in four have 1.8 or less.
WORD_RATIO = 1.8
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST_RUN = 12, 18, 16, 16

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Digests of 128, 160, 224, 256, 384 and 512 bits.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I)
#: Words in one case, or capitalised, joined by nothing, `_`, `-` or `/`, with a number after each at most; or no letters.
IDENTIFIER = re.compile(r"[_/-]*(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[A-Z]|[a-z])(?:[_/-]+[0-9]{1,4}|[0-9]{1,4}(?![A-Za-z]))?(?:[_/-]+|(?=[A-Z][a-z]{2,})|\Z))+\Z|[0-9+/_=-]+\Z")

_RUN_BYTE = np.ones(256, bool)
_RUN_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = False
_VALUE_BYTE = _RUN_BYTE.copy()
_VALUE_BYTE[list(b".=")] = False


PART = re.compile(r"[^/_-]+")
WORD = re.compile(r"[A-Z]?[a-z]+\Z|[A-Z]+\Z|(?:[A-Z][a-z]+){2,}\Z|[a-z]+(?:[A-Z][a-z]+)+\Z")


def is_random(run: str, encoding, max_ratio: float) -> bool:
    bare = run.rstrip("=")
    if DIGEST.match(bare) or UUID.match(bare):
        return False
    if WORD.match(bare):
        max_ratio = min(max_ratio, WORD_RATIO)
    elif IDENTIFIER.match(bare):
        return False
    return len(bare) <= max_ratio * len(encoding.encode_ordinary(bare))


def random_spans(run: str, encoding, max_ratio: float) -> list[tuple[int, int]]:
    """Where a run stands out: as a whole, if no part of it is a digest, or in those of its parts that do."""
    parts = [m for m in PART.finditer(run) if len(m.group().rstrip("=")) >= LEAST_RUN]
    if not any(DIGEST.match(m.group().rstrip("=")) for m in parts):
        if is_random(run, encoding, max_ratio):
            return [(0, len(run))]
        if UUID.match(run):
            return []
    return [m.span() for m in parts if m.group() != run and is_random(m.group(), encoding, max_ratio)]


def spans(text: str, encoding, max_ratio: float = MAX_RATIO, values: bool = True, runs: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans in order. values, runs: whether the text can hold assigned values, or long runs."""
    out: list[tuple[int, int, int]] = []
    low = text.lower() if values else ""
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if runs:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
        out += [(m.start() + a, 3, m.start() + b) for m in RUN.finditer(text) for a, b in random_spans(m.group(), encoding, max_ratio)]
    return sorted(out)


def _rows_with(data: np.ndarray, offs: np.ndarray, outside: np.ndarray, least: int) -> np.ndarray:
    """Which rows have a run of so many bytes of the class."""
    starts, ends, count = scan.words(data, offs, outside)
    return np.bincount(np.repeat(np.arange(len(count)), count)[ends - starts >= least], minlength=len(count)) > 0


def scan_batch(column: pa.Array, vocabulary: str, max_ratio: float) -> list[list[tuple[int, int, int]]]:
    """Spans of each text. Texts without a long run of the right bytes can't match and are passed over."""
    data, offs = scan.buffers(column)
    encoding, out = vocab.tiktoken_encoding(vocabulary), []
    for i, j in scan.steps(offs):
        part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        values, runs = _rows_with(part, at, _VALUE_BYTE, LEAST_ASSIGN), _rows_with(part, at, _RUN_BYTE, LEAST_RUN)
        raw = part.tobytes()
        for r in range(j - i):
            out.append(spans(raw[at[r] : at[r + 1]].decode(), encoding, max_ratio, bool(values[r]), bool(runs[r])) if values[r] or runs[r] else [])
    return out


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


COUNTS = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """The columns of keep, and COUNTS, for each row. base_sha256: hex digest of the base spans as written in spans."""
    names = [f.split()[0] for f in COUNTS.split(", ")]
    if clash := [c for c in keep if c in names]:
        raise ValueError(f"columns {clash} would be hidden by the counts")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan_batch(batch.column(len(keep)), vocabulary, max_ratio)
            counts = [pa.array([sum(x[1] == k for x in row) for row in found], pa.int64()) for k in range(4)]
            digest = pa.array([hashlib.sha256(written([x for x in row if x[1] < 3]).encode()).hexdigest() for row in found], pa.string())
            own = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, *counts, digest, pa.array(map(written, found), pa.string())], [*keep, *names])

    return scan.map_batches(spread(docs.select(*keep, docs[text].alias("__text"))), run, f"{schema}, {COUNTS}")


def mask_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]", vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """The same rows and columns, with each span in the text replaced by a mark; spans that overlap are replaced as one. Null stays null."""
    k = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column(k), []
            for value, found in zip(column, scan_batch(column, vocabulary, max_ratio), strict=True):
                if found:
                    value, parts, at = value.as_py(), [], 0
                    for s, _, e in found:
                        if s >= at:
                            parts += [value[at:s], mark]
                        at = max(at, e)
                    value = "".join([*parts, value[at:]])
                else:
                    value = value.as_py()
                out.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out, column.type) if i == k else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    return scan.map_batches(docs, run, docs.schema)
