"""Token counts by byte-pair merging with a heap and a linked list.

A pre-token begins as one symbol for each byte, linked in a list; the adjacent pair of lowest rank is popped from a heap and merged, leftmost
first, until no pair has a rank. The count is the number of initial symbols less the merges; no identifiers are made. Pre-tokens repeat, so
counts are kept by pre-token in a table bounded in bytes.

Defined results: null and empty texts have no bytes and no tokens; special strings inside texts count one each, as the library has it by
default; a text of any length is one row; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa

from pyspark.sql import DataFrame

from tessera.llm import scan, units, vocab
from tessera.runtime import spread

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512


def _ranks(path: str) -> dict[tuple[str, str], int]:
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    return {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(merges)}


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when all merges are done. An entry of the heap holds rank and place; one whose pair has changed since is passed over."""
    n = len(symbols)
    rank_of, shift = ranks.get, n.bit_length()
    heap = [(r << shift) | i for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(pair)) is not None]
    if not heap:
        return n
    heapify(heap)
    symbols = [*symbols, None]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    before.append(n - 1)
    merges, mask = 0, (1 << shift) - 1
    while heap:
        top = heappop(heap)
        i = top & mask
        j = after[i]
        if j >= n or symbols[i] is None or rank_of((symbols[i], symbols[j])) != top >> shift:
            continue
        symbols[i] += symbols[j]
        symbols[j] = None
        k = after[i] = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (r := rank_of((symbols[i], symbols[k]))) is not None:
                heappush(heap, (r << shift) | i)
        h = before[i]
        if h >= 0 and (r := rank_of((symbols[h], symbols[i]))) is not None:
            heappush(heap, (r << shift) | h)
    return n - merges


def counter(vocabulary: str):
    """A function from texts to their number of tokens."""
    own, ranks = units.tokenizer(vocabulary), vocab.once("ranks", vocabulary, _ranks)

    def of_unit(unit: str) -> int:
        words, special = own.pre_tokens(unit)
        return special + sum(merged_length(list(w), ranks) for w in words)

    words = units.Memo(lambda w: merged_length(list(units.lettered(w)), ranks))
    others = units.Memo(of_unit)

    def count(text: str) -> int:
        parts, plain = own.units(text)
        memo = words if plain else others
        return sum(map(memo.__getitem__, parts))

    return count


def count_tokens(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """The columns of keep, and n_bytes, n_tokens and over_limit."""
    if clash := [c for c in keep if c in ("n_bytes", "n_tokens", "over_limit")]:
        raise ValueError(f"columns {clash} would be hidden by the counts")
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = vocab.once("counter", vocabulary, lambda _: counter(vocabulary))
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(len(keep))]
            n = [count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"],
            )

    return scan.map_batches(spread(docs.select(*keep, docs[text].alias("__text"))), run, f"{kept}, n_bytes long, n_tokens long, over_limit boolean")
