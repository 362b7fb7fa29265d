"""Quality rules with suffix-array repetition.

Every whole text is read as its words, runs of characters other than blanks (space and \\x09 to \\x0D). Base figures are exact counts.
The verdict adds a suffix array over the text's words: longest-common-prefix intervals give the maximal repeated word sequences, whose
spans are united; a text fails if the united spans cover more than `max_covered` of its words, or the longest repeat has more than
`max_repeat` words. A sequence counts as repeated from `min_repeat` words on, so texts in which no window of that size occurs twice have
no such interval and need no array. Every word so covered is a repeated word of the base rule too, so a share of MAX_REPEATED or more could never reject what that rule keeps.

Defined results: null and empty texts have no words, so they fail the base rule on size; a text of any length is one row in one task;
repeated rows give repeated results; further columns are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame

from tessera.llm import scan
from tessera.runtime import spread

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEATED = 10, 5, 20
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 8, 0.1, 60

FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, longest_repeat long, covered double, kept boolean"


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a sequence of non-negative numbers by prefix doubling, and the longest common prefix of each suffix with the one before it in order."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels = [rank]
    k = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - k] = rank[k:]
        pair = rank * (n + 1) + after + 1
        order = np.argsort(pair, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
        rank = new
        k *= 2
        if rank[order[-1]] == n - 1 or k >= n:
            break
        levels.append(rank)
    # the ranks after 1, 2, 4, ... words say at once whether so many words agree: from the largest down, that gives each prefix length
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        size = 1 << level
        ok = (a + size <= n) & (b + size <= n)
        ok[ok] = levels[level][a[ok]] == levels[level][b[ok]]
        lcp[1:][ok] += size
        a[ok] += size
        b[ok] += size
    return order, lcp


def repeats(ids: np.ndarray, least: int) -> tuple[np.ndarray, int]:
    """Which words stand in a repeated sequence of `least` words or more, and the length of the longest repeated sequence.

    A suffix that shares a prefix with a neighbour in suffix order starts a repeat of the larger of the two lengths: the value of the
    innermost interval that holds it. All spans of the intervals that hold it further out are within that one."""
    order, lcp = suffix_array(ids)
    most = lcp.copy()
    most[:-1] = np.maximum(most[:-1], lcp[1:])
    marks = np.zeros(len(ids) + 1, np.int64)
    at, size = order[most >= least], most[most >= least]
    np.add.at(marks, at, 1)
    np.add.at(marks, at + size, -1)
    return np.cumsum(marks[:-1]) > 0, int(lcp.max(initial=0))


def _twice(key: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _windows(hashed: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of so many words that lie within one row, and whether each occurs twice in its row."""
    if len(hashed) < size:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
    key = scan.mix(scan.grams(hashed, size)[at] + row[at].astype(np.uint64) * scan._ODD)
    return at, _twice(key)


def figures(column: pa.Array, min_repeat: int, max_covered: float, max_repeat: int) -> list[pa.Array]:
    """The columns of FIGURES for a column of texts."""
    data_all, offs_all = scan.buffers(column)
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("n", "chars", "symbols", "lines", "repeated", "longest", "covered")}
    is_symbol = np.zeros(256, np.int64)
    is_symbol[list(SYMBOLS)] = 1
    for i, j in scan.steps(offs_all):
        offs = offs_all[i : j + 1] - offs_all[i]
        data = data_all[offs_all[i] : offs_all[j]]
        starts, ends, count = scan.words(data, offs)
        hashed, row = scan.hashes(data, starts, ends), np.repeat(np.arange(j - i), count)

        def per_row(flag: np.ndarray, offs: np.ndarray = offs) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
            return total[offs[1:]] - total[offs[:-1]]

        out["n"].append(count)
        out["chars"].append(per_row(~scan.BLANKS[data] & ((data & 0xC0) != 0x80)))
        out["symbols"].append(per_row(is_symbol[data]))
        at, twice = _windows(hashed, row, WINDOW)
        marks = np.zeros(len(row) + 1, np.int64)
        np.add.at(marks, at[twice], 1)
        np.add.at(marks, at[twice] + WINDOW, -1)
        out["repeated"].append(np.bincount(row, np.cumsum(marks[:-1]) > 0, j - i).astype(np.int64))
        longest, covered = np.zeros(j - i, np.int64), np.zeros(j - i)
        at, twice = _windows(hashed, row, min_repeat)
        first = np.concatenate([[0], np.cumsum(count)])
        for r in np.unique(row[at[twice]]):
            inside, longest[r] = repeats(hashed[first[r] : first[r + 1]], min_repeat)
            covered[r] = inside.mean()
        out["longest"].append(longest)
        out["covered"].append(covered)
        raw = data.tobytes()
        dup = np.zeros(j - i, np.int64)
        for r in range(j - i):
            lines = [x for x in raw[offs[r] : offs[r + 1]].split(b"\n") if x.split()]
            dup[r] = len(lines) - len(set(lines))
        out["lines"].append(dup)
    n, chars, symbols, lines, repeated, longest, covered = (np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64) for k in out)
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)
    kept = ~failed & (covered <= max_covered) & (longest <= max_repeat)
    return [*(pa.array(x, pa.int64()) for x in (n, chars, symbols, lines, repeated)), pa.array(failed), pa.array(longest, pa.int64()), pa.array(covered, pa.float64()), pa.array(kept)]


def quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The columns of keep, and FIGURES, for each row."""
    names = [f.split()[0] for f in FIGURES.split(", ")]
    if clash := [c for c in keep if c in names]:
        raise ValueError(f"columns {clash} would be hidden by the figures")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays(own + figures(batch.column(len(keep)), min_repeat, max_covered, max_repeat), [*keep, *names])

    return scan.map_batches(spread(docs.select(*keep, docs[text].alias("__text"))), run, f"{schema}, {FIGURES}")


def keep_good(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(figures(batch.column(at), min_repeat, max_covered, max_repeat)[-1])

    return scan.map_batches(docs, run, docs.schema)
