"""LM scoring by masked pseudo-likelihood.

A window network predicts every word from the two words on either side: the sum of their embeddings, weighted for each place, a tanh layer, and a
binary decision at each node of a Huffman tree, all of them conditioned on that layer. The tree's leaves are the words of a vocabulary counted from all
documents, which grows with the root of their number of words, and buckets of the words outside it, which grow alike. Only inside a bucket
are words equally likely, whatever their context. Node biases start at the counts' odds, so training begins at the words' shares. A
document's score is the sum of the logarithms of the chances of all its words, and the chances of all counted words sum to 1 in any context.

Counts, training and scores are over all words of all texts; none are left out. A text's words, as numbers of leaves, are dealt to slices by the text's
hash and stand there in the order of hash and place, equal texts as one of so much weight: how the input is split changes nothing. A first round trains
on one slice; from there, each slice trains a copy of its own, in minibatches, and what the copies changed is averaged row by row, by how often each used
the row. Slices grow with the root of the number of words, as the vocabulary does, so that what they send is in proportion to the input. It is added up
in blocks of rows by as many tasks. Sums are of whole numbers, so they don't depend on the order of tasks.

Defined results: null and empty texts have no words, a log_likelihood of 0 and a null mean; a text of any length is scored as a whole; repeated rows
give repeated results; words are compared by 64-bit hashes; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame, functions as F

from tessera.llm import scan
from tessera.runtime import Kept, spread

#: Words of the vocabulary for each root of the number of words, and words of the vocabulary for each bucket of others.
GROWTH, PER_BUCKET = 6, 2
PLACES = (-2, -1, 1, 2)
WIDTH, BATCH, RATE, SEED = 16, 4096, 0.1, 11
#: Bytes of text whose distinct words are counted at once; fewer would make more rows of counts.
COUNTED = 2 << 20
#: Words of a part of a slice, and those whose contexts a training task has at once.
PART_WORDS = 1 << 19
#: Words that are scored at once.
SCORED = 1 << 14
#: Words of a slice: so many at least, and so many for each root of the number of all words.
SLICE_WORDS, SLICE_GROWTH = 5_000_000, 200
#: Rows of one key that are added up at once.
RUN = 16
#: Words that are put in random order together.
SHUFFLED = 1 << 18
#: Rounds over all slices, after the one on the first slice.
ROUNDS = 1
#: Changes are added up as whole numbers of this part, weighted by uses; rows of a block of parameters.
PART, BLOCK = 1 << 14, 1 << 12
#: The tree's heaviest nodes, nearly all on most paths, are worked out for all words of a minibatch at once, the others only on the paths that hold them.
TOP = 96


@dataclass
class Vocabulary:
    """words: sorted hashes. counts: of each word, and then of each bucket. distinct: words in each bucket."""

    words: np.ndarray
    counts: np.ndarray
    distinct: np.ndarray

    def __post_init__(self) -> None:
        self.first, self.steps, self.bias = tree(self.counts)
        self.share = np.concatenate([np.zeros(len(self.words)), -np.log(np.maximum(self.distinct, 1))])
        # a path's first steps, `deep` of them, are below the heaviest nodes; entry: which of the ways through these, on and turns by node, the others are
        self.low = max(0, len(self.counts) - 1 - TOP)
        self.deep = np.add.reduceat((self.steps >> 1 < self.low).astype(np.int64), self.first[:-1])
        _, one, self.entry = np.unique(self.steps[self.first[:-1] + self.deep], return_index=True, return_inverse=True)
        self.on, self.turns = np.zeros((2, len(one), len(self.counts) - 1 - self.low), np.float32)
        for k, leaf in enumerate(one.tolist()):
            way = self.steps[self.first[leaf] + self.deep[leaf] : self.first[leaf + 1]]
            self.on[k, (way >> 1) - self.low], self.turns[k, (way >> 1) - self.low] = 1, way & 1

    def sum(self) -> int:
        return int(self.counts.sum())

    def leaves(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each word, and the logarithm of its share of the leaf."""
        n = len(self.words)
        at = np.searchsorted(self.words, hashed)
        other = self.words[np.minimum(at, n - 1)] != hashed if n else np.ones(len(hashed), bool)
        at[other] = n + (hashed[other] % np.uint64(len(self.distinct))).astype(np.int64)
        return at, self.share[at]


def tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman tree over two leaves or more: where each leaf's path begins, 2 * node + turn of all steps, and the logarithm of each node's odds of turn 1."""
    n = len(counts)
    weight = np.maximum(counts, 0.5).astype(np.float64)
    order = np.argsort(weight, kind="stable")
    have, made, parent, turn = weight[order].tolist(), [], np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64)
    leaf = node = 0
    bias = np.zeros(n - 1)
    for k in range(n - 1):
        two = []
        for side in (0, 1):
            if leaf < n and (node >= len(made) or have[leaf] <= made[node]):
                child, w, leaf = leaf, have[leaf], leaf + 1
            else:
                child, w, node = n + node, made[node], node + 1
            parent[child], turn[child] = k, side
            two.append(w)
        made.append(two[0] + two[1])
        bias[k] = np.log(two[1] / two[0])
    rows, nodes, turns = [], [], []
    at, row = np.arange(n), order
    while len(at):
        rows.append(row)
        nodes.append(parent[at])
        turns.append(turn[at])
        up = parent[at] < n - 2
        at, row = n + parent[at][up], row[up]
    row = np.concatenate(rows)
    by = np.argsort(row, kind="stable")
    return np.searchsorted(row[by], np.arange(n + 1)), (2 * np.concatenate(nodes) + np.concatenate(turns))[by].astype(np.int32), bias.astype(np.float32)


@dataclass
class Network:
    """Embeddings (no word, then leaves), the nodes' weights with their bias last, and, in one row each, the places' weights and the layer's bias."""

    embed: np.ndarray
    node: np.ndarray
    layer: np.ndarray

    @classmethod
    def new(cls, words: Vocabulary) -> Network:
        draw = np.random.Generator(np.random.PCG64(SEED))
        leaves = len(words.counts)
        node = np.zeros((leaves - 1, WIDTH + 1), np.float32)
        node[:, -1] = words.bias
        layer = np.ones((len(PLACES) + 1, WIDTH), np.float32)
        layer[-1] = 0
        return cls(draw.normal(0, 0.1, (leaves + 1, WIDTH)).astype(np.float32), node, layer)

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.node, self.layer]

    def copy(self) -> Network:
        return Network(*(x.copy() for x in self.parts))

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The hidden layer for each row of contexts, and the embeddings by place."""
        seen = [self.embed.take(context[:, k], axis=0) for k in range(len(PLACES))]
        h = seen[0] * self.layer[0]
        for k in range(1, len(PLACES)):
            h += seen[k] * self.layer[k]
        h += self.layer[-1]
        return np.tanh(h, out=h), seen

    def log_chances(self, context: np.ndarray, leaf: np.ndarray, words: Vocabulary, apart: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Logarithm of each leaf's chance in its context. Longest paths first, so that the words with a k-th step are the first ones for every k. apart: the nodes' weights, and
        their biases, as apart() has them, where many calls share them."""
        weights, bias = apart or self.apart()
        size = words.first[leaf + 1] - words.first[leaf]
        order = np.argsort(-size, kind="stable")
        h, first = self.hidden(context.take(order, axis=0))[0], words.first[leaf[order]]
        many = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")  # words whose path has more than k steps
        chance = np.ones(len(leaf))
        for k, n in enumerate(many.tolist()):
            step = words.steps.take(first[:n] + k)
            node = step >> 1
            odds = np.einsum("ij,ij->i", h[:n], weights.take(node, axis=0))
            odds += bias.take(node)
            odds *= 1 - 2 * (step & 1).astype(odds.dtype)
            np.exp(odds, out=odds)
            odds += 1
            chance[:n] /= odds
        out = np.empty(len(leaf))
        out[order] = np.log(np.maximum(chance, np.finfo(float).tiny))
        return out

    def apart(self) -> tuple[np.ndarray, np.ndarray]:
        return np.ascontiguousarray(self.node[:, :-1]), np.ascontiguousarray(self.node[:, -1])


def _by_key(key: np.ndarray, weight: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the weight of each, and the sums of their rows of values; keys of up to RUN rows come first."""
    bits = len(key).bit_length()
    held = np.sort((key.astype(np.int64) << bits) | np.arange(len(key)))
    at, key = held & ((1 << bits) - 1), held >> bits
    start = np.flatnonzero(np.diff(key, prepend=-1))
    size = np.diff(start, append=len(key))
    by = np.argsort(np.where(size > RUN, RUN, RUN - size).astype(np.uint8), kind="stable")
    light = len(by) - int(np.count_nonzero(size > RUN))
    sums = [_by_size(values, at, start[by[:light]], size[by[:light]])]
    if light < len(by):
        sums.append(_by_runs(values, at, start[by[light:]], size[by[light:]]))
    return key[start][by], np.add.reduceat(weight[at], start)[by], np.concatenate(sums)


def _by_size(values: np.ndarray, at: np.ndarray, begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each begin, the sum of the values at so many places of at from there on; the largest many come first."""
    total = values.take(at[begin], axis=0)
    for k, n in enumerate(np.searchsorted(-many, -np.arange(1, many.max(initial=0)), "left").tolist(), 1):
        total[:n] += values.take(at[begin[:n] + k], axis=0)
    return total


def _by_runs(values: np.ndarray, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """_by_size() for any sizes in any order: runs of up to RUN rows are summed, then runs of their sums."""
    while True:
        runs = -(-size // RUN)
        first = np.cumsum(runs) - runs
        place = (np.arange(runs.sum()) - np.repeat(first, runs)) * RUN
        begin, many = np.repeat(start, runs) + place, np.minimum(RUN, np.repeat(size, runs) - place)
        by = np.argsort((RUN - many).astype(np.uint8), kind="stable")
        total = _by_size(values, at, begin[by], many[by])
        values = np.empty_like(total)
        values[by] = total
        if len(values) == len(size):
            return values
        at, start, size = np.arange(len(values)), first, runs


EMBED, NODE, LAYER = range(3)


class Trainer:
    """Adagrad on minibatches; uses counts how often each row of the parameters was used."""

    def __init__(self, net: Network, words: Vocabulary):
        self.net, self.words = net, words
        self.seen = [np.full_like(x, 1e-6) for x in net.parts]
        self.uses = [np.zeros(len(x), np.int64) for x in net.parts]

    def gradients(self, context: np.ndarray, leaf: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Part, rows, weight of their uses and gradient of the weighted mean of -log chance."""
        net, words = self.net, self.words
        # longest ways below the heaviest nodes first, so that the words with a k-th step there are the first ones for every k
        order = np.argsort((255 - np.minimum(words.deep[leaf], 255)).astype(np.uint8) if words.deep.max() < 256 else -words.deep[leaf], kind="stable")
        context, leaf, weight = context.take(order, axis=0), leaf[order], weight[order]
        h, seen = net.hidden(context)
        kind, one = h.dtype, np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)
        share = (weight / weight.sum()).astype(np.float32)
        top, entry = net.node[words.low :], words.entry[leaf]
        d = one @ -top.T
        np.exp(d, out=d)
        d += 1
        np.divide(words.on.take(entry, axis=0), d, out=d)
        d -= words.turns.take(entry, axis=0)
        d *= share[:, None]
        dh = np.empty_like(one)  # its last column, the bias's, isn't used
        dh[:, :-1], dh[:, -1] = d @ top[:, :-1], 0
        uses = np.bincount(entry, weight, len(words.on)) @ words.on
        out = [(NODE, np.arange(words.low, len(net.node)), uses, d.T @ one)]
        deep, first = words.deep[leaf], words.first[leaf]
        many = np.searchsorted(-deep, -np.arange(deep.max(initial=0)), "left").tolist()
        nodes, weights, values, lo = [], [], np.empty((sum(many), one.shape[1]), kind), 0
        for k, n in enumerate(many):
            step = words.steps.take(first[:n] + k)
            node = step >> 1
            some = net.node.take(node, axis=0)
            own = ((1 / (1 + np.exp(-np.einsum("ij,ij->i", one[:n], some))) - (step & 1).astype(kind)) * share[:n])[:, None]
            some *= own
            dh[:n] += some
            nodes.append(node)
            weights.append(weight[:n])
            np.multiply(own, one[:n], out=values[lo : lo + n])
            lo += n
        if nodes:
            out.append((NODE, *_by_key(np.concatenate(nodes), np.concatenate(weights), values)))
        dh = dh[:, :-1] * (1 - h * h)
        out.append((LAYER, np.arange(len(net.layer)), np.full(len(net.layer), weight.sum()), np.stack([*(np.einsum("ij,ij->j", dh, x) for x in seen), dh.sum(0)])))
        values = (dh * net.layer[: len(PLACES), None]).reshape(-1, WIDTH)
        out.append((EMBED, *_by_key(context.T.ravel(), np.tile(weight, len(PLACES)), values)))
        return out

    def step(self, context: np.ndarray, leaf: np.ndarray, weight: np.ndarray) -> None:
        for part, at, uses, g in self.gradients(context, leaf, weight):
            seen, net = self.seen[part], self.net.parts[part]
            s = seen.take(at, axis=0)
            s += g * g
            seen[at] = s
            g *= RATE
            g /= np.sqrt(s, out=s)
            net[at] = np.subtract(net.take(at, axis=0, out=s, mode="clip"), g, out=g)  # rows of at are there; clip takes without a buffer
            self.uses[part][at] += np.ceil(uses).astype(np.int64)

    def learn(self, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """parts: leaves, contexts and weights of runs of words, gathered to SHUFFLED words whatever their lengths."""
        draw, held, n = np.random.Generator(np.random.PCG64(SEED)), [], 0
        for part in parts:
            held.append(part)
            n += len(part[0])
            while n >= SHUFFLED:
                leaf, context, weight = (np.concatenate(x) for x in zip(*held, strict=True))
                self._learn(draw, leaf[:SHUFFLED], context[:SHUFFLED], weight[:SHUFFLED])
                held, n = [(leaf[SHUFFLED:], context[SHUFFLED:], weight[SHUFFLED:])], n - SHUFFLED
        if n:
            self._learn(draw, *(np.concatenate(x) for x in zip(*held, strict=True)))

    def _learn(self, draw: np.random.Generator, leaf: np.ndarray, context: np.ndarray, weight: np.ndarray) -> None:
        order = draw.permutation(len(leaf))
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            self.step(context.take(at, axis=0), leaf[at], weight[at])


def contexts(count: np.ndarray, leaf: np.ndarray, most: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For runs of up to `most` words of texts of so many words: which they are, the text of each, and their contexts as rows of the embedding."""
    edge = max(map(abs, PLACES))
    row = np.pad(np.repeat(np.arange(len(count), dtype=np.int32), count), edge, constant_values=-1)
    for lo in range(0, len(leaf), most):
        hi = min(lo + most, len(leaf))
        near, own = np.zeros(hi - lo + 2 * edge, np.int64), row[lo + edge : hi + edge]
        a, b = max(lo - edge, 0), min(hi + edge, len(leaf))
        near[a - lo + edge : b - lo + edge] = leaf[a:b] + 1
        yield slice(lo, hi), own, np.stack([np.where(row[lo + edge + by : hi + edge + by] == own, near[edge + by : edge + by + hi - lo], 0) for by in PLACES], axis=1)


def _hashed(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data_all, offs_all = scan.buffers(column)
    for i, j in scan.steps(offs_all, COUNTED):
        data, offs = scan.LOWER[data_all[offs_all[i] : offs_all[j]]], offs_all[i : j + 1] - offs_all[i]
        starts, ends, count = scan.words(data, offs)
        yield count, scan.hashes(data, starts, ends)


def count_words(texts: DataFrame, growth: int = GROWTH) -> Vocabulary:
    """texts: one string column. The vocabulary has the most frequent words: all that occur so often that at most growth * sqrt(all words) occur as often or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.unique(x, return_counts=True) for _, x in _hashed(batch.column(0))]
            for word, n in parts:
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    kept = Kept(texts.sparkSession, "lm")
    counted = kept.put("counts", scan.map_batches(texts, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = counted.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()  # under 1,024 rows
    most, upto, least = int(growth * sum(r.n for r in sizes) ** 0.5), 0, 1 << 20
    for r in sizes:
        upto += r.words
        if upto > most:
            break
        least = r.level
    buckets = max(2, most // PER_BUCKET)
    head = counted.where(level >= least).toArrow()
    # hashes are unsigned, so their rest is that of the number's halves
    high, low = F.shiftrightunsigned("word", 32), F.col("word").bitwiseAND(F.lit(0xFFFFFFFF))
    bucket = ((high % buckets) * ((1 << 32) % buckets) + low % buckets) % buckets
    rest = counted.where(level < least).groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    kept.drop("counts")
    word, n = (head.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(word.view(np.uint64))
    counts, distinct = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    at = rest.column(0).to_numpy()
    counts[at], distinct[at] = rest.column(1).to_numpy(), rest.column(2).to_numpy()
    return Vocabulary(word.view(np.uint64)[order], np.concatenate([n[order], counts]), distinct)


def _blocks(net: Network) -> list[tuple[int, int, int]]:
    """Part, first row and row after the last of each block of parameters."""
    return [(p, lo, min(lo + BLOCK, len(x))) for p, x in enumerate(net.parts) for lo in range(0, len(x), BLOCK)]


def _packed(x: np.ndarray) -> bytes:
    """Numbers as bytes of equal place together, which are alike for small numbers, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.ravel().view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes())


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


CHANGES = "block int, changes binary, uses binary"
ENCODED = "h long, leaves binary"
#: Texts in the order of part and hash: the text's hash, copies, and its words' leaves.
DEALT = "slice int, part int, h long, copies int, leaves binary"


def encode(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """docs' columns, of which the last is text, with h, a hash of the text, and leaves, the leaf of each of its words in 32 bits, instead of it."""
    sent, names = docs.sparkSession.sparkContext.broadcast(words), docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            i = 0
            for count, hashed in _hashed(batch.column(len(names) + 1)):
                leaf, offs = words.leaves(hashed)[0].astype(np.int32), np.concatenate([[0], 4 * np.cumsum(count)]).astype(np.int32)
                leaves = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offs), pa.py_buffer(leaf)])
                yield pa.RecordBatch.from_arrays([*(c.slice(i, len(count)) for c in batch.columns[:-1]), leaves], [*names, "h", "leaves"])
                i += len(count)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[:-1]), ENCODED])
    return scan.map_batches(docs.select(*names, F.xxhash64("text").alias("h"), "text"), run, schema)


def _leaves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and the leaves of all."""
    if len(column) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.diff(offs) // 4, np.frombuffer(data.slice(int(offs[0]), int(offs[-1] - offs[0])).to_pybytes(), np.int32) if data is not None else np.zeros(0, np.int32)


def deal(leaves: DataFrame, slices: int, parts: int) -> DataFrame:
    """DEALT of all texts that have words: a slice is a rest of the hash, a part of a slice a range of hashes. Copies that a batch has go as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at, copies = np.unique(batch.column(2).to_numpy(), return_index=True, return_counts=True)
            some = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(copies, pa.int32()), some.column(3)], ["slice", "part", "h", "copies", "leaves"])

    # parts by other bits of the hash than slices
    part = F.shiftright(F.shiftrightunsigned(F.xxhash64("h"), 40) * parts, 24).cast("int")
    rows = leaves.where("length(leaves) > 0").select(F.pmod("h", F.lit(slices)).cast("int").alias("slice"), part.alias("part"), "h", "leaves")
    return scan.map_batches(rows, run, DEALT)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Leaves, contexts and weights of each part of a slice; rows (DEALT) come by part."""
    held: list[pa.RecordBatch] = []
    at = -1

    def whole() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        hashed, copies = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (2, 3))
        count, leaf = (np.concatenate(x) for x in zip(*(_leaves(x.column(4)) for x in held), strict=True))
        _, one, of = np.unique(hashed, return_index=True, return_inverse=True)
        copies, begin, count = np.bincount(of, copies), (np.cumsum(count) - count)[one], count[one]
        leaf = leaf[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())].astype(np.int64)
        for run, text, context in contexts(count, leaf, PART_WORDS):
            yield leaf[run], context, copies[text]

    for batch in batches:
        part = batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(part)]):
            if held and part[lo] != at:
                yield from whole()
                held = []
            held.append(batch.slice(lo, hi - lo))
            at = part[lo]
    if held:
        yield from whole()


def _round(dealt: DataFrame, net: Network, words: Vocabulary, slices: int) -> None:
    """Each slice of dealt (DEALT) trains a copy of net; net takes over the mean of what they changed."""
    sent = dealt.sparkSession.sparkContext.broadcast((net, words))
    blocks = _blocks(net)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, words = sent.value
        trainer = Trainer(begun.copy(), words)
        trainer.learn(_parts(batches))
        for k, (p, lo, hi) in enumerate(blocks):
            uses = trainer.uses[p][lo:hi]
            if uses.any():
                moved = np.rint((trainer.net.parts[p][lo:hi] - begun.parts[p][lo:hi]) * PART).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(moved)], pa.binary()), pa.array([_packed(uses)], pa.binary())], ["block", "changes", "uses"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, moved, uses in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                uses = _unpacked(uses, np.int64)
                weighted = _unpacked(moved, np.int32).reshape(len(uses), -1) * uses[:, None]
                total[k] = [total[k][0] + weighted, total[k][1] + uses] if k in total else [weighted, uses]
        for k, (weighted, uses) in total.items():
            moved = np.rint(weighted / np.maximum(uses, 1)[:, None]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(moved)], pa.binary()), pa.array([b""], pa.binary())], ["block", "changes", "uses"])

    dealt = dealt.repartitionById(slices, "slice").sortWithinPartitions("part")
    parts = scan.map_batches(dealt, learn, CHANGES).repartitionById(min(len(blocks), 1 << 10), "block")
    for r in scan.map_batches(parts, mean, CHANGES).toLocalIterator():  # one row a block
        p, lo, hi = blocks[r.block]
        net.parts[p][lo:hi] += _unpacked(bytes(r.changes), np.int32).reshape(hi - lo, -1).astype(np.float32) / PART
    sent.destroy()


def train(texts: DataFrame, words: Vocabulary, rounds: int = ROUNDS, slice_words: int | None = None) -> Network:
    """texts: one string column. slice_words: words of a slice, by SLICE_WORDS and SLICE_GROWTH if none are given."""
    kept = Kept(texts.sparkSession, "lm-train")
    net = train_encoded(kept.put("leaves", encode(texts.toDF("text"), words), "zstd"), words, rounds, slice_words)
    kept.close()
    return net


def train_encoded(leaves: DataFrame, words: Vocabulary, rounds: int = ROUNDS, slice_words: int | None = None) -> Network:
    """train() on a table of ENCODED."""
    net, total = Network.new(words), words.sum()
    slices = max(1, round(total / (slice_words or max(SLICE_WORDS, SLICE_GROWTH * total**0.5))))
    parts = max(1, round(total / slices / PART_WORDS))
    _round(deal(leaves.where(F.pmod("h", F.lit(slices)) == 0), slices, parts), net, words, 1)
    for _ in range(rounds):
        _round(deal(leaves, slices, parts), net, words, slices)
    return net


def score_leaves(count: np.ndarray, leaf: np.ndarray, net: Network, words: Vocabulary, apart: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Summed log-chances of texts of so many words."""
    out = np.zeros(len(count))
    for run, text, context in contexts(count, leaf, SCORED):
        logs = net.log_chances(context, leaf[run], words, apart) + words.share[leaf[run]]
        lo = text[0]
        sums = np.bincount(text - lo, logs)
        out[lo : lo + len(sums)] += sums
    return out


def score_texts(column: pa.Array, net: Network, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and summed log-chances of each text."""
    n, out, apart = [np.zeros(0, np.int64)], [np.zeros(0)], net.apart()
    for count, hashed in _hashed(column):
        n.append(count)
        out.append(score_leaves(count, words.leaves(hashed)[0], net, words, apart))
    return np.concatenate(n), np.concatenate(out)


def spread_once(docs: DataFrame, kept: Kept) -> DataFrame:
    """docs, or if spread() deals them out, a table of what it dealt, so that it does so once however often they are read."""
    dealt = spread(docs)
    return docs if dealt is docs else kept.put("docs", dealt)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, log_likelihood and mean_log_likelihood of each row, by a network trained on all rows."""
    docs, kept = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), Kept(docs.sparkSession, "lm-score")
    docs = spread_once(docs, kept)
    words = count_words(docs.select("text"))
    leaves = kept.put("leaves", encode(docs, words), "zstd")
    kept.drop("docs")
    sent = docs.sparkSession.sparkContext.broadcast((train_encoded(leaves.select("h", "leaves"), words, rounds), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, words = sent.value
        apart = net.apart()
        for batch in batches:
            n, leaf = _leaves(batch.column(1))
            logs = score_leaves(n, leaf, net, words, apart)
            mean = pa.array(logs / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(logs), mean], ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return scan.map_batches(leaves.select("doc_id", "leaves"), run, f"doc_id {kind}, n_words long, log_likelihood double, mean_log_likelihood double")
