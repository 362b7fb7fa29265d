"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct shingles of `size` words; two documents link when 100 * intersection >= percent * union. Texts with the
same set are one class, named by its least doc_id. Shingles are put in one order for all, rare before frequent by a table of hashed counts over
all documents, and a class's prefix is its first n - ceil(percent * n / 100) + 1 shingles: classes that link share a shingle of their
prefixes. The order only decides how many candidates there are, never which links are found. Classes with the same prefix and size are
collapsed into one group; groups that share a prefix shingle are filtered by size and position; the members of those left are verified on
their whole sets.

Only components are asked for, so a pair whose ends are already connected needs no verifying: a first round verifies one promising
partner for each class, and then every candidate pair that still joins two components is verified. Large groups of near copies thus cost
as many pairs as they have members, and no link between different components is passed over.

Each step that joins or counts is written before the next reads it, so that the driver never holds the plans, stages and tasks of several at once.

A shingle or group that very many classes share is dealt out: its list is cut into blocks, and pairs are formed by a task for each pair of blocks; a text that
very many others are compared with is sent to as many tasks as its pairs are dealt to. What is dealt so is found by counting first, and is a
bounded list.

Defined results: null and empty texts, and texts without words, have no set and link with nothing; a text with fewer than `size` words has its
whole sequence as its one shingle; doc_id names a document: rows that share one are linked, whatever their texts, so that each repeats the
document's component; rows with a null doc_id have their size and a null component; further columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from tessera.llm import scan, sums
from tessera.llm.components import contract, directed, labels, settle
from tessera.runtime import Kept, small_batches, spread, text_bytes

SHINGLE, PERCENT = 4, 85
#: log2 of the least and largest number of hashed counts, one byte each of which is sent to the executors, and bytes of input for each.
COUNT_BITS, COUNT_BYTES = (21, 24), 2048
#: log2 of the least and largest number of bits that thin out texts; bits for each text looked for.
TEXT_BITS, BITS_EACH = (20, 28), 16
ODD = 512
#: Rows of a key from which on it is dealt out, if it is also more than one row in HOT_KEYS; rows of a block.
HOT, HOT_KEYS, BLOCK = 1000, 100_000, 512
#: Rounds of contraction after each step of verifying.
ROUNDS = 2


def sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, by row and then by hash."""
    low = scan.LOWER[data]
    starts, ends, count = scan.words(low, offs)
    hashed, row = scan.hashes(low, starts, ends), np.repeat(np.arange(len(count)), count)
    key, at = scan.grams(hashed, size), np.zeros(0, np.int64)
    if len(key):
        at = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
    rows, keys = [row[at]], [key[at]]
    first = np.concatenate([[0], np.cumsum(count)])
    for n in range(1, size):
        few = np.flatnonzero(count == n)
        rows.append(few)
        keys.append(scan.mix(scan.grams(hashed, n)[first[few]] + np.uint64(n)) if len(few) else np.zeros(0, np.uint64))
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(key)
    order = order[_by_row(row[order])]
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def _by_row(row: np.ndarray) -> np.ndarray:
    """A stable order by small numbers; numpy sorts 16-bit ones by radix."""
    return np.argsort(row.astype(np.uint16) if row.max(initial=0) < 1 << 16 else row, kind="stable")


def _each(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = scan.buffers(column)
    for i, j in scan.steps(offs):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def frequency_classes(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """For each bucket of shingle hashes, eight times the logarithm of the number of documents that hold one of them."""
    mask = np.uint64((1 << bits) - 1)

    def fill(batch: pa.RecordBatch, counters: np.ndarray) -> None:
        for _, _, data, offs in _each(batch.column(0)):
            np.add.at(counters, (sets(data, offs, size)[1] & mask).astype(np.int64), 1)

    return np.minimum(255, 8 * np.log2(1 + sums.add_up(docs.select("text"), 1 << bits, fill))).astype(np.uint8)


def count_bits(docs: DataFrame) -> int:
    """By the input's bytes, as estimated or counted."""
    size = text_bytes(docs, "text")
    return min(max(int(np.ceil(np.log2(max(1, size / COUNT_BYTES)))), COUNT_BITS[0]), COUNT_BITS[1])


def signatures(docs: DataFrame, classes: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, said (a hash of the text), n (the set's size), set and prefix_key (hashes of the set and of the ordered prefix), prefix (32 bits of each shingle), cold (how many of
    these, the first, are in HOT documents at most, as their hashed counts are no less than their own), and odd: for
    each of ODD values of a hash, whether an odd number of the set's shingles has it. Two sets differ in as many shingles as their odds do in bits, at least."""
    sent = docs.sparkSession.sparkContext.broadcast(classes.tobytes())
    mask = np.uint64(len(classes) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for i, j, data, offs in _each(batch.column(2)):
                row, key = sets(data, offs, size)
                n = np.bincount(row, minlength=j - i)
                ranks = rank[(key & mask).astype(np.int64)]
                order = np.argsort(ranks, kind="stable")
                order = order[_by_row(row[order])]
                first = np.cumsum(n) - n
                least = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                place = np.arange(len(row)) - first[row]
                within = place < least[row]
                token = key[order][within]
                cold = np.bincount(row[within], ranks[order][within] < 8 * np.log2(1 + HOT), j - i).astype(np.int32)
                cuts = np.concatenate([[0], np.cumsum(least)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(n, pa.int32()),
                        _digest(key, np.concatenate([[0], np.cumsum(n)])),
                        _digest(scan.mix(token + _places(cuts) * scan._ODD), cuts),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((token >> np.uint64(32)).astype(np.uint32).view(np.int32))),
                        pa.array(cold, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * (ODD // 64), pa.int32()), pa.array(_odd(row, key, j - i))),
                    ],
                    ["doc_id", "said", "n", "set_key", "prefix_key", "prefix", "cold", "odd"],
                )

    out = scan.map_batches(docs.select("doc_id", F.xxhash64("text").alias("said"), "text"), run, "doc_id long, said long, n int, set_key binary, prefix_key binary, prefix array<int>, cold int, odd array<long>")
    return out.select("doc_id", "said", "n", F.xxhash64("set_key").alias("set"), F.xxhash64("prefix_key", "n").alias("prefix_key"), "prefix", "cold", "odd")


def _odd(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """ODD bits for each row, as 64-bit numbers."""
    bit = row * ODD + ((key >> np.uint64(20)) % np.uint64(ODD)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=rows * ODD).astype(np.uint8) & 1).view(np.int64)


def _places(cuts: np.ndarray) -> np.ndarray:
    return (np.arange(cuts[-1]) - np.repeat(cuts[:-1], np.diff(cuts))).astype(np.uint64)


def _digest(key: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """128 bits for each run of keys, whatever their order."""
    halves = []
    for salt in (1, 2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scan.mix(key + np.array([salt], np.uint64) * scan._ODD), dtype=np.uint64)])
        halves.append(total[cuts[1:]] - total[cuts[:-1]])
    packed = np.stack(halves, axis=1).tobytes()
    n = len(cuts) - 1
    return pa.Array.from_buffers(pa.binary(16), n, [None, pa.py_buffer(packed)]).cast(pa.binary())


def _bits(ids: DataFrame, key: str) -> tuple[int, bytes]:
    """log2 of the number of bits, and the bits that are set by a hash of the key. Bits follow the number of rows."""
    n = min(max(int(np.ceil(np.log2(max(1, BITS_EACH * ids.count())))), TEXT_BITS[0]), TEXT_BITS[1])
    at = F.xxhash64(key).bitwiseAND(F.lit((1 << n) - 1)) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    table = bytearray((1 << n) // 8)
    for r in rows.collect():  # as many bytes as the table has
        table[(r.k - 1) * 4096 : r.k * 4096] = r.bits
    return n, bytes(table)


def _some_texts(docs: DataFrame, named: DataFrame) -> DataFrame:
    """cid and text of the classes in named (cid, doc_id, said): the text of the row that stands for each. Bits of their hashes thin the rows out before the join, so that few texts are shuffled."""
    named = named.withColumn("row", F.xxhash64("doc_id", "said"))
    n, table = _bits(named, "row")
    sent, mask = docs.sparkSession.sparkContext.broadcast(table), (1 << n) - 1
    rows = docs.withColumn("said", F.xxhash64("text")).withColumn("row", F.xxhash64("doc_id", "said")).select("row", F.xxhash64("row").bitwiseAND(F.lit(mask)).alias("at"), "text")

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            at = batch.column(1).to_numpy()
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    return scan.map_batches(rows, thin, "row long, at long, text string").join(named.select("cid", "row"), "row").select("cid", "text").dropDuplicates(["cid"])


def _hot(counted: DataFrame, n: str, total: int) -> DataFrame:
    """The rows of a table of counts whose key is to be dealt out: under HOT_KEYS of them, as each has more than one in HOT_KEYS of all that was counted, at least `total`."""
    return F.broadcast(counted.where(F.col(n) > max(HOT, total // HOT_KEYS)))


def _with(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of rows with a written table of one row for each key, of which n is how many of `total` rows have it. Rows of hot keys aren't shuffled; where there are none, the driver has one join to plan."""
    hot = _hot(table, n, total)
    if hot.isEmpty():
        return rows.join(table, key)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(table, key))


def _cells(rows: DataFrame, key: str, n: str) -> tuple[DataFrame, DataFrame]:
    """rows twice, to be joined on the key, _i and _j: each pair of rows of a key meets once, by the pair of blocks that they are in. n: how many rows have the key."""
    blocks = F.ceil(F.col(n) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(*[c for c in ("cid", "g") if c in rows.columns]), blocks).cast("int")
    each = F.explode(F.sequence(F.lit(0), blocks - 1))
    return rows.withColumn("_i", own).withColumn("_j", each), rows.withColumn("_j", own).withColumn("_i", each)


def _texts_of(pairs: DataFrame, texts: DataFrame, side: str, parts: DataFrame) -> DataFrame:
    """Adds the text of one side of the pairs. parts, of a written table: the texts of very many pairs, each of which goes to so many tasks, among which its pairs are dealt."""
    texts = texts.toDF(side, f"text_{side}")
    if parts.isEmpty():
        return pairs.join(texts, side)
    parts = F.broadcast(parts)
    pairs = pairs.join(parts, side, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("a", "b"), "parts").cast("int"), F.lit(0))).drop("parts")
    texts = texts.join(parts, side, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return pairs.join(texts, [side, "part"]).drop("part")


def verify(docs: DataFrame, named: DataFrame, kept: Kept, name: str, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) of classes that link, by their whole sets. named: cid, and the doc_id and said of the row that stands for it."""
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    texts = kept.put(f"{name}-texts", _some_texts(docs, kept.put(f"{name}-ids", named.join(ids, "cid"))))
    each = pairs.select(F.lit("a").alias("side"), F.col("a").alias("cid")).union(pairs.select(F.lit("b"), "b")).groupBy("side", "cid").agg(F.count("*").alias("n"))
    parts = kept.put(f"{name}-parts", _hot(each, "n", pairs.count()).select("side", "cid", F.ceil(F.col("n") / HOT).cast("int").alias("parts")))
    both = pairs
    for side in "ab":
        both = _texts_of(both, texts, side, parts.where(F.col("side") == side).select(F.col("cid").alias(side), "parts"))
    both = both.select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(side: int, batch: pa.RecordBatch) -> list[np.ndarray]:
            out = []
            for i, j, data, offs in _each(batch.column(2 + side)):
                row, key = sets(data, offs, size)
                out += np.split(key, np.searchsorted(row, np.arange(1, j - i)))
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ok = []
                for x, y in zip(of(0, part), of(1, part), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), part.column(1).filter(pa.array(ok))], ["a", "b"])

    links = kept.put(f"{name}-links", scan.map_batches(both, run, "a long, b long"))
    kept.drop(f"{name}-texts", f"{name}-ids", f"{name}-parts")
    return links


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bits: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text). bits: log2 of the number of hashed counts, by the input's size if none is given."""
    with small_batches(docs.sparkSession):  # what is returned has no Python in it
        return _jaccard_components(docs, size, percent, bits)


def _jaccard_components(docs: DataFrame, size: int, percent: int, bits: int | None) -> DataFrame:
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    known, kept = docs.filter("doc_id IS NOT NULL"), Kept(docs.sparkSession, "jaccard")
    signed = kept.put("signed", signatures(docs, frequency_classes(docs, size, bits or count_bits(docs)), size, percent))
    some = signed.filter("n > 0 AND doc_id IS NOT NULL")
    # a document that has several rows may have several sets, and is then known by each set's hash
    several = kept.put("several", some.groupBy("doc_id").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).filter("lo <> hi"))
    own_name = F.when(F.col("shared"), F.col("set").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))).otherwise(F.col("doc_id"))
    with_name = lambda df: df.join(several.select("doc_id", F.lit(True).alias("shared")), "doc_id", "left").withColumn("cid", own_name).drop("shared")
    # classes: texts with the same set, for which one row stands, that of the least doc_id, whose id is the class's; groups: classes with the same prefix and size, known by their least class
    least = kept.put("least", some.groupBy("set").agg(F.min("doc_id").alias("doc_id")))
    copies = some.select("set", "doc_id").join(least, ["set", "doc_id"], "left_anti").distinct()
    classes = kept.put("classes", with_name(some.join(copies, ["set", "doc_id"], "left_anti").dropDuplicates(["set", "doc_id"])))
    named = classes.select("cid", "doc_id", "said")
    # as it is one document, its sets' classes are linked
    sets = some.select("doc_id", "set").join(several.select("doc_id"), "doc_id").distinct().join(with_name(least).select("set", "cid"), "set")
    own = kept.put("own", directed(sets.join(sets.groupBy("doc_id").agg(F.min("cid").alias("lo")), "doc_id").select("cid", "lo")))
    many = kept.put("many", classes.groupBy("prefix_key").agg(F.count("*").alias("members"), F.min("cid").alias("g")).filter("members > 1"))
    member = kept.put("member", _with(classes.select("cid", "odd", "n", "prefix_key"), many, "prefix_key", "members", classes.count()).select("cid", "g", "odd", "n", "members"))

    leads = classes.join(member.filter("cid <> g").select("cid"), "cid", "left_anti").select(F.col("cid").alias("g"), "n", "cold", "prefix")
    every = leads.select("g", "n", "cold", F.posexplode("prefix").alias("pos", "token"))
    # the lists of few are counted as they meet; those that may be of many are counted first
    few = every.filter("pos < cold").select("token", "g", "n", "pos", F.expr("count(*) OVER (PARTITION BY token)").alias("listed")).filter("listed > 1")
    often = kept.put("often", every.filter("pos >= cold").select("token", "g", "n", "pos"))
    listed = kept.put("listed", often.groupBy("token").agg(F.count("*").alias("listed")).filter("listed > 1"))
    lists = kept.put("lists", few.unionByName(_with(often, listed, "token", "listed", often.count())))
    kept.drop("often", "listed", "many")  # also frees what made the lists

    # round 1: a member and its group; a group and the head of its lists, and the one before it in its block there, that it meets most often. A group that shares more of its
    # prefix stands nearer the head, as it differs less from the rest
    shared = lists.groupBy("g").agg(F.count("*").alias("shared"))
    placed = kept.put("placed", lists.join(shared, "g").select("token", "listed", "shared", F.struct("g", "n").alias("of"), F.pmod(F.xxhash64("g"), F.ceil(F.col("listed") / HOT)).alias("block")))
    heads = kept.put("heads", placed.groupBy("token").agg(F.max("listed").alias("listed"), F.min(F.struct((-F.col("shared")).alias("s"), "of.n", "of.g")).alias("head")))
    to_head = _with(placed.select("token", "of"), heads, "token", "listed", placed.count()).select("of", F.struct("head.g", "head.n").alias("other"), F.lit(1).alias("place"))
    prev = F.expr("lag(of) OVER (PARTITION BY token, block ORDER BY shared DESC, of.n, of.g)")
    votes = to_head.unionByName(placed.select("of", prev.alias("other"), F.lit(0).alias("place"))).filter(f"other IS NOT NULL AND other.g <> of.g AND 100 * least(of.n, other.n) >= {percent} * greatest(of.n, other.n)")
    best = votes.groupBy(F.col("of.g").alias("g"), "place", F.col("other.g").alias("h")).agg(F.count("*").alias("votes")).groupBy("g", "place").agg(F.max_by("h", F.struct("votes", "h")).alias("h")).select("g", "h")
    best = kept.put("best", best)
    kept.drop("placed", "heads")
    sketches = classes.select("cid", "n", "odd")
    edges = _joined(known, named, kept, "one", best.union(member.filter("cid <> g").select("cid", "g")), own, sketches, size, percent)
    found = kept.put("found", labels(edges))

    # round 2: pairs of groups, or of members of one group, that are in different components and near enough by size, place and odds
    inside = kept.put("inside", _at(member, found, "cid"))
    mixed = kept.put("mixed", inside.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("members").alias("members")).filter("lo <> hi").select("g", "members"))
    x, y = _cells(_with(inside.drop("members"), mixed, "g", "members", inside.count()), "g", "members")
    within = x.alias("x").join(y.alias("y"), F.expr(f"x.g = y.g AND x._i = y._i AND x._j = y._j AND x.cid > y.cid AND x.component <> y.component AND {_near(percent)}")).selectExpr("x.cid AS a", "y.cid AS b")
    within = kept.put("within", within)
    # every class of a group stands in the group's lists; a list whose classes are all of one component is done with
    entries = kept.put("spread", _at(lists.select("token", "g", "n", "pos", "listed"), found, "g").join(mixed.select("g", F.lit(True).alias("mixed")), "g", "left"))
    open_ = entries.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("mixed").alias("mixed"), F.max("listed").alias("listed")).filter("lo <> hi OR mixed").select("token", "listed")
    open_ = kept.put("open", open_)
    entries = _with(entries.select("token", "g", "n", "pos"), open_, "token", "listed", entries.count()).select("token", "g", "n", "pos")
    one = classes.select("cid", "odd").join(member.select("cid"), "cid", "left_anti").select(F.col("cid").alias("g"), "cid", "odd").union(member.select("g", "cid", "odd"))
    entries = kept.put("open-lists", entries)
    sizes = one.groupBy("g").agg(F.count("*").alias("classes"))
    filled = kept.put("filled", entries.join(sizes, "g").groupBy("token").agg(F.sum("classes").alias("filled")))
    entries = kept.put("entries", _at(_with(entries, filled, "token", "filled", entries.count()).join(one, "g"), found, "cid"))
    kept.drop("lists", "spread", "open", "open-lists", "filled", "inside", "mixed", "member")
    # the smaller of a pair meets the other within a shorter prefix: n - ceil(2 percent n / (100 + percent)) + 1
    short = f"{100 + percent} * (y.n - y.pos) >= {2 * percent} * y.n"
    x, y = _cells(entries, "token", "filled")
    across = (
        x.alias("x")
        .join(y.alias("y"), F.expr(f"x.token = y.token AND x._i = y._i AND x._j = y._j AND (x.n > y.n OR x.n = y.n AND x.g > y.g) AND x.component <> y.component AND {short} AND {100 + percent} * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n) AND {_near(percent)}"))
        .groupBy(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
        .agg(F.count("*").alias("both"))
    )
    met = kept.put("met", across.union(within.withColumn("both", F.lit(1 << 40))))
    kept.drop("entries", "within", "best")
    # first the likeliest partner of each class; what it joins needs no more verifying
    likely = met.unionAll(met.select("b", "a", "both")).groupBy("a").agg(F.max_by("b", F.struct("both", "b")).alias("b"))
    edges = _joined(known, named, kept, "two", likely, edges, None, size, percent)
    edges = _joined(known, named, kept, "three", met.select("a", "b"), edges, None, size, percent)
    found = settle(edges)
    of_class = classes.select("cid", "doc_id", "set").join(labels(found).withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    firsts = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = kept.put("components", of_class.join(firsts, "component").select("set", "component_id"))
    kept.drop("met", "own", "classes", "found", "least", "several")
    out = signed.select("doc_id", "n", "set").join(of_class, "set", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def _at(df: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """Adds the component of a node: its own name if it has no link to a lesser one."""
    return df.join(found.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))


def _near(percent: int) -> str:
    """Condition on rows x and y: their sizes and odds don't rule a link out."""
    differ = " + ".join(f"bit_count(x.odd[{k}] ^ y.odd[{k}])" for k in range(ODD // 64))
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND {100 + percent} * ({differ}) <= {100 - percent} * (x.n + y.n)"


def _joined(docs: DataFrame, named: DataFrame, kept: Kept, name: str, pairs: DataFrame, edges: DataFrame, sketches: DataFrame | None, size: int, percent: int) -> DataFrame:
    """The edges with the links among pairs added, partly contracted. Pairs whose ends have one label already aren't verified, nor those that sketches (cid, n, odd) rule out."""
    a, b = pairs.columns[:2]
    pairs = pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    if sketches is None:
        found = labels(edges)
        pairs = _at(_at(pairs, found, "a").withColumnRenamed("component", "ca"), found, "b").filter("ca <> component").select("a", "b")
    else:
        pairs = pairs.join(sketches.select(F.col("cid").alias("a"), F.struct("n", "odd").alias("x")), "a").join(sketches.select(F.col("cid").alias("b"), F.struct("n", "odd").alias("y")), "b").filter(_near(percent)).select("a", "b").distinct()
    pairs = kept.put(f"{name}-pairs", pairs)
    if sketches is None and pairs.isEmpty():
        return edges
    links = directed(verify(docs, named, kept, name, pairs, size, percent))
    out = contract(kept.put(f"{name}-edges", links.union(edges).distinct()), ROUNDS)
    kept.drop(f"{name}-pairs", f"{name}-links", f"{name}-edges")
    return out


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component; rows without words stay. A row without a doc_id is known by a hash
    of its text from 2^62 on, so that it gives way to rows with one, and of such rows with the same text one stays."""
    by_text = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    named = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), by_text))
    of = jaccard_components(named.select(F.col("__id").alias("doc_id"), "text"), size, percent)
    left = named.join(of.filter("n_shingles > 0 AND component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct(), "__id", "left_anti")
    nameless = F.col("doc_id").isNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return left.filter(~nameless).unionByName(left.filter(nameless).dropDuplicates(["__id"])).select(docs.columns)
