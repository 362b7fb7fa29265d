"""Sharding by sampled splitters.

Records are put in the order of a key, the hash of their text and then doc_id, so that equal texts stand together. A sample drawn with
probabilities in proportion to size gives splitters at equal quantiles; they cut the order into ranges, and a range that turns out
overfull (one text's copies may be a third of all) is subdivided by splitters of its own. Ranges are many more than shards and are sorted by
one task each; with each range's exact size and count known, every record's place in the whole order follows, and the shards are cut at
equal shares of the bytes. So the sample decides only how the work is spread, and the shards are the same whatever was drawn.

Law `bytes`: a shard's size is the total divided by the number of shards, to within the size of one record. A record goes to the shard in
which its middle falls.

Defined results: a null text has size 1 and the checksum of no bytes; rows with a null doc_id come first among their text's copies
(ids being -2**62 or more); rows that repeat stand together, in one range, and which of two equal rows comes first makes no difference; a group of equal
texts is cut where a shard ends, as the law is of bytes; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, Window, functions as F

from tessera.runtime import cut, ship

SHARDS = 16
#: Ranges for each shard, and sampled records for each range, on average.
RANGES, SAMPLED = 16, 16
#: Rows of a range at most, on average: what one task sorts. The sample grows with it, by SAMPLED records for so many rows.
ROWS = 1 << 20
SEED = 97
#: How often overfull ranges are subdivided, at most.
SUBDIVIDED = 4


def _splitters(sample: list[tuple[int, int, float]], ranges: int) -> list[tuple[int, int]]:
    """Keys that cut the sample into ranges of equal weight. The first is the largest of the first range."""
    sample = sorted(sample)
    if not sample or ranges < 2:
        return []
    total = np.cumsum([w for *_, w in sample])
    at = np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges)
    return sorted({sample[i][:2] for i in at.tolist()})


def _range_of(splitters: list[tuple[int, int]]):
    """Column function: the number of splitters below (key, tie)."""
    keys = np.array([k for k, _ in splitters], np.int64)
    ties = np.array([t for _, t in splitters], np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        out, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for same in np.unique(out[out < hi]):
            rows = (out == same) & (hi > same)
            end = int(hi[rows][0])
            out[rows] = same + np.searchsorted(ties[same:end], t[rows], "left")
        return pd.Series(out.astype(np.int32))

    return place


def _draw(rows: DataFrame, total: int, want: int) -> list[tuple[int, int, float]]:
    """About `want` records (at most that many more, as each is worth total / want bytes or is larger than that), drawn by a hash of key and tie."""
    worth = max(1.0, total / want)
    chance = F.xxhash64("key", "tie", F.lit(SEED)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    # rows that repeat draw alike, so each counts for all its copies
    drawn = rows.filter(chance * worth < F.col("size")).groupBy("key", "tie").agg(F.sum(F.greatest(F.col("size").cast("double"), F.lit(worth))).alias("w"))
    return [(r.key, r.tie, r.w) for r in drawn.collect()]


OUT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """OUT for each row: slot counts from 0 within the shard, grown_shard is null under this law; and the columns to carry along, such as the text
    itself where the shards are to be written (`.write.partitionBy("shard")`; rows are in ranges of the order already)."""
    if clash := [c for c in carry if c in OUT]:
        raise ValueError(f"columns {clash} would be hidden by the result's own")
    ship(docs.sparkSession)
    said = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(said) + 1).cast("long").alias("size"),
        F.crc32(said.cast("binary")).alias("text_crc32"),
        F.xxhash64(said).alias("key"),
        # rows without an id are told apart by their number, which is written with them, so that very many of one text can be subdivided
        F.coalesce(F.col(doc_id).cast("long"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(-(1 << 63))).alias("tie"),
        *[F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)],
    )
    rows = cut(rows)
    whole = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    total, ranges = whole["size"] or 0, max(shards * RANGES, whole["n"] // ROWS)
    splitters = _splitters(_draw(rows, total, ranges * SAMPLED), ranges)
    placed = rows.withColumn("range", _range_of(splitters)("key", "tie"))
    for _ in range(SUBDIVIDED):
        sizes = {r["range"]: r["size"] for r in placed.groupBy("range").agg(F.sum("size").alias("size")).collect()}  # as many rows as ranges
        over = [k for k, size in sizes.items() if size > 2 * total / ranges]
        if not over:
            break
        more = _draw(placed.filter(F.col("range").isin(over)), sum(sizes[k] for k in over), len(over) * SAMPLED * 4)
        inside = {k: [] for k in over}
        for key, tie, w in more:
            inside[bisect_left(splitters, (key, tie))].append((key, tie, w))
        finer = sorted({*splitters, *(s for k in over for s in _splitters(inside[k], int(sizes[k] * ranges / total) + 1))})
        if len(finer) == len(splitters):
            break
        splitters = finer
        placed = rows.withColumn("range", _range_of(splitters)("key", "tie"))
    spans = placed.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("range").collect()
    before, starts = (0, 0), []
    for r in spans:
        starts.append((r["range"], *before))
        before = (before[0] + r["size"], before[1] + r["n"])
    at = docs.sparkSession.createDataFrame(starts, "range int, bytes_before long, rows_before long")  # as many rows as ranges
    order = Window.partitionBy("range").orderBy("key", "tie", "size", "text_crc32")
    ranked = (
        placed.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(at), "range")
        .withColumn("rank", F.col("rows_before") + F.col("nth") - 1)
        .withColumn("shard", F.floor((2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")) / F.lit(2 * max(1, total) / shards)).cast("int"))
        .withColumn("shard", F.least("shard", F.lit(shards - 1)))
    )
    carried = [f"__c{k}" for k in range(len(carry))]
    ranked = cut(ranked.select("doc_id", "size", "text_crc32", "shard", "rank", *carried))
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))  # as many rows as shards
    return ranked.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"__c{k}").alias(c) for k, c in enumerate(carry)],
    )

