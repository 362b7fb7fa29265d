"""Selection of regions by what lies in them, from bins (chr, from, to, and figures), and sampling of places in regions.

Selected bins are joined where they touch, so that a region is a maximal stretch of selected bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.draws import draw
from tessera.operators import intervals as iv


def where(bins: DataFrame, condition: Column, joinsize: int = 0, minsize: int = 0) -> DataFrame:
    """Regions of the bins that meet a condition; gaps up to joinsize are closed, and regions under minsize dropped."""
    return iv.join(bins.where(condition).select("chr", "from", "to"), joinsize, minsize)


def by_range(bins: DataFrame, value: str, lo: float, hi: float, joinsize: int = 0, minsize: int = 0) -> DataFrame:
    return where(bins, F.col(value).between(lo, hi), joinsize, minsize)


def strata(bins: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """stratum, chr, from, to: regions by the stratum of a value, the number of cuts at or below it; values under the first cut or null have none."""
    at = F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda s, c: s + F.when(F.col(value) >= c, 1).otherwise(0))
    rows = bins.where(F.col(value).isNotNull()).withColumn("stratum", at).where("stratum > 0")
    # regions of different strata may touch: the stratum is part of the sequence that islands are found in
    keyed = rows.select(F.struct("chr", "stratum").alias("chr"), "from", "to")
    return iv.reduce(keyed).select("chr.stratum", "chr.chr", "from", "to")


def within(bins: DataFrame, regions: DataFrame) -> DataFrame:
    """The bins that the union of the regions contains, with all their columns."""
    rows = bins.withColumn("__id", F.struct("chr", "from", "to"))
    inside = iv.covered(rows.select("chr", "from", "to", "__id").distinct(), regions, "__id").where("covered").select(F.col("a_id").alias("__id"))
    return rows.join(inside, "__id", "left_semi").drop("__id")


def sample_spaced(points: DataFrame, spacing: int, seed: int = 0) -> DataFrame:
    """chr, pos: at most one place, drawn by a hash, of each stretch of `spacing`, with places in the latter half of a stretch left out, so that
    two are spacing / 2 apart or more."""
    rows = points.select("chr", "pos").distinct().withColumn("_cell", F.floor(F.col("pos") / spacing)).where(F.col("pos") % spacing < (spacing + 1) // 2)
    first = Window.partitionBy("chr", "_cell").orderBy(draw(seed, "chr", "pos"), "pos")
    return rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("chr", "pos")


def sample_strata(df: DataFrame, stratum: str, size: int, seed: int, *key: str) -> DataFrame:
    """size rows at most of each stratum, those of the least hashes of their key. A stratum's rows are cut down in every hash cell before they meet."""
    cell = F.pmod(F.xxhash64(*key, F.lit(seed + 1)), F.lit(64))
    order = [F.xxhash64(*key, F.lit(seed)), *key]
    first = df.withColumn("_cell", cell).withColumn("_k", F.row_number().over(Window.partitionBy(stratum, "_cell").orderBy(*order))).where(F.col("_k") <= size)
    return first.withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_k") <= size).drop("_k", "_cell")


# sets of places as bitmaps


def to_bits(points: DataFrame) -> DataFrame:
    """chr, bucket and bits: places (from 1) as bitmaps of 32,768 places each."""
    p = F.col("pos").cast("long")
    return points.groupBy("chr", F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bits"))


def count_bits(bits: DataFrame) -> DataFrame:
    """chr and n, the number of places."""
    return bits.groupBy("chr").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def union_bits(*sets: DataFrame) -> DataFrame:
    every = sets[0]
    for s in sets[1:]:
        every = every.unionByName(s)
    return every.groupBy("chr", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def inter_bits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places of both, by buckets that both have."""
    both = a.join(b.select("chr", "bucket"), ["chr", "bucket"], "left_semi").unionByName(b.join(a.select("chr", "bucket"), ["chr", "bucket"], "left_semi"))
    return both.groupBy("chr", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
