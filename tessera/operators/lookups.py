"""Lookups by place or key, rows put together, and functions by region."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.intervals import overlap_pairs


def at_points(points: DataFrame, values: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("chr", "pos"), missing=0) -> DataFrame:
    """The points with the columns of values at the same place, `missing` where there is none. A place that values has several times gives as many rows."""
    out = points.join(values.select(*keys, *columns), list(keys), "left")
    return out.select(*points.columns, *[F.coalesce(F.col(c), F.lit(missing)).alias(c) for c in columns])


def kmers_at(points: DataFrame, parts: DataFrame, k: int, width: int) -> DataFrame:
    """Adds kmer: the k letters from chr, pos on, fewer at a sequence's end, null beyond it. parts: index, chunk, part, of `width` letters each. A k-mer across a border is put together from two parts."""
    own = parts.select(F.col("index").alias("chr"), F.col("chunk").cast("long").alias("_chunk"), "part")
    # each part with the first letters of the next one, of which it needs no more
    ahead = own.select("chr", (F.col("_chunk") - 1).alias("_chunk"), F.substring("part", 1, k - 1).alias("_more"))
    wide = own.join(ahead, ["chr", "_chunk"], "left").select("chr", "_chunk", F.concat("part", F.coalesce("_more", F.lit(""))).alias("_part"))
    at = points.withColumn("_chunk", F.floor((F.col("pos") - 1) / width).cast("long"))
    out = at.join(wide, ["chr", "_chunk"], "left")
    return out.withColumn("kmer", F.nullif(F.substr("_part", (F.col("pos") - F.col("_chunk") * width).cast("int"), F.lit(k)), F.lit(""))).select(*points.columns, "kmer")


def member(df: DataFrame, table: DataFrame, key: str, of: str | None = None) -> DataFrame:
    """Adds member: whether the key is among the table's. Null is a member of nothing."""
    known = table.select(F.col(of or key).alias("_of")).where("_of IS NOT NULL").distinct().withColumn("_in", F.lit(True))
    return df.join(known, F.col(key) == F.col("_of"), "left").withColumn("member", F.coalesce("_in", F.lit(False))).drop("_of", "_in")


def bind(*tables: DataFrame) -> DataFrame:
    """The rows of all tables, by column names; a column that a table lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def _met(values: DataFrame, regions: DataFrame, region: str, pos: str) -> DataFrame:
    rows = values.withColumn("_row", F.struct(*values.columns)).select("chr", F.col(pos).alias("from"), F.col(pos).alias("to"), "_row")
    return overlap_pairs(regions, rows, region, "_row").select(F.col("a_id").alias(region), "b_id.*")


def by_region(values: DataFrame, regions: DataFrame, aggregates: dict[str, Column], region: str = "id", pos: str = "pos") -> DataFrame:
    """Aggregates of the values within each region; regions without values have nulls, or a count of 0."""
    out = _met(values.withColumnRenamed(region, f"_{region}") if region in values.columns else values, regions, region, pos)
    return regions.select(region).join(out.groupBy(region).agg(*[c.alias(n) for n, c in aggregates.items()]), region, "left")


def apply_by_region(values: DataFrame, regions: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, region: str = "id", pos: str = "pos") -> DataFrame:
    """f of the values of each region, as one frame that has the region's id: for functions that no aggregate says. A region is one task's."""
    out = _met(values.withColumnRenamed(region, f"_{region}") if region in values.columns else values, regions, region, pos)
    return out.groupBy(region).applyInPandas(f, schema)


def apply_by_chr(values: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, bits: int | None = None, pos: str = "pos") -> DataFrame:
    """f of the values of each chr, or, with bits, of each of its stretches of 2**bits places, for functions that may be cut there."""
    if bits is None:
        return values.groupBy("chr").applyInPandas(f, schema)
    return values.withColumn("_stretch", F.shiftright(F.col(pos).cast("long"), bits)).groupBy("chr", "_stretch").applyInPandas(f, schema)
