"""Conversions between places on named sequences, on numbered sequences, and on all sequences laid end to end.

seq is a small dimension table: index, name, size, offset (the number of positions before the sequence); its size is the number of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def sequences(df: DataFrame) -> DataFrame:
    """Adds offset to index, name, size."""
    by = Window.orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum("size").over(by), F.lit(0)))


def to_absolute(df: DataFrame, seq: DataFrame) -> DataFrame:
    """chr, from, to as abs_from and abs_to over all sequences; rows of unknown sequences drop out."""
    return df.join(seq.select(F.col("index").alias("chr"), "offset"), "chr").withColumn("abs_from", F.col("from") + F.col("offset")).withColumn("abs_to", F.col("to") + F.col("offset")).drop("offset")


def to_relative(df: DataFrame, seq: DataFrame, truncate: bool = False) -> DataFrame:
    """abs_from and abs_to as chr, from, to; rows that begin outside, or end in another sequence than they begin in, drop out, or are cut at its end with truncate."""
    s = seq.select(F.col("index").alias("chr"), "offset", "size")
    out = df.join(s, (F.col("abs_from") > F.col("offset")) & (F.col("abs_from") <= F.col("offset") + F.col("size")))
    end = F.col("offset") + F.col("size")
    out = out.withColumn("abs_to", F.least("abs_to", end)) if truncate else out.where(F.col("abs_to") <= end)
    return out.withColumn("from", F.col("abs_from") - F.col("offset")).withColumn("to", F.col("abs_to") - F.col("offset")).drop("offset", "size")


def format_sloc(df: DataFrame, seq: DataFrame, zero_based: bool = False) -> DataFrame:
    """Adds sloc, name:from-to; with zero_based, from is one less."""
    named = df.join(seq.select(F.col("index").alias("chr"), "name"), "chr")
    return named.withColumn("sloc", F.concat(F.col("name"), F.lit(":"), (F.col("from") - int(zero_based)).cast("string"), F.lit("-"), F.col("to").cast("string"))).drop("name")


def sloc_to_absolute(df: DataFrame, seq: DataFrame, zero_based: bool = False) -> DataFrame:
    """sloc as abs_from and abs_to."""
    return to_absolute(parse_sloc(df, seq, zero_based), seq).drop("chr", "from", "to")


def absolute_to_sloc(df: DataFrame, seq: DataFrame, zero_based: bool = False) -> DataFrame:
    """abs_from and abs_to as sloc; rows that are in no one sequence drop out."""
    return format_sloc(to_relative(df, seq), seq, zero_based).drop("chr", "from", "to")


def to_lists(df: DataFrame, by: str = "chr") -> DataFrame:
    """by and spans: each sequence's rows as one sorted array of from and to, a row by its meaning."""
    return df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to")))).alias("spans"))


def from_lists(df: DataFrame, by: str = "chr") -> DataFrame:
    """by, from, to of rows of arrays."""
    return df.select(by, F.explode("spans").alias("s")).select(by, F.col("s.from").alias("from"), F.col("s.to").alias("to"))


def absolute_to_lists(df: DataFrame, seq: DataFrame) -> DataFrame:
    """abs_from and abs_to as an array of from and to for each sequence."""
    return to_lists(to_relative(df, seq).select("chr", "from", "to"))


def lists_to_absolute(df: DataFrame, seq: DataFrame) -> DataFrame:
    """abs_from and abs_to of rows of arrays."""
    return to_absolute(from_lists(df), seq).select("abs_from", "abs_to")


def parse_sloc(df: DataFrame, seq: DataFrame, zero_based: bool = False) -> DataFrame:
    """sloc as chr, from, to; texts of another form and unknown names drop out."""
    form = r"^(.+):([0-9]+)-([0-9]+)$"
    parts = df.where(F.col("sloc").rlike(form)).select("*", *(F.regexp_extract("sloc", form, k).alias(n) for k, n in enumerate(("name", "_f", "_t"), 1)))
    out = parts.join(seq.select(F.col("index").alias("chr"), "name"), "name")
    return out.withColumn("from", F.col("_f").cast("long") + int(zero_based)).withColumn("to", F.col("_t").cast("long")).drop("name", "_f", "_t")
