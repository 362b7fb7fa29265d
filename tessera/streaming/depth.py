"""Sorted one-pass operators as streams: rows that come in the order of their event time, or of their place, with a bound on how late they may be."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators.alleles import ALLELES, pileup


def windowed_sums(rows: DataFrame, time: str, value: str, width: str, late: str, *by: str) -> DataFrame:
    """by, start, n and total of each time window; rows later than `late` behind the newest are dropped, and a window is given out when it can't change any more (append mode)."""
    out = rows.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*by, F.col("window.start").alias("start"), "n", "total")


def sorted_pileup(reads: DataFrame, longest: int, mapq: int = 0, baseq: int = 0) -> DataFrame:
    """chr, pos and counts of a, c, g, t of alignments that stream in by place (chr, pos, cigar, seq, qual, mapq): places are laid on a clock, a second each, and a place
    is given out once reads begin `longest` places beyond it, the longest stretch of a read (append mode). A read that comes later than that is dropped; a sequence of its own begins at its
    own thousand million seconds, so sequences come in the order of chr, a whole number."""
    clock = F.timestamp_seconds(F.col("chr").cast("long") * 1_000_000_000 + F.col("pos"))
    bases = pileup(reads, mapq, baseq, counted=False).withColumn("at", clock).withWatermark("at", f"{longest} seconds")
    counts = [F.count_if(F.col("base") == b).cast("int").alias(b) for b in ALLELES]
    return bases.groupBy(F.window("at", "1 second"), "chr", "pos").agg(*counts).drop("window")
