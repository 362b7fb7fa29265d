"""Rows of four allele counts, columns a, c, g, t by default. An allele is present when its count is above lowread. A null count is 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.draws import unit
from tessera.operators.tables import quantile

ALLELES = ("a", "c", "g", "t")


def _counts(columns: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit(0)) for c in columns]


def coverage(columns: Sequence[str] = ALLELES) -> Column:
    a, *rest = _counts(columns)
    for c in rest:
        a = a + c
    return a


def present(lowread: int = 2, columns: Sequence[str] = ALLELES) -> Column:
    """How many alleles are present."""
    a, *rest = [F.when(c > lowread, 1).otherwise(0) for c in _counts(columns)]
    for c in rest:
        a = a + c
    return a


def passes(lowread: int = 2, mincov: float = 10, minall: int = 1, maxall: int = 4, deltafreq: float = 0.1, columns: Sequence[str] = ALLELES) -> Column:
    """Covered enough, with an allowed number of alleles; where two or more are present, and allowed, the largest count's share is within deltafreq of a half."""
    n, cov = present(lowread, columns), coverage(columns)
    even = F.abs(F.greatest(*_counts(columns)) / F.when(cov > 0, cov) - 0.5) <= deltafreq
    ok = (cov >= mincov) & n.between(minall, maxall)
    return (ok & ((n < 2) | even)) if maxall >= 2 else ok


def heterozygous(lowread: int = 2, mincov: float = 10, deltafreq: float = 0.1, columns: Sequence[str] = ALLELES) -> Column:
    return passes(lowread, mincov, 2, 2, deltafreq, columns)


def coverage_quantile(df: DataFrame, permille: int, columns: Sequence[str] = ALLELES) -> DataFrame:
    """One row: the per-mille quantile of coverage over rows that have any."""
    return quantile(df.select(coverage(columns).alias("cov")).where("cov > 0"), [], "cov", permille / 1000, "mincov")


def sample(df: DataFrame, size: int, seed: int = 0, place: Sequence[str] = ("chr", "pos")) -> DataFrame:
    """About size rows, of each chr in proportion to its rows: a row is drawn by its place, with the same chance for all."""
    n = df.agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(n)).where(unit(seed, *place) * F.col("_n") < size).drop("_n")


def genotype(lowread: int = 2, ordered: bool = False, columns: Sequence[str] = ALLELES) -> Column:
    """Letters of the alleles present, in the columns' order, or by decreasing count (ties in the columns' order)."""
    found = F.array_compact(F.array(*[F.when(c > lowread, F.struct((-c.cast("long")).alias("n"), F.lit(k).alias("k"), F.lit(n.upper()).alias("s"))) for k, (n, c) in enumerate(zip(columns, _counts(columns), strict=True))]))
    return F.array_join(F.transform(F.sort_array(found) if ordered else found, lambda x: x.s), "")


def genotype_probability(geno: Column, ref: Column, alt: Column, freq: Column) -> Column:
    """Chance of a genotype of one or two letters under an ALT frequency: p squared, or 2 p q; null where a letter is neither REF nor ALT."""
    p = lambda s: F.when(s == alt, freq).when(s == ref, 1 - freq)
    one, two = p(F.substring(geno, 1, 1)), p(F.substring(geno, 2, 1))
    return F.when(F.length(geno) == 1, one * one).when(F.length(geno) == 2, 2 * one * two)


def log_likelihood(proba: Column, tiny: float = 1e-10) -> Column:
    """Aggregate: sum of logarithms, nulls passed over."""
    return F.sum(F.log(proba + tiny))


def posterior(df: DataFrame, llk: str) -> DataFrame:
    """Adds posterior over the rows of a table of hypotheses (one row each): 1 / sum over j of exp(llk_j - llk_i)."""
    return df.withColumn("_all", F.collect_list(llk).over(_all())).withColumn("posterior", 1 / F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col(llk)))).drop("_all")


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def match_rate(df: DataFrame, proba: str, same: str, nbest: int) -> DataFrame:
    """One row: the share of `same` among the nbest rows of least probability, and how many there were."""
    best = df.where(F.col(proba).isNotNull()).orderBy(proba, *[c for c in df.columns if c not in (proba, same)]).limit(nbest)
    return best.agg(F.avg(F.col(same).cast("double")).alias("rate"), F.count("*").alias("n"))


def pileup(reads: DataFrame, mapq: int = 0, baseq: int = 0, counted: bool = True) -> DataFrame:
    """chr, pos and counts of a, c, g, t (or, if not counted, a row chr, pos, base for each) from reads (chr, pos, cigar, seq, qual, mapq): aligned bases only, with deletions, skips and clipped ends left out.

    Each CIGAR operation is unrolled with the places it starts at on the reference and in the read, found by running sums over the operations."""
    ops = F.regexp_extract_all("cigar", F.lit("([0-9]+)[MIDNSHP=X]"), 1)
    kinds = F.regexp_extract_all("cigar", F.lit("[0-9]+([MIDNSHP=X])"), 1)
    pairs = F.zip_with(ops, kinds, lambda n, k: F.struct(n.cast("int").alias("n"), k.alias("k")))
    start = F.struct(F.col("pos").cast("long").alias("r"), F.lit(1).alias("q"), F.array().cast("array<struct<r:bigint,q:int,n:int>>").alias("m"))

    def step(s, op):
        on_ref, on_read = op.k.isin("M", "D", "N", "=", "X"), op.k.isin("M", "I", "S", "=", "X")
        m = F.when(op.k.isin("M", "=", "X"), F.concat(s.m, F.array(F.struct(s.r.alias("r"), s.q.alias("q"), op.n.alias("n"))))).otherwise(s.m)
        return F.struct((s.r + F.when(on_ref, op.n).otherwise(0)).alias("r"), (s.q + F.when(on_read, op.n).otherwise(0)).alias("q"), m.alias("m"))

    blocks = reads.where(F.col("mapq") >= mapq).select("chr", "seq", "qual", F.explode(F.aggregate(pairs, start, step, lambda s: s.m)).alias("b"))
    bases = blocks.select("chr", "seq", "qual", "b.*").select("chr", "seq", "qual", "r", "q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    bases = bases.select("chr", (F.col("r") + F.col("k")).alias("pos"), F.lower(F.substr("seq", F.col("q") + F.col("k"), F.lit(1))).alias("base"), (F.ascii(F.substr("qual", F.col("q") + F.col("k"), F.lit(1))) - 33).alias("bq"))
    bases = bases.where((F.col("bq") >= baseq) | F.col("bq").isNull())
    if not counted:
        return bases.select("chr", "pos", "base")
    return bases.groupBy("chr", "pos").agg(*[F.count_if(F.col("base") == b).cast("int").alias(b) for b in ALLELES])
