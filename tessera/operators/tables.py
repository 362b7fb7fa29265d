"""Contingency tables, set tables and grouped statistics. Null is a level like any other where levels are counted, and is passed over by sums and means."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.draws import draw, unit


def conditional_sum(df: DataFrame, x: str, y: str, dense: bool = False) -> DataFrame:
    """x, n and total of y for each whole number x; dense: for every number from the least to the largest."""
    out = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("long").alias("x")).agg(F.count("*").alias("n"), F.sum(y).alias("total"))
    if not dense:
        return out
    every = out.agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("x"))
    return every.join(out, "x", "left").select("x", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def contingency(df: DataFrame, columns: Sequence[str], levels: dict[str, Sequence] | None = None) -> DataFrame:
    """Counts by all the columns; with levels, of every combination of them, absent ones 0. Levels are an argument, so their number is the caller's."""
    out = df.groupBy(*columns).agg(F.count("*").alias("n"))
    if not levels:
        return out
    every = None
    for c in columns:
        one = df.sparkSession.createDataFrame([(v,) for v in levels[c]], f"`{c}` {df.schema[c].dataType.simpleString()}")
        every = one if every is None else every.join(F.broadcast(one))
    return every.join(out, list(columns), "left").fillna(0, ["n"])


def pairwise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts by each pair of columns: var1, var2, level1, level2, n. One pass: each row stands once for each pair."""
    pairs = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(a).cast("string").alias("level1"), F.col(b).cast("string").alias("level2")) for a, b in combinations(columns, 2)])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.var1", "p.var2", "p.level1", "p.level2").agg(F.count("*").alias("n"))


def factor_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts by each column alone: var, level, n."""
    cells = F.array(*[F.struct(F.lit(c).alias("var"), F.col(c).cast("string").alias("level")) for c in columns])
    return df.select(F.explode(cells).alias("p")).groupBy("p.var", "p.level").agg(F.count("*").alias("n"))


def margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by a and b, by either, and of all; `*` stands where a column is summed over."""
    out = df.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
    return out.select(F.when(F.col("_a") == 1, "*").otherwise(F.col(a)).alias(a), F.when(F.col("_b") == 1, "*").otherwise(F.col(b)).alias(b), "n")


def set_table(df: DataFrame, key: str, item: str) -> DataFrame:
    """In how many sets each item occurs; repeats within a set count once."""
    return df.select(key, item).distinct().groupBy(item).agg(F.count("*").alias("n"))


def multiset_table(df: DataFrame, key: str, item: str) -> DataFrame:
    """How many sets hold an item how many times: item, times, n."""
    return df.groupBy(key, item).agg(F.count("*").alias("times")).groupBy(item, "times").agg(F.count("*").alias("n"))


def cooccurrence(df: DataFrame, key: str, item: str) -> DataFrame:
    """In how many sets two items (a <= b) occur together, an item with itself included. The pairs of a set are made within its own sorted list, so the
    work is the sum of squares of the sets' numbers of distinct items."""
    sets = df.select(key, item).distinct().groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("s"))
    pairs = sets.select(F.posexplode("s").alias("i", "a"), "s").select("a", F.explode(F.slice("s", F.col("i") + 1, F.size("s"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def tapply(df: DataFrame, by: str, f: Column, levels: Sequence, missing=None) -> DataFrame:
    """A grouped aggregate as `value`, for every level; absent ones get `missing`."""
    out = df.groupBy(by).agg(f.alias("value"))
    every = df.sparkSession.createDataFrame([(v,) for v in levels], f"`{by}` {df.schema[by].dataType.simpleString()}")
    return every.join(out, by, "left").withColumn("value", F.coalesce("value", F.lit(missing)))


def weighted_mean(x: str, w: str) -> Column:
    """Sum of w x over sum of w, over rows that have both."""
    both = F.col(x).isNotNull() & F.col(w).isNotNull()
    return F.sum(F.when(both, F.col(x) * F.col(w))) / F.sum(F.when(both, F.col(w)))


def weighted_var(x: str, w: str, repeat: bool = True) -> Column:
    """Variance with weights that say how often a value occurs (repeat), or how reliable it is."""
    both = F.col(x).isNotNull() & F.col(w).isNotNull()
    s = lambda c: F.sum(F.when(both, c))
    v1, v2 = s(F.col(w)), s(F.col(w) * F.col(w))
    square = s(F.col(w) * F.col(x) * F.col(x)) - s(F.col(w) * F.col(x)) * s(F.col(w) * F.col(x)) / v1
    return square / (v1 - 1 if repeat else v1 - v2 / v1)


def robust(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sd, median and mad (1.4826 times the median distance from the median) by group."""
    first = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("med"))
    rows = df.join(first, list(by)).where(F.col(value).isNotNull())
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.first("med").alias("med"), (1.4826 * F.percentile(F.abs(F.col(value) - F.col("med")), F.lit(0.5))).alias("mad")
    )


def z_score(med: Column, ref: Column, mad: Column, sd: Column) -> Column:
    """Distance of a group's median from a reference in mads, or in sds where the mad is 0; 0 where they are equal, null without spread."""
    return F.when(med == ref, F.lit(0.0)).otherwise(F.try_divide(med - ref, F.when(mad == 0, sd).otherwise(mad)))


#: Classes into which a quantile's search cuts the range of values.
CLASSES = 1 << 20


def _counted(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, _v and _n of each value that isn't null: a value that many rows have is one row from here on."""
    return df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_n"))


def _at_ranks(counted: DataFrame, by: Sequence[str], figures: dict[str, float]) -> DataFrame:
    """by and the exact quantiles of counted values, by name.

    The range from least to largest value is cut into CLASSES, which are counted; the values of the classes that hold the ranks go on, and are counted through."""
    on, share = list(by), list(figures.items())
    met = lambda a, b: a.join(b, on) if on else a.join(F.broadcast(b))
    ends = counted.groupBy(*by).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.sum("_n").alias("_all"))
    width = F.col("_b") - F.col("_a")
    classed = met(counted, ends).withColumn("_c", F.when(width > 0, F.floor((F.col("_v") - F.col("_a")) / width * (CLASSES - 1))).otherwise(0)).drop("_a", "_b")
    counts = classed.groupBy(*by, "_c", "_all").agg(F.sum("_n").alias("_m"))
    counts = counts.withColumn("_before", F.sum("_m").over(Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m"))
    rank = lambda q: (F.col("_all") - 1) * F.lit(q)
    ranks = F.array(*[F.struct(F.lit(k).alias("_k"), F.floor(rank(q)).alias("_lo"), F.ceil(rank(q)).alias("_hi"), (rank(q) - F.floor(rank(q))).alias("_part")) for k, (_, q) in enumerate(share)])
    holds = counts.select(*by, "_c", "_m", "_before", F.explode(ranks).alias("_r")).select(*by, "_c", "_m", "_before", "_r.*").where((F.col("_before") <= F.col("_hi")) & (F.col("_lo") < F.col("_before") + F.col("_m")))
    rows = classed.join(F.broadcast(holds.drop("_m")) if not on else holds.drop("_m"), [*by, "_c"])
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_c", "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto)
    found = lambda k, r: F.max(F.when((F.col("_k") == k) & (F.col("_upto") - F.col("_n") <= F.col(r)) & (F.col(r) < F.col("_upto")), F.col("_v")))
    two = rows.groupBy(*by, "_all").agg(*[c for k in range(len(share)) for c in (found(k, "_lo").alias(f"_x{k}"), found(k, "_hi").alias(f"_y{k}"), F.max(F.when(F.col("_k") == k, F.col("_part"))).alias(f"_p{k}"))])
    return two.select(*by, *[(F.col(f"_x{k}") + (F.col(f"_y{k}") - F.col(f"_x{k}")) * F.col(f"_p{k}")).alias(name) for k, (name, _) in enumerate(share)])


def quantile(df: DataFrame, by: Sequence[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """by and the exact quantile (between the two values about it, linear) of the values that aren't null; no row without any. No task holds the values of a group."""
    return _at_ranks(_counted(df, by, value), by, {name: q})


def trimmed_mean(df: DataFrame, by: Sequence[str], value: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Mean of the values between two quantiles of their group."""
    counted = _counted(df, by, value)
    rows = counted.join(_at_ranks(counted, by, {"_lo": lo, "_hi": hi}), list(by)).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    return rows.groupBy(*by).agg((F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"))


def two_sided(z: Column) -> Column:
    """Chance of a standard normal value at least as far from 0 as z, to 1.5e-7, by a rational approximation of the error function."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    return F.when(z.isNotNull(), t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x))


#: Agreement of a value with its prediction, by name, as aggregates.
OBJECTIVES = {
    "pearson": lambda seen, said: F.corr(seen, said),
    "rsq": lambda seen, said: 1 - F.sum((F.col(seen) - F.col(said)) * (F.col(seen) - F.col(said))) / (F.var_pop(seen) * F.count(seen)),
}


def objective(name: str, seen: str, said: str) -> Column:
    if name not in OBJECTIVES:
        raise ValueError(f"no objective {name}; there are {', '.join(OBJECTIVES)}")
    return OBJECTIVES[name](seen, said)


def weighted_sample(df: DataFrame, weight: str, size: int, seed: int, *key: str) -> DataFrame:
    """size rows without replacement, with chances in proportion to weight: those of the largest u ** (1 / weight), u from a hash of the key."""
    return df.where(F.col(weight) > 0).withColumn("_k", F.log(unit(seed, *key)) / F.col(weight)).orderBy(F.desc("_k"), *key).limit(size).drop("_k")


def uniform_sample(df: DataFrame, size: int, seed: int, *key: str) -> DataFrame:
    """size rows without replacement, all with the same chance: those of the least draws of their key."""
    return df.withColumn("_k", draw(seed, *key)).orderBy("_k", *key).limit(size).drop("_k")
