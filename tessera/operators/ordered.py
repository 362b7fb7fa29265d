"""Operators on ordered rows. Each takes the columns that make a sequence (by) and those that order it; sequences are independent, so work
spreads over them. A null value counts as missing: sums and means pass over it. Empty tables give empty results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.tiles import running, tiled


def _w(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds __rn (from 1) and __n, the sequence's length."""
    return df.withColumn("__rn", F.row_number().over(_w(by, order)).cast("long")).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))


def bin_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, k: int, drop: bool = True) -> DataFrame:
    """Sums of k consecutive values by bin (from 1); a last bin of fewer is dropped, or kept as it is."""
    rows = df.withColumn("__rn", F.row_number().over(_w(by, order)))
    out = rows.groupBy(*by, (F.floor((F.col("__rn") - 1) / k) + 1).alias("bin")).agg(F.sum(value).alias("total"), F.count("*").alias("size"))
    return (out.where(F.col("size") == k) if drop else out).drop("size")


def bin_values(df: DataFrame, by: Sequence[str], pos: str, value: str, width: int, fun: str = "mean") -> DataFrame:
    """sum, mean or median of the values whose place falls in each bin of so many places, bins counting from place 0; a bin's mean is over what it holds."""
    f = {"sum": F.sum, "mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5))}[fun]
    return df.groupBy(*by, F.floor(F.col(pos) / width).alias("bin")).agg(f(value).alias("value"), F.count(value).alias("size"))


def region_bins(regions: DataFrame, values: DataFrame, width: int, r_id: str = "id", pos: str = "pos", value: str = "value") -> DataFrame:
    """Sums of values by bins that count from each region's start: region, bin, total and places (the bin's true width; the last may be short)."""
    from tessera.operators.intervals import overlap_pairs

    v = values.select("chr", F.col(pos).alias("from"), F.col(pos).alias("to"), F.struct(F.col("id").alias("i"), F.col(value).alias("v")).alias("vid"))
    met = overlap_pairs(regions, v, r_id, "vid").select(F.col("a_id").alias("region"), "from", "b_id.v")
    starts = regions.select(F.col(r_id).alias("region"), F.col("from").alias("start"), F.col("to").alias("stop"))
    out = met.join(starts, "region").withColumn("bin", F.floor((F.col("from") - F.col("start")) / width) + 1)
    places = F.least(F.lit(width), F.col("stop") - F.col("start") + 1 - (F.col("bin") - 1) * width)
    return out.groupBy("region", "bin", places.alias("places")).agg(F.sum("v").alias("total"))


def roll_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, k: int, drop: bool = False) -> DataFrame:
    """Adds rolled, the sum of a value and the k - 1 that follow; with drop, rows with fewer following go."""
    out = df.withColumn("rolled", F.sum(value).over(_w(by, order).rowsBetween(0, k - 1)))
    return numbered(out, by, order).where(F.col("__rn") <= F.col("__n") - k + 1).drop("__rn", "__n") if drop else out


def shift(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, n: int, fill=None) -> DataFrame:
    """Adds shifted: the value n rows on (n > 0) or back, fill where there is none."""
    f = F.lead(value, n, fill) if n >= 0 else F.lag(value, -n, fill)
    return df.withColumn("shifted", f.over(_w(by, order)))


def rotate(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Adds place: where each row comes to stand (from 1) when the first n rows go to the end."""
    return numbered(df, by, order).withColumn("place", F.pmod(F.col("__rn") - 1 - n, F.col("__n")) + 1).drop("__rn", "__n")


def recycle(df: DataFrame, by: Sequence[str], order: Sequence[str], length: int) -> DataFrame:
    """Repeats each sequence from its start until it has `length` rows, or cuts it; place counts from 1."""
    rows = numbered(df, by, order)
    places = F.when(F.col("__rn") <= length, F.sequence(F.col("__rn"), F.lit(length).cast("long"), F.col("__n")))
    return rows.withColumn("place", F.explode(places)).drop("__rn", "__n")


def decimate(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: float) -> DataFrame:
    """A systematic sample of the given share: the rows at which the running share passes a whole number."""
    rows = numbered(df, by, order)
    return rows.where(F.floor(F.col("__rn") * F.lit(keep)) > F.floor((F.col("__rn") - 1) * F.lit(keep))).drop("__rn", "__n")


def head(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows, or all but the last -n."""
    rows = numbered(df, by, order)
    return rows.where(F.col("__rn") <= (F.lit(n) if n >= 0 else F.col("__n") + n)).drop("__rn", "__n")


def tail(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows, or all but the first -n."""
    rows = numbered(df, by, order)
    return rows.where(F.col("__rn") > (F.col("__n") - n if n >= 0 else F.lit(-n))).drop("__rn", "__n")


def find_interval(points: DataFrame, breaks: DataFrame, by: Sequence[str], pos: str, at: str, keep: Sequence[str]) -> DataFrame:
    """Adds place: how many breaks of the sequence are at or below each point, 1 at least. One sweep over points and breaks in order, without pairs."""
    breaks = breaks.groupBy(*by, F.col(at).alias("_p")).agg(F.count("*").alias("_n"))
    marks = points.select(*by, *keep, F.col(pos).alias("_p"), F.lit(1).alias("_q")).unionByName(breaks.withColumn("_q", F.lit(0)), allowMissingColumns=True)
    out = running(tiled(marks, "_p"), by, ["_p"], {"place": ("sum", F.col("_n"))}, then=["_q"]).where("_q = 1")
    return out.select(*by, *keep, F.col("_p").alias(pos), F.greatest(F.lit(1), F.col("place")).cast("long").alias("place"))


def asof(points: DataFrame, values: DataFrame, by: Sequence[str], pos: str, at: str, value: str, keep: Sequence[str], tolerance: int | None = None) -> DataFrame:
    """Adds the value of the last row of values at or below each point (of several there, the largest), and found_at; null beyond the tolerance or where there is none."""
    values = values.groupBy(*by, F.col(at).alias("_p")).agg(F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))).alias("_w"))
    marks = points.select(*by, *keep, F.col(pos).alias("_p"), F.lit(1).alias("_q")).unionByName(values.withColumn("_q", F.lit(0)), allowMissingColumns=True)
    out = running(tiled(marks, "_p"), by, ["_p"], {"_v": ("last", F.col("_w"))}, then=["_q"]).where("_q = 1")
    if tolerance is not None:
        out = out.withColumn("_v", F.when(F.col("_p") - F.col("_v.at") <= tolerance, F.col("_v")))
    return out.select(*by, *keep, F.col("_p").alias(pos), F.col("_v.at").alias("found_at"), F.col("_v.v").alias(value))


def run_lengths(df: DataFrame, by: Sequence[str], order: Sequence[str], state: str, pos: str) -> DataFrame:
    """Runs of equal states: run (from 1), state, from and to (the places of its first and last row), size. Nulls are a state."""
    rows = tiled(df.select(*dict.fromkeys([*by, *order, pos, state])).withColumn("_s", F.struct(F.col(state).alias("s"))), order[0])
    rows = running(rows, by, order, {"_b": ("last", F.col("_s"))}, inclusive=False)
    new = F.when(F.col("_b").isNotNull() & F.col("_s.s").eqNullSafe(F.col("_b.s")), 0).otherwise(1)
    rows = running(rows.withColumn("_new", new), by, order, {"run": ("sum", F.col("_new"))})
    return rows.groupBy(*by, "run").agg(F.first(state).alias("state"), F.min(pos).alias("from"), F.max(pos).alias("to"), F.count("*").alias("size"))


def fuse(df: DataFrame, by: Sequence[str], gap: int) -> DataFrame:
    """Joins a row of from, to, state with the one before when the states are the same and the gap is under `gap`; a fused row has the first's from and the last's other values."""
    order = ["from", "to", "state"]
    rows = tiled(df.select(*by, *order), "from")
    rows = running(rows, by, order, {"_b": ("last", F.struct("to", "state"))}, inclusive=False)
    new = F.when(F.col("_b").isNotNull() & F.col("state").eqNullSafe(F.col("_b.state")) & (F.col("from") - F.col("_b.to") < gap), 0).otherwise(1)
    rows = running(rows.withColumn("_new", new), by, order, {"_g": ("sum", F.col("_new"))})
    return rows.groupBy(*by, "_g").agg(F.max_by("state", F.struct("from", "to")).alias("state"), F.min("from").alias("from"), F.max_by("to", F.struct("from", "to")).alias("to"), F.count("*").alias("fused")).drop("_g")


def window_mean(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, half: int) -> DataFrame:
    """Adds mean over the half rows before, the row, and the half rows after, from running totals as far as the sequence goes."""
    w = _w(by, order).rowsBetween(-half, half)
    return df.withColumn("mean", F.sum(value).over(w) / F.count("*").over(w))


def local_maxima(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, eps: float = 0.0) -> DataFrame:
    """Rows above the row before and not below the row after, of at least eps times the sequence's maximum."""
    w = _w(by, order)
    up = F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(True))
    down = F.coalesce(F.col(value) >= F.lead(value).over(w), F.lit(True))
    top = F.max(value).over(Window.partitionBy(*by))
    return df.withColumn("_k", up & down & (F.col(value) >= top * eps)).where("_k").drop("_k")


def running_median(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, k: int) -> DataFrame:
    """Adds smooth: the median over k rows about each; the ends keep the value of the first and last full window."""
    h, w = k // 2, _w(by, order)
    rows = numbered(df, by, order).withColumn("_m", F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-h, h)))
    rows = rows.withColumn("_m", F.when((F.col("__rn") > h) & (F.col("__rn") <= F.col("__n") - h), F.col("_m")))
    whole = Window.partitionBy(*by).orderBy("__rn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = F.when(F.col("__rn") <= h, F.first("_m", ignorenulls=True).over(whole)).otherwise(F.last("_m", ignorenulls=True).over(whole))
    return rows.withColumn("smooth", F.coalesce("_m", end, F.col(value))).drop("_m", "__rn", "__n")


def _medians(x: np.ndarray, k: int) -> np.ndarray:
    if len(x) < k:
        return x
    mid = np.median(np.lib.stride_tricks.sliding_window_view(x, k), axis=1)
    return np.concatenate([np.full(k // 2, mid[0]), mid, np.full(k // 2, mid[-1])])


def smooth_median(x: np.ndarray, widths: Sequence[int] = (3, 5, 15), tol: float = 1e-6, most: int = 1000) -> np.ndarray:
    """For each width in turn, running medians until they move by tol or less in the sum of squares' root."""
    x = np.asarray(x, float)
    for k in widths:
        for _ in range(most):
            new = _medians(x, k)
            moved = float(np.sqrt(((new - x) ** 2).sum()))
            x = new
            if moved <= tol:
                break
    return x


def smooth(df: DataFrame, by: Sequence[str], order: str, value: str, widths: Sequence[int] = (3, 5, 15), tol: float = 1e-6) -> DataFrame:
    """by, order and smooth, by smooth_median over each sequence. A sequence is one task's: the fixpoint needs it whole."""
    kept = df.select(*by, order, F.col(value).cast("double").alias("value"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "value")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        return part.assign(smooth=smooth_median(part["value"].to_numpy(), widths, tol)).drop(columns="value")

    return kept.groupBy(*by).applyInPandas(run, f"{schema}, smooth double")


def row_extremes(columns: Sequence[str]) -> tuple[Column, Column, Column, Column]:
    """Largest and least value of a row's columns and their numbers from 1; ties go to the first."""
    cols = [F.col(c) for c in columns]
    hi, lo = F.greatest(*cols), F.least(*cols)
    return hi, F.array_position(F.array(*cols), hi), lo, F.array_position(F.array(*cols), lo)


def scale(df: DataFrame, by: Sequence[str], value: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Adds scaled: values moved linearly so that the least is lo and the largest hi; lo where all are equal."""
    w = Window.partitionBy(*by)
    a, b = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scaled", F.when(b == a, F.lit(lo)).otherwise(lo + (F.col(value) - a) / (b - a) * (hi - lo)))


def peaks(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[float, float, float]]:
    """Place of each maximum of a curve, highest first, and of the steepest points to its left and right."""
    slope = np.diff(y)
    tops = [i for i in range(1, len(y) - 1) if y[i] > y[i - 1] and y[i] >= y[i + 1]]
    for i in sorted(tops, key=lambda i: -y[i]):
        left = next((j for j in range(i - 1, 0, -1) if abs(slope[j]) >= abs(slope[j - 1]) and abs(slope[j]) >= abs(slope[min(j + 1, len(slope) - 1)])), 0)
        right = next((j for j in range(i, len(slope) - 1) if abs(slope[j]) >= abs(slope[j + 1]) and abs(slope[j]) >= abs(slope[j - 1])), len(slope) - 1)
        yield float(x[i]), float(x[left]), float(x[right + 1])
