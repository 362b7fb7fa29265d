"""The staged copy-number run: coverage bins to a composition model, corrected ratios, levels, a ploidy fit, segments and their figures.

Stages hand DataFrames on; those that several stages read are kept in the shared folder. Only fitted tables of bounded size reach the driver: a row for each
thousandth of gc, a histogram of ratios, and the levels of the fit."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import coverage as cv, hmm, intervals as iv, ordered as od, ploidy as pl, tables as tb
from tessera.runtime import Kept, cut


@dataclass
class Params:
    """Defaults of the run."""

    band: str = "2 * poisson"
    smooth: tuple[int, ...] = (3, 5, 15)
    levels: int = 10
    tau: float = 1e-50
    alphas: tuple[int, int, int] = (0, 20, 1)
    ploidies: tuple[int, int, int] = (20, 160, 1)
    normal_alpha: float = 0.95
    joinsize: int = 100_000
    minsize: int = 1000
    sd: float = 0.1
    cnmax: int = 30


@dataclass
class Result:
    corrected: DataFrame
    fit: DataFrame
    segments: DataFrame
    alpha: float
    ploidy: float
    model: np.ndarray = field(repr=False)


def gaussian(u1, u2):
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * np.pi * u2)


def redraw(df: DataFrame, key: str, mean: str, sd: str, seed: int = 0) -> DataFrame:
    """Adds drawn, a normal draw that depends on the key alone, so that a task that runs again draws alike."""
    unit = lambda k: (F.xxhash64(key, F.lit(seed + k)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    return df.withColumn("drawn", F.col(mean) + F.coalesce(F.col(sd), F.lit(0.0)) * gaussian(unit(0), unit(1)))


def fit_composition(bins: DataFrame, params: Params) -> np.ndarray:
    """The model of coverage by gc over bins within the band."""
    lo, hi = cv.band(bins, "cov", params.band)
    rows = cv.aggregate(bins.where(F.col("cov").between(lo, hi)), "gc", "cov").collect()
    return cv.gc_model([(r.gc, r["cov"], r.n) for r in rows])


def observed_levels(corrected: DataFrame, params: Params) -> list[tuple[int, float, float, float]]:
    """Levels of the corrected ratio by a level search over a histogram's quantiles: id, rc, af, weight. One level stands for a normal sample."""
    found = cv.histogram(corrected, "rrc_cor")
    if not len(found.v):
        return []
    x = np.interp((np.arange(400) + 0.5) / 400, found.upto / found.total, found.v)
    model = hmm.discover_levels(x, params.levels, 1e-6)
    states = hmm.viterbi(model, x)
    return [(k, float(p["mean"]), 0.5, float((states == k).sum())) for k, p in enumerate(model.params) if (states == k).any()]


def segment(corrected: DataFrame, regions: DataFrame, alpha: float, ploidy: float, params: Params) -> DataFrame:
    """chr, from, to, state, lev_rrc, lev_cn, delta_cn, nb_mark, ppm_mark, med, mad, z, p, med_cn."""
    top = corrected.agg(F.max("rrc_cor").alias("m")).first()["m"] or 2.0
    cn = min(params.cnmax, max(2, int(np.ceil(top * ploidy + 2 * alpha * (top - 1) / (1 - min(alpha, 0.999))))))
    means = [(q * (1 - alpha) + 2 * alpha) / (ploidy * (1 - alpha) + 2 * alpha) for q in range(cn + 1)]
    model = hmm.Hmm.new([{"mean": m, "sd": params.sd} for m in means], params.tau)
    states = hmm.decode(corrected.where("rrc_cor IS NOT NULL"), ["chr"], "from", "rrc_cor", model)
    marks = cut(states.join(corrected, ["chr", "from"]).select("chr", "from", "to", (F.col("state") - 1).alias("state"), "rrc_cor"))
    runs = od.run_lengths(marks, ["chr"], ["from"], "state", "from").select("chr", "from", F.col("to").alias("last"), "state")
    ends = marks.select("chr", F.col("from").alias("last"), "to")
    whole = cut(runs.join(ends, ["chr", "last"]).select("chr", "from", "to", "state"))
    parts = whole.withColumn("id", F.xxhash64("chr", "from"))
    inside = iv.overlap_pairs(parts, regions.withColumn("id", F.xxhash64("chr", "from", "to"))).join(parts.select(F.col("id").alias("a_id"), "state"), "a_id").select("chr", "from", "to", "state")
    fused = od.fuse(cut(iv.threshold(inside, params.minsize)), ["chr"], params.joinsize).select("chr", "from", "to", "state")
    fused = cut(fused.withColumn("id", F.xxhash64("chr", "from")))
    met = iv.overlap_pairs(fused, marks.withColumn("id", F.struct("from", "rrc_cor"))).select("a_id", F.col("b_id.rrc_cor").alias("rrc"))
    stats = tb.robust(met, ["a_id"], "rrc")
    levels = F.array(*[F.lit(float(m)) for m in means])
    out = pl.reference_state(fused.withColumn("lev_cn", F.col("state"))).join(stats.withColumnRenamed("a_id", "id"), "id")
    lev = F.get(levels, F.col("state").cast("int"))
    return out.select(
        "chr", "from", "to", "state", lev.alias("lev_rrc"), "lev_cn", "delta_cn", F.col("n").alias("nb_mark"), (F.col("n") / (F.col("to") - F.col("from") + 1) * 1e6).alias("ppm_mark"), "med", "mad",
        tb.z_score(F.col("med"), lev, F.col("mad"), F.col("sd")).alias("z"), tb.two_sided(tb.z_score(F.col("med"), lev, F.col("mad"), F.col("sd"))).alias("p"), pl.absolute_cn(F.col("med"), F.lit(alpha), F.lit(ploidy)).alias("med_cn"),
    )


def run(spark: SparkSession, bins: DataFrame, regions: DataFrame, params: Params | None = None) -> Result:
    """bins: chr, from, to, cov, gc. regions: chr, from, to, where segments may lie."""
    params, kept = params or Params(), Kept(spark, "copynumber")
    bins = kept.put("bins", bins.select("chr", "from", "to", "cov", "gc"))
    model = fit_composition(bins, params)
    corrected = kept.put("corrected", cv.correct(bins, model, "gc", "cov"))
    found = observed_levels(corrected, params)
    levels = spark.createDataFrame(found, "id int, rc double, af double, weight double")
    grid = pl.grid_of(spark, params.alphas, params.ploidies)
    fitted = kept.put("fit", pl.fit(levels, grid)) if len(found) > 1 else spark.createDataFrame([(0.0, 2.0, 0.0)], "alpha double, ploidy double, fit double")
    best = pl.best(fitted).first()
    alpha, ploidy = (0.0, 2.0) if len(found) < 2 or best.alpha >= params.normal_alpha else (best.alpha, best.ploidy)
    return Result(corrected, fitted, segment(corrected, regions, alpha, ploidy, params), alpha, ploidy, model)
