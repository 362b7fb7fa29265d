"""Copy-number theory: expected levels under contamination and ploidy, a grid fit to observed levels, and its quality."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, functions as F


def relative_rc(q: Column, alpha: Column, ploidy: Column) -> Column:
    return (q * (1 - alpha) + 2 * alpha) / (ploidy * (1 - alpha) + 2 * alpha)


def relative_af(q: Column, k: Column, alpha: Column) -> Column:
    a = F.greatest(alpha, F.lit(0.001))
    return (k * (1 - a) + a) / (q * (1 - a) + 2 * a)


def absolute_cn(rc: Column, alpha: Column, ploidy: Column) -> Column:
    a = F.least(alpha, F.lit(0.999))
    return rc * ploidy + 2 * a * (rc - 1) / (1 - a)


def theory(grid: DataFrame, qmax: int, weighted: bool = False) -> DataFrame:
    """grid's rows (alpha, ploidy) with each level: q, k, rc, af, weight and label (A k times, B the rest); levels of af under a half are left out. A row makes (qmax + 1)(qmax + 2) / 2 at most."""
    levels = [(q, k, float(comb(q, k)) / 2**q if weighted else 1.0, "A" * k + "B" * (q - k)) for q in range(qmax + 1) for k in range(q + 1)]
    cells = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(k).alias("k"), F.lit(w).alias("weight"), F.lit(label).alias("label")) for q, k, w, label in levels])
    rows = grid.select("*", F.explode(cells).alias("c")).select(*grid.columns, "c.*")
    rows = rows.withColumn("rc", relative_rc(F.col("q"), F.col("alpha"), F.col("ploidy"))).withColumn("af", relative_af(F.col("q"), F.col("k"), F.col("alpha")))
    return rows.where("af >= 0.5")


def grid_of(spark, alphas: tuple[int, int, int], ploidies: tuple[int, int, int], parts: int = 20) -> DataFrame:
    """alpha and ploidy as whole numbers of 1 / parts: (first, last, step) each."""
    a = spark.range(alphas[0], alphas[1] + 1, alphas[2]).select((F.col("id") / parts).alias("alpha"))
    q = spark.range(ploidies[0], ploidies[1] + 1, ploidies[2]).select((F.col("id") / parts).alias("ploidy"))
    return a.join(F.broadcast(q))


def fit(observed: DataFrame, grid: DataFrame, gamma0: float = 1.0, rho: float = 0.5, qcap: int = 20) -> DataFrame:
    """alpha, ploidy and fit. observed: id, rc, af, weight, aggregated levels; the grid is a stated set of models against all of them.

    A level's distance to each expected one is min(1, |rc|) ** g + min(1, |af|) ** g; its score is the least distance weighted by both, over the runner-up's
    to the power rho; fit is minus the logarithm of the mean score."""
    top = observed.agg(F.max("rc").alias("_top"))
    most = grid.agg(F.max("alpha").alias("_ma"), F.max("ploidy").alias("_mq"))
    models = grid.join(F.broadcast(top)).join(F.broadcast(most))
    models = models.withColumn("_q", F.greatest(F.lit(2), F.least(F.lit(qcap), F.ceil(absolute_cn(F.col("_top"), F.col("alpha"), F.col("ploidy"))))))
    models = models.withColumn("_g", 2 - gamma0 * F.greatest(F.try_divide(F.col("ploidy"), F.col("_mq")), F.coalesce(F.try_divide(F.col("alpha"), F.col("_ma")), F.lit(0.0))))
    levels = theory(models, qcap).where("q <= _q").groupBy("alpha", "ploidy", "_g").agg(F.collect_list(F.struct("rc", "af", "weight")).alias("levels"))
    met = levels.join(F.broadcast(observed.select("id", F.col("rc").alias("orc"), F.col("af").alias("oaf"), F.col("weight").alias("ow"))))
    far = F.transform("levels", lambda t: F.pow(F.least(F.lit(1.0), F.abs(t.rc - F.col("orc"))), F.col("_g")) + F.pow(F.least(F.lit(1.0), F.abs(t.af - F.col("oaf"))), F.col("_g")))
    two = F.slice(F.sort_array(F.zip_with(far, "levels", lambda d, t: F.struct(d.alias("d"), (d * t.weight).alias("s")))), 1, 2)
    s1, s2 = F.get(two, F.lit(0)).s * F.col("ow"), F.get(two, F.lit(1)).s * F.col("ow")
    scored = met.select("alpha", "ploidy", F.when(s1 == 0, 0.0).otherwise(s1 / F.pow(F.coalesce(s2, F.lit(1.0)), F.lit(rho))).alias("score"))
    return scored.groupBy("alpha", "ploidy").agg((-F.log(F.sum("score") / F.count("*"))).alias("fit"))


def best(fitted: DataFrame) -> DataFrame:
    """The row of the largest fit; ties go to the lower ploidy, then the lower alpha."""
    return fitted.orderBy(F.desc("fit"), "ploidy", "alpha").limit(1)


def quality(fitted: DataFrame) -> DataFrame:
    """The best row with quality: the weight of the fits about it, within 0.1 of alpha and 0.25 of ploidy, against the weight about the next best elsewhere."""
    one = best(fitted).select(F.col("alpha").alias("a0"), F.col("ploidy").alias("q0"), F.col("fit").alias("fit0"))
    rows = fitted.join(F.broadcast(one)).withColumn("near", (F.abs(F.col("alpha") - F.col("a0")) <= 0.1 + 1e-9) & (F.abs(F.col("ploidy") - F.col("q0")) <= 0.25 + 1e-9))
    two = rows.where("NOT near").orderBy(F.desc("fit"), "ploidy", "alpha").limit(1).select(F.col("alpha").alias("a1"), F.col("ploidy").alias("q1"))
    rows = rows.join(F.broadcast(two), how="left")
    next_ = ~F.col("near") & (F.abs(F.col("alpha") - F.col("a1")) <= 0.1 + 1e-9) & (F.abs(F.col("ploidy") - F.col("q1")) <= 0.25 + 1e-9)
    return rows.groupBy(F.col("a0").alias("alpha"), F.col("q0").alias("ploidy"), F.col("fit0").alias("fit")).agg(
        (F.sum(F.when(F.col("near"), F.exp("fit"))) / (F.sum(F.when(F.col("near"), F.exp("fit"))) + F.coalesce(F.sum(F.when(next_, F.exp("fit"))), F.lit(0.0)))).alias("quality")
    )


def reference_state(segments: DataFrame) -> DataFrame:
    """Adds delta_cn: a segment's lev_cn less the level of the largest total length; ties go to the lower level."""
    total = segments.groupBy("lev_cn").agg(F.sum(F.col("to") - F.col("from") + 1).alias("w"))
    ref = total.orderBy(F.desc("w"), "lev_cn").limit(1).select(F.col("lev_cn").alias("_ref"))
    return segments.join(F.broadcast(ref)).withColumn("delta_cn", F.col("lev_cn") - F.col("_ref")).drop("_ref")

