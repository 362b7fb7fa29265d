"""Models over the driver tables: composition, bands, ploidy, hidden Markov models, and the staged copy-number run."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.operators import coverage as cv, hmm, intervals as iv, ploidy as pl
from tessera.plans import copynumber
from tessera.plans.adapters import P_SQL, points
from tessera.plans.catalogue import register, table
from tessera.plans.ordered_queries import _DAILY, _daily, r6
from tessera.runtime import cut

_L = "(SELECT l_orderkey AS id, l_discount * 5 + l_tax AS gc, l_quantity AS cov FROM lineitem)"


def _lines(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_discount") * 5 + F.col("l_tax")).alias("gc"), F.col("l_quantity").alias("cov"))


@register("gc_aggregate", f"SELECT CAST(round_even(gc * 1000, 0) AS BIGINT) AS gc, round(avg(cov), 6) AS cov, count(*) AS n FROM {_L} GROUP BY 1")
def gc_aggregate(spark, d):
    return cv.aggregate(_lines(spark, d), "gc", "cov").select(F.col("gc").cast("long").alias("gc"), r6("cov"), "n")


@register("gc_correct_lookup", f"SELECT count(*) AS n, round(avg(cov / (20 + 0.01 * round_even(gc * 1000, 0))), 6) AS rrc_cor, round(avg(cov / (SELECT median(cov) FROM {_L} WHERE gc <= 1)), 6) AS rrc_raw FROM {_L} WHERE gc <= 1")
def gc_correct_lookup(spark, d):
    """By a straight model, 20 + 0.01 for each thousandth; as averages, since every row has a ratio of its own."""
    rows = cv.correct(_lines(spark, d).where("gc <= 1"), [20 + 0.01 * k for k in range(cv.LEVELS + 1)], "gc", "cov")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("rrc_cor"), 6).alias("rrc_cor"), F.round(F.avg("rrc_raw"), 6).alias("rrc_raw"))


@register("gc_model_fit")
def gc_model_fit(spark, d):
    rows = cv.aggregate(_lines(spark, d).where("gc <= 1"), "gc", "cov").collect()  # a row for each thousandth
    model = cv.gc_model([(r.gc, r["cov"], r.n) for r in rows])
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(model)], "gc int, pred double")


@register("cover_range", f"SELECT chr, day FROM {_DAILY} WHERE n BETWEEN 12 AND 20")
def cover_range(spark, d):
    return cv.in_band(_daily(spark, d), "n", 12, 20).select("chr", "day")


@register("cover_band_median", f"WITH m AS (SELECT median(n) AS med FROM {_DAILY}), s AS (SELECT any_value(med) AS med, 1.4826 * median(abs(n - med)) AS mad FROM {_DAILY}, m) SELECT CAST(floor(greatest(0, med - 2 * mad)) AS DOUBLE) AS lo, CAST(ceil(med + 2 * mad) AS DOUBLE) AS hi FROM s")
def cover_band_median(spark, d):
    return cv.median_band(_daily(spark, d).withColumn("cov", F.col("n").cast("double")), "cov", 2.0)


@register("cover_band_poisson")
def cover_band_poisson(spark, d):
    lo, hi = cv.band(_daily(spark, d), "n", "2 * poisson - 3 * median")
    return _daily(spark, d).where(F.col("n").between(lo, hi))


@register(
    "cohort_normalise",
    """WITH x AS (SELECT l_suppkey AS probe, l_linenumber % 4 AS sample, avg(l_quantity) AS depth, any_value(s_nationkey) AS length FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    m AS (SELECT sample, avg(depth) AS m FROM x GROUP BY sample), s AS (SELECT probe, x.sample AS sample, depth / m AS d, length FROM x JOIN m ON x.sample = m.sample),
    k AS (SELECT probe FROM s GROUP BY probe HAVING stddev_samp(d) / avg(d) <= 0.04), t AS (SELECT s.sample AS sample, regr_slope(d, length) AS b, regr_intercept(d, length) AS a FROM s JOIN k ON s.probe = k.probe GROUP BY s.sample)
    SELECT s.probe AS probe, s.sample AS sample, round(d - a - b * length, 6) AS norm FROM s JOIN k ON s.probe = k.probe JOIN t ON s.sample = t.sample""",
)
def cohort_normalise(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    x = x.groupBy(F.col("l_suppkey").alias("probe"), (F.col("l_linenumber") % 4).alias("sample")).agg(F.avg("l_quantity").alias("depth"), F.any_value("s_nationkey").alias("length"))
    return cv.normalise_cohort(x, "probe", "sample", "depth", "length", 0.04).select("probe", F.col("sample").cast("int").alias("sample"), r6("norm"))


_CELLS = "(SELECT q, unnest(range(0, q + 1)) AS k FROM (SELECT unnest(range(0, 6)) AS q))"
_GRID = "(SELECT a.a / 20.0 AS alpha, p.p / 20.0 AS ploidy FROM (SELECT unnest(range(0, 20, 4)) AS a) a, (SELECT unnest(range(20, 101, 10)) AS p) p)"
_AF = "(k * (1 - greatest(alpha, 0.001)) + greatest(alpha, 0.001)) / (q * (1 - greatest(alpha, 0.001)) + 2 * greatest(alpha, 0.001))"
_RC = "(q * (1 - alpha) + 2 * alpha) / (ploidy * (1 - alpha) + 2 * alpha)"


@register("theo_levels", f"SELECT alpha, ploidy, q, CAST(k AS INTEGER) AS k, round({_RC}, 6) AS rc, round({_AF}, 6) AS af, repeat('A', CAST(k AS INTEGER)) || repeat('B', CAST(q - k AS INTEGER)) AS label FROM {_GRID}, {_CELLS} WHERE {_AF} >= 0.5")
def theo_levels(spark, d):
    return pl.theory(pl.grid_of(spark, (0, 19, 4), (20, 100, 10)), 5).select("alpha", "ploidy", F.col("q").cast("long").alias("q"), "k", r6("rc"), r6("af"), "label")


_OBS = "(SELECT l_suppkey % 12 AS id, avg(l_quantity) / 25 + (l_suppkey % 12) * 0.07 AS rc, 0.5 + (l_suppkey % 12) * 0.03 AS af, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY l_suppkey % 12)"
_FIT = f"""(WITH o AS {_OBS}, g AS {_GRID},
  mo AS (SELECT g.*, greatest(2, least(20, ceil(t.rc * ploidy + 2 * least(alpha, 0.999) * (t.rc - 1) / (1 - least(alpha, 0.999))))) AS qm, 2 - greatest(ploidy / (SELECT max(ploidy) FROM g), alpha / (SELECT max(alpha) FROM g)) AS gm FROM g, (SELECT max(rc) AS rc FROM o) t),
  th AS (SELECT alpha, ploidy, gm, {_RC} AS rc, {_AF} AS af FROM mo, (SELECT q, unnest(range(0, q + 1)) AS k FROM (SELECT unnest(range(0, 21)) AS q)) WHERE q <= qm AND {_AF} >= 0.5),
  di AS (SELECT alpha, ploidy, o.id AS id, weight, pow(least(1, abs(th.rc - o.rc)), gm) + pow(least(1, abs(th.af - o.af)), gm) AS dist FROM th, o),
  rk AS (SELECT *, row_number() OVER (PARTITION BY alpha, ploidy, id ORDER BY dist) AS r FROM di),
  sc AS (SELECT alpha, ploidy, id, max(dist * weight) FILTER (WHERE r = 1) AS s1, max(dist * weight) FILTER (WHERE r = 2) AS s2 FROM rk WHERE r <= 2 GROUP BY alpha, ploidy, id)
  SELECT alpha, ploidy, -ln(sum(CASE WHEN s1 = 0 THEN 0 ELSE s1 / sqrt(s2) END) / count(*)) AS fit FROM sc GROUP BY alpha, ploidy)"""


def _observed(spark, d):
    k = F.col("l_suppkey") % 12
    out = table(spark, d, "lineitem").groupBy(k.alias("id")).agg(F.avg("l_quantity").alias("m"), F.count("*").cast("double").alias("weight"))
    return out.select("id", (F.col("m") / 25 + F.col("id") * 0.07).alias("rc"), (0.5 + F.col("id") * 0.03).alias("af"), "weight")


def _fit(spark, d):
    """Kept, as its readers read it more than once; the observed levels likewise, which each model of the grid meets."""
    return cut(pl.fit(cut(_observed(spark, d)), pl.grid_of(spark, (0, 19, 4), (20, 100, 10))))


@register("ploidy_grid", f"SELECT alpha, ploidy, round(fit, 6) AS fit FROM {_FIT}")
def ploidy_grid(spark, d):
    return _fit(spark, d).select("alpha", "ploidy", r6("fit"))


@register("ploidy_best", f"SELECT alpha, ploidy, round(fit, 6) AS fit FROM {_FIT} ORDER BY fit DESC, ploidy, alpha LIMIT 1")
def ploidy_best(spark, d):
    return pl.best(_fit(spark, d)).select("alpha", "ploidy", r6("fit"))


@register("ploidy_quality", f"""WITH f AS {_FIT}, b AS (SELECT alpha AS a0, ploidy AS q0, fit AS f0 FROM f ORDER BY fit DESC, ploidy, alpha LIMIT 1),
  r AS (SELECT *, abs(alpha - a0) <= 0.1 + 1e-9 AND abs(ploidy - q0) <= 0.25 + 1e-9 AS near FROM f, b), o AS (SELECT alpha AS a1, ploidy AS q1 FROM r WHERE NOT near ORDER BY fit DESC, ploidy, alpha LIMIT 1)
  SELECT any_value(a0) AS alpha, any_value(q0) AS ploidy, round(any_value(f0), 6) AS fit,
    round(sum(exp(fit)) FILTER (WHERE near) / (sum(exp(fit)) FILTER (WHERE near) + coalesce(sum(exp(fit)) FILTER (WHERE NOT near AND abs(alpha - a1) <= 0.1 + 1e-9 AND abs(ploidy - q1) <= 0.25 + 1e-9), 0)), 6) AS quality FROM r LEFT JOIN o ON true""")
def ploidy_quality(spark, d):
    return pl.quality(_fit(spark, d)).select("alpha", "ploidy", r6("fit"), r6("quality"))


_LEN = f"""(SELECT chr, "from", "to", CAST("to" - "from" + 1 AS BIGINT) % 4 AS lev_cn FROM (SELECT chr, day * 10 AS "from", day * 10 + n AS "to" FROM {_DAILY}))"""


@register("reference_copy", f"""SELECT chr, "from", lev_cn - (SELECT lev_cn FROM {_LEN} GROUP BY lev_cn ORDER BY sum("to" - "from" + 1) DESC, lev_cn LIMIT 1) AS delta_cn FROM {_LEN}""")
def reference_copy(spark, d):
    s = _daily(spark, d).select("chr", (F.col("day") * 10).alias("from"), (F.col("day") * 10 + F.col("n")).alias("to"))
    return pl.reference_state(s.withColumn("lev_cn", (F.col("to") - F.col("from") + 1) % 4)).select("chr", "from", "delta_cn")


MODEL = hmm.Hmm.new([{"mean": 20.0, "sd": 15.0}, {"mean": 70.0, "sd": 20.0}], 0.2)


# the model's figures, written out: emissions are the normal densities' logarithms
_EMIT = [f"(-0.5 * pow((value - {p['mean']}) / {p['sd']}, 2) - ln({p['sd']}) - 0.9189385332046727)" for p in MODEL.params]
_SEEN = f"(SELECT user_id, id, value, row_number() OVER (PARTITION BY user_id ORDER BY id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM {P_SQL})"
_T = [[float(math.log(x)) for x in row] for row in MODEL.trans]
_I = [float(math.log(x)) for x in MODEL.init]
_LSE = "(greatest({0}, {1}) + ln(1 + exp(-abs(({0}) - ({1})))))"
_FORWARD = f"""WITH RECURSIVE s AS MATERIALIZED {_SEEN}, f AS (SELECT user_id, k, n, {_I[0]} + {_EMIT[0]} AS a, {_I[1]} + {_EMIT[1]} AS b FROM s WHERE k = 1
  UNION ALL SELECT s.user_id, s.k, s.n, {_LSE.format(f'a + {_T[0][0]}', f'b + {_T[1][0]}')} + {_EMIT[0]}, {_LSE.format(f'a + {_T[0][1]}', f'b + {_T[1][1]}')} + {_EMIT[1]} FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)
  SELECT user_id, round({_LSE.format('a', 'b')}, 4) AS loglike, n FROM f WHERE k = n"""
# the best way into each state, forward; then from the last state back
_VITERBI = f"""WITH RECURSIVE s AS MATERIALIZED {_SEEN}, f AS (SELECT user_id, id, k, n, {_I[0]} + {_EMIT[0]} AS a, {_I[1]} + {_EMIT[1]} AS b, 0 AS pa, 0 AS pb FROM s WHERE k = 1
  UNION ALL SELECT s.user_id, s.id, s.k, s.n, greatest(a + {_T[0][0]}, b + {_T[1][0]}) + {_EMIT[0]}, greatest(a + {_T[0][1]}, b + {_T[1][1]}) + {_EMIT[1]},
    CASE WHEN a + {_T[0][0]} >= b + {_T[1][0]} THEN 1 ELSE 2 END, CASE WHEN a + {_T[0][1]} >= b + {_T[1][1]} THEN 1 ELSE 2 END FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1),
  m AS MATERIALIZED (SELECT * FROM f), w AS (SELECT user_id, id, k, CASE WHEN a >= b THEN 1 ELSE 2 END AS state, pa, pb FROM m WHERE k = n
  UNION ALL SELECT m.user_id, m.id, m.k, CASE WHEN w.state = 1 THEN w.pa ELSE w.pb END, m.pa, m.pb FROM w JOIN m ON m.user_id = w.user_id AND m.k = w.k - 1)
  SELECT user_id, id, CAST(state AS BIGINT) AS state FROM w"""


@register("hmm_loglike", _FORWARD)
def hmm_loglike(spark, d):
    return hmm.log_likelihoods(points(spark, d), ["user_id"], "id", "value", MODEL).select("user_id", F.round("loglike", 4).alias("loglike"), "n")


@register("hmm_viterbi", _VITERBI)
def hmm_viterbi(spark, d):
    return hmm.decode(points(spark, d), ["user_id"], "id", "value", MODEL)


@register("hmm_fit")
def hmm_fit(spark, d):
    return hmm.fit_each(points(spark, d), ["chr"], "id", "value", MODEL).select("chr", "state", "mean", "sd")


@register("hmm_bic")
def hmm_bic(spark, d):
    return hmm.fit_each(points(spark, d), ["chr"], "id", "value", MODEL).where("state = 1").select("chr", "loglike", "bic")


@register("segment_hmm")
def segment_hmm(spark, d):
    """The copy-number run over daily counts as coverage: correction, ploidy, segmentation."""
    p = points(spark, d).groupBy("chr", F.floor(F.col("pos") / 3600).alias("bin")).agg(F.count("*").cast("double").alias("cov"), (F.avg("value") / 100).alias("gc"))
    first = p.agg(F.min("bin").alias("b"))
    bins = p.join(F.broadcast(first)).select("chr", ((F.col("bin") - F.col("b")) * 1000 + 1).alias("from"), ((F.col("bin") - F.col("b")) * 1000 + 1000).alias("to"), "cov", "gc")
    return copynumber.run(spark, bins, iv.reduce(bins), copynumber.Params(alphas=(0, 20, 5), ploidies=(20, 80, 10), sd=0.3)).segments


@register("regularise_gaussian")
def regularise_gaussian(spark, d):
    """Each value as a draw about its user's mean with its user's sd: the draw is a hash of the event."""
    p = points(spark, d)
    stats = p.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return copynumber.redraw(p.join(stats, "user_id"), "id", "m", "s").select("id", "drawn")
