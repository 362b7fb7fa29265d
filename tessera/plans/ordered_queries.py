"""Ordered operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import intervals as iv, ordered as od
from tessera.plans.adapters import B_SQL, P_SQL, intervals_b, points, seconds
from tessera.plans.catalogue import register, table

BY, ORDER = ["user_id"], ["pos", "id"]
W = "PARTITION BY user_id ORDER BY pos, id"


def r6(column: str, name: str | None = None):
    return F.round(F.col(column), 6).alias(name or column)


@register("bin_sum", f"SELECT user_id, bin, round(sum(value), 6) AS total FROM (SELECT *, (row_number() OVER ({W}) - 1) // 4 + 1 AS bin FROM {P_SQL}) GROUP BY user_id, bin HAVING count(*) = 4")
def bin_sum(spark, d):
    return od.bin_sum(points(spark, d), BY, ORDER, "value", 4).select("user_id", F.col("bin").cast("long").alias("bin"), r6("total"))


@register("bin_mean_partial", f"SELECT chr, pos // 86400 AS bin, round(avg(value), 6) AS value, count(value) AS size FROM {P_SQL} GROUP BY ALL")
def bin_mean_partial(spark, d):
    return od.bin_values(points(spark, d), ["chr"], "pos", "value", 86400).select("chr", "bin", r6("value"), "size")


@register("bin_median", f"SELECT chr, pos // 86400 AS bin, round(median(value), 6) AS value FROM {P_SQL} GROUP BY ALL")
def bin_median(spark, d):
    return od.bin_values(points(spark, d), ["chr"], "pos", "value", 86400, "median").select("chr", "bin", r6("value"))


_P60 = f"(SELECT id, chr, pos % 60000 AS pos, value FROM {P_SQL})"


@register(
    "region_bin_cover",
    f"""SELECT b.id AS region, (p.pos - b."from") // 8 + 1 AS bin, least(8, b."to" - b."from" + 1 - ((p.pos - b."from") // 8) * 8) AS places, round(sum(value), 6) AS total
    FROM {B_SQL} b JOIN {_P60} p ON p.chr = b.chr AND p.pos BETWEEN b."from" AND b."to" GROUP BY ALL""",
)
def region_bin_cover(spark, d):
    p = points(spark, d).select("id", "chr", (F.col("pos") % 60000).alias("pos"), "value")
    return od.region_bins(intervals_b(spark, d), p, 8).select("region", "bin", F.col("places").cast("long").alias("places"), r6("total"))


@register("roll_sum", f"SELECT id, round(sum(value) OVER ({W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 6) AS rolled FROM {P_SQL}")
def roll_sum(spark, d):
    return od.roll_sum(points(spark, d), BY, ORDER, "value", 3).select("id", r6("rolled"))


@register("roll_sum_drop", f"SELECT id, round(rolled, 6) AS rolled FROM (SELECT id, sum(value) OVER ({W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS rolled, count(*) OVER ({W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM {P_SQL}) WHERE n = 3")
def roll_sum_drop(spark, d):
    return od.roll_sum(points(spark, d), BY, ORDER, "value", 3, True).select("id", r6("rolled"))


@register("shift_lead", f"SELECT id, lead(value, 2, -1.0) OVER ({W}) AS shifted FROM {P_SQL}")
def shift_lead(spark, d):
    return od.shift(points(spark, d), BY, ORDER, "value", 2, -1.0).select("id", "shifted")


@register("shift_lag", f"SELECT id, lag(value, 1) OVER ({W}) AS shifted FROM {P_SQL}")
def shift_lag(spark, d):
    return od.shift(points(spark, d), BY, ORDER, "value", -1).select("id", "shifted")


@register("rotate", f"SELECT id, CAST((((rn - 1 - 3) % n) + n) % n + 1 AS BIGINT) AS place FROM (SELECT id, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM {P_SQL})")
def rotate(spark, d):
    return od.rotate(points(spark, d), BY, ORDER, 3).select("id", "place")


@register("recycle", f"SELECT id, CAST(place AS BIGINT) AS place FROM (SELECT id, unnest(range(rn, 26, n)) AS place FROM (SELECT id, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM {P_SQL}) WHERE rn <= 25)")
def recycle(spark, d):
    return od.recycle(points(spark, d), BY, ORDER, 25).select("id", "place")


@register("decimate", f"SELECT id FROM (SELECT id, row_number() OVER ({W}) AS rn FROM {P_SQL}) WHERE floor(rn * 0.25) > floor((rn - 1) * 0.25)")
def decimate(spark, d):
    return od.decimate(points(spark, d), BY, ORDER, 0.25).select("id")


@register("head_neg", f"SELECT id FROM (SELECT id, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM {P_SQL}) WHERE rn <= n - 5")
def head_neg(spark, d):
    return od.head(points(spark, d), BY, ORDER, -5).select("id")


@register("tail_neg", f"SELECT id FROM (SELECT id, row_number() OVER ({W}) AS rn FROM {P_SQL}) WHERE rn > 5")
def tail_neg(spark, d):
    return od.tail(points(spark, d), BY, ORDER, -5).select("id")


_DAYS = "(SELECT DISTINCT o_custkey % 22 + 1 AS chr, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS pos FROM orders)"


def _days(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 22 + 1).alias("chr"), seconds("o_orderdate").alias("at")).distinct()


@register("find_interval", f"SELECT id, greatest(1, (SELECT count(*) FROM {_DAYS} b WHERE b.chr = p.chr AND b.pos <= p.pos)) AS place FROM {P_SQL} p")
def find_interval(spark, d):
    return od.find_interval(points(spark, d), _days(spark, d), ["chr"], "pos", "at", ["id"]).select("id", "place")


_LATE = f"(SELECT chr, pos + 3600 AS at_, max(value) AS v FROM {P_SQL} WHERE event_type = 'purchase' GROUP BY ALL)"


@register("asof_tolerance", f"SELECT id, CASE WHEN p.pos - b.at_ <= 7200 THEN b.at_ ELSE -1 END AS found_at, CASE WHEN p.pos - b.at_ <= 7200 THEN b.v END AS v FROM {P_SQL} p ASOF LEFT JOIN {_LATE} b ON p.chr = b.chr AND p.pos >= b.at_")
def asof_tolerance(spark, d):
    p = points(spark, d)
    late = p.where("event_type = 'purchase'").groupBy("chr", (F.col("pos") + 3600).alias("at")).agg(F.max("value").alias("v"))
    return od.asof(p.drop("value"), late, ["chr"], "pos", "at", "v", ["id"], 7200).select("id", F.coalesce("found_at", F.lit(-1)).alias("found_at"), "v")


_RLE = f"""(SELECT user_id, run, min(event_type) AS state, min(pos) AS "from", max(pos) AS "to", count(*) AS size FROM (SELECT *, CAST(sum(new) OVER ({W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (
  SELECT *, CASE WHEN event_type = lag(event_type) OVER ({W}) THEN 0 ELSE 1 END AS new FROM {P_SQL})) GROUP BY user_id, run)"""


@register("rle_segments", f"""SELECT user_id, run, state, "from", "to", size FROM {_RLE}""")
def rle_segments(spark, d):
    return od.run_lengths(points(spark, d), BY, ORDER, "event_type", "pos")


@register(
    "fuse_segments",
    f"""SELECT chr, state, min("from") AS "from", arg_max("to", "from") AS "to", count(*) AS fused FROM (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY "from", "to" ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN state = lag(state) OVER w AND "from" - lag("to") OVER w < 5000 THEN 0 ELSE 1 END AS new FROM (SELECT chr, "from", "to", id % 2 AS state FROM {B_SQL}) WINDOW w AS (PARTITION BY chr ORDER BY "from", "to"))) GROUP BY chr, g, state""",
)
def fuse_segments(spark, d):
    return od.fuse(intervals_b(spark, d).withColumn("state", F.col("id") % 2), ["chr"], 5000)


@register("window_mean_prefix", f"SELECT id, round(sum(value) OVER w / count(*) OVER w, 6) AS mean FROM {P_SQL} WINDOW w AS ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def window_mean_prefix(spark, d):
    return od.window_mean(points(spark, d), BY, ORDER, "value", 2).select("id", r6("mean"))


_DAILY = f"(SELECT chr, pos // 86400 AS day, count(*) AS n FROM {P_SQL} GROUP BY ALL)"


def _daily(spark, d):
    return points(spark, d).groupBy("chr", F.floor(F.col("pos") / 86400).alias("day")).agg(F.count("*").alias("n"))


@register("local_maxima", f"SELECT chr, day, n FROM (SELECT *, lag(n) OVER w AS a, lead(n) OVER w AS b, max(n) OVER (PARTITION BY chr) AS top FROM {_DAILY} WINDOW w AS (PARTITION BY chr ORDER BY day)) WHERE (a IS NULL OR n > a) AND (b IS NULL OR n >= b) AND n >= 0.1 * top")
def local_maxima(spark, d):
    return od.local_maxima(_daily(spark, d), ["chr"], ["day"], "n", 0.1)


@register("running_median3", f"""SELECT chr, day, CAST(coalesce(m, CASE WHEN rn = 1 THEN first_value(m IGNORE NULLS) OVER a ELSE last_value(m IGNORE NULLS) OVER a END, n) AS DOUBLE) AS smooth FROM (
  SELECT chr, day, n, rn, CASE WHEN rn > 1 AND rn < c THEN m END AS m FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY chr) AS c, median(n) OVER (PARTITION BY chr ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM {_DAILY} WINDOW w AS (PARTITION BY chr ORDER BY day)))
  WINDOW a AS (PARTITION BY chr ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def running_median3(spark, d):
    return od.running_median(_daily(spark, d), ["chr"], ["day"], "n", 3).select("chr", "day", F.col("smooth").cast("double").alias("smooth"))


@register("smooth_median")
def smooth_median(spark, d):
    return od.smooth(_daily(spark, d), ["chr"], "day", "n", (3, 5))


_PIV = f"(SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS a, count(*) FILTER (WHERE event_type = 'error') AS c, count(*) FILTER (WHERE event_type = 'purchase') AS g, count(*) FILTER (WHERE event_type = 'signup') AS t FROM {P_SQL} GROUP BY user_id)"


def counts4(spark, d):
    """Allele-like counts: four kinds of event by user."""
    kinds = (("a", "click"), ("c", "error"), ("g", "purchase"), ("t", "signup"))
    return points(spark, d).groupBy("user_id").agg(*[F.count_if(F.col("event_type") == e).alias(n) for n, e in kinds])


@register("row_max_min", f"SELECT user_id, greatest(a, c, g, t) AS hi, CAST(list_position([a, c, g, t], greatest(a, c, g, t)) AS BIGINT) AS hi_at, least(a, c, g, t) AS lo, CAST(list_position([a, c, g, t], least(a, c, g, t)) AS BIGINT) AS lo_at FROM {_PIV}")
def row_max_min(spark, d):
    hi, hi_at, lo, lo_at = od.row_extremes(["a", "c", "g", "t"])
    return counts4(spark, d).select("user_id", hi.alias("hi"), hi_at.alias("hi_at"), lo.alias("lo"), lo_at.alias("lo_at"))


@register("scale01", f"SELECT id, round(CASE WHEN hi = lo THEN 0.0 ELSE (value - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT id, value, min(value) OVER (PARTITION BY chr) AS lo, max(value) OVER (PARTITION BY chr) AS hi FROM {P_SQL})")
def scale01(spark, d):
    return od.scale(points(spark, d), ["chr"], "value").select("id", r6("scaled"))


@register("to_base16", f"SELECT id, upper(to_hex(id)) AS hex FROM {B_SQL}")
def to_base16(spark, d):
    return intervals_b(spark, d).select("id", F.conv(F.col("id").cast("string"), 10, 16).alias("hex"))
