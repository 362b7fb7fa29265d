"""Region selection, sampling and bitmaps over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.draws import draw_sql
from tessera.operators import regions as rg
from tessera.plans.adapters import A_SQL, P_SQL, intervals_a, points
from tessera.plans.catalogue import register
from tessera.plans.interval_queries import islands_sql
from tessera.plans.ordered_queries import _DAILY, _daily

_BINS = f'(SELECT chr, day * 10 + 1 AS "from", day * 10 + 10 AS "to", n FROM {_DAILY})'


def _bins(spark, d):
    return _daily(spark, d).select("chr", (F.col("day") * 10 + 1).alias("from"), (F.col("day") * 10 + 10).alias("to"), "n")


@register("regions_by_range", f"""SELECT chr, "from", "to" FROM {islands_sql(f'(SELECT * FROM {_BINS} WHERE n BETWEEN 10 AND 20)', 10)} WHERE "to" - "from" + 1 >= 20""")
def regions_by_range(spark, d):
    return rg.by_range(_bins(spark, d), "n", 10, 20, 10, 20)


_STRATUM = "(CASE WHEN n >= 8 THEN 1 ELSE 0 END) + (CASE WHEN n >= 14 THEN 1 ELSE 0 END) + (CASE WHEN n >= 20 THEN 1 ELSE 0 END)"
_KEYED = f"""(SELECT chr * 10 + s AS chr, "from", "to" FROM (SELECT *, {_STRATUM} AS s FROM {_BINS}) WHERE s > 0)"""


@register("regions_by_strata", f"""SELECT CAST(chr % 10 AS INTEGER) AS stratum, chr // 10 AS chr, "from", "to" FROM {islands_sql(_KEYED)}""")
def regions_by_strata(spark, d):
    return rg.strata(_bins(spark, d), "n", [8, 14, 20])


@register("bins_within", f"""SELECT b.chr AS chr, b."from" AS "from", b.n AS n FROM {_BINS} b WHERE EXISTS (SELECT 1 FROM {islands_sql(f'(SELECT * FROM {_BINS} WHERE n > 12)')} r WHERE r.chr = b.chr AND r."from" <= b."from" AND r."to" >= b."to")""")
def bins_within(spark, d):
    b = _bins(spark, d)
    return rg.within(b, rg.where(b, F.col("n") > 12)).select("chr", "from", "n")


_SETS = f"""(SELECT DISTINCT chr, "from" AS pos FROM {A_SQL} WHERE ("to" - "from") % 2 = 0), y AS (SELECT DISTINCT chr, "from" AS pos FROM {A_SQL} WHERE ("to" - "from") % 3 = 0)"""


def _sets(spark, d):
    a = intervals_a(spark, d).withColumn("w", F.col("to") - F.col("from"))
    return tuple(rg.to_bits(a.where(F.col("w") % k == 0).select("chr", F.col("from").alias("pos"))) for k in (2, 3))


@register("bits_union", f"WITH x AS {_SETS} SELECT chr, count(*) AS n FROM (SELECT * FROM x UNION SELECT * FROM y) GROUP BY chr")
def bits_union(spark, d):
    return rg.count_bits(rg.union_bits(*_sets(spark, d)))


@register("bits_inter", f"WITH x AS {_SETS} SELECT chr, count(*) AS n FROM (SELECT * FROM x INTERSECT SELECT * FROM y) GROUP BY chr")
def bits_inter(spark, d):
    return rg.count_bits(rg.inter_bits(*_sets(spark, d)))


@register("spaced_sample", f"SELECT chr, pos FROM (SELECT chr, pos, row_number() OVER (PARTITION BY chr, pos // 3600 ORDER BY {draw_sql(0, 'chr', 'pos')}, pos) AS k FROM (SELECT DISTINCT chr, pos FROM {P_SQL}) WHERE pos % 3600 < 1800) WHERE k = 1")
def spaced_sample(spark, d):
    return rg.sample_spaced(points(spark, d), 3600)


@register("strata_sample", f"SELECT event_type, least(count(*), 50) AS n FROM {P_SQL} GROUP BY event_type")
def strata_sample(spark, d):
    """The draw itself depends on a hash; that each stratum gives its share doesn't."""
    return rg.sample_strata(points(spark, d), "event_type", 50, 1, "id").groupBy("event_type").agg(F.count("*").alias("n"))
