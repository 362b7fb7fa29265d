"""Interval algebra over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import coords, intervals as iv
from tessera.plans.adapters import A_SQL, B_SQL, P_SQL, intervals_a, intervals_b, points
from tessera.plans.catalogue import register, table


def islands_sql(rows: str, delta: int = 0) -> str:
    """chr, from, to of the islands of a subquery."""
    return f"""(SELECT chr, min("from") AS "from", max("to") AS "to" FROM (
      SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY "from", "to" ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN "from" - max("to") OVER (PARTITION BY chr ORDER BY "from", "to" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 <= {delta} THEN 0 ELSE 1 END AS new FROM {rows}))
      GROUP BY chr, g)"""


def _spans(df: DataFrame) -> DataFrame:
    return df.select(F.col("chr").cast("long").alias("chr"), F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"))


def spans_sql(rows: str) -> str:
    return f"""SELECT CAST(chr AS BIGINT) AS chr, CAST("from" AS BIGINT) AS "from", CAST("to" AS BIGINT) AS "to" FROM {rows}"""


RA, RB = islands_sql(A_SQL), islands_sql(B_SQL)


@register("iv_coverage_by_chr", f"""SELECT CAST(chr AS BIGINT) AS chr, count(*) AS n_islands, CAST(sum("to" - "from" + 1) AS BIGINT) AS covered FROM {RA} GROUP BY chr""")
def coverage_by_chr(spark: SparkSession, d: str) -> DataFrame:
    return iv.reduce(intervals_a(spark, d)).groupBy("chr").agg(F.count("*").alias("n_islands"), F.sum(F.col("to") - F.col("from") + 1).alias("covered"))


@register("iv_reduce", spans_sql(RA))
def reduce_(spark, d):
    return _spans(iv.reduce(intervals_a(spark, d)))


@register("iv_join_delta", spans_sql(islands_sql(A_SQL, 10)))
def join_delta(spark, d):
    return _spans(iv.join(intervals_a(spark, d), 10))


@register("iv_join_minsize", spans_sql(f'(SELECT * FROM {islands_sql(A_SQL, 2)} WHERE "to" - "from" + 1 >= 40)'))
def join_minsize(spark, d):
    return _spans(iv.join(intervals_a(spark, d), 2, 40))


@register("iv_threshold", spans_sql(f'{A_SQL} WHERE "to" - "from" + 1 >= 20'))
def threshold(spark, d):
    return _spans(iv.threshold(intervals_a(spark, d), 20))


@register("iv_union", spans_sql(islands_sql(f'(SELECT chr, "from", "to" FROM {A_SQL} UNION ALL SELECT chr, "from", "to" FROM {B_SQL})')))
def union(spark, d):
    return _spans(iv.union(intervals_a(spark, d), intervals_b(spark, d)))


_INTER = f"""(SELECT x.chr AS chr, greatest(x."from", y."from") AS "from", least(x."to", y."to") AS "to" FROM {RA} x JOIN {RB} y ON x.chr = y.chr AND x."from" <= y."to" AND y."from" <= x."to")"""


@register("iv_inter", spans_sql(islands_sql(_INTER)))
def inter(spark, d):
    return _spans(iv.inter(intervals_a(spark, d), intervals_b(spark, d)))


_EXCLUDE = f"""(SELECT chr, "from", "to" FROM (
  SELECT x.chr AS chr, x."from" AS xf, coalesce(lag(y."to") OVER w + 1, x."from") AS "from", y."from" - 1 AS "to" FROM {RA} x JOIN {RB} y ON x.chr = y.chr AND x."from" <= y."to" AND y."from" <= x."to" WINDOW w AS (PARTITION BY x.chr, x."from" ORDER BY y."from")
  UNION ALL SELECT x.chr, x."from", coalesce(max(y."to") + 1, x."from"), x."to" FROM {RA} x LEFT JOIN {RB} y ON x.chr = y.chr AND x."from" <= y."to" AND y."from" <= x."to" GROUP BY x.chr, x."from", x."to") WHERE "from" <= "to")"""


@register("iv_exclude", spans_sql(_EXCLUDE))
def exclude(spark, d):
    return _spans(iv.exclude(intervals_a(spark, d), intervals_b(spark, d)))


@register("iv_complement", spans_sql(f"""(SELECT chr, "to" + 1 AS "from", lead("from") OVER (PARTITION BY chr ORDER BY "from") - 1 AS "to" FROM {RA}) WHERE "to" IS NOT NULL"""))
def complement(spark, d):
    a = intervals_a(spark, d)
    return _spans(iv.complement(a, a.groupBy("chr").agg(F.min("from").alias("from"), F.max("to").alias("to"))))


@register("iv_trim", spans_sql(f"""(SELECT chr, "from" + 5 AS "from", "to" - 5 AS "to" FROM {A_SQL}) WHERE "from" <= "to" """))
def trim(spark, d):
    return _spans(iv.trim(intervals_a(spark, d), 5))


_DEPTH = f"""(SELECT chr, p AS "from", lead(p) OVER (PARTITION BY chr ORDER BY p) - 1 AS "to", CAST(sum(d) OVER (PARTITION BY chr ORDER BY p ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM (
    SELECT chr, p, sum(d) AS d FROM (SELECT chr, "from" AS p, 1 AS d FROM {A_SQL} UNION ALL SELECT chr, "to" + 1, -1 FROM {A_SQL}) GROUP BY chr, p HAVING sum(d) <> 0))"""


@register("iv_depth", f'SELECT chr, "from", "to", depth FROM {_DEPTH} WHERE depth > 0')
def depth(spark, d):
    return iv.depth(intervals_a(spark, d)).select("chr", "from", "to", F.col("depth").cast("long").alias("depth"))


_PAIRS = f"""FROM {A_SQL} x JOIN {B_SQL} y ON x.chr = y.chr AND x."from" <= y."to" AND y."from" <= x."to" """


@register("iv_overlap", f"""SELECT x.id AS a_id, y.id AS b_id, greatest(x."from", y."from") AS "from", least(x."to", y."to") AS "to" {_PAIRS}""")
def overlap(spark, d):
    return iv.overlap_pairs(intervals_a(spark, d), intervals_b(spark, d)).select("a_id", "b_id", "from", "to")


@register(
    "iv_overlap_list",
    f"""SELECT x.id AS a_id, count(y.id) AS n, coalesce(string_agg(CAST(y.id AS VARCHAR), ',' ORDER BY y.id), '') AS ids {_PAIRS.replace(' JOIN ', ' LEFT JOIN ', 1)} GROUP BY x.id""",
)
def overlap_list(spark, d):
    out = iv.overlap(intervals_a(spark, d), intervals_b(spark, d))
    return out.select("a_id", F.size("b_ids").cast("long").alias("n"), F.array_join("b_ids", ",").alias("ids"))


@register(
    "iv_nearest",
    f"""WITH a AS {A_SQL}, b AS {B_SQL},
    d AS (SELECT a.id AS a_id, greatest(0, b."from" - a."to", a."from" - b."to") AS dist FROM a JOIN b ON a.chr = b.chr AND b."from" <= a."to" + 4000 AND b."to" >= a."from" - 4000),
    m AS (SELECT a_id, min(dist) AS distance FROM d GROUP BY a_id),
    far AS (SELECT a.id AS a_id, min(greatest(0, b."from" - a."to", a."from" - b."to")) AS distance FROM a JOIN b ON a.chr = b.chr WHERE a.id NOT IN (SELECT a_id FROM m) GROUP BY a.id),
    alls AS (SELECT * FROM m UNION ALL SELECT * FROM far)
    SELECT a.id AS a_id, alls.distance AS distance, CASE WHEN alls.distance IS NULL THEN 0 ELSE (SELECT count(*) FROM b WHERE b.chr = a.chr AND greatest(0, b."from" - a."to", a."from" - b."to") = alls.distance) END AS ties
    FROM a LEFT JOIN alls ON a.id = alls.a_id""",
)
def nearest(spark, d):
    return iv.nearest(intervals_a(spark, d), intervals_b(spark, d))


@register("iv_included", f"""WITH a AS {A_SQL}, b AS {B_SQL} SELECT a.id AS a_id, EXISTS (SELECT 1 FROM b WHERE b.chr = a.chr AND b."from" <= a."from" AND b."to" >= a."to") AS included FROM a""")
def included(spark, d):
    return iv.included(intervals_a(spark, d), intervals_b(spark, d))


@register("iv_covered", f"""WITH a AS {A_SQL}, b AS {RB} SELECT a.id AS a_id, EXISTS (SELECT 1 FROM b WHERE b.chr = a.chr AND b."from" <= a."from" AND b."to" >= a."to") AS covered FROM a""")
def covered(spark, d):
    return iv.covered(intervals_a(spark, d), intervals_b(spark, d))


@register("iv_points_covered", f"""WITH a AS (SELECT id, chr, pos % 60000 AS p FROM {P_SQL}), b AS {RB} SELECT a.id AS a_id, EXISTS (SELECT 1 FROM b WHERE b.chr = a.chr AND b."from" <= a.p AND b."to" >= a.p) AS covered FROM a""")
def points_covered(spark, d):
    p = points(spark, d).select("id", "chr", (F.col("pos") % 60000).alias("from"), (F.col("pos") % 60000).alias("to"))
    return iv.covered(p, intervals_b(spark, d))


@register("iv_is_valid", f"""SELECT bool_and("from" >= 1 AND "from" <= "to") AS ok FROM {A_SQL}""")
def is_valid(spark, d):
    return iv.is_valid(intervals_a(spark, d))


@register("iv_is_unsorted", f"""SELECT bool_or(b) AS unsorted FROM (SELECT "from" < lag("from") OVER (PARTITION BY chr ORDER BY id) AS b FROM {B_SQL})""")
def is_unsorted(spark, d):
    return iv.is_unsorted(intervals_b(spark, d), "id")


@register("iv_is_disjoint_strong", f"""SELECT NOT bool_or(b) AS disjoint FROM (SELECT max("to") OVER (PARTITION BY chr ORDER BY "from", "to" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= "from" AS b FROM {A_SQL})""")
def is_disjoint_strong(spark, d):
    return iv.is_disjoint(intervals_a(spark, d), True)


@register("iv_is_disjoint_weak", f"""SELECT NOT EXISTS (SELECT 1 FROM {RA} x JOIN {RA} y ON x.chr = y.chr AND x."from" <= y."from" AND x."to" >= y."to" AND (x."from", x."to") <> (y."from", y."to")) AS disjoint""")
def is_disjoint_weak(spark, d):
    return iv.is_disjoint(iv.reduce(intervals_a(spark, d)), False)


@register("iv_sort", f"""SELECT id, row_number() OVER (PARTITION BY chr ORDER BY "to", "from", id) AS idx FROM {B_SQL}""")
def sort(spark, d):
    return iv.sort_index(intervals_b(spark, d), "id").select("id", F.col("idx").cast("long").alias("idx"))


@register("iv_group", f"""SELECT chr, string_agg("from" || '-' || "to", ',' ORDER BY "from", "to") AS spans FROM {B_SQL} GROUP BY chr""")
def group(spark, d):
    return iv.group_lists(intervals_b(spark, d))


SEQ_SQL = """(SELECT CAST(n_nationkey + 1 AS BIGINT) AS "index", n_name AS name, 1000 + n_nationkey * 100 AS size, 1000 * n_nationkey + 100 * (n_nationkey * (n_nationkey - 1) // 2) AS "offset" FROM nation)"""


def _seq(spark, d):
    return coords.sequences(table(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("index"), F.col("n_name").alias("name"), (1000 + F.col("n_nationkey") * 100).cast("long").alias("size")))


def _small_a(spark, d):
    return intervals_a(spark, d).select("id", "chr", (F.col("from") % 900 + 1).alias("from"), (F.col("from") % 900 + 51).alias("to"))


SMALL_A = f"""(SELECT id, chr, "from" % 900 + 1 AS "from", "from" % 900 + 51 AS "to" FROM {A_SQL})"""


@register("coord_abs", f"""SELECT id, CAST(a."from" + s."offset" AS BIGINT) AS abs_from, CAST(a."to" + s."offset" AS BIGINT) AS abs_to FROM {SMALL_A} a JOIN {SEQ_SQL} s ON a.chr = s."index" """)
def coord_abs(spark, d):
    return coords.to_absolute(_small_a(spark, d), _seq(spark, d)).select("id", "abs_from", "abs_to")


_ABS = f"""(SELECT id, id % 50000 + 1 AS abs_from, id % 50000 + 80 AS abs_to FROM {B_SQL})"""


@register("coord_rel", f"""SELECT id, s."index" AS chr, CAST(abs_from - s."offset" AS BIGINT) AS "from", CAST(abs_to - s."offset" AS BIGINT) AS "to" FROM {_ABS} a JOIN {SEQ_SQL} s ON abs_from > s."offset" AND abs_to <= s."offset" + s.size""")
def coord_rel(spark, d):
    b = intervals_b(spark, d).select("id", (F.col("id") % 50000 + 1).alias("abs_from"), (F.col("id") % 50000 + 80).alias("abs_to"))
    return coords.to_relative(b, _seq(spark, d)).select("id", "chr", "from", "to")


_SLOC = f"""(SELECT id, s.name || ':' || (a."from" - 1) || '-' || a."to" AS sloc FROM {SMALL_A} a JOIN {SEQ_SQL} s ON a.chr = s."index")"""


@register("sloc_format", f"SELECT id, sloc FROM {_SLOC}")
def sloc_format(spark, d):
    return coords.format_sloc(_small_a(spark, d), _seq(spark, d), True).select("id", "sloc")


@register("sloc_parse", f"""SELECT id, chr, "from", "to" FROM {SMALL_A}""")
def sloc_parse(spark, d):
    made = coords.format_sloc(_small_a(spark, d), _seq(spark, d), True).select("id", "sloc")
    return coords.parse_sloc(made, _seq(spark, d), True).select("id", "chr", "from", "to")


_BITS = f"""(SELECT chr, pos // 86400 AS day, count(*) > 3 AS flag FROM {P_SQL} GROUP BY ALL)"""


@register(
    "bits_runs",
    f"""SELECT chr, CAST(min(idx) * 10 - 9 AS BIGINT) AS "from", CAST(max(idx) * 10 AS BIGINT) AS "to" FROM (
    SELECT chr, idx, idx - row_number() OVER (PARTITION BY chr ORDER BY idx) AS g FROM (SELECT chr, day - (SELECT min(pos // 86400) FROM {P_SQL}) + 1 AS idx FROM {_BITS} WHERE flag)) GROUP BY chr, g HAVING max(idx) > min(idx)""",
)
def bits_runs(spark, d):
    p = points(spark, d).withColumn("day", F.floor(F.col("pos") / 86400))
    first = p.agg(F.min("day").alias("first"))
    flags = p.groupBy("chr", "day").agg((F.count("*") > 3).alias("flag")).join(F.broadcast(first)).withColumn("idx", F.col("day") - F.col("first") + 1)
    return _spans(iv.runs(flags, "flag", 1, 10, 20))


@register("bed_coverage", f"""WITH b AS {RB} SELECT b.chr AS chr, b."from" AS "from", b."to" AS "to", CAST(coalesce(sum(least(b."to", a."to") - greatest(b."from", a."from") + 1) FILTER (WHERE a.id IS NOT NULL), 0) AS BIGINT) AS depth_sum
  FROM b LEFT JOIN {A_SQL} a ON a.chr = b.chr AND a."from" <= b."to" AND b."from" <= a."to" GROUP BY ALL""")
def bed_coverage(spark, d):
    b = iv.reduce(intervals_b(spark, d)).withColumn("id", F.col("chr") * 1000000000000 + F.col("from"))
    pairs = iv.overlap_pairs(b, intervals_a(spark, d)).groupBy(F.col("a_id").alias("id")).agg(F.sum(F.col("to") - F.col("from") + 1).alias("depth_sum"))
    return b.join(pairs, "id", "left").select("chr", "from", "to", F.coalesce("depth_sum", F.lit(0)).alias("depth_sum"))


@register("depth_profile", f'SELECT depth, CAST(sum("to" - "from" + 1) AS BIGINT) AS positions FROM {_DEPTH} WHERE depth > 0 GROUP BY depth')
def depth_profile(spark, d):
    return iv.depth(intervals_a(spark, d)).groupBy(F.col("depth").cast("long").alias("depth")).agg(F.sum(F.col("to") - F.col("from") + 1).alias("positions"))

