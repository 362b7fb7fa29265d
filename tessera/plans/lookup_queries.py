"""Lookups, rows put together, functions by region, maps and matrices, and samples over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import maps
from tessera.functions.draws import draw_sql, unit_sql
from tessera.operators import alleles as al, coords, intervals as iv, lookups as lk, tables as tb
from tessera.plans.adapters import A_SQL, B_SQL, P_SQL, intervals_a, intervals_b, points
from tessera.plans.catalogue import register, table
from tessera.plans.interval_queries import SEQ_SQL, SMALL_A, _seq, _small_a
from tessera.plans.ordered_queries import r6
from tessera.sources import texts

_NEAR = f"""(SELECT x.id AS a_id, y.id AS b_id, greatest(0, y."from" - x."to", x."from" - y."to") AS distance FROM {A_SQL} x JOIN {B_SQL} y ON x.chr = y.chr WHERE x.id % 7 = 0 OR true)"""


@register("iv_neighbours", f"SELECT a_id, b_id, distance FROM (SELECT *, min(distance) OVER (PARTITION BY a_id) AS least FROM {_NEAR}) WHERE distance = least")
def neighbours(spark, d):
    return iv.neighbours(intervals_a(spark, d), intervals_b(spark, d))


@register("iv_neighbours_named", f"SELECT 'a' || a_id AS a_id, 'b' || b_id AS b_id, distance FROM (SELECT *, min(distance) OVER (PARTITION BY a_id) AS least FROM {_NEAR}) WHERE distance = least")
def neighbours_named(spark, d):
    """The same with ids that are texts."""
    a, b = ((f(spark, d).withColumn("id", F.concat(F.lit(n), F.col("id").cast("string")))) for f, n in ((intervals_a, "a"), (intervals_b, "b")))
    return iv.neighbours(a, b)


_SITES = f"(SELECT chr, pos % 20000 AS pos, count(*) AS n FROM {P_SQL} GROUP BY ALL)"


def _sites(spark, d):
    return points(spark, d).groupBy("chr", (F.col("pos") % 20000).alias("pos")).agg(F.count("*").alias("n"))


@register("point_lookup", f"""SELECT id, coalesce(n, 0) AS n FROM (SELECT id, chr, "from" AS pos FROM {A_SQL}) a LEFT JOIN {_SITES} s ON a.chr = s.chr AND a.pos = s.pos""")
def point_lookup(spark, d):
    return lk.at_points(intervals_a(spark, d).select("id", "chr", F.col("from").alias("pos")), _sites(spark, d), ["n"]).select("id", "n")


@register("kmers_at_points", "SELECT doc_id, pos, nullif(substr(text, CAST(pos AS BIGINT), 5), '') AS kmer FROM (SELECT doc_id, text, unnest([1, 62, 64, 500, 100000]) AS pos FROM documents WHERE length(text) > 0)")
def kmers_at_points(spark, d):
    docs = table(spark, d, "documents").where("text <> ''")
    at = docs.select("doc_id", F.col("doc_id").alias("chr"), F.explode(F.array(*map(F.lit, (1, 62, 64, 500, 100000)))).alias("pos"))
    return lk.kmers_at(at, texts.chunks(docs.select(F.col("doc_id").alias("index"), F.col("text").alias("seq")), 64), 5, 64).select("doc_id", "pos", "kmer")


@register("membership", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) AS member FROM customer")
def membership(spark, d):
    return lk.member(table(spark, d, "customer"), table(spark, d, "orders").where("o_orderkey % 2 = 0"), "c_custkey", "o_custkey").select("c_custkey", "member")


@register("row_bind", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def row_bind(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return lk.bind(n, table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


_P60 = f"(SELECT chr, pos % 60000 AS pos, value FROM {P_SQL})"


@register("region_apply", f"""SELECT b.id AS id, count(p.pos) AS n, round(max(p.value), 6) AS top FROM {B_SQL} b LEFT JOIN {_P60} p ON p.chr = b.chr AND p.pos BETWEEN b."from" AND b."to" GROUP BY b.id""")
def region_apply(spark, d):
    p = points(spark, d).select("chr", (F.col("pos") % 60000).alias("pos"), "value")
    out = lk.by_region(p, intervals_b(spark, d), {"n": F.count("*"), "top": F.max("value")})
    return out.select("id", F.coalesce("n", F.lit(0)).alias("n"), r6("top"))


@register("chr_apply", f"SELECT chr, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM {P_SQL} GROUP BY chr")
def chr_apply(spark, d):
    def spread(part):
        return part.groupby("chr", as_index=False).agg(n=("value", "size"), top=("value", "max"), low=("value", "min")).assign(spread=lambda x: (x.top - x.low).round(6))[["chr", "n", "spread"]]

    return lk.apply_by_chr(points(spark, d).select("chr", "value"), spread, "chr long, n long, spread double")


@register("sloc_abs", f"""SELECT id, CAST(a."from" + s."offset" AS BIGINT) AS abs_from, CAST(a."to" + s."offset" AS BIGINT) AS abs_to FROM {SMALL_A} a JOIN {SEQ_SQL} s ON a.chr = s."index" """)
def sloc_abs(spark, d):
    return coords.sloc_to_absolute(coords.format_sloc(_small_a(spark, d), _seq(spark, d)).select("id", "sloc"), _seq(spark, d)).select("id", "abs_from", "abs_to")


@register("abs_sloc", f"""SELECT id, s.name || ':' || a."from" || '-' || a."to" AS sloc FROM {SMALL_A} a JOIN {SEQ_SQL} s ON a.chr = s."index" """)
def abs_sloc(spark, d):
    return coords.absolute_to_sloc(coords.to_absolute(_small_a(spark, d), _seq(spark, d)).select("id", "abs_from", "abs_to"), _seq(spark, d)).select("id", "sloc")


@register("abs_lists", f"""SELECT chr, count(*) AS n, string_agg("from" || '-' || "to", ',' ORDER BY "from", "to") AS spans FROM {SMALL_A} GROUP BY chr""")
def abs_lists(spark, d):
    out = coords.absolute_to_lists(coords.to_absolute(_small_a(spark, d), _seq(spark, d)).select("abs_from", "abs_to"), _seq(spark, d))
    return out.select("chr", F.size("spans").cast("long").alias("n"), F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["from"], s["to"])), ",").alias("spans"))


@register("lists_abs", f"""SELECT CAST(a."from" + s."offset" AS BIGINT) AS abs_from, CAST(a."to" + s."offset" AS BIGINT) AS abs_to FROM {SMALL_A} a JOIN {SEQ_SQL} s ON a.chr = s."index" """)
def lists_abs(spark, d):
    return coords.lists_to_absolute(coords.to_lists(_small_a(spark, d)), _seq(spark, d))


@register("key_translate", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' ELSE CAST(n_regionkey AS VARCHAR) END AS place FROM nation")
def key_translate(spark, d):
    names = F.create_map(F.lit("0"), F.lit("south"), F.lit("1"), F.lit("west"))
    return table(spark, d, "nation").select("n_nationkey", maps.translate(F.col("n_regionkey").cast("string"), names).alias("place"))


@register("reverse_dict", "SELECT source AS value, string_agg(lang, ',' ORDER BY lang) AS keys FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY source")
def reverse_dict(spark, d):
    sets = table(spark, d, "documents").groupBy("lang").agg(F.collect_set("source").alias("sources"))
    return maps.reverse(sets, "lang", "sources").select("value", F.array_join("keys", ",").alias("keys"))


@register("cross_product", "WITH m AS (SELECT sum(l_quantity * l_tax) AS a, sum(l_quantity * l_discount) AS b, sum(l_linenumber * l_tax) AS c, sum(l_linenumber * l_discount) AS e FROM lineitem) SELECT 'q' AS row_name, 'tax' AS column_name, round(a, 4) AS value FROM m UNION ALL SELECT 'q', 'discount', round(b, 4) FROM m UNION ALL SELECT 'l', 'tax', round(c, 4) FROM m UNION ALL SELECT 'l', 'discount', round(e, 4) FROM m")
def cross_product(spark, d):
    c = F.col
    out = maps.cross_product(table(spark, d, "lineitem"), "row_name", {"q": c("l_quantity"), "l": c("l_linenumber")}, {"tax": c("l_tax"), "discount": c("l_discount")})
    return out.select("row_name", "column_name", F.round("value", 4).alias("value"))


@register("upper_triangle", f"SELECT user_id, list_aggregate([a, c, g, 0], 'sum') AS total, g AS back FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS a, count(*) FILTER (WHERE event_type = 'error') AS c, count(*) FILTER (WHERE event_type = 'purchase') AS g FROM {P_SQL} GROUP BY user_id)")
def upper_triangle(spark, d):
    """Three numbers of each user as the upper triangle of a matrix, summed over it, and the last of them read back from below the diagonal."""
    kinds = ("click", "error", "purchase")
    rows = points(spark, d).groupBy("user_id").agg(F.array(*[F.count_if(F.col("event_type") == k).cast("double") for k in kinds]).alias("v"))
    m = rows.withColumn("m", maps.from_upper(F.col("v"), 3))
    upper = maps.to_upper(F.col("m"), 3)
    return m.select("user_id", F.aggregate(upper, F.lit(0.0), lambda s, x: s + x).cast("long").alias("total"), F.get(F.get("m", F.lit(2)), F.lit(1)).cast("long").alias("back"))


@register("uniform_sample", f"SELECT o_orderkey FROM orders ORDER BY {draw_sql(3, 'o_orderkey')}, o_orderkey LIMIT 100")
def uniform_sample(spark, d):
    return tb.uniform_sample(table(spark, d, "orders"), 100, 3, "o_orderkey").select("o_orderkey")


@register("weighted_sample", f"SELECT o_orderkey FROM orders WHERE o_totalprice > 0 ORDER BY ln({unit_sql(7, 'o_orderkey')}) / o_totalprice DESC, o_orderkey LIMIT 100")
def weighted_sample(spark, d):
    return tb.weighted_sample(table(spark, d, "orders"), "o_totalprice", 100, 7, "o_orderkey").select("o_orderkey")


@register("allele_sample", f"SELECT chr, pos, n FROM {_SITES} WHERE {unit_sql(5, 'chr', 'pos')} * (SELECT count(*) FROM {_SITES}) < 400")
def allele_sample(spark, d):
    return al.sample(_sites(spark, d), 400, 5)


_REDUCED = "WITH r AS (SELECT chr, \"from\", \"to\" - \"from\" + 1 AS w FROM {rows}), p AS (SELECT *, coalesce(sum(w) OVER (ORDER BY chr, \"from\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM r), t AS (SELECT CAST(sum(w) AS BIGINT) AS total, least(500, CAST(sum(w) AS BIGINT) // 2) AS size FROM r)"


def _sample_sql(rows: str) -> str:
    return _REDUCED.format(rows=rows) + f""", k AS (SELECT id, {draw_sql(0, 'id')} % (SELECT total FROM t) AS number FROM (SELECT unnest(range(0, 2 * (SELECT size FROM t) + 64)) AS id)),
    s AS (SELECT number, min(id) AS id FROM k GROUP BY number ORDER BY 2 LIMIT (SELECT size FROM t))
    SELECT chr, CAST("from" + number - first AS BIGINT) AS pos FROM s JOIN p ON number >= first AND number < first + w"""


def _register_sample():
    from tessera.plans.interval_queries import RA

    @register("position_sample", _sample_sql(RA))
    def position_sample(spark, d):
        return iv.sample_positions(intervals_a(spark, d), 500)


_register_sample()


@register("segment_p", f"""WITH s AS (SELECT user_id, (avg(value) - 50) / stddev_samp(value) * sqrt(count(*)) AS z FROM {P_SQL} GROUP BY user_id HAVING count(*) > 2), x AS (SELECT user_id, abs(z) / sqrt(2.0) AS x FROM s), t AS (SELECT user_id, x, 1 / (1 + 0.3275911 * x) AS t FROM x)
    SELECT user_id, round(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x), 6) AS p FROM t""")
def segment_p(spark, d):
    s = points(spark, d).groupBy("user_id").agg(((F.avg("value") - 50) / F.stddev_samp("value") * F.sqrt(F.count("*"))).alias("z"), F.count("*").alias("n")).where("n > 2")
    return s.select("user_id", F.round(tb.two_sided(F.col("z")), 6).alias("p"))


@register("objective_rsq", "SELECT l_returnflag, round(1 - sum((l_quantity - 25) * (l_quantity - 25)) / (var_pop(l_quantity) * count(l_quantity)), 6) AS r FROM lineitem GROUP BY l_returnflag")
def objective_rsq(spark, d):
    rows = table(spark, d, "lineitem").withColumn("said", F.lit(25.0))
    return rows.groupBy("l_returnflag").agg(F.round(tb.objective("rsq", "l_quantity", "said"), 6).alias("r"))


@register("quantile_groups", f"SELECT chr, round(quantile_cont(value, 0.9), 6) AS q FROM {P_SQL} GROUP BY chr")
def quantile_groups(spark, d):
    return tb.quantile(points(spark, d), ["chr"], "value", 0.9, "q").select("chr", r6("q"))
