"""Tables, statistics, strings, sequences, alleles and records over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.functions import dna, text
from tessera.operators import alleles as al, records, tables as tb
from tessera.plans.adapters import P_SQL, points
from tessera.plans.catalogue import register, table
from tessera.plans.ordered_queries import _PIV, counts4, r6

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE")


@register("cond_sum", "SELECT CAST(floor(l_quantity) AS BIGINT) AS x, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def cond_sum(spark, d):
    return tb.conditional_sum(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select("x", "n", F.round("total", 2).alias("total"))


@register("cond_sum_zero", "WITH s AS (SELECT CAST(floor(l_quantity) AS BIGINT) * 3 AS x, count(*) AS n, sum(l_tax) AS total FROM lineitem GROUP BY 1) SELECT r.x AS x, coalesce(n, 0) AS n, round(coalesce(total, 0), 4) AS total FROM (SELECT unnest(range(min(x), max(x) + 1)) AS x FROM s) r LEFT JOIN s ON r.x = s.x")
def cond_sum_zero(spark, d):
    return tb.conditional_sum(table(spark, d, "lineitem").withColumn("x", F.col("l_quantity") * 3), "x", "l_tax", True).select("x", "n", F.round("total", 4).alias("total"))


@register("table_1d_levels", f"SELECT l AS c_mktsegment, count(c_custkey) AS n FROM (SELECT unnest({list(SEGMENTS)}) AS l) LEFT JOIN customer ON c_mktsegment = l GROUP BY l")
def table_1d_levels(spark, d):
    return tb.contingency(table(spark, d, "customer"), ["c_mktsegment"], {"c_mktsegment": SEGMENTS})


_CO = "(SELECT c_mktsegment AS seg, o_orderpriority AS pri, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey)"


def _co(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("seg"), F.col("o_orderpriority").alias("pri"), F.col("o_orderstatus").alias("st"))


@register("table_kd", f"SELECT seg, pri, st, count(*) AS n FROM {_CO} GROUP BY ALL")
def table_kd(spark, d):
    return tb.contingency(_co(spark, d), ["seg", "pri", "st"])


@register("table_pairs", " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, {a} AS level1, {b} AS level2, count(*) AS n FROM {_CO} GROUP BY ALL" for a, b in (("seg", "pri"), ("seg", "st"), ("pri", "st"))))
def table_pairs(spark, d):
    return tb.pairwise(_co(spark, d), ["seg", "pri", "st"])


@register("table_facts", " UNION ALL ".join(f"SELECT '{a}' AS var, {a} AS level, count(*) AS n FROM {_CO} GROUP BY ALL" for a in ("seg", "pri", "st")))
def table_facts(spark, d):
    return tb.factor_counts(_co(spark, d), ["seg", "pri", "st"])


@register("table_margins", f"SELECT CASE WHEN grouping(seg) = 1 THEN '*' ELSE seg END AS seg, CASE WHEN grouping(st) = 1 THEN '*' ELSE st END AS st, count(*) AS n FROM {_CO} GROUP BY CUBE (seg, st)")
def table_margins(spark, d):
    return tb.margins(_co(spark, d), "seg", "st")


def _items(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 50).alias("item"))


_IT = "(SELECT l_orderkey, l_suppkey % 50 AS item FROM lineitem)"


@register("table_sets", f"SELECT item, count(DISTINCT l_orderkey) AS n FROM {_IT} GROUP BY item")
def table_sets(spark, d):
    return tb.set_table(_items(spark, d), "l_orderkey", "item")


@register("table_msets", f"SELECT item, times, count(*) AS n FROM (SELECT l_orderkey, item, count(*) AS times FROM {_IT} GROUP BY ALL) GROUP BY ALL")
def table_msets(spark, d):
    return tb.multiset_table(_items(spark, d), "l_orderkey", "item")


@register("table_coocs", f"WITH s AS (SELECT DISTINCT l_orderkey, item FROM {_IT}) SELECT x.item AS a, y.item AS b, count(*) AS n FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.item <= y.item GROUP BY ALL")
def table_coocs(spark, d):
    return tb.cooccurrence(_items(spark, d), "l_orderkey", "item")


@register("tapply_levels", f"SELECT l AS c_mktsegment, round(coalesce(avg(c_acctbal), -1), 6) AS value FROM (SELECT unnest({list(SEGMENTS)}) AS l) LEFT JOIN customer ON c_mktsegment = l GROUP BY l")
def tapply_levels(spark, d):
    return tb.tapply(table(spark, d, "customer"), "c_mktsegment", F.avg("c_acctbal"), SEGMENTS, -1.0).select("c_mktsegment", r6("value"))


_WV = "sum(l_quantity) AS v1, sum(l_quantity * l_quantity) AS v2, sum(l_quantity * l_discount) AS wx, sum(l_quantity * l_discount * l_discount) AS wxx FROM lineitem GROUP BY l_returnflag"


@register("wt_mean", f"SELECT l_returnflag, round(wx / v1, 6) AS value FROM (SELECT l_returnflag, {_WV})")
def wt_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(tb.weighted_mean("l_discount", "l_quantity"), 6).alias("value"))


@register("wt_var_repeat", f"SELECT l_returnflag, round((wxx - wx * wx / v1) / (v1 - 1), 8) AS value FROM (SELECT l_returnflag, {_WV})")
def wt_var_repeat(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(tb.weighted_var("l_discount", "l_quantity"), 8).alias("value"))


@register("wt_var_reliability", f"SELECT l_returnflag, round((wxx - wx * wx / v1) / (v1 - v2 / v1), 8) AS value FROM (SELECT l_returnflag, {_WV})")
def wt_var_reliability(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(tb.weighted_var("l_discount", "l_quantity", False), 8).alias("value"))


@register(
    "seg_stats",
    f"""WITH m AS (SELECT *, median(value) OVER (PARTITION BY user_id) AS med FROM {P_SQL}),
    s AS (SELECT user_id, count(*) AS n, stddev_samp(value) AS sd, any_value(med) AS med, 1.4826 * median(abs(value - med)) AS mad FROM m GROUP BY user_id)
    SELECT user_id, n, round(med, 6) AS med, round(mad, 6) AS mad, round(sd, 6) AS sd, round(CASE WHEN med = 50 THEN 0.0 ELSE (med - 50) / CASE WHEN mad = 0 THEN sd ELSE mad END END, 6) AS z FROM s""",
)
def seg_stats(spark, d):
    s = tb.robust(points(spark, d), ["user_id"], "value")
    return s.select("user_id", "n", r6("med"), r6("mad"), r6("sd"), F.round(tb.z_score(F.col("med"), F.lit(50.0), F.col("mad"), F.col("sd")), 6).alias("z"))


@register("mean_ploidy", f"SELECT chr, round(avg(value), 6) AS mean FROM (SELECT chr, value, quantile_cont(value, 0.01) OVER (PARTITION BY chr) AS lo, quantile_cont(value, 0.99) OVER (PARTITION BY chr) AS hi FROM {P_SQL}) WHERE value BETWEEN lo AND hi GROUP BY chr")
def mean_ploidy(spark, d):
    return tb.trimmed_mean(points(spark, d), ["chr"], "value").select("chr", r6("mean"))


@register("correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")
def correlation(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(tb.objective("pearson", "l_quantity", "l_extendedprice"), 6).alias("r"))


_LOW, _COV = 8, 40
_N = " + ".join(f"(CASE WHEN {c} > {_LOW} THEN 1 ELSE 0 END)" for c in "acgt")
_OK = f"(a + c + g + t >= {_COV} AND ({_N}) BETWEEN 1 AND 4 AND (({_N}) < 2 OR abs(greatest(a, c, g, t) / (a + c + g + t) - 0.5) <= 0.3))"


@register("allele_filter", f"SELECT user_id, a, c, g, t FROM {_PIV} WHERE a + c + g + t > 0 AND {_OK}")
def allele_filter(spark, d):
    return counts4(spark, d).where(al.passes(_LOW, _COV, 1, 4, 0.3))


@register("allele_index", f"SELECT rn FROM (SELECT row_number() OVER (ORDER BY user_id) AS rn, * FROM {_PIV}) WHERE a + c + g + t > 0 AND {_OK}")
def allele_index(spark, d):
    return counts4(spark, d).withColumn("rn", F.row_number().over(Window.orderBy("user_id")).cast("long")).where(al.passes(_LOW, _COV, 1, 4, 0.3)).select("rn")


_GENO = " || ".join(f"CASE WHEN {c} > {_LOW} THEN '{c.upper()}' ELSE '' END" for c in "acgt")


@register("genotype_string", f"SELECT user_id, {_GENO} AS geno FROM {_PIV}")
def genotype_string(spark, d):
    return counts4(spark, d).select("user_id", al.genotype(_LOW).alias("geno"))


@register("genotype_sorted", f"SELECT user_id, coalesce(string_agg(s, '' ORDER BY n DESC, s) FILTER (WHERE n > {_LOW}), '') AS geno FROM (SELECT user_id, unnest(['A', 'C', 'G', 'T']) AS s, unnest([a, c, g, t]) AS n FROM {_PIV}) GROUP BY user_id")
def genotype_sorted(spark, d):
    return counts4(spark, d).select("user_id", al.genotype(_LOW, True).alias("geno"))


@register("heterozygous", f"SELECT user_id, coalesce(a + c + g + t >= 40 AND ({_N}) = 2 AND abs(greatest(a, c, g, t) / (a + c + g + t) - 0.5) <= 0.3, false) AS het FROM {_PIV}")
def heterozygous(spark, d):
    return counts4(spark, d).select("user_id", F.coalesce(al.heterozygous(_LOW, 40, 0.3), F.lit(False)).alias("het"))


@register("mincov_quantile", f"SELECT round(quantile_cont(CAST(a + c + g + t AS DOUBLE), 0.25), 6) AS mincov FROM {_PIV} WHERE a + c + g + t > 0")
def mincov_quantile(spark, d):
    return al.coverage_quantile(counts4(spark, d), 250).select(r6("mincov"))


_BINS = "(SELECT doc_id, bin, substr(text, CAST(bin * 200 + 1 AS BIGINT), 200) AS part FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 200.0) AS BIGINT))) AS bin FROM documents WHERE length(text) > 0))"


def _n(c: str, letters: str) -> str:
    both = letters.lower() + letters.upper()
    return f"(length({c}) - length(translate({c}, '{both}', '')))"


def _bins(spark, d):
    return dna.bins(table(spark, d, "documents"), "doc_id", "text", 200)


@register("gc_bins", f"SELECT doc_id, bin, {_n('part', 'gc')} AS gc, {_n('part', 'acgt')} AS acgt FROM {_BINS}")
def gc_bins(spark, d):
    return _bins(spark, d).select("doc_id", F.col("bin").cast("long").alias("bin"), dna.count(F.col("part"), "gc").alias("gc"), dna.count(F.col("part"), "acgt").alias("acgt"))


@register("gc_range", f"SELECT doc_id, bin FROM {_BINS} WHERE {_n('part', 'acgt')} > 0 AND {_n('part', 'gc')} / {_n('part', 'acgt')} BETWEEN 0.2 AND 0.3")
def gc_range(spark, d):
    return _bins(spark, d).where(dna.gc(F.col("part")).between(0.2, 0.3)).select("doc_id", F.col("bin").cast("long").alias("bin"))


@register("gc_strata", f"SELECT CAST(floor({_n('part', 'gc')} / {_n('part', 'acgt')} * 10) AS BIGINT) AS stratum, count(*) AS n FROM {_BINS} WHERE {_n('part', 'acgt')} > 0 GROUP BY ALL")
def gc_strata(spark, d):
    return _bins(spark, d).where(dna.gc(F.col("part")).isNotNull()).groupBy(F.floor(dna.gc(F.col("part")) * 10).alias("stratum")).agg(F.count("*").alias("n"))


@register(
    "acgt_runs",
    """SELECT doc_id, CAST("to" - length(run) + 1 AS BIGINT) AS "from", CAST("to" AS BIGINT) AS "to" FROM (SELECT doc_id, run, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i) AS "to" FROM (
    SELECT doc_id, unnest(r) AS run, unnest(range(len(r))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[acgt]+|[^acgt]+') AS r FROM documents))) WHERE regexp_matches(run, '^[acgt]')""",
)
def acgt_runs(spark, d):
    return dna.allowed_runs(table(spark, d, "documents"), "doc_id", "text")


@register("symbol_counts", f"SELECT doc_id, {_n('text', 'a')} AS a, {_n('text', 'gc')} AS gc, length(text) - {_n('text', 'acgt')} AS other FROM documents")
def symbol_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", dna.count(t, "a").alias("a"), dna.count(t, "gc").alias("gc"), dna.count(t, "other").cast("long").alias("other"))


@register("dna_revcompl", "SELECT doc_id, reverse(translate(regexp_replace(lower(text), '[^acgt]', '', 'g'), 'acgt', 'tgca')) AS seq FROM documents")
def dna_revcompl(spark, d):
    return table(spark, d, "documents").select("doc_id", dna.reverse_complement(dna.only(F.col("text"), "acgt")).alias("seq"))


@register("dna_hamming", "SELECT x.item_id AS a, y.item_id AS b, CAST(list_sum(list_transform(range(1, greatest(length(x.text), length(y.text)) + 1), lambda i: CASE WHEN substr(x.text, i, 1) = substr(y.text, i, 1) THEN 0 ELSE 1 END)) AS BIGINT) AS dist FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1")
def dna_hamming(spark, d):
    """Each item against the next, over the whole texts."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("s"))
    y = b.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("s").alias("t"))
    return b.join(y, "item_id").select(F.col("item_id").alias("a"), "b", dna.hamming(F.col("s"), F.col("t")).cast("long").alias("dist"))


@register("subseq", "SELECT doc_id, substr(text, 5, 20) AS part FROM documents")
def subseq(spark, d):
    return table(spark, d, "documents").select("doc_id", dna.subseq(F.col("text"), 5, 24).alias("part"))


@register("str_trim", r"SELECT doc_id, regexp_replace(regexp_replace(text, '^[ \t\n\r]+', ''), '[ \t\n\r]+$', '') AS s FROM documents")
def str_trim(spark, d):
    return table(spark, d, "documents").select("doc_id", text.trim(F.col("text")).alias("s"))


@register("str_trunc", "SELECT doc_id, CASE WHEN length(text) > 30 THEN substr(text, 1, 27) || '...' ELSE text END AS s FROM documents")
def str_trunc(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 30).alias("s"))


@register("str_split", "SELECT doc_id, len(string_split(text, ' ')) AS n, string_split(text, ' ')[1] AS first FROM documents")
def str_split(spark, d):
    parts = text.split(F.col("text"), " ")
    return table(spark, d, "documents").select("doc_id", F.size(parts).cast("long").alias("n"), F.get(parts, F.lit(0)).alias("first"))


@register("str_positions", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ''), lambda c, i: CASE WHEN c = '.' THEN i END), lambda i: i IS NOT NULL), ',') AS at FROM documents".replace(" AS at ", ' AS "at" '))
def str_positions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.positions(F.col("text"), ".").cast("array<string>"), ",").alias("at"))


@register("record_find", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)password ?[=:]') OR contains(text, 'license')")
def record_find(spark, d):
    docs = table(spark, d, "documents")
    return records.find(docs, "text", "password ?[=:]", ignore_case=True).select("doc_id").union(records.find(docs, "text", "license", literal=True).select("doc_id")).distinct()


@register("assoc_filter", "SELECT DISTINCT upper(regexp_replace(source, '^src', 'db:')) AS a, lang AS b FROM documents WHERE lang IN ('en', 'de') AND text <> ''")
def assoc_filter(spark, d):
    docs = table(spark, d, "documents").where("text <> ''").withColumn("a", F.upper(F.regexp_replace("source", "^src", "db:")))
    return records.distinct_pairs(docs, "a", "lang", "lang", ("en", "de")).withColumnsRenamed({"lang": "b"})


_EDGES = "(SELECT conv_id * 1000 + turn AS child, conv_id * 1000 + turn - 1 AS parent FROM conversations WHERE turn > 0)"


def _edges(spark, d):
    c = table(spark, d, "conversations").where("turn > 0")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("child"), (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"))


_REC = f"WITH RECURSIVE r AS (SELECT child, parent AS ancestor, 1 AS depth FROM {_EDGES} UNION SELECT r.child, e.parent, depth + 1 FROM r JOIN {_EDGES} e ON r.ancestor = e.child"


@register("ancestors", f"{_REC}) SELECT child, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY ALL")
def ancestors(spark, d):
    return records.ancestors(_edges(spark, d))


@register("ancestors_depth", f"{_REC} WHERE depth < 2) SELECT child, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY ALL")
def ancestors_depth(spark, d):
    return records.ancestors(_edges(spark, d), 2)


_GP = "(SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'A' WHEN user_id % 3 = 1 THEN 'AG' ELSE 'G' END AS geno, 'A' AS ref, 'G' AS alt, (user_id % 49 + 1) / 51.0 AS f FROM (SELECT DISTINCT user_id FROM events))"
_PROBA = "CASE WHEN geno = 'A' THEN (1 - f) * (1 - f) WHEN geno = 'AG' THEN 2 * f * (1 - f) ELSE f * f END"


def _genotypes(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    geno = F.when(F.col("user_id") % 3 == 0, "A").when(F.col("user_id") % 3 == 1, "AG").otherwise("G")
    return u.select("user_id", geno.alias("geno"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), ((F.col("user_id") % 49 + 1) / 51.0).alias("f"))


@register("genotype_proba", f"SELECT user_id, round({_PROBA}, 6) AS proba FROM {_GP}")
def genotype_proba(spark, d):
    return _genotypes(spark, d).select("user_id", F.round(al.genotype_probability(*map(F.col, ("geno", "ref", "alt", "f"))), 6).alias("proba"))


@register(
    "population_posterior",
    f"""WITH p AS (SELECT pop, sum(ln(CASE WHEN geno = 'A' THEN (1 - q) * (1 - q) WHEN geno = 'AG' THEN 2 * q * (1 - q) ELSE q * q END + 1e-10)) AS llk FROM (
    SELECT geno, pop, (user_id * (7 + pop) % 49 + 1) / 51.0 AS q FROM {_GP}, (SELECT unnest([0, 1, 2]) AS pop)) GROUP BY pop)
    SELECT pop, round(llk, 4) AS llk, round(1 / (SELECT sum(exp(q.llk - p.llk)) FROM p q), 6) AS posterior FROM p""",
)
def population_posterior(spark, d):
    pops = spark.range(3).select(F.col("id").cast("int").alias("pop"))
    rows = _genotypes(spark, d).join(F.broadcast(pops)).withColumn("q", (F.col("user_id") * (7 + F.col("pop")) % 49 + 1) / 51.0)
    llk = rows.groupBy("pop").agg(al.log_likelihood(al.genotype_probability(*map(F.col, ("geno", "ref", "alt", "q")))).alias("llk"))
    return al.posterior(llk, "llk").select("pop", F.round("llk", 4).alias("llk"), r6("posterior"))


@register("sample_match", f"SELECT round(avg(same), 6) AS rate, count(*) AS n FROM (SELECT CASE WHEN user_id % 7 > 0 THEN 1.0 ELSE 0.0 END AS same, user_id, {_PROBA} AS p FROM {_GP} WHERE length(geno) = 1 ORDER BY p, user_id LIMIT 40)")
def sample_match(spark, d):
    g = _genotypes(spark, d).where(F.length("geno") == 1).select("user_id", al.genotype_probability(*map(F.col, ("geno", "ref", "alt", "f"))).alias("p"), (F.col("user_id") % 7 > 0).alias("same"))
    return al.match_rate(g, "p", "same", 40).select(r6("rate"), "n")
