"""Formats over the driver tables: rows are written in the format to the shared folder, read back from there, and given out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import alleles as al
from tessera.plans.adapters import A_SQL, B_SQL, intervals_a, intervals_b
from tessera.plans.catalogue import register, table
from tessera.runtime import new_dir
from tessera.sources import texts


@register("src_bed", f"""SELECT 'chr' || chr AS name, "from", "to" FROM {A_SQL}""")
def src_bed(spark, d):
    path = new_dir(spark, "bed")
    texts.write_bed(intervals_a(spark, d).select(F.concat(F.lit("chr"), F.col("chr").cast("string")).alias("name"), "from", "to"), path)
    return texts.bed(spark, path)


@register("src_bed_index", f"""SELECT chr, "from", "to" FROM {A_SQL} WHERE "to" <= 5000""")
def src_bed_index(spark, d):
    path = new_dir(spark, "bed")
    texts.write_bed(intervals_a(spark, d).select(F.concat(F.lit("chr"), F.col("chr").cast("string")).alias("name"), "from", "to"), path)
    seq = spark.range(1, 23).select(F.col("id").alias("index"), F.concat(F.lit("chr"), F.col("id").cast("string")).alias("name"), F.lit(5000).cast("long").alias("size"))
    return texts.with_index(texts.bed(spark, path), seq).select("chr", "from", "to")


@register("src_gaf", "SELECT DISTINCT 'D' || doc_id % 50 AS id, 'GO:' || lang AS go_id FROM documents WHERE source IN ('src0', 'src1') AND doc_id % 3 <> 0")
def src_gaf(spark, d):
    """Associations of documents' numbers and languages, of two databases, without the rows that have a qualifier."""
    path, rows = new_dir(spark, "gaf"), table(spark, d, "documents")
    kept = {0: F.col("source"), 1: F.concat(F.lit("D"), (F.col("doc_id") % 50).cast("string"), F.lit(":x")), 3: F.when(F.col("doc_id") % 3 == 0, "NOT").otherwise(""), 4: F.concat(F.lit("GO:"), "lang")}
    line = F.concat_ws("\t", *[kept.get(k, F.lit("")) for k in range(17)])
    rows.select(line.alias("value")).union(spark.createDataFrame([("!gaf-version: 2.1",)], "value string")).write.text(path, compression="gzip")
    return texts.associations(texts.gaf(spark, path), ("src0", "src1"))


@register("src_obo", """SELECT 'N:' || n_nationkey AS id, n_name AS name, 'world' AS namespace, 'R:' || n_regionkey AS parents, 'R:' || n_regionkey AS part_of, 0 AS children FROM nation
  UNION ALL SELECT 'R:' || r_regionkey, r_name, 'world', '', '', (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) FROM region""")
def src_obo(spark, d):
    path = new_dir(spark, "obo")
    term = lambda key, name, *more: F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: "), key), F.concat(F.lit("name: "), name), F.lit("namespace: world"), *more)
    up = F.concat(F.lit("R:"), F.col("n_regionkey").cast("string"))
    nations = table(spark, d, "nation").select(term(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")), F.col("n_name"), F.concat(F.lit("is_a: "), up, F.lit(" ! its region")), F.concat(F.lit("relationship: part_of "), up, F.lit(" ! its region"))).alias("value"))
    regions = table(spark, d, "region").select(term(F.concat(F.lit("R:"), F.col("r_regionkey").cast("string")), F.col("r_name")).alias("value"))
    nations.union(regions).write.text(path, lineSep="\n\n")
    out = texts.obo(spark, path)
    part = F.coalesce(F.element_at("relationship", F.lit("part_of")), F.array().cast("array<string>"))
    return out.select("id", "name", "namespace", F.array_join("is_a", ",").alias("parents"), F.array_join(part, ",").alias("part_of"), F.size("parent_of").cast("long").alias("children"))


@register("src_swiss", "SELECT 'P' || s_suppkey AS id, 'A' || s_suppkey || ',B' || s_suppkey AS accessions, s_name AS de, 'GO:' || s_nationkey AS go, upper(repeat('acgt', CAST(s_suppkey % 40 + 1 AS INTEGER))) AS seq FROM supplier")
def src_swiss(spark, d):
    path, s = new_dir(spark, "swiss"), table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    letters = F.upper(F.repeat(F.lit("acgt"), (F.col("s_suppkey") % 40 + 1).cast("int")))
    lines = F.array_join(F.transform(F.regexp_extract_all(letters, F.lit(".{1,60}"), 0), lambda x: F.concat(F.lit("     "), x)), "\n")
    record = F.concat_ws("\n", F.concat(F.lit("ID   P"), key, F.lit(" Reviewed; 3 AA.")), F.concat(F.lit("AC   A"), key, F.lit("; B"), key, F.lit(";")), F.concat(F.lit("DE   "), "s_name"), F.concat(F.lit("DR   GO; GO:"), F.col("s_nationkey").cast("string"), F.lit("; x.")), F.lit("SQ   SEQUENCE"), lines, F.lit(""))
    s.select(record.alias("value")).write.text(path, lineSep="//\n")
    out = texts.swiss(spark, path)
    return out.select("id", F.array_join("accessions", ",").alias("accessions"), F.element_at("fields", F.lit("DE")).alias("de"), F.array_join(F.element_at("xref", F.lit("GO")), ",").alias("go"), "seq")


@register("src_snps", "SELECT 'chr' || p_size % 3 AS chr, p_partkey AS pos, round(p_size / 51.0, 6) AS eur FROM part WHERE p_size % 3 < 2 AND p_size / 51.0 BETWEEN 0.1 AND 0.9 AND p_partkey % 50 / 50.0 BETWEEN 0.1 AND 0.9")
def src_snps(spark, d):
    """SNPs of two chromosomes that are common in either population."""
    path, p = new_dir(spark, "snp"), table(spark, d, "part")
    p.select(
        F.concat(F.lit("chr"), (F.col("p_size") % 3).cast("string")).alias("CHROM"), F.col("p_partkey").alias("POS"), F.lit("A").alias("REF"), F.lit("G").alias("ALT"), F.lit("").alias("ID"), F.lit("").alias("INFO"),
        (F.col("p_size") / 51.0).alias("EUR"), (F.col("p_partkey") % 50 / 50.0).alias("AFR"),
    ).write.csv(path, sep="\t", header=True)
    return texts.filter_snps(texts.snps(spark, path), ["chr0", "chr1"], 0.1).select("chr", "pos", F.round(F.element_at("freqs", F.lit("EUR")), 6).alias("eur"))


_READ = "(SELECT o_orderkey AS q, o_custkey % 22 + 1 AS chr, o_orderkey % 3000 + 1 AS pos, CAST(o_orderkey * 37 % 4096 AS BIGINT) AS flag, o_orderkey % 61 AS mapq, substr('acgtacgtac', CAST(o_orderkey % 4 + 1 AS BIGINT), 6) AS seq FROM orders)"


def _reads(spark, d):
    """Reads of orders as alignment lines, read back: three places, two that the read lacks, and three more."""
    path, o = new_dir(spark, "sam"), table(spark, d, "orders")
    key = F.col("o_orderkey")
    seq = F.substr(F.lit("acgtacgtac"), (key % 4 + 1).cast("int"), F.lit(6))
    cells = (key, key * 37 % 4096, F.col("o_custkey") % 22 + 1, key % 3000 + 1, key % 61, F.lit("3M2D3M"), F.lit("*"), F.lit(0), F.lit(0), seq, F.lit("IIII!I"), F.lit("NM:i:0"))
    o.select(F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("value")).union(spark.createDataFrame([("@HD\tVN:1.6",)], "value string")).write.text(path)
    return texts.sam(spark, path)


@register("src_sam", f"SELECT CAST(q AS VARCHAR) AS qname, flag, pos, mapq, '3M2D3M' AS cigar, seq, 'NM:i:0' AS tags FROM {_READ}")
def src_sam(spark, d):
    return _reads(spark, d).select("qname", "flag", "pos", "mapq", "cigar", "seq", F.array_join("tags", ",").alias("tags"))


_BIT = "count(*) FILTER (WHERE flag & {} <> 0) AS {}"


@register("flag_counts", f"SELECT count(*) AS total, count(*) FILTER (WHERE flag & 4 = 0) AS mapped, {', '.join(_BIT.format(b, n) for n, b in (('paired', 1), ('proper', 2), ('secondary', 256), ('failed', 512), ('duplicate', 1024), ('supplementary', 2048)))} FROM {_READ}")
def flag_counts(spark, d):
    return texts.flag_counts(_reads(spark, d))


@register(
    "pileup",
    f"""SELECT CAST(chr AS VARCHAR) AS chr, place AS pos, {', '.join(f"CAST(count(*) FILTER (WHERE base = '{b}') AS INTEGER) AS {b}" for b in 'acgt')} FROM (
    SELECT chr, pos + i + CASE WHEN i > 2 THEN 2 ELSE 0 END AS place, substr(seq, CAST(i + 1 AS BIGINT), 1) AS base FROM (SELECT *, unnest([0, 1, 2, 3, 5]) AS i FROM {_READ} WHERE mapq >= 20)) GROUP BY ALL""",
)
def pileup(spark, d):
    """Counts of the bases of quality 20 or more; the fifth base of each read has quality 0."""
    return al.pileup(_reads(spark, d).select(F.col("rname").alias("chr"), "pos", "cigar", "seq", "qual", "mapq"), 20, 20)


@register("src_fasta", "SELECT n_nationkey AS \"index\", n_name AS name, CAST(length(n_comment) * 3 AS BIGINT) AS size FROM (SELECT n_nationkey, n_name, 'acgtacgtac' AS n_comment FROM nation)")
def src_fasta(spark, d):
    path, n = new_dir(spark, "fasta"), table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    line = F.lit("acgtacgtac")
    n.select(F.concat(F.lit(">"), "n_name", F.lit(" a nation\n"), line, F.lit("\n"), line, F.lit("\n"), line).alias("value")).write.text(path)
    return texts.fasta(spark, path).select(F.col("index").cast("long").alias("index"), "name", "size")


@register("src_table", f"SELECT CAST(chr AS VARCHAR) || chr(9) || id AS line FROM {B_SQL}")
def src_table(spark, d):
    path = new_dir(spark, "table")
    texts.write_table(intervals_b(spark, d), {"chr": "%d", "id": "%d"}, path)
    return spark.read.text(path).select(F.col("value").alias("line"))
