"""Readers of biological text formats, as DataFrames. Files may be gzipped; several files at once are read by a pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: The columns of a gene association file.
GAF_COLUMNS = (
    "db", "db_object_id", "db_object_symbol", "qualifier", "go_id", "db_reference", "evidence", "with_from", "aspect", "db_object_name",
    "db_object_synonym", "db_object_type", "taxon", "date", "assigned_by", "annotation_extension", "gene_product_form_id",
)
#: The mandatory columns of an alignment line.
SAM_COLUMNS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """name, from, to: 1-based, both ends included, of lines `name from0 to`; comments, headers and lines without two numbers drop out."""
    parts = F.split(F.trim(F.col("value")), "[ \t]+")
    rows = spark.read.text(path).where(~F.col("value").rlike("^\\s*(#|track|browser)")).select(parts.alias("p")).where("size(p) >= 3")
    out = rows.select(F.get("p", F.lit(0)).alias("name"), (F.expr("try_cast(get(p, 1) AS BIGINT)") + 1).alias("from"), F.expr("try_cast(get(p, 2) AS BIGINT)").alias("to"))
    return out.where("`from` IS NOT NULL AND `to` IS NOT NULL")


def write_bed(df: DataFrame, path: str) -> None:
    """name, from, to as tab-separated 0-based half-open lines, gzipped."""
    df.select(F.concat_ws("\t", "name", (F.col("from") - 1).cast("string"), F.col("to").cast("string"))).write.text(path, compression="gzip")


def with_index(df: DataFrame, seq: DataFrame) -> DataFrame:
    """chr instead of name, by the sequences' dimension table; rows of unknown sequences, or beyond their sequence's end, drop out."""
    out = df.join(F.broadcast(seq.select("name", F.col("index").alias("chr"), "size")), "name")
    return out.where((F.col("from") >= 1) & (F.col("from") <= F.col("to")) & (F.col("to") <= F.col("size"))).drop("name", "size")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """index (from 0), name (up to the first blank), size, crc32 and seq of each sequence. Records are cut at `>`; order is that of the files' bytes."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("i"), F.regexp_replace("value", "^>", "").alias("v"))
    raw = raw.where("length(trim(v)) > 0")
    head = F.substring_index("v", "\n", 1)
    seq = F.regexp_replace(F.substr(F.col("v"), F.length(head) + 1), "[\\s>]+", "")
    rows = raw.select("i", F.regexp_extract(head, "^\\s*(\\S*)", 1).alias("name"), seq.alias("seq"))
    # as many numbers as sequences; the sequences themselves stay where they are
    number = rows.select("i", (F.row_number().over(Window.orderBy("i")) - 1).alias("index"))
    return rows.join(number, "i").select("index", "name", F.length("seq").cast("long").alias("size"), F.when(F.length("seq") > 0, F.crc32(F.col("seq").cast("binary"))).otherwise(0).alias("crc32"), "seq")


def chunks(seqs: DataFrame, width: int = 1 << 20) -> DataFrame:
    """index, chunk and part: sequences cut into parts of equal width, so that a place is found by chunk = (pos - 1) div width."""
    n = F.ceil(F.length("seq") / width).cast("int")
    cut = seqs.where(F.length("seq") > 0).select("index", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return cut.select("index", "chunk", F.substr("seq", F.col("chunk") * width + 1, F.lit(width)).alias("part"))


def symbols_at(points: DataFrame, parts: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Adds symbol, the letter at chr, pos; null beyond the sequence."""
    at = points.withColumn("_chunk", F.floor((F.col("pos") - 1) / width).cast("int"))
    out = at.join(parts.select(F.col("index").alias("chr"), F.col("chunk").alias("_chunk"), "part"), ["chr", "_chunk"], "left")
    return out.withColumn("symbol", F.nullif(F.substr("part", (F.col("pos") - 1 - F.col("_chunk") * width + 1).cast("int"), F.lit(1)), F.lit(""))).drop("_chunk", "part")


def sam(spark: SparkSession, path: str) -> DataFrame:
    """The mandatory columns and tags (array) of alignment lines; header lines drop out."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where("NOT startswith(value, '@') AND value <> ''").select(p.alias("p"))
    number = {"flag", "pos", "mapq", "pnext", "tlen"}
    cols = [F.expr(f"get(p, {k})").cast("long" if n in number else "string").alias(n) for k, n in enumerate(SAM_COLUMNS)]
    return rows.select(*cols, F.slice("p", 12, F.greatest(F.size("p"), F.lit(1))).alias("tags"))


def flag(c: Column, bit: int) -> Column:
    return c.bitwiseAND(bit) != 0


def flag_counts(reads: DataFrame) -> DataFrame:
    """One row: reads in all, mapped, paired, properly paired, secondary, supplementary, duplicate, failed."""
    f = F.col("flag")
    kinds = {"paired": 1, "proper": 2, "secondary": 256, "failed": 512, "duplicate": 1024, "supplementary": 2048}
    return reads.agg(F.count("*").alias("total"), F.count_if(~flag(f, 4)).alias("mapped"), *[F.count_if(flag(f, b)).alias(n) for n, b in kinds.items()])


def gaf(spark: SparkSession, path: str) -> DataFrame:
    """A gene association table of 15 to 17 columns; missing ones are null, comments (`!`) drop out."""
    rows = spark.read.text(path).where("NOT startswith(value, '!') AND value <> ''").select(F.split("value", "\t", -1).alias("p"))
    return rows.select(*[F.get("p", F.lit(k)).alias(n) for k, n in enumerate(GAF_COLUMNS)])


def associations(gaf_rows: DataFrame, dbs: tuple[str, ...]) -> DataFrame:
    """Distinct (id, go_id) of rows without a qualifier from the given databases; ids lose what stands after a colon or a bar."""
    from tessera.operators.records import distinct_pairs

    rows = gaf_rows.withColumn("id", F.regexp_extract("db_object_id", "^([^:|]*)", 1))
    return distinct_pairs(rows, "id", "go_id", "db", dbs, "qualifier")


def obo(spark: SparkSession, path: str) -> DataFrame:
    """id, name, namespace, is_a, relationship (kind -> ids), fields (key -> values) and parent_of of each term."""
    raw = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value").startswith("[Term]"))
    lines = F.filter(F.split("value", "\n"), lambda x: x.contains(": "))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ": ", 1)).alias("k"), F.trim(F.regexp_replace(F.substr(x, F.length(F.substring_index(x, ": ", 1)) + 3), " ! .*$", "")).alias("v"))
    rows = raw.select(F.transform(lines, pair).alias("kv"))
    of = lambda key: F.transform(F.filter("kv", lambda x: x.k == key), lambda x: x.v)
    rows = rows.select(
        F.get(of("id"), F.lit(0)).alias("id"), F.get(of("name"), F.lit(0)).alias("name"), F.get(of("namespace"), F.lit(0)).alias("namespace"), of("is_a").alias("is_a"), of("relationship").alias("rel"),
        F.map_from_entries(F.transform(F.array_distinct(F.transform("kv", lambda x: x.k)), lambda k: F.struct(k.alias("key"), F.transform(F.filter("kv", lambda x: x.k == k), lambda x: x.v).alias("value")))).alias("fields"),
    )
    kinds = F.array_distinct(F.transform("rel", lambda r: F.substring_index(r, " ", 1)))
    rows = rows.withColumn("relationship", F.map_from_entries(F.transform(kinds, lambda k: F.struct(k.alias("key"), F.transform(F.filter("rel", lambda r: F.substring_index(r, " ", 1) == k), lambda r: F.substring_index(r, " ", -1)).alias("value"))))).drop("rel")
    children = rows.select(F.col("id").alias("child"), F.explode("is_a").alias("id")).groupBy("id").agg(F.sort_array(F.collect_set("child")).alias("parent_of"))
    return rows.join(children, "id", "left").withColumn("parent_of", F.coalesce("parent_of", F.array().cast("array<string>")))


def edges(terms: DataFrame) -> DataFrame:
    """child and parent of the terms' is_a."""
    return terms.select(F.col("id").alias("child"), F.explode("is_a").alias("parent"))


def swiss(spark: SparkSession, path: str) -> DataFrame:
    """id, accessions, fields (two-letter code -> lines joined by blanks), xref (database -> ids) and seq of each protein record."""
    raw = spark.read.option("lineSep", "//\n").text(path).where(F.col("value").contains("ID   "))
    lines = F.filter(F.split("value", "\n"), lambda x: F.length(F.trim(x)) > 0)
    coded = F.filter(lines, lambda x: x.rlike("^[A-Z]{2}   "))
    pairs = F.transform(coded, lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.trim(F.substr(x, F.lit(6))).alias("v")))
    rows = raw.select(pairs.alias("kv"), F.regexp_replace(F.array_join(F.filter(lines, lambda x: x.startswith("     ")), ""), "\\s", "").alias("seq"))
    of = lambda key: F.transform(F.filter("kv", lambda x: x.k == key), lambda x: x.v)
    joined = lambda k: F.array_join(F.transform(F.filter("kv", lambda x: x.k == k), lambda x: x.v), " ")
    dr = F.transform(of("DR"), lambda x: F.split(F.regexp_replace(x, "\\.$", ""), "; *"))
    dbs = F.array_distinct(F.transform("dr", lambda x: F.get(x, F.lit(0))))
    rows = rows.select(
        F.substring_index(F.get(of("ID"), F.lit(0)), " ", 1).alias("id"), F.filter(F.split(joined(F.lit("AC")), "; *"), lambda x: x != "").alias("accessions"),
        F.map_from_entries(F.transform(F.array_distinct(F.transform("kv", lambda x: x.k)), lambda k: F.struct(k.alias("key"), joined(k).alias("value")))).alias("fields"), dr.alias("dr"), "seq",
    )
    return rows.withColumn("xref", F.map_from_entries(F.transform(dbs, lambda d: F.struct(d.alias("key"), F.transform(F.filter("dr", lambda x: F.get(x, F.lit(0)) == d), lambda x: F.get(x, F.lit(1))).alias("value"))))).drop("dr")


def snps(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated SNP table with a header: chr, pos, ref, alt, and freqs, each further column from the seventh on by its name."""
    rows = spark.read.csv(path, sep="\t", header=True)
    pops = rows.columns[6:]
    freqs = F.map_from_arrays(F.array(*map(F.lit, pops)), F.array(*[F.expr(f"try_cast(`{p}` AS DOUBLE)") for p in pops])) if pops else F.create_map().cast("map<string,double>")
    return rows.select(F.col("CHROM").alias("chr"), F.col("POS").cast("long").alias("pos"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"), freqs.alias("freqs"))


def filter_snps(rows: DataFrame, chrs: list[str], low: float) -> DataFrame:
    """SNPs of the chromosomes whose frequency is within [low, 1 - low] in every population that has one."""
    return rows.where(F.col("chr").isin(chrs) & F.forall(F.map_values("freqs"), lambda f: F.coalesce(f.between(low, 1 - low), F.lit(True))))


def write_table(df: DataFrame, formats: dict[str, str], path: str) -> None:
    """A gzipped tab-separated file of the columns, each by its printf format."""
    df.select(F.concat_ws("\t", *[F.format_string(f, c) for c, f in formats.items()])).write.text(path, compression="gzip")
