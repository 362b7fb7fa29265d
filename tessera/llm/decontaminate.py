"""Benchmark decontamination by winnowing; DataFrame functions only.

Words are runs of digits, letters and non-ASCII characters after A-Z are lower-cased. Of each GRAMS consecutive hashes of `gram` words the
least is kept, and kept once for all windows in a row that agree on it: about 2 / (GRAMS + 1) fingerprints a word. Every span of `window` = gram +
GRAMS - 1 words leaves one, the same in a document and in an item: every shared span of that length is found. Document fingerprints are joined with
those of the benchmark, and a hit is extended to the windows that it stands for, which must then equal a benchmark window word for word. An
item of fewer words than a window is one window of its own, shorter than the guarantee; such items are met by their first word instead, and their
windows compared likewise.

A table of bits for the benchmark's fingerprints, of a fixed size and sent with the plan, thins out the documents' before they become rows; the join
decides. The benchmark's side is broadcast only if its windows are counted to have `broadcast_bytes` at most; beyond that the fingerprints that both
sides have are found first, of each task's documents once each, and then joined by salted keys. The items of a window are rows: they are joined, for each
distinct set of windows that a document has, after the hits are known.

Defined results: a null or empty text has no words and no hits; an item without words has no window; an item with a null id is listed as
an empty id, and items that share an id count once; repeated document rows give repeated results, and rows that share a doc_id are told
apart by their text; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from tessera.runtime import cut, spread

WINDOW, GRAM = 10, 4
BROADCAST_BYTES = 32 << 20
#: log2 of the number of bits of the table that thins out fingerprints; parts that a key is dealt to where both sides are shuffled.
BITS, SALTS = 18, 16
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """The words of a text. Texts of ASCII alone, which have as many bytes as characters, take the quicker of two equal ways to lower A-Z."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, SEPARATOR, -1), "")


def _shifted(hashes: str, by: int, f) -> Column:
    """f of each element and of the one so many places on, or of null beyond the end."""
    return F.zip_with(F.col(hashes), F.slice(F.col(hashes), F.lit(by + 1), F.size(hashes)), f)


# Arrays are made into rows by explode_outer: none of them is empty, and for explode the optimizer would work out each array once more, and its
# parts many times, to filter empty ones out beforehand


def fingerprints(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Adds __fp, the least hash of a gram in each window, by the window's start, to rows with __words. Longer grams and windows are
    built by doubling: of runs of n elements overlapping by n - d, runs of n + d."""
    df = df.withColumn("__fp", F.transform("__words", lambda w: F.xxhash64(w)))
    for size, f in ((gram, lambda x, y: F.xxhash64(x, y)), (window - gram + 1, lambda x, y: F.least(x, y))):
        have = 1
        while have < size:
            by = min(have, size - have)
            df = df.withColumn("__fp", _shifted("__fp", by, f))
            have += by
    return df.withColumn("__fp", F.slice("__fp", F.lit(1), F.greatest(F.size("__words") - (window - 1), F.lit(0))))


def _window_text(words: Column, start: Column, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, F.lit(size) if isinstance(size, int) else size), " ")


def benchmark_windows(items: DataFrame, window: int, gram: int, item_id: str, text: str) -> DataFrame:
    """fp, first (word), size, said (its words) and item of each window of each item, once each. fp is null for windows shorter than the rest."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), word_array(F.col(text)).alias("__words")).distinct()
    long = fingerprints(rows.filter(F.size("__words") >= window), window, gram)
    long = long.select("item", "__words", F.posexplode_outer("__fp").alias("at", "fp")).select("fp", F.lit(None).cast("string").alias("first"), F.lit(window).alias("size"), _window_text(F.col("__words"), F.col("at") + 1, window).alias("said"), "item")
    short = rows.filter(F.size("__words").between(1, window - 1)).select(F.lit(None).cast("long").alias("fp"), F.get("__words", F.lit(0)).alias("first"), F.size("__words").alias("size"), F.array_join("__words", " ").alias("said"), "item")
    return long.union(short).distinct()


def _bit(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(1 << BITS)).cast("int")


def _bit_table(hashes: DataFrame) -> Column:
    """A constant of one byte for each value of _bit, 1 where one of the hashes has it."""
    table = bytearray(1 << BITS)
    for r in hashes.select(_bit(F.col("h")).alias("b")).distinct().collect():  # 2**BITS numbers at most
        table[r.b] = 1
    return F.lit(bytes(table))


def _set_in(table: Column, hashed: Column) -> Column:
    return F.substring(table, _bit(hashed) + 1, F.lit(1)) == F.lit(b"\1")


def _places(size: Column, keep) -> Column:
    """The numbers from 0 below size for which keep holds."""
    return F.when(size > 0, F.filter(F.sequence(F.lit(0), size - 1), keep)).otherwise(F.array().cast("array<int>"))


def winnowed(fp: str, window: int, gram: int, also=None) -> Column:
    """The windows whose fingerprints winnowing keeps, of an array of fingerprints by window: the first of each run of windows with the same one, and every one that
    agrees with the window that ends before its own gram places begin. So each window of a run follows a kept one by less than window - gram + 1. also: a further condition on a fingerprint."""
    here = lambda i: F.get(fp, i)
    keep = lambda i: (i == 0) | (here(i) != here(i - 1)) | (here(i) == here(i - (window - gram + 1)))
    return _places(F.size(fp), keep if also is None else lambda i: keep(i) & also(here(i)))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted), items_sha256 and contaminated of each row of docs."""
    every = cut(benchmark_windows(items, window, gram, item_id, item_text).withColumn("wid", F.xxhash64("size", "said")))
    bench = every.groupBy("wid").agg(F.first("fp").alias("fp"), F.first("first").alias("first"), F.first("size").alias("size"), F.first("said").alias("said"))
    bench = cut(bench)
    figures = bench.groupBy("size").agg(F.sum(F.octet_length("said") + 64).alias("bytes")).collect()  # as many rows as window sizes
    small = sum(r["bytes"] for r in figures) <= broadcast_bytes
    near = F.broadcast if small else lambda df: df
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("__key"), F.col(text).alias("__text")))
    rows = rows.withColumn("__words", word_array(F.col("__text"))).drop("__text")

    def met(cast: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
        """doc_id, __key and the places (of __found) at which one of keys stands; and of each document one row of a null place."""
        exploded = cast.select("*", F.explode_outer(F.concat(F.array(F.lit(None).cast("int")), "__found")).alias("__k"))
        exploded = exploded.withColumn("key", key)
        if not small:
            # the keys that documents have at all: of each task's, once each
            keys = cut(exploded.where("__k IS NOT NULL").select("key").distinct().join(keys, "key", "left_semi"))
            salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("hit", F.lit(True))
            return exploded.withColumn("salt", F.when(F.col("__k").isNotNull(), F.pmod("__key", F.lit(SALTS)).cast("int"))).join(salted, ["key", "salt"], "left").where("hit OR __k IS NULL")
        return exploded.join(near(keys.withColumn("hit", F.lit(True))), "key", "left").where("hit OR __k IS NULL")

    long_keys = bench.where("fp IS NOT NULL").select(F.col("fp").alias("key")).distinct()
    table = _bit_table(long_keys.select(F.col("key").alias("h")))
    kept = fingerprints(rows, window, gram).withColumn("__found", winnowed("__fp", window, gram, lambda h: _set_in(table, h)))
    hits = met(kept, F.get("__fp", F.col("__k")), long_keys)
    # a hit stands for the windows near it that have its fingerprint
    near_by = F.filter(F.sequence(F.col("__k"), F.least(F.col("__k") + (window - gram), F.size("__fp") - 1)), lambda i: F.get("__fp", i) == F.get("__fp", F.col("__k")))
    spans = F.when(F.col("__k").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.transform(near_by, lambda i: i + 1))
    found = hits.select("doc_id", "__key", "__words", F.explode_outer(spans).alias("at"))
    found = found.select("doc_id", "__key", F.size("__words").alias("n_words"), "at", F.lit(window).alias("size"), F.when(F.col("at").isNotNull(), _window_text(F.col("__words"), F.col("at"), window)).alias("said"), F.col("at").isNull().alias("self"))
    if shorter := sorted(r["size"] for r in figures if r["size"] < window):
        firsts = bench.where("first IS NOT NULL").select(F.col("first").alias("key")).distinct()
        words = _bit_table(firsts.select(F.xxhash64("key").alias("h")))
        tried = rows.withColumn("__found", _places(F.size("__words"), lambda i: _set_in(words, F.xxhash64(F.get("__words", i)))))
        tried = met(tried, F.get("__words", F.col("__k")), firsts).where("__k IS NOT NULL").withColumn("at", F.col("__k") + 1)
        tried = tried.withColumn("size", F.explode_outer(F.array(*map(F.lit, shorter)))).where(F.col("at") + F.col("size") - 1 <= F.size("__words"))
        found = found.union(tried.select("doc_id", "__key", F.size("__words"), "at", "size", _window_text(F.col("__words"), F.col("at"), F.col("size")), F.lit(False)))
    found = found.join(near(bench.select("said", "size", "wid")), ["said", "size"], "left")
    hit = F.col("wid").isNotNull()
    per_doc = found.groupBy("doc_id", "__key").agg(
        F.max("n_words").alias("n_words"),
        F.count_if("self").alias("copies"),
        F.collect_set(F.when(hit, F.struct("at", "size"))).alias("spans"),
        F.sort_array(F.collect_set("wid")).alias("wids"),
    )
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s.at, s.at + s.size - 1)))
    per_doc = per_doc.select("doc_id", F.col("copies").cast("int").alias("copies"), F.col("n_words").cast("long").alias("n_words"), F.size(F.array_distinct(places)).cast("long").alias("n_hit"), "wids")
    per_doc = cut(per_doc.withColumn("group", F.when(F.size("wids") > 0, F.xxhash64("wids"))))
    groups = per_doc.where("group IS NOT NULL").groupBy("group").agg(F.first("wids").alias("wids"))
    listed = groups.select("group", F.explode("wids").alias("wid")).join(every.select("wid", "item"), "wid").groupBy("group").agg(F.sort_array(F.collect_set("item")).alias("items"))
    listed = cut(listed.select("group", "items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    weight = listed.agg(F.sum(F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 32))).first()[0] or 0
    per_doc = per_doc.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    own = per_doc.where("group IS NOT NULL")
    if weight <= broadcast_bytes:
        own = own.join(F.broadcast(listed), "group")
    else:
        # many documents may have the same windows
        listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(listed, ["group", "salt"])
    clean = per_doc.where("group IS NULL").withColumn("items", F.array().cast("array<string>")).withColumn("items_sha256", F.sha2(F.lit(""), 256))
    columns = ["doc_id", "n_words", "n_hit", "items", "items_sha256"]
    out = own.select(columns).unionByName(clean.select(columns))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that aren't contaminated. A row is known by its doc_id, null or not, and its text."""
    own = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key")).alias("doc_id"), "text")
    hit = decontaminate(own, items, window=window, gram=gram).filter("contaminated").select(F.col("doc_id.id").alias("__id"), F.col("doc_id.key").alias("__own")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__own")), "left_anti").select(docs.columns)
