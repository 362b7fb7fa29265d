"""The queries of this subpackage over the driver tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import bpe, chat, counts, decontaminate, jaccard, lm, quality, secrets, shards, sstable
from tessera.runtime import new_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OWN_TEXT = "<|im_end|><|im_start|>assistant ok"


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as messages records, and conversation -1 as a prompt record; each figure is read back from the rendered text."""
    rows = chat.gather_turns(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    kinds = {name: "string" for name in ("instruction", "input", "output", "system", "prompt", "completion")}
    lists = {"messages": "array<struct<role:string,content:string>>", "conversations": "array<struct<`from`:string,value:string>>", "qa": "struct<question:string,answer:string>"} | kinds
    order = ("messages", "conversations", "instruction", "input", "output", "system", "prompt", "completion", "qa")

    def record(**have):
        return F.struct(*[(have[n] if n in have else F.lit(None)).cast(lists[n]).alias(n) for n in order]).alias("record")

    records = rows.select(F.col("key").alias("conv_id"), record(messages=F.col("messages"))).unionByName(
        spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), record(prompt=F.lit(OWN_TEXT), completion=F.lit(OWN_TEXT)))
    )
    out = chat.render(chat.to_turns(records)).select("conv_id", "layout", "formatted", "loss")
    back = out.select("conv_id", "layout", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


SQL["op1_chat_formatting"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 'messages' AS layout FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{OWN_TEXT}', 'prompt' UNION ALL SELECT -1, 1, 'assistant', '{OWN_TEXT}', 'prompt'
), said AS (
  SELECT conv_id, min(layout) AS layout, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
    sum(12 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + 1
        + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
  sha256(learnt) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, layout
FROM said
"""


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat", "covered"
    )


@query
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL["op5_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS said
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS said
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
hits AS (SELECT DISTINCT doc_id, i, dw.size AS size, item_id FROM dw JOIN bw ON dw.said = bw.said AND dw.size = bw.size),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""


@query
def op4_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a folder of its own in the shared folder, and read back from there."""
    folder = new_dir(spark, "sstable")
    sstable.write_shards(read(spark, sf_dir, "documents"), folder)
    return sstable.read_shards(spark, folder, sstable.checksum, "n_tokens long, ids_crc32 long")


@query
def op7_bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.map_ids(read(spark, sf_dir, "documents"), bpe.digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(read(spark, sf_dir, "documents"))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(read(spark, sf_dir, "documents"))


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))

