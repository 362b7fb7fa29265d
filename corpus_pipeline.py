"""A corpus pipeline over `documents`: each stage takes all rows that the one before it left, and is written as Parquet before the next reads it.

Rows without a doc_id are known by their text in decisions about pairs or passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import bpe, decontaminate, jaccard, quality, secrets
from tessera.runtime import Kept


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of near duplicates: those that share 80 % of their shingles of five words."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and n_chars counted again."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, their number, and digests of the ids and of the text decoded from them."""
    return bpe.map_ids(docs, bpe.digests_and_lists, "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("bpe_encoding_and_decoding", bpe_encoding),
]

#: The suffix arrays' verdict and the vocabulary's merges are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`. A stage's table goes as soon as the next one's is written; tessera.runtime.close(spark) takes the rest when the result has been read.
    A document that isn't there, an empty table, and nulls in any column are as the stages have them."""
    kept, docs = Kept(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept.put(name, docs)
            if k:
                kept.drop(STAGES[k - 1][0])
    return docs
