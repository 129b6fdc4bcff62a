"""The text pipeline: raw documents to token ids, each stage over all that the one before kept.

Quality rules drop documents, near-duplicate groups keep one document, documents that hold benchmark
items go, secrets are masked, and what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemap.llm import decontam, pieces_bpe, quality, secrets, simhash
from ripplemap.llm.common import ship, table
from ripplemap.plans.session import stored

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; ``n_chars`` counts the new text where there was a count."""
    own = F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("row")
    found = docs.select(own, secrets.spans(docs["text"], secrets.model_of(docs)).alias("found"))
    some = F.size("found") > 0
    text = F.when(some, secrets.redacted(F.col("row.text"), F.col("found"))).otherwise(F.col("row.text"))
    masked = found.select("row", some.alias("some"), text.alias("text"))
    counted = F.when(F.col("some"), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": counted}
    return masked.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids`` (with the end id) and ``decoded``."""
    ship(spark)
    return pieces_bpe.round_trip(docs, MODEL).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

# Fingerprint groups, edit bounds and piece merges are not expressible in SQL; tests compare with
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read by the next one."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage_{k}")
    return docs
