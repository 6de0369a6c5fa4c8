"""A corpus through quality rules, near-dedup, decontamination, secret scans and byte-level encoding.

Every stage takes what its predecessor kept. A document leaves if the quality rules reject it, if it is not
the one that stays of its group of near-duplicates, or if it holds a benchmark item; credentials that stay
with few owners are masked in the text; what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm import bpe, leaks, minhash, quality, secrets
from veil.llm.common import keep, passing, ship, without_rows

SHINGLE_WORDS, PERCENT = 5, 80
RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned ones reject."""
    ship(spark)
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept_only(docs, rules)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id."""
    ship(spark)
    with passing(spark):
        decided = minhash.near_duplicates(docs, SHINGLE_WORDS, PERCENT)
        ids = decided.groupBy(F.col("doc_id").alias("gone_id")).agg(F.bool_or("kept").alias("kept"))
        gone = keep(ids.where("NOT kept").select("gone_id"), "gone-ids", 1)
    return without_rows(docs, gone, "doc_id", "gone_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    ship(spark)
    with passing(spark):
        found = leaks.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        leaked = keep(found.select(F.col("doc_id").alias("leaked_id")).distinct(), "leaked-ids", 1)
    return without_rows(docs, leaked, "doc_id", "leaked_id")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with credentials of few owners masked, and ``n_chars`` as it is then."""
    ship(spark)
    clean = secrets.redacted(docs)
    length = F.length("text").cast(clean.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of what they decode to."""
    ship(spark)
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    rows = bpe.recoded(docs, path, pattern)
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

ORACLE_SQL = None  # rules are learned, and leaks are found in a latent space: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written, so that the next reads files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = keep(docs, name)
    return docs
