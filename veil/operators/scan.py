"""Scanned or text-based: votes over page statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions.text import strip, words

# --- fixed values: thresholds and the weight of each vote for and against ---
MIN_CHARS, MIN_DENSITY, MIN_WORDS, IMAGE_CHARS = 50, 0.1, 10, 100
WEIGHTS = [(0.8, 0.2), (0.7, 0.1), (0.6, 0.1), (0.5, 0.1)]
# --- fixed values: recommended action ---
NEEDS_OCR, DIRECT = "Process with OCR before PII detection", "Process directly for PII detection"


def scan_classify(pages: DataFrame) -> DataFrame:
    """Per document from pages with text, width, height, n_images: is_scanned, confidence, averages."""
    body = strip(F.col("text"))
    stats = pages.groupBy("doc_id").agg(
        F.sum(F.length(body)).alias("total_chars"),
        F.sum(F.size(words(F.col("text")))).alias("total_words"),
        F.count("*").alias("total_pages"),
        F.avg(F.col("width") * F.col("height")).alias("area"),
        (F.max("n_images") > 0).alias("has_images"),
    )
    per_page = F.col("total_chars") / F.col("total_pages")
    words_per_page = F.col("total_words") / F.col("total_pages")
    density = F.when(F.col("area") > 0, F.col("total_chars") / F.col("area")).otherwise(F.lit(0.0))
    votes = [
        F.col("total_chars") < MIN_CHARS,
        density < MIN_DENSITY,
        words_per_page < MIN_WORDS,
        F.col("has_images") & (per_page < IMAGE_CHARS),
    ]
    n_yes = sum((v.cast("int") for v in votes[1:]), votes[0].cast("int"))
    weigh = lambda side: sum(
        (F.when(v if side == 0 else ~v, F.lit(w[side])).otherwise(F.lit(0.0)) for v, w in zip(votes, WEIGHTS)),
        F.lit(0.0),
    )
    scanned = n_yes >= 2
    confidence = F.when(scanned, weigh(0) / n_yes).otherwise(weigh(1) / F.greatest(4 - n_yes, F.lit(1)))
    return stats.select(
        "doc_id",
        scanned.alias("is_scanned"),
        F.round(confidence, 3).alias("confidence"),
        "total_chars",
        "total_pages",
        F.round(per_page, 1).alias("avg_chars_per_page"),
        F.round(words_per_page, 1).alias("avg_words_per_page"),
        F.round(density, 6).alias("text_density"),
        "has_images",
        F.when(scanned, NEEDS_OCR).otherwise(DIRECT).alias("action"),
    )
