"""Counts and scores over entities, plans and the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions import dims
from veil.operators.running import running_sum


def detection_stats(plan: DataFrame) -> DataFrame:
    """Total, per type and per strategy in one pass: (dimension, name, n)."""
    sets = plan.groupingSets([["pii_type"], ["strategy"], []], "pii_type", "strategy").agg(
        F.count("*").alias("n"), F.grouping("pii_type").alias("gt"), F.grouping("strategy").alias("gs")
    )
    return sets.select(
        F.when(F.col("gt") == 0, "type").when(F.col("gs") == 0, "strategy").otherwise("total").alias("dimension"),
        F.when(F.col("gt") == 0, F.col("pii_type")).when(F.col("gs") == 0, F.col("strategy")).otherwise("all").alias("name"),
        "n",
    )


def category_counts(plan: DataFrame) -> DataFrame:
    """Items per review category, also for categories without items."""
    counts = plan.groupBy(dims.category(F.col("pii_type")).alias("category")).agg(F.count("*").alias("n"))
    return dims.category_rows(plan.sparkSession).join(counts, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).alias("n_items")
    )


def user_stats(registry: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Per user: documents, bytes, KB, MB, and counts per file type as sorted text.

    Pre-aggregated per (user, type); what is gathered per user is one entry per file type.
    """
    per_type = registry.groupBy("user_id", F.coalesce("file_type", F.lit("unknown")).alias("ft")).agg(
        F.count("*").alias("n"), F.sum("file_size").alias("bytes")
    )
    stats = per_type.groupBy("user_id").agg(
        F.sum("n").alias("total_documents"),
        F.sum("bytes").alias("total_size_bytes"),
        F.array_join(
            F.sort_array(F.collect_list(F.concat_ws("=", "ft", F.col("n").cast("string")))), ";"
        ).alias("file_types"),
    )
    if users is not None:
        stats = users.select("user_id").join(stats, "user_id", "left")
    size = F.coalesce("total_size_bytes", F.lit(0))
    return stats.select(
        "user_id",
        F.coalesce("total_documents", F.lit(0)).alias("total_documents"),
        size.alias("total_size_bytes"),
        F.round(size / 1024, 2).alias("size_kb"),
        F.round(size / 1048576, 2).alias("total_size_mb"),
        F.coalesce("file_types", F.lit("")).alias("file_types"),
    )


def sensitivity_counts(plan: DataFrame) -> DataFrame:
    """Items per severity as one row of low, medium, high."""
    level = dims.severity_single(F.col("pii_type"))
    return plan.agg(*[F.count_if(level == s).alias(s) for s in ("low", "medium", "high")])


def monthly_trend(items: DataFrame) -> DataFrame:
    """Per month: documents, items detected, items masked. Needs ts, doc_id, masked.

    Counted per (month, document) first, so that distinct documents need no second pass over rows.
    """
    per_doc = items.groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), "doc_id").agg(
        F.count("*").alias("n"), F.count_if("masked").alias("m")
    )
    return per_doc.groupBy("month").agg(
        F.count("*").alias("documents"), F.sum("n").alias("pii_detected"), F.sum("m").alias("masked")
    )


# --- fixed values: score from which a framework counts as compliant or at risk ---
COMPLIANT, AT_RISK = 85.0, 60.0


def score_status(score: Column) -> Column:
    return F.when(score.isNull(), "no findings").when(score >= COMPLIANT, "compliant").when(score >= AT_RISK, "at-risk").otherwise("non-compliant")


def compliance_report(items: DataFrame) -> DataFrame:
    """Per framework: relevant items, masked share as score, status; no score without items. Needs pii_type, masked.

    Items are counted per type before the framework rows are joined, so the join sees one row per type.
    """
    per_type = items.groupBy("pii_type").agg(F.count("*").alias("n"), F.count_if("masked").alias("m"))
    joined = dims.framework_rows(items.sparkSession).join(per_type, "pii_type", "left")
    n, m = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))
    score = F.when(n > 0, F.round(m * 100.0 / n, 2))
    return joined.groupBy("framework").agg(
        n.alias("relevant_items"),
        m.alias("masked_items"),
        F.count("n").alias("types_found"),
        score.alias("score"),
        score_status(score).alias("status"),
    )


def page_running(entities: DataFrame, block: int = 1000) -> DataFrame:
    """Running number of items per document by page."""
    per_page = entities.groupBy("doc_id", "page_num").agg(F.count("*").alias("n_items"))
    return running_sum(
        per_page, ["doc_id"], "page_num", "n_items", "running_items", F.floor(F.col("page_num") / block)
    )


def job_progress(chunks: DataFrame) -> DataFrame:
    """Progress of a job at each chunk: up to 90 while rewriting, 95 assembling, n/N of 100 per dataset.

    Needs chunk_idx, n_chunks, dataset_number, num_datasets; row-local.
    """
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    done = F.col("chunk_idx") + 1
    last = done == F.col("n_chunks")
    return chunks.withColumn("progress", clamp(F.round(done * 90.0 / F.col("n_chunks"), 6))).withColumn(
        "dataset_progress", F.when(last, clamp(F.round(F.col("dataset_number") * 100.0 / F.col("num_datasets"), 6)))
    ).withColumn("assembling", F.when(last, F.lit(95.0)))


def processing_summary(uploads: DataFrame, detections: DataFrame, maskings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per document and overall outcome of upload -> detect -> mask.

    Inputs hold document_id and ok, plus filename and file_size (uploads), total_pii (detections),
    masked_filename (maskings).
    """
    docs = (
        uploads.select("document_id", "filename", "file_size", F.col("ok").alias("uploaded"))
        .join(detections.select("document_id", "total_pii", F.col("ok").alias("detected")), "document_id", "left")
        .join(maskings.select("document_id", "masked_filename", F.col("ok").alias("masked")), "document_id", "left")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    docs = docs.select(
        "document_id", "filename", "file_size", "total_pii", "masked_filename",
        yes("uploaded").alias("uploaded"), yes("detected").alias("detected"), yes("masked").alias("masked"),
        F.when(yes("uploaded") & yes("detected") & yes("masked"), "completed").otherwise("failed").alias("status"),
    )
    overall = docs.agg(
        F.count("*").alias("total_files"),
        F.count_if("uploaded").alias("successful_uploads"),
        F.count_if(~F.col("uploaded")).alias("failed_uploads"),
        F.count_if("detected").alias("successful_detections"),
        F.count_if(F.col("uploaded") & ~F.col("detected")).alias("failed_detections"),
        F.count_if("masked").alias("successful_maskings"),
        F.count_if(F.col("detected") & ~F.col("masked")).alias("failed_maskings"),
    )
    overall = overall.withColumn(
        "overall_status",
        F.when(F.col("successful_maskings") == F.col("total_files"), "completed")
        .when(F.col("successful_maskings") > 0, "partial_success")
        .otherwise("failed"),
    )
    return docs, overall
