"""The document registry: append, list, update, expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.text import content_type

SCHEMA = (
    "document_id string, user_id string, original_name string, file_type string, mime_type string, "
    "file_size bigint, status string, upload_date timestamp, metadata map<string,string>"
)


def registry_rows(files: DataFrame, status: str = "uploaded") -> DataFrame:
    """Registry rows from files with document_id, user_id, original_name, file_size, upload_date."""
    name = F.col("original_name")
    return files.select(
        "document_id",
        "user_id",
        "original_name",
        F.when(name.contains("."), F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).alias("file_type"),
        content_type(name).alias("mime_type"),
        "file_size",
        F.lit(status).alias("status"),
        "upload_date",
        F.create_map(F.lit("document_id"), F.col("document_id")).alias("metadata"),
    )


def registry_append(rows: DataFrame, path: str) -> None:
    """Append, partitioned by status so that lifecycle reads prune."""
    rows.write.mode("append").partitionBy("status").parquet(path)


def registry_list(registry: DataFrame, user_id: str | None = None, status: str | None = None, document_id: str | None = None) -> DataFrame:
    out = registry
    for column, value in (("user_id", user_id), ("status", status), ("document_id", document_id)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy(F.col("upload_date").desc())


def recent_masked(registry: DataFrame, search: str, n: int = 6, *ties: str) -> DataFrame:
    """The newest masked files whose name contains ``search``, ignoring case."""
    hit = (F.col("status") == "masked") & F.contains(F.lower("original_name"), F.lit(search.lower()))
    return registry.where(hit).orderBy(F.col("upload_date").desc(), *ties).limit(n)


def recent_jobs(jobs: DataFrame, user_id: str, n: int = 20) -> DataFrame:
    return jobs.where(F.col("user_id") == user_id).orderBy(F.col("created_at").desc(), "job_id").limit(n)


def paginate(df: DataFrame, order: list[Column], page: int = 1, per_page: int = 20) -> DataFrame:
    """One page of rows with total, pages, has_next, has_prev.

    The total is a partial-aggregated count in a scalar subquery, and the page a top-k.
    """
    total = df.groupBy().agg(F.count("*").alias("n")).scalar()
    rows = df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    return (
        rows.withColumn("total", total)
        .withColumn("pages", F.ceil(F.col("total") / per_page))
        .withColumn("has_next", F.lit(page * per_page) < F.col("total"))
        .withColumn("has_prev", F.lit(page > 1))
    )


def status_of(registry: DataFrame, configs: DataFrame) -> DataFrame:
    """Per document: uploaded, config_generated, masking_completed and row counts."""
    counts = registry.groupBy("document_id").agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("status") == "uploaded").alias("uploaded_count"),
        F.count_if(F.col("status") == "masked").alias("masked_count"),
    )
    known = configs.select("document_id").distinct().withColumn("config_generated", F.lit(True))
    return counts.join(known, "document_id", "left").select(
        "document_id",
        (F.col("uploaded_count") > 0).alias("uploaded"),
        F.coalesce("config_generated", F.lit(False)).alias("config_generated"),
        (F.col("masked_count") > 0).alias("masking_completed"),
        "total_files",
        "uploaded_count",
        "masked_count",
    )


def merge_metadata(old: Column, new: Column) -> Column:
    """Old keys stay, new ones are added, on conflict the new value wins."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))


def metadata_merge(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply (document_id, metadata) updates, one per document, to the registry."""
    u = updates.select("document_id", F.col("metadata").alias("_new"))
    return registry.join(u, "document_id", "left").withColumn("metadata", merge_metadata(F.col("metadata"), F.col("_new"))).drop("_new")


def retention(registry: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """What stays: after masking a document loses its uploaded rows; forced documents lose all."""
    masked = registry.where(F.col("status") == "masked").select("document_id").distinct()
    uploaded = registry.where(F.col("status") == "uploaded").join(masked, "document_id", "left_anti")
    kept = registry.where(~F.col("status").eqNullSafe("uploaded")).unionByName(uploaded)
    return kept if forced is None else kept.join(forced.select("document_id"), "document_id", "left_anti")


def retention_counts(registry: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Rows deleted per document."""
    before = registry.groupBy("document_id").agg(F.count("*").alias("before"))
    after = retention(registry, forced).groupBy("document_id").agg(F.count("*").alias("after"))
    left = F.coalesce("after", F.lit(0))
    return before.join(after, "document_id", "left").select(
        "document_id", (F.col("before") - left).alias("deleted"), left.alias("kept")
    ).where("deleted > 0")
