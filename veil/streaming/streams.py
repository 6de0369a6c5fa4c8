"""Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veil.operators.mask import protect

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_folder(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000, glob: str = "*.parquet") -> DataFrame:
    """Files arriving in a folder as a stream."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", glob).parquet(path)
    )


def read_table(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """The files of one table as a stream: ``path`` is a single file or the folder that holds its parts.

    A stream takes a single file by a pattern only, so the last character of the path is written as one.
    """
    only = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(only)


def arrivals(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000, glob: str = "*.parquet") -> DataFrame:
    """Like ``read_folder``, with ``arrived``: when the row's file was last written."""
    rows = read_folder(spark, path, schema, files_per_batch, glob)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def once(arriving: DataFrame, within: str = "1 day") -> DataFrame:
    """A row per content: what is delivered again less than ``within`` after it is dropped, over restarts, too.

    The state is one digest per row for that time; the digest covers every column but ``arrived``, and nulls count
    as values. A row that arrives later than that counts as new.
    """
    content = F.sha2(F.to_json(F.struct(*[c for c in arriving.columns if c != "arrived"])), 256)
    watched = arriving.withColumn("_content", content).withWatermark("arrived", within)
    return watched.dropDuplicatesWithinWatermark(["_content"]).drop("_content", "arrived")


def mask_stream(documents: DataFrame, registry, min_confidence: float = 0.0, salt: str = "") -> DataFrame:
    """Each arriving document is masked from its own matches: stateless, so it scales out and restarts freely."""
    return protect(documents, registry, min_confidence, salt).drop("plan")


def progress_stream(pages: DataFrame) -> DataFrame:
    """Running totals per document; the state is two counters per document."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), F.max("page_num").alias("last_page")
    )


def window_stream(events: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Events per type per tumbling window; rows later than the watermark are dropped with their state."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "cents")
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there once, append to parquet; restarts continue from the checkpoint."""
    return (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Update-mode results as parquet: each batch is written under its number, so a replay overwrites itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of every key among the written updates."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select(*keys, "v.*")
