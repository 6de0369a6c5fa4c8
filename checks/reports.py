"""Sources and sinks, registry lifecycle, reports, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import DERIVED, case, derived, query, table
from checks.detection import CUSTOM, MASKED
from checks.inputs import ALL_TYPES, O
from checks.sqltext import category_sql, quote, strategy_sql
from veil.functions import dims
from veil.operators import privacy, report
from veil.session import shared_path
from veil.sources import readers
from veil.sources import registry as reg
from veil.streaming import streams

# --- files ---------------------------------------------------------------------------------------


@query("src_text", "SELECT count(*) AS n_lines, CAST(sum(length(c_name || ' é') + 1) AS BIGINT) AS n_chars FROM customer")
def src_text(spark, sf):
    """Text files written from a table and read back whole."""
    path = shared_path(spark, "texts")
    table(spark, sf, "customer").select(F.concat("c_name", F.lit(" é")).alias("value")).write.text(path)
    files = readers.read_text(spark, path).where("doc_id LIKE '%.txt'")
    return files.agg(F.sum(F.size(F.split("text", "\n")) - 1).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query(
    "src_csv_dir",
    """SELECT 'customer.csv' AS file, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, count(DISTINCT c_name) AS names FROM customer
    UNION ALL SELECT 'supplier.csv', count(*), CAST(sum(s_suppkey) AS BIGINT), count(DISTINCT s_name) FROM supplier""",
)
def src_csv_dir(spark, sf):
    """A directory of CSV files as a table set."""
    path = shared_path(spark, "csv")
    readers.write_csv_set({f"{t}.csv": table(spark, sf, t) for t in ("customer", "supplier")}, path)
    found = readers.read_csv_dir(spark, path)
    parts = []
    for name, df in found.items():
        k, n = df.columns[0], df.columns[1]
        parts.append(
            df.groupBy(n).agg(F.count("*").alias("n"), F.sum(k).alias("keys"))
            .agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), F.count("*").alias("names"))
            .select(F.lit(name).alias("file"), "n", F.col("keys").cast("bigint").alias("keys"), "names")
        )
    return parts[0].unionByName(parts[1])


@query("sink_csv", "SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def sink_csv(spark, sf):
    """An anonymized table written as CSV: row counts and distinct stand-ins survive the round trip."""
    from checks.tables import renamed
    from veil.plans.jobs import anonymize_set

    path = shared_path(spark, "anonymized")
    out = anonymize_set({"orders.csv": renamed(spark, sf)["orders"]}, {"cust_id": "generic_id"})
    readers.write_csv_set(out, path)
    back = readers.read_csv_dir(spark, path)["orders.csv"]
    per_key = back.groupBy("status", "cust_id").agg(F.count("*").alias("n"))
    return per_key.groupBy("status").agg(F.sum("n").alias("n"), F.count("*").alias("customers"))


DERIVED["files"] = f"""SELECT 'doc' || CAST({O} AS STRING) AS document_id, 'user' || CAST(o_custkey AS STRING) AS user_id,
    'F' || CAST({O} AS STRING) || {case(O, "'.pdf'", "'.DOCX'", "'.txt'", "''")} AS original_name, CAST({O} * 37 % 100000000 AS BIGINT) AS file_size, o_orderdate AS upload_date FROM {{orders}}"""


@query(
    "registry_append",
    """SELECT CASE WHEN contains(original_name, '.') THEN '.' || lower(split_part(original_name, '.', -1)) END AS file_type,
    CASE WHEN original_name LIKE '%.pdf' THEN 'application/pdf' WHEN original_name LIKE '%.DOCX' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
        WHEN original_name LIKE '%.txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime_type, 'uploaded' AS status, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM files GROUP BY 1, 2""",
    ("files",),
)
def registry_append(spark, sf):
    """Registry rows appended twice over, read back with the status partition pruned."""
    path = shared_path(spark, "registry")
    files = derived(spark, sf, "files")
    reg.registry_append(reg.registry_rows(files), path)
    reg.registry_append(reg.registry_rows(files, "masked"), path)
    back = spark.read.schema(reg.SCHEMA).parquet(path).where("status = 'uploaded'")
    return back.groupBy("file_type", "mime_type", "status").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


# --- registry ------------------------------------------------------------------------------------


@query(
    "registry_list",
    "SELECT document_id, original_name, upload_date, row_id FROM registry WHERE user_id = 'user7' AND status = 'uploaded'",
    ("registry",),
)
def registry_list(spark, sf):
    out = reg.registry_list(derived(spark, sf, "registry"), user_id="user7", status="uploaded")
    return out.select("document_id", "original_name", "upload_date", "row_id")


@query(
    "recent_masked",
    "SELECT row_id, original_name, upload_date FROM registry WHERE status = 'masked' AND contains(lower(original_name), 'file_1') ORDER BY upload_date DESC, row_id LIMIT 6",
    ("registry",),
)
def recent_masked(spark, sf):
    return reg.recent_masked(derived(spark, sf, "registry"), "File_1", 6, "row_id").select("row_id", "original_name", "upload_date")


@query(
    "recent_jobs",
    "SELECT job_id, status, num_datasets, created_at FROM jobs WHERE user_id = 'user5' ORDER BY created_at DESC, job_id LIMIT 20",
    ("jobs",),
)
def recent_jobs(spark, sf):
    return reg.recent_jobs(derived(spark, sf, "jobs"), "user5").select("job_id", "status", "num_datasets", "created_at")


@query(
    "paginate",
    """SELECT row_id, original_name, t AS total, CAST(ceil(t / 20.0) AS BIGINT) AS pages, 3 * 20 < t AS has_next, true AS has_prev
    FROM (SELECT row_id, original_name, upload_date FROM registry ORDER BY upload_date DESC, row_id LIMIT 20 OFFSET 40), (SELECT count(*) AS t FROM registry)""",
    ("registry",),
)
def paginate(spark, sf):
    order = [F.col("upload_date").desc(), F.col("row_id")]
    out = reg.paginate(derived(spark, sf, "registry"), order, page=3)
    return out.select("row_id", "original_name", "total", "pages", "has_next", "has_prev")


@query(
    "status_of",
    """SELECT r.document_id, count(*) FILTER (status = 'uploaded') > 0 AS uploaded, max(c.document_id) IS NOT NULL AS config_generated, count(*) FILTER (status = 'masked') > 0 AS masking_completed,
    count(*) AS total_files, count(*) FILTER (status = 'uploaded') AS uploaded_count, count(*) FILTER (status = 'masked') AS masked_count
    FROM registry r LEFT JOIN (SELECT DISTINCT document_id FROM registry WHERE file_type = '.pdf') c ON r.document_id = c.document_id GROUP BY r.document_id""",
    ("registry",),
)
def status_of(spark, sf):
    registry = derived(spark, sf, "registry")
    return reg.status_of(registry, registry.where("file_type = '.pdf'"))


@query(
    "metadata_merge",
    """SELECT row_id, CASE WHEN status = 'masked' THEN 'local_path=/p' || row_id || ';masked=yes;pages=new' ELSE 'local_path=/p' || row_id || ';pages=' || row_id % 9 END AS metadata FROM registry""",
    ("registry",),
)
def metadata_merge(spark, sf):
    """Updates for masked rows: one key replaced, one added."""
    registry = derived(spark, sf, "registry").withColumn("document_id", F.col("row_id").cast("string"))
    old = registry.withColumn(
        "metadata",
        F.create_map(
            F.lit("local_path"), F.concat(F.lit("/p"), F.col("row_id").cast("string")),
            F.lit("pages"), (F.col("row_id") % 9).cast("string"),
        ),
    )
    new = registry.where("status = 'masked'").select(
        "document_id", F.create_map(F.lit("pages"), F.lit("new"), F.lit("masked"), F.lit("yes")).alias("metadata")
    )
    flat = F.array_join(F.sort_array(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return reg.metadata_merge(old, new).select("row_id", flat.alias("metadata"))


KEPT = """(SELECT * FROM registry WHERE NOT (status = 'uploaded' AND document_id IN (SELECT document_id FROM registry WHERE status = 'masked')) AND document_id NOT IN (SELECT document_id FROM registry WHERE file_size > 99000000))"""


@query(
    "retention",
    f"""SELECT b.document_id, b.n - coalesce(a.n, 0) AS deleted, coalesce(a.n, 0) AS kept FROM (SELECT document_id, count(*) AS n FROM registry GROUP BY 1) b
    LEFT JOIN (SELECT document_id, count(*) AS n FROM {KEPT} GROUP BY 1) a ON b.document_id = a.document_id WHERE b.n > coalesce(a.n, 0)""",
    ("registry",),
)
def retention(spark, sf):
    registry = derived(spark, sf, "registry")
    forced = registry.where("file_size > 99000000").select("document_id").distinct()
    return reg.retention_counts(registry, forced)


# --- reports -------------------------------------------------------------------------------------


@query(
    "detection_stats",
    f"""WITH p AS (SELECT pii_type, {strategy_sql('pii_type')} AS strategy FROM entities) SELECT 'type' AS dimension, pii_type AS name, count(*) AS n FROM p GROUP BY 2
    UNION ALL SELECT 'strategy', strategy, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM p""",
    ("entities",),
)
def detection_stats(spark, sf):
    plan = derived(spark, sf, "entities").withColumn("strategy", dims.suggest_strategy(F.col("pii_type")))
    return report.detection_stats(plan)


@query(
    "category_counts",
    f"SELECT c.category, coalesce(n, 0) AS n_items FROM (SELECT unnest({dims.CATEGORIES}) AS category) c LEFT JOIN (SELECT {category_sql('pii_type')} AS category, count(*) AS n FROM entities GROUP BY 1) e ON c.category = e.category",
    ("entities",),
)
def category_counts(spark, sf):
    return report.category_counts(derived(spark, sf, "entities"))


@query(
    "user_stats",
    """SELECT u.user_id, coalesce(s.n, 0) AS total_documents, coalesce(s.b, 0) AS total_size_bytes, round(coalesce(s.b, 0) / 1024.0::DOUBLE, 2) AS size_kb, round(coalesce(s.b, 0) / 1048576.0::DOUBLE, 2) AS total_size_mb, coalesce(t.f, '') AS file_types
    FROM (SELECT 'user' || c_custkey AS user_id FROM customer) u LEFT JOIN (SELECT user_id, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS b FROM registry GROUP BY 1) s ON u.user_id = s.user_id
    LEFT JOIN (SELECT user_id, string_agg(e, ';' ORDER BY e) AS f FROM (SELECT user_id, coalesce(file_type, 'unknown') || '=' || count(*) AS e FROM registry GROUP BY user_id, coalesce(file_type, 'unknown')) GROUP BY 1) t ON u.user_id = t.user_id""",
    ("registry",),
)
def user_stats(spark, sf):
    users = table(spark, sf, "customer").select(F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("user_id"))
    return report.user_stats(derived(spark, sf, "registry"), users)


DERIVED["dated_items"] = f"""SELECT o_orderdate AS ts, o_custkey AS doc_id, {case(O, *[f"'{t}'" for t in ALL_TYPES])} AS pii_type, {O} % 5 <> 0 AND {O} % 33 <> 2 AS masked FROM {{orders}}"""


@query(
    "scorecard",
    "SELECT date_trunc('month', ts) AS month, count(DISTINCT doc_id) AS documents, count(*) AS pii_detected, count(*) FILTER (masked) AS masked FROM dated_items GROUP BY 1",
    ("dated_items",),
)
def scorecard(spark, sf):
    return report.monthly_trend(derived(spark, sf, "dated_items"))


HIGH, MED = (", ".join(quote(t) for t in ts) for ts in (dims.HIGH_TYPES, dims.MEDIUM_TYPES))


@query(
    "sensitivity_counts",
    f"SELECT count(*) FILTER (pii_type NOT IN ({HIGH}, {MED})) AS low, count(*) FILTER (pii_type IN ({MED})) AS medium, count(*) FILTER (pii_type IN ({HIGH})) AS high FROM entities",
    ("entities",),
)
def sensitivity_counts(spark, sf):
    return report.sensitivity_counts(derived(spark, sf, "entities"))


FRAMEWORKS = " UNION ALL ".join(f"SELECT '{f}' AS framework, unnest({ts}) AS pii_type" for f, ts in dims.FRAMEWORKS.items())


@query(
    "compliance_report",
    f"""SELECT *, CASE WHEN score IS NULL THEN 'no findings' WHEN score >= 85 THEN 'compliant' WHEN score >= 60 THEN 'at-risk' ELSE 'non-compliant' END AS status FROM
    (SELECT f.framework, count(i.pii_type) AS relevant_items, count(*) FILTER (i.masked) AS masked_items, count(DISTINCT i.pii_type) AS types_found, CASE WHEN count(i.pii_type) > 0 THEN round(count(*) FILTER (i.masked) * 100.0::DOUBLE / count(i.pii_type), 2) END AS score
    FROM ({FRAMEWORKS}) f LEFT JOIN dated_items i ON f.pii_type = i.pii_type GROUP BY f.framework)""",
    ("dated_items",),
)
def compliance_report(spark, sf):
    return report.compliance_report(derived(spark, sf, "dated_items"))


@query(
    "k_anonymity",
    "SELECT c_nationkey, c_mktsegment, count(*) AS n, count(*) < 10 AS at_risk FROM customer GROUP BY 1, 2",
)
def k_anonymity(spark, sf):
    return privacy.k_anonymity(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], 10)


@query(
    "k_anonymity_summary",
    """SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (n < 10), 0) AS BIGINT) AS rows_at_risk, min(n) AS smallest_group
    FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)""",
)
def k_anonymity_summary(spark, sf):
    groups = privacy.k_anonymity(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], 10)
    return privacy.k_anonymity_summary(groups)


# --- streams -------------------------------------------------------------------------------------


@query("stream_mask", f"SELECT doc_id, sha256(masked_text) AS masked_sha, n_masked FROM {MASKED}")
def stream_mask(spark, sf):
    """Documents arriving in a folder, masked once; equals the batch result."""
    stream = streams.read_table(spark, f"{sf}/documents.parquet", streams.DOCUMENT_SCHEMA)
    out, mark = shared_path(spark, "masked"), shared_path(spark, "offsets")
    streams.run_available(streams.mask_stream(readers.documents(stream), CUSTOM), out, mark).awaitTermination()
    back = spark.read.parquet(out)
    return back.select("doc_id", F.sha2("masked_text", 256).alias("masked_sha"), "n_masked")


@query(
    "stream_progress",
    "SELECT conv_id AS doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, max(turn) AS last_page FROM conversations GROUP BY 1",
)
def stream_progress(spark, sf):
    schema = "conv_id bigint, turn bigint, role string, text string"
    stream = streams.read_table(spark, f"{sf}/conversations.parquet", schema)
    pages = stream.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), "text")
    out, mark = shared_path(spark, "progress"), shared_path(spark, "offsets")
    streams.run_updates(streams.progress_stream(pages), out, mark).awaitTermination()
    return streams.latest(spark, out, ["doc_id"])


@query(
    "stream_window",
    "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2",
)
def stream_window(spark, sf):
    stream = streams.read_table(spark, f"{sf}/events.parquet", streams.EVENT_SCHEMA)
    out, mark = shared_path(spark, "windows"), shared_path(spark, "offsets")
    streams.run_updates(streams.window_stream(stream), out, mark).awaitTermination()
    return streams.latest(spark, out, ["window_start", "event_type"])
