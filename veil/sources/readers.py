"""Scans: text files, page tables, CSV directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.functions.text import SPACE, strip


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (doc_id = path, page_num = 0, text). UTF-8 where valid, else Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.col("path").alias("doc_id"), F.lit(0).alias("page_num"), decode_bytes("content").alias("text")
    )


def decode_bytes(column: str) -> F.Column:
    return F.expr(
        f"CASE WHEN is_valid_utf8(CAST({column} AS STRING)) THEN CAST({column} AS STRING) "
        f"ELSE decode({column}, 'ISO-8859-1') END"
    )


def pages(df: DataFrame, doc_id: str, page_num: str, text: str) -> DataFrame:
    """Any table as ordered pages, blank pages dropped."""
    return df.select(
        F.col(doc_id).alias("doc_id"), F.col(page_num).cast("int").alias("page_num"), F.col(text).alias("text")
    ).where(strip(F.col("text")) != "")


def documents(df: DataFrame) -> DataFrame:
    """A table with one whole text per row as one-page documents."""
    return df.select("doc_id", F.lit(0).alias("page_num"), "text").where(F.col("text").rlike(f"[^{SPACE[1:-1]}]"))


def full_text(page_table: DataFrame) -> DataFrame:
    """Pages joined back into one text per document, each page followed by a blank line.

    One document is bounded by the upload limit (50 MB), so its pages fit one row.
    """
    return page_table.groupBy("doc_id").agg(
        F.expr(
            "concat(array_join(transform(sort_array(collect_list(struct(page_num, text))), p -> p.text), '\n\n'), '\n\n')"
        ).alias("text"),
        F.count("*").alias("n_pages"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan where the session asks for it by ``veil.scan.partitions``.

    Off by default: files are split as they are. For files of one row group, which are one task.
    """
    wanted = df.sparkSession.conf.get("veil.scan.partitions", None)
    return df.repartition(int(wanted)) if wanted else df


ROWS_A_TASK = 8192


def dealt(df: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Rows that become much larger than they are in their file, in as many tasks as their number asks for.

    Files are split by their bytes, so a few columns of a large table are a single task. Deal the narrow
    rows out before they are expanded. The number of rows comes from the files' footers.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_a_task))
    return df.repartition(tasks)


def read_csv_dir(
    spark: SparkSession, directory: str, schemas: dict[str, str] | None = None, multi_line: bool = False
) -> dict[str, DataFrame]:
    """Every ``*.csv`` of a directory as ``{file name: DataFrame}``, in name order.

    A schema given by file name spares the pass that infers one. Quoted line ends need ``multi_line``,
    which makes each file one task; without it files are split.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(directory.rstrip("/") + "/*.csv")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = sorted(str(st.getPath().toString()) for st in (fs.globStatus(pattern) or []))
    return {
        name: spark.read.csv(
            p, schema=(schemas or {}).get(name), header=True, inferSchema=name not in (schemas or {}), multiLine=multi_line, escape='"'
        )
        for p, name in ((p, p.rsplit("/", 1)[1]) for p in paths)
    }


def write_csv_set(tables: dict[str, DataFrame], directory: str) -> None:
    """One CSV folder per input table, under its file name; parts stay parallel."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{directory.rstrip('/')}/{name}", header=True, escape='"')
