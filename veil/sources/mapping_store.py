"""Persisted value mappings, reused across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

SCHEMA = "group_key string, original string, synthetic string"


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The stored mapping, or an empty one where there is none; a store that cannot be read is an error."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def append_mapping(new_rows: DataFrame, path: str) -> None:
    """Add unseen values; earlier entries are never rewritten."""
    new_rows.select("group_key", "original", "synthetic").write.mode("append").partitionBy("group_key").parquet(path)
