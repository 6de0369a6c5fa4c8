"""Linkability of released rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def k_anonymity(df: DataFrame, quasi_identifiers: list[str], k: int = 5) -> DataFrame:
    """Size of every combination of quasi-identifiers, and whether it is at risk (fewer than k rows)."""
    return df.groupBy(*quasi_identifiers).agg(F.count("*").alias("n")).withColumn("at_risk", F.col("n") < k)


def k_anonymity_summary(groups: DataFrame) -> DataFrame:
    """Combinations, rows, rows at risk, smallest group."""
    return groups.agg(
        F.count("*").alias("n_groups"),
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("at_risk"), F.col("n"))), F.lit(0)).alias("rows_at_risk"),
        F.min("n").alias("smallest_group"),
    )
