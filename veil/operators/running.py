"""Running totals and ranks that hold when one group has most of the rows.

A group is cut into blocks of the order key. Block totals are counted first (partial aggregation),
summed over the few blocks of a group, and added to the running value inside each block, so no task
sees more than one block of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, group: list[str], order: str, value: str, out: str, block: Column) -> DataFrame:
    """``out`` = sum of ``value`` over the group's rows up to this one in ``order``.

    ``block`` must grow with ``order`` (for example order divided by a block length).
    """
    rows = df.withColumn("_block", block)
    totals = rows.groupBy(*group, "_block").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(offsets, [*group, "_block"])
        .withColumn(out, F.sum(value).over(inside) + F.col("_before"))
        .drop("_block", "_before")
    )


def block_rank(df: DataFrame, group: list[str], order: Column, block: Column, out: str) -> DataFrame:
    """0-based rank of distinct rows in a group by ``order``; ``block`` must grow with ``order``."""
    rows = df.withColumn("_order", order).withColumn("_block", block).withColumn("_one", F.lit(1).cast("bigint"))
    return (
        running_sum(rows, [*group], "_order", "_one", out, F.col("_block"))
        .withColumn(out, F.col(out) - 1)
        .drop("_order", "_one")
    )
