"""Synthetic tables with the statistical shape of given ones: weighted sampling by interval joins.

A shape is a set of tables, so its size does not matter to the driver or to the plan. The values of a category
column, and the numbers of children of a parent, own intervals of [0, 2^40) as long as their shares. The cut points
of a number column come by slot. A draw is 40 bits of the digest of row and column; it meets the interval it falls
into by a join. Results do not depend on partitions or retries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veil.functions.hashing import digest
from veil.operators.running import running_sum
from veil.session import cut_lineage

BITS = 40
SLOTS = 100
MARKS = 256
KEYS_A_BLOCK = 100_000
FAN_OUT = "fan_out"


@dataclass
class Shape:
    """Shares of categories (column, value, lo, hi, block) and cut points of numbers (column, slot, low, high).

    ``shifts`` and ``types`` have one entry per column; they are all that the driver knows.
    """

    shares: DataFrame | None = None
    cuts: DataFrame | None = None
    numbers: list[str] = field(default_factory=list)
    shifts: dict[str, int] = field(default_factory=dict)
    types: dict[str, T.DataType] = field(default_factory=dict)


def draw(row: str, column: str, salt: str = "", start: int = 1) -> Column:
    """40 bits that depend on row and column only."""
    name = column.replace("\\", "\\\\").replace("'", "\\'")
    hashed = digest(f"concat('{name}:', CAST(`{row}` AS STRING))", salt)
    return F.expr(f"CAST(conv(substr({hashed}, {start}, {BITS // 4}), 16, 10) AS BIGINT)")


def tally(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(column, value, n) of several columns at once; repeats are counted before they travel."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def spread(df: DataFrame, first: str, last: str, out: str, step: int = 4096) -> DataFrame:
    """A row for every number from ``first`` to ``last``; a row with a long range is dealt over tasks first."""
    length = F.col(last) - F.col(first) + 1
    short = df.where((length > 0) & (length <= step)).withColumn(out, F.expr(f"explode(sequence({first}, {last}))"))
    parts = df.where(length > step).withColumn("_at", F.expr(f"explode(sequence({first}, {last}, {step}L))"))
    long = parts.repartition("_at").withColumn(
        out, F.expr(f"explode(sequence(_at, least(_at + {step - 1}, {last})))")
    )
    return short.unionByName(long.drop("_at"))


def interval_shares(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """Intervals of every value of every column, cut at blocks of equal length, and the blocks' bits.

    A column of m values has between m and 2m blocks (1024 at least), so there are at most 3m pieces or so, and
    a draw compares with three of them on average, however uneven the shares are. Draws are even over blocks.
    """
    counts = tally(df, columns, "string").withColumn("h", F.expr("sha2(coalesce(concat('=', value), ''), 256)"))
    # by digest, so that the blocks of the running sum have equal numbers of values
    placed = cut_lineage(running_sum(cut_lineage(counts), ["column"], "h", "n", "until", F.substring("h", 1, 3)))
    totals = placed.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").alias("m"))
    totals = cut_lineage(totals.withColumn("shift", F.expr(f"{BITS} - greatest(10, length(bin(m)))")))
    shifts = {r["column"]: r["shift"] for r in totals.collect()}  # one row per column
    end = f"CAST(floor(CAST({{}} AS DOUBLE) / total * {1 << BITS}D) AS BIGINT)"
    whole = placed.join(F.broadcast(totals), "column").selectExpr(  # one row per column
        "column", "value", f"{end.format('until - n')} AS lo", f"{end.format('until')} AS hi", "shift"
    )
    cut = spread(
        whole.selectExpr("*", "shiftright(lo, shift) AS b0", "shiftright(hi - 1, shift) AS b1").where("lo < hi"),
        "b0", "b1", "block",
    )
    return cut_lineage(cut.select("column", "value", "lo", "hi", "block")), shifts


def cut_points(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, slot, low, high, null_below): exact percentiles, a slot from each to the next.

    Ranks come from running sums over blocks of the value; approximate percentiles choose the blocks only.
    ``null_below`` is the share of nulls (NaN is one) in units of 2^-40.
    """
    counts = tally(df, columns, "double")
    counts = cut_lineage(counts.withColumn("value", F.when(~F.isnan("value"), F.col("value"))))
    steps = F.array(*[F.lit(i / MARKS) for i in range(1, MARKS)])
    known = F.col("value").isNotNull()
    marks = counts.groupBy("column").agg(
        F.percentile_approx("value", steps, 10000).alias("marks"),
        F.sum(F.when(known, F.col("n"))).alias("total"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"),
    )
    placed = counts.where(known).join(F.broadcast(marks), "column")  # one row of 255 marks per column
    block = F.expr("size(filter(marks, p -> p < value))")
    ranked = running_sum(placed, ["column"], "value", "n", "until", block)
    points = ranked.selectExpr(
        "column", "value", f"CAST(floor(CAST(nulls AS DOUBLE) / (nulls + total) * {1 << BITS}D) AS BIGINT) AS null_below",
        f"CAST(ceil((until - n) * {SLOTS}D / greatest(total - 1, 1)) AS BIGINT) AS i0",
        f"IF(until = total, {SLOTS}L, (until * {SLOTS} - 1) div (total - 1)) AS i1",
    ).where("i0 <= i1").selectExpr("column", "value", "null_below", "explode(sequence(i0, i1)) AS slot")
    ahead = Window.partitionBy("column").orderBy("slot")  # 101 rows
    return cut_lineage(
        points.select("column", "slot", F.col("value").alias("low"), F.lead("value").over(ahead).alias("high"), "null_below")
        .where(F.col("slot") < SLOTS)
    )


def profile(df: DataFrame, numeric: list[str], categorical: list[str]) -> Shape:
    """The shape of a table. Nulls are a value of a category and a share of a number.

    An empty table has no shares and no cut points; rows drawn from it hold nulls.
    """
    shape = Shape(numbers=list(numeric), types={c: df.schema[c].dataType for c in categorical})
    if numeric:
        shape.cuts = cut_points(df, numeric)
    if categorical:
        shape.shares, shape.shifts = interval_shares(df, categorical)
    return shape


def fan_out(parents: DataFrame, key: str, children: DataFrame, foreign: str) -> Shape:
    """How many children parents have, those without any included; children without a parent do not count."""
    per = children.groupBy(F.col(foreign).alias("_key")).agg(F.count("*").alias("_n"))
    counted = parents.select(F.col(key).alias("_key")).join(per, "_key", "left")
    shares, shifts = interval_shares(counted.select(F.coalesce("_n", F.lit(0)).alias(FAN_OUT)), [FAN_OUT])
    return Shape(shares=shares, shifts=shifts, types={FAN_OUT: T.LongType()})


def draw_category(rows: DataFrame, key: str, column: str, shape: Shape, salt: str = "") -> DataFrame:
    """``rows`` with a value of the column, each as likely as it is frequent."""
    pieces = shape.shares.where(F.col("column") == column).select(
        F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("block").alias("_block"),
        F.col("value").cast(shape.types[column]).alias(column),
    )
    drawn = rows.withColumn("_x", draw(key, column, salt))
    drawn = drawn.withColumn("_block", F.shiftright("_x", shape.shifts.get(column, 0)))
    inside = (F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_hi"))
    return drawn.join(pieces, (drawn["_block"] == pieces["_block"]) & inside, "left").select(*rows.columns, column)


def draw_number(rows: DataFrame, key: str, column: str, shape: Shape, salt: str = "") -> DataFrame:
    """``rows`` with a number by the inverse of the percentile curve, straight between cut points."""
    cuts = shape.cuts.where(F.col("column") == column).select(
        F.col("slot").alias("_slot"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("null_below").alias("_null")
    )
    drawn = rows.withColumn("_x", draw(key, column, salt) * SLOTS)
    drawn = drawn.withColumn("_slot", F.shiftright("_x", BITS)).withColumn("_z", draw(key, column, salt, 1 + BITS // 4))
    value = F.expr(f"IF(_z >= _null, _low + (_high - _low) * ((_x & {(1 << BITS) - 1}L) / {1 << BITS}D), NULL)")
    joined = drawn.join(F.broadcast(cuts), "_slot", "left")  # 100 rows
    return joined.select(*rows.columns, value.alias(column))


def synth_table(rows: DataFrame, key: str, shape: Shape, salt: str = "") -> DataFrame:
    """``rows`` (a unique ``key`` and any other columns) with every column of the shape drawn."""
    for column in shape.numbers:
        rows = draw_number(rows, key, column, shape, salt)
    for column in shape.types:
        rows = draw_category(rows, key, column, shape, salt)
    return rows


def synth_children(parents: DataFrame, key: str, fan: Shape, child_key: str, foreign: str, salt: str = "") -> DataFrame:
    """(child_key, foreign): dense child keys, as many for a parent of ``parents`` as its draw says.

    ``key`` must be a dense number. A parent with most of all children is dealt over tasks.
    """
    drawn = draw_category(parents.select(key), key, FAN_OUT, fan, salt)
    counted = cut_lineage(drawn.select(F.col(key).alias(foreign), F.coalesce(FAN_OUT, F.lit(0)).alias("_n")))
    block = F.expr(f"`{foreign}` div {KEYS_A_BLOCK}")
    ends = running_sum(counted, [], foreign, "_n", "_until", block)
    ranges = ends.selectExpr(f"`{foreign}`", "_until - _n AS _first", "_until - 1 AS _last")
    return spread(ranges, "_first", "_last", child_key).select(child_key, foreign)
