"""Plan rows as text lines ``TEXT:TYPE:STRATEGY:PAGE:X0:Y0:X1:Y1`` and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions.text import SPACE, strip

# --- fixed values: header of a written configuration ---
HEADER = [
    "# PII masking configuration",
    "# Format: PII_TEXT:TYPE:STRATEGY:PAGE:X0:Y0:X1:Y1",
    "#",
]
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def config_write(plan: DataFrame) -> DataFrame:
    """One line per plan row, coordinates with two decimals."""
    line = F.format_string(
        "%s:%s:%s:%d:%.2f:%.2f:%.2f:%.2f", "text", "pii_type", "strategy", "page_num", "x0", "y0", "x1", "y1"
    )
    return plan.select("doc_id", "page_num", "y0", "x0", line.alias("line"))


def save_config(plan: DataFrame, path: str) -> None:
    """Text files of lines, each behind its document and a tab: header first, lines in plan order.

    Files hold ranges of documents, so their number follows the data and not the number of documents.
    """
    body = config_write(plan).select("doc_id", F.lit(1).alias("part"), "page_num", "y0", "x0", "line")
    head = plan.select("doc_id").distinct().select(
        "doc_id", F.lit(0).alias("part"), F.lit(0).alias("page_num"),
        F.lit(0.0).alias("y0"), F.lit(0.0).alias("x0"), F.explode(F.array(*map(F.lit, HEADER))).alias("line"),
    )
    (
        head.unionByName(body)
        .repartitionByRange("doc_id", "part", "page_num", "y0", "x0")
        .sortWithinPartitions("doc_id", "part", "page_num", "y0", "x0")
        .select(F.concat_ws("\t", F.col("doc_id").cast("string"), "line"))
        .write.mode("overwrite")
        .text(path)
    )


def _number(part: str, pattern: str, kind: str) -> F.Column:
    cell = strip(F.expr(part))
    return F.when(cell.rlike(pattern), cell.try_cast(kind))


def config_parse(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_num, line) as plan rows.

    Blank lines, comments and lines of fewer than three parts are skipped. From eight parts on the
    last seven are fields and the rest is text (texts may hold colons); below that the last two are
    type and strategy. A bad number drops the row.
    """
    rows = lines.select("doc_id", "line_num", strip(F.col("line")).alias("line"))
    rows = rows.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.withColumn("p", F.split("line", ":"))
    n = F.size("p")
    full = n >= 8
    # one test of the line's tail decides whether its five numbers are good
    tail = f":{SPACE}*{INTEGER[1:-1]}{SPACE}*(:{SPACE}*{NUMBER[1:-1]}{SPACE}*){{4}}$"
    rows = rows.where((n >= 3) & (~full | F.col("line").rlike(tail)))

    def cell(back: int) -> F.Column:
        return strip(F.expr(f"get(p, size(p) - {back})"))

    rows = rows.withColumn("page", cell(5).try_cast("int")).where(~full | F.col("page").isNotNull())
    return rows.select(
        "doc_id",
        F.concat(F.lit("pii_"), F.col("line_num").cast("string")).alias("pii_id"),
        F.expr("array_join(slice(p, 1, size(p) - IF(size(p) >= 8, 7, 2)), ':')").alias("text"),
        F.expr("get(p, size(p) - IF(size(p) >= 8, 7, 2))").alias("pii_type"),
        F.expr("get(p, size(p) - IF(size(p) >= 8, 6, 1))").alias("strategy"),
        F.when(full, F.col("page")).otherwise(F.lit(0)).alias("page_num"),
        *[
            F.when(full, cell(4 - i).try_cast("double")).otherwise(F.lit(0.0)).alias(name)
            for i, name in enumerate(("x0", "y0", "x1", "y1"))
        ],
    )


def config_parse_replacement(lines: DataFrame) -> DataFrame:
    """The dialect with replacements: ``TEXT:TYPE:STRATEGY[:REPLACEMENT]`` or the coordinate form.

    Type is upper-cased, strategy lower-cased, every field trimmed. A bad coordinate keeps defaults
    for itself and what follows it instead of dropping the row.
    """
    rows = lines.select("doc_id", "line_num", strip(F.col("line")).alias("line"))
    rows = rows.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.withColumn("p", F.split("line", ":")).where(F.size("p") >= 3)
    n = F.size("p")
    full, plain = n >= 8, n == 3
    # fields behind the text: seven with coordinates, two plain, three with a replacement
    rows = rows.withColumn("k", F.when(full, 7).when(plain, 2).otherwise(3))
    numbers = [_number("get(p, size(p) - 5)", INTEGER, "int")] + [
        _number(f"get(p, size(p) - {4 - i})", NUMBER, "double") for i in range(4)
    ]
    columns, good = [], full
    for value, (name, default) in zip(numbers, [("page_num", 0), ("x0", 0.0), ("y0", 0.0), ("x1", 0.0), ("y1", 0.0)]):
        good = good & value.isNotNull()
        columns.append(F.when(good, value).otherwise(F.lit(default)).alias(name))
    return rows.select(
        "doc_id",
        "line_num",
        strip(F.expr("array_join(slice(p, 1, size(p) - k), ':')")).alias("text"),
        F.upper(strip(F.expr("get(p, size(p) - k)"))).alias("pii_type"),
        F.lower(strip(F.expr("get(p, size(p) - k + 1)"))).alias("strategy"),
        *columns,
        F.when(~full & ~plain, strip(F.expr("get(p, size(p) - 1)"))).alias("replacement"),
    )
