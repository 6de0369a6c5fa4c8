"""Registry of queries and the inputs they share.

Derived inputs are written once as SQL that Spark and DuckDB both run: Spark reads it through
``derived``, the check SQL names it in its WITH clause through ``with_inputs``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veil.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(key: str, sql: str | None = None, inputs: tuple = ()):
    """Register a query and, if it has one, its check SQL."""

    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = with_inputs(sql, inputs)
        return fn

    return add


DERIVED: dict[str, str] = {}
PLACEHOLDER = re.compile(r"\{(\w+)\}")
QUOTED_NAME = re.compile(r'"(start|end|left)"(?!:)')


def needs(name: str) -> list[str]:
    """Derived inputs a derived input uses, in order of definition."""
    found: list[str] = []
    for other in DERIVED:
        if other != name and re.search(rf"\{{{other}\}}", DERIVED[name]):
            for n in needs(other) + [other]:
                if n not in found:
                    found.append(n)
    return found


def with_inputs(sql: str, inputs: tuple) -> str:
    names: list[str] = []
    for name in inputs:
        for n in needs(name) + [name]:
            if n not in names:
                names.append(n)
    parts = [f"{n} AS ({PLACEHOLDER.sub(r'\1', DERIVED[n])})" for n in names]
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, sql[5:]]) if not sql.upper().startswith("WITH RECURSIVE") else (
            "WITH RECURSIVE " + ", ".join([*parts, sql[15:]])
        )
    return ("WITH " + ", ".join(parts) + " " if parts else "") + sql


EXPANDED = {"pii_corpus": "c_custkey"}  # inputs that make long texts of one narrow column


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = QUOTED_NAME.sub(r"`\1`", DERIVED[name])
    frames = {
        n: derived(spark, sf_dir, n) if n in DERIVED else table(spark, sf_dir, n)
        for n in set(PLACEHOLDER.findall(sql))
    }
    if name in EXPANDED:
        frames = {n: readers.dealt(df.select(EXPANDED[name])) for n, df in frames.items()}
    # braces of JSON texts are doubled, those of inputs stay
    sql = PLACEHOLDER.sub("\x01\\1\x02", sql).replace("{", "{{").replace("}", "}}")
    return spark.sql(sql.replace("\x01", "{").replace("\x02", "}"), **frames)


def case(key: str, *values: str) -> str:
    """``CASE key % n WHEN i THEN value`` in both dialects."""
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"(CASE {key} % {len(values)} {arms} END)"
