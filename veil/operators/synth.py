"""Synthetic copies of text: chunk, rewrite, assemble, replicate."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.patterns import FALLBACK, java_regex
from veil.functions.spans import let, literal
from veil.functions.text import SPACE_CHARS, strip
from veil.operators.chunk import stride_chunks

# --- fixed value: what an empty result says ---
EMPTY_RESULT = (
    "Synthetic data generation completed, but content appears to be empty. "
    "Please check the original document and try again."
)


def fallback_sql(text: str) -> str:
    """The six substitutions in order, as SQL text over a column or lambda variable."""
    for regex, constant in FALLBACK:
        plain = constant.replace("$", "\\$")
        java = java_regex(regex, any_digit=True).replace("]+@", "]++@")  # no run before an @ holds one: nothing to go back for
        text = f"regexp_replace({text}, {literal(java)}, {literal(plain)})"
    return text


def anonymize_fallback(column: str) -> Column:
    return F.expr(fallback_sql(column))


def unfence(text: str) -> str:
    """Drop code fences around a rewritten chunk."""
    return f"regexp_replace(regexp_replace({text}, r'```[0-9A-Za-z_]*\\n', ''), r'\\n```', '')"


def rewrite_with(chunks: DataFrame, rewriter: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Adds ``rewritten`` from a pluggable model, built once per task; a chunk that fails gets null."""
    names = chunks.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema) + ", rewritten string"

    def run(batches):
        rewrite = rewriter()

        def safe(text):
            try:
                return rewrite(text)
            except Exception:
                return None

        for b in batches:
            yield pd.concat([b[names], b["chunk"].map(safe).rename("rewritten")], axis=1)

    return chunks.mapInPandas(run, schema)


def synth_rewrite(chunks: DataFrame) -> DataFrame:
    """Final text per chunk: the model's ``rewritten`` without fences, or the fallback where it is blank."""
    clean = F.expr(unfence("rewritten"))
    blank = F.col("rewritten").isNull() | (strip(clean) == "")
    return chunks.withColumn("synthetic", F.when(blank, anonymize_fallback("chunk")).otherwise(clean))


def assemble_sql(chunks: str) -> str:
    """Join non-blank trimmed chunks by a blank line; at most three newlines in a row."""
    joined = f"""array_join(filter(transform({chunks}, c -> btrim(c, '{SPACE_CHARS}')), c -> c <> ''), '\\n\\n')"""
    few = let(joined, "j", "IF(contains(j, '\\n\\n\\n\\n'), regexp_replace(j, r'\\n{4,}', '\\n\\n\\n'), j)")
    return let(f"btrim({few}, '{SPACE_CHARS}')", "t", f"IF(t = '', '{EMPTY_RESULT}', t)")


def assemble(chunks: DataFrame, group: list[str]) -> DataFrame:
    """Documents from (group…, chunk_idx, synthetic); a document's chunks are bounded by its size limit."""
    return (
        chunks.groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "synthetic"))).alias("c"))
        .select(*group, F.expr(assemble_sql("transform(c, x -> x.synthetic)")).alias("content"))
    )


def replicate(df: DataFrame, datasets: int) -> DataFrame:
    """``datasets`` (1-10) numbered copies of every row."""
    if not 1 <= datasets <= 10:
        raise ValueError("between 1 and 10 datasets")
    return df.withColumn("dataset_number", F.explode(F.sequence(F.lit(1), F.lit(datasets))))


def synthesize(texts: DataFrame, datasets: int = 1, size: int = 2000, overlap: int = 150, dedupe_overlap: bool = True) -> DataFrame:
    """Synthetic datasets of one-row documents with the built-in rewriter: chunk, rewrite, assemble in the row.

    Without a model stage nothing has to be shuffled. ``dedupe_overlap`` drops the repeated head of
    every later chunk.
    """
    chunks = stride_chunks("text", size, overlap)
    if dedupe_overlap:
        chunks = f"transform({chunks}, (c, i) -> IF(i = 0, c, substr(c, {overlap + 1})))"
    content = assemble_sql(f"transform({chunks}, c -> {fallback_sql('c')})")
    return replicate(texts.withColumn("content", F.expr(content)), datasets)


def dataset_rows(datasets: DataFrame, name: str = "original_name", file_type: str = "file_type") -> DataFrame:
    """Stored form of synthetic datasets: name, size in bytes, mime type."""
    return datasets.select(
        "doc_id",
        "dataset_number",
        F.concat(F.lit("synthetic_"), F.col("dataset_number").cast("string"), F.lit("_"), F.col(name)).alias("synthetic_name"),
        F.octet_length("content").alias("size"),
        F.when(F.lower(file_type) == ".pdf", "application/pdf").otherwise("text/plain").alias("original_mime_type"),
        "content",
    )
