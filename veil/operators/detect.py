"""Detection: typed spans in page text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions import dims
from veil.functions.patterns import REGISTRY, Pattern
from veil.functions.spans import all_spans, let, resolve_overlaps
from veil.functions.text import SPACE, json_bounds, llm_json_text, strip


def detect_patterns(pages: DataFrame, registry: list[Pattern] = REGISTRY) -> DataFrame:
    """Entities of every registry pattern. Narrow: one scan, no shuffle.

    Custom patterns are further ``Pattern`` rows of ``registry``.
    """
    # The outer form keeps the optimizer from copying the scan into a size filter.
    spans = pages.select(
        "doc_id", "page_num", F.posexplode_outer(F.expr(all_spans("text", registry))).alias("ord", "s")
    ).where(F.col("s").isNotNull())
    return spans.select(
        "doc_id",
        "page_num",
        "ord",
        F.col("s.kind").alias("pii_type"),
        F.col("s.text").alias("text"),
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
        F.col("s.confidence").alias("confidence"),
        F.col("s.source").alias("source"),
    )


def detect_model(
    pages: DataFrame,
    scorer: Callable[[], Callable[[str], Iterable[dict]]] | None,
) -> DataFrame:
    """Entities of a pluggable recognizer: raw groups, filtered and mapped by ``ner_filter``.

    ``scorer()`` builds the recognizer once per Python worker task; it maps a text to dicts with
    entity_group, word, score, start, end. No scorer: no rows. A text that fails gives no rows.
    """
    doc_type = pages.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, page_num int, ord int, entity_group string, word string, score double, start int, end int"
    spark = pages.sparkSession
    if scorer is None:
        return ner_entities(spark.createDataFrame([], schema))

    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        recognize = scorer()
        for batch in batches:
            rows = []
            for doc_id, page_num, text in zip(batch.doc_id, batch.page_num, batch.text):
                try:
                    found = list(recognize(text))
                except Exception:
                    continue
                rows += [
                    (doc_id, page_num, i, e["entity_group"], e["word"], float(e["score"]), e["start"], e["end"])
                    for i, e in enumerate(found)
                ]
            yield pd.DataFrame(rows, columns=columns)

    return ner_entities(pages.select("doc_id", "page_num", "text").mapInPandas(run, schema))


def ner_valid() -> F.Column:
    """Which raw recognizer groups count: no word pieces, long enough, sure enough, no stop word."""
    word = strip(F.col("word"))
    return (
        ~word.startswith("##")
        & (F.length(word) > 2)
        & (F.col("score") >= 0.7)
        & ~F.lower(word).isin(dims.NER_STOP_WORDS)
        & F.col("entity_group").isin(list(dims.NER_LABELS))
    )


def ner_type(group: F.Column) -> F.Column:
    return dims.case_lookup(group, dims.NER_LABELS, group)


def ner_entities(raw: DataFrame) -> DataFrame:
    return raw.where(ner_valid()).select(
        "doc_id",
        "page_num",
        "ord",
        ner_type(F.col("entity_group")).alias("pii_type"),
        F.col("word").alias("text"),
        "start",
        "end",
        F.col("score").alias("confidence"),
        F.lit("NER").alias("source"),
    )


RESPONSE = "array<struct<text:string,pii_type:string,start:int,end:int,confidence:double,context_info:string,suggested_strategy:string>>"


def parse_responses(responses: DataFrame) -> DataFrame:
    """Model answers (doc_id, chunk_idx, response) as rows; an answer that is no JSON array gives none."""
    parsed = F.from_json(llm_json_text(F.col("response")), RESPONSE)
    return responses.select(
        "*", F.posexplode(parsed).alias("item_idx", "item")
    )


def llm_entities(responses: DataFrame) -> DataFrame:
    """Verified entities from model answers.

    ``responses`` has doc_id, page_num, chunk_idx, chunk, chunk_offset, response. An item counts only
    if its text occurs in the chunk, exactly or after collapsing whitespace. Given offsets are moved
    by the chunk offset, missing ones are located in the chunk, else the chunk start is used.
    """
    rows = parse_responses(responses).where("item.text IS NOT NULL AND item.pii_type IS NOT NULL")
    squeeze = lambda c: strip(F.regexp_replace(c, f"{SPACE}+", " "))
    item = F.col("item.text")
    exact = F.contains(F.col("chunk"), item)
    rows = rows.where(exact | F.contains(squeeze(F.col("chunk")), squeeze(item)))
    at = F.expr("greatest(locate(item.text, chunk) - 1, 0)")
    given = F.col("item.start").isNotNull() & F.col("item.end").isNotNull()
    start = F.when(given, F.col("item.start")).otherwise(at) + F.col("chunk_offset")
    end = F.when(given, F.col("item.end")).otherwise(at + F.length(item)) + F.col("chunk_offset")
    return rows.select(
        "doc_id",
        "page_num",
        F.shiftleft(F.col("chunk_idx").cast("bigint"), 32).bitwiseOR(F.col("item_idx").cast("bigint")).alias("ord"),
        dims.normalize_type(F.col("item.pii_type")).alias("pii_type"),
        item.alias("text"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        F.coalesce(F.col("item.confidence"), F.lit(0.8)).alias("confidence"),
        F.lit("LLM").alias("source"),
        F.col("item.suggested_strategy").alias("strategy"),
    )


def column_answers(responses: DataFrame) -> DataFrame:
    """Model answers on columns (answer_id, response) as normalized column classifications."""
    from veil.functions.text import normalize_label, normalize_subtype

    schema = "array<struct<column:string,label:string,subtype:string,confidence:double,examples:array<string>>>"
    parsed = F.from_json(json_bounds(F.col("response")), schema)
    fallback_label = F.upper(F.regexp_extract("response", r"(?is)label[\"']?\s*[:\s]*[\"']([A-Z]+)[\"']", 1))
    fallback_sub = F.regexp_extract("response", r"(?is)subtype[\"']?\s*[:\s]*[\"']([^\"']+)[\"']", 1)
    known = fallback_label.isin(dims.COLUMN_LABELS)
    rough = F.array(
        F.struct(
            F.regexp_extract("response", r"(?is)column[\"']?\s*[:\s]*[\"']([^\"']+)[\"']", 1).alias("column"),
            F.when(known, fallback_label).otherwise(F.lit("NONE")).alias("label"),
            F.when(known & (fallback_sub != ""), fallback_sub).otherwise(F.lit("other")).alias("subtype"),
            F.when(known, F.lit(0.8)).otherwise(F.lit(0.0)).alias("confidence"),
            F.array().cast("array<string>").alias("examples"),
        )
    )
    items = responses.select("answer_id", F.explode(F.coalesce(parsed, rough)).alias("i"))
    return items.select(
        "answer_id",
        F.coalesce("i.column", F.lit("")).alias("column_name"),
        F.coalesce(normalize_label(F.col("i.label")), F.lit("NONE")).alias("label"),
        normalize_subtype(F.col("i.subtype")).alias("subtype"),
        F.coalesce("i.confidence", F.lit(0.0)).alias("confidence"),
    )


def entities_union(*parts: DataFrame) -> DataFrame:
    """All sources together; columns missing in one source become null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def request_filter(entities: DataFrame, types: list[str] | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Only the requested types at or above the confidence threshold; by default everything."""
    out = entities.where(F.col("confidence") >= min_confidence)
    return out.where(F.col("pii_type").isin(types)) if types else out


def detect_items(blocks: DataFrame, patterns: list[Pattern], keep: str) -> DataFrame:
    """Numbers or proper nouns in text blocks, first pattern first, overlaps dropped.

    ``keep`` is a predicate over span ``s``; a span it rejects does not claim its place, so it is
    applied before overlap resolution. Each item gets the box that its characters cover.
    """
    kept_spans = let(f"filter({all_spans('text', patterns)}, s -> {keep})", "found", resolve_overlaps("found"))
    kept = blocks.select("*", F.posexplode_outer(F.expr(kept_spans)).alias("item_idx", "s")).where(
        F.col("s").isNotNull()
    )
    width = (F.col("x1") - F.col("x0")) / F.length("text")
    return kept.select(
        "doc_id",
        "page_num",
        "block_id",
        "item_idx",
        F.col("s.kind").alias("item_type"),
        F.col("s.text").alias("value"),
        F.col("s.start").alias("start_pos"),
        F.col("s.end").alias("end_pos"),
        (F.col("x0") + F.col("s.start") * width).alias("bx0"),
        F.col("y0").alias("by0"),
        (F.col("x0") + F.col("s.start") * width + (F.col("s.end") - F.col("s.start")) * width).alias("bx1"),
        F.col("y1").alias("by1"),
        F.col("source"),
    )


# A number is left alone when it is a single digit, a likely year or a likely page number.
KEEP_NUMBER = let(
    "replace(replace(replace(s.text, '$'), ','), '.')",
    "bare",
    """NOT (
    length(bare) = 1
    OR (length(bare) = 4 AND coalesce(try_cast(bare AS INT) BETWEEN 1900 AND 2100, false))
    OR (length(bare) = 2 AND coalesce(try_cast(bare AS INT) <= 50, false)))""",
)


def keep_noun() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(dims.NOUN_STOP_WORDS)))
    space = SPACE
    return (
        f"NOT ((length(s.text) < 4 AND NOT rlike(s.text, r'{space}')) OR lower(s.text) IN ({stop}))"
    )


def detect_numeric(blocks: DataFrame) -> DataFrame:
    from veil.functions.patterns import NUMERIC

    return detect_items(blocks, NUMERIC, KEEP_NUMBER)


def detect_nouns(blocks: DataFrame) -> DataFrame:
    from veil.functions.patterns import NOUNS

    return detect_items(blocks, NOUNS, keep_noun())


def ocr_blocks(ocr_words: DataFrame) -> DataFrame:
    """Recognized words with confidence above 15, scaled from image pixels to page coordinates.

    Needs text, conf, left, top, width, height, image size (img_w, img_h) and image box ix0..iy1.
    """
    word = strip(F.col("text"))
    sx = (F.col("ix1") - F.col("ix0")) / F.col("img_w")
    sy = (F.col("iy1") - F.col("iy0")) / F.col("img_h")
    x0 = F.col("ix0") + F.col("left") * sx
    y0 = F.col("iy0") + F.col("top") * sy
    return ocr_words.where((word != "") & (F.col("conf") > 15)).select(
        "doc_id",
        "page_num",
        F.col("word_id").alias("block_id"),
        word.alias("text"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + F.col("width") * sx).alias("x1"),
        (y0 + F.col("height") * sy).alias("y1"),
        F.lit("ocr").alias("source"),
        F.col("conf").alias("confidence"),
    )
