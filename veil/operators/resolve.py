"""From entities to a reviewed masking plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions import dims
from veil.functions.text import strip


def dedup_best_type(entities: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One entity per (document, page, text ignoring case and outer blanks).

    The highest (priority, confidence) wins, the first detected on ties. A max over structs, so
    repeats of a hot value collapse before the shuffle.
    """
    extra = extra or []
    best = F.max(
        F.struct(
            dims.type_priority(F.col("pii_type")).alias("priority"),
            F.col("confidence"),
            (-F.col("ord")).alias("first"),
            F.col("pii_type"),
            F.col("text"),
            F.col("start"),
            F.col("end"),
            *[F.col(c) for c in extra],
        )
    )
    grouped = entities.groupBy("doc_id", "page_num", F.lower(strip(F.col("text"))).alias("key")).agg(
        best.alias("b"), F.count("*").alias("n_detected")
    )
    return grouped.select(
        "doc_id",
        "page_num",
        (-F.col("b.first")).alias("ord"),
        F.col("b.pii_type").alias("pii_type"),
        F.col("b.text").alias("text"),
        F.col("b.start").alias("start"),
        F.col("b.end").alias("end"),
        F.col("b.confidence").alias("confidence"),
        "n_detected",
        *[F.col(f"b.{c}").alias(c) for c in extra],
    )


def mask_plan(entities: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Deduplicated entities with a suggested strategy."""
    return dedup_best_type(entities, extra).withColumn("strategy", dims.suggest_strategy(F.col("pii_type")))


def plan_order(plan: DataFrame) -> DataFrame:
    """Output order of a plan: page, then top to bottom, then left to right."""
    return plan.orderBy("doc_id", "page_num", "y0", "x0", "ord")


def review_override(plan: DataFrame, reviews: DataFrame) -> DataFrame:
    """A reviewed strategy wins over the suggested one; without either, redact."""
    picked = reviews.select("doc_id", "pii_id", F.col("strategy").alias("reviewed"))
    return (
        plan.join(picked, ["doc_id", "pii_id"], "left")
        .withColumn("strategy", F.coalesce("reviewed", "strategy", F.lit("redact")))
        .drop("reviewed")
    )


def review_select(plan: DataFrame, selected: DataFrame) -> DataFrame:
    """Only selected items are masked; ``selected`` holds (doc_id, pii_id)."""
    return plan.join(selected.select("doc_id", "pii_id"), ["doc_id", "pii_id"], "left_semi")


def toggle_category(plan: DataFrame, category: str) -> DataFrame:
    """Toggle one category of a plan with a boolean ``selected``, per document.

    If every item of the category is selected they are all deselected, else all are selected.
    """
    inside = dims.category(F.col("pii_type")) == category
    state = plan.where(inside).groupBy("doc_id").agg(F.bool_and("selected").alias("all_on"))
    return (
        plan.join(state, "doc_id", "left")
        .withColumn("selected", F.when(inside, ~F.col("all_on")).otherwise(F.col("selected")))
        .drop("all_on")
    )


def toggle_item(plan: DataFrame, items: DataFrame) -> DataFrame:
    """Toggle single items; ``items`` holds (doc_id, pii_id)."""
    hit = items.select("doc_id", "pii_id").distinct().withColumn("_hit", F.lit(True))
    return (
        plan.join(hit, ["doc_id", "pii_id"], "left")
        .withColumn("selected", F.when(F.col("_hit"), ~F.col("selected")).otherwise(F.col("selected")))
        .drop("_hit")
    )


def toggle_all(plan: DataFrame) -> DataFrame:
    """Per document: everything selected becomes nothing selected, anything else becomes everything."""
    state = plan.groupBy("doc_id").agg(F.bool_and("selected").alias("_all"))
    return plan.join(state, "doc_id", "left").withColumn("selected", ~F.col("_all")).drop("_all")


def selection_state(plan: DataFrame) -> DataFrame:
    """Per document and category: none, all or partial."""
    on, n = F.count_if("selected"), F.count("*")
    return plan.groupBy("doc_id", dims.category(F.col("pii_type")).alias("category")).agg(
        n.alias("items"),
        on.alias("selected_items"),
        F.when(on == 0, "none").when(on == n, "all").otherwise("partial").alias("state"),
    )
