"""Whole jobs, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veil.functions import dims
from veil.operators import detect, resolve
from veil.operators import tables as T
from veil.operators.mask import mask_document, protect
from veil.operators.tables import anonymize_table


def protect_report(texts: DataFrame, registry, min_confidence: float = 0.0, salt: str = "") -> DataFrame:
    """Detect, plan and mask every text in one narrow pass; counts per type and strategy.

    Each text contributes one row per type it holds plus one row with its mask counter; a document of
    several texts counts once per type.
    """
    done = protect(texts, registry, min_confidence, salt)
    per_text = done.select(
        "doc_id",
        F.explode(
            F.expr(
                """concat(
                transform(array_distinct(transform(plan, p -> struct(p.pii_type AS pii_type, p.strategy AS strategy))),
                    k -> struct(k.pii_type AS pii_type, k.strategy AS strategy,
                        CAST(size(filter(plan, p -> p.pii_type = k.pii_type)) AS BIGINT) AS n, 0L AS masked)),
                array(struct(CAST(NULL AS STRING) AS pii_type, CAST(NULL AS STRING) AS strategy, 0L AS n, n_masked AS masked)))"""
            )
        ).alias("r")
    )
    per_doc = per_text.groupBy("r.pii_type", "r.strategy", "doc_id").agg(F.sum("r.n").alias("n"), F.sum("r.masked").alias("masked"))
    counts = per_doc.groupBy("pii_type", "strategy").agg(
        F.sum("n").alias("n_items"), F.count("*").alias("n_docs"), F.sum("masked").alias("masked")
    )
    # a window over the few dozen counted rows, never over data rows
    total = F.sum("masked").over(Window.partitionBy(F.lit(1)))
    return (
        counts.withColumn("total_masked", total)
        .where(F.col("pii_type").isNotNull())
        .select("pii_type", "strategy", "n_items", "n_docs", "total_masked")
    )


def plan_all(pages: DataFrame, registry, scorer=None, responses: DataFrame | None = None) -> DataFrame:
    """One plan from all detectors: patterns, a pluggable recognizer and model answers.

    The best type of a text wins over all sources, on ties the source listed first. A strategy that an
    answer suggests wins over the rule for its type.
    """
    parts = [detect.detect_patterns(pages, registry)]
    if scorer is not None:
        parts.append(detect.detect_model(pages, scorer))
    if responses is not None:
        parts.append(detect.llm_entities(responses))
    ranked = [
        p.withColumn("ord", F.shiftleft(F.lit(rank).cast("bigint"), 52).bitwiseOR(F.col("ord").cast("bigint"))) for rank, p in enumerate(parts)
    ]
    found = detect.entities_union(*ranked)
    if "strategy" not in found.columns:
        found = found.withColumn("strategy", F.lit(None).cast("string"))
    best = resolve.dedup_best_type(found, ["strategy"])
    return best.withColumn("strategy", F.coalesce("strategy", dims.suggest_strategy(F.col("pii_type"))))


def protect_all(pages: DataFrame, registry, scorer=None, responses: DataFrame | None = None, salt: str = "") -> DataFrame:
    """Pages masked by the plan of all detectors: what any of them finds on a page is masked on all of its document."""
    return mask_document(pages, plan_all(pages, registry, scorer, responses), salt)


def anonymize_set(tables_by_name: dict[str, DataFrame], subtypes: dict[str, str], null_policy: str = "keep", salt: str = "") -> dict[str, DataFrame]:
    """Anonymize the named columns wherever they occur in a set of tables.

    ``subtypes`` maps column names to subtypes. Each table is one projection; equal values get equal
    stand-ins in every table, so joins on them hold.
    """
    return {
        name: anonymize_table(df, {c: subtypes[c] for c in df.columns if c in subtypes}, null_policy, True, salt)
        for name, df in tables_by_name.items()
    }


def plan_set(tables_by_name: dict[str, DataFrame], min_overlap: float = 0.2) -> DataFrame:
    """Discovery over a set of tables: (node, group_key, subtype) of every sensitive column.

    Columns are judged by all their values. The result has at most one row per column of the set.
    """
    catalog = T.column_catalog(tables_by_name)
    values = T.column_values(tables_by_name)
    same = catalog.join(T.same_name_links(catalog).select("column_name"), "column_name")
    named = same.groupBy("column_name").agg(F.min("column_id").alias("a")).join(same, "column_name").select("a", F.col("column_id").alias("b"))
    edges = T.column_pairs(tables_by_name, min_overlap).select("a", "b").unionByName(named)
    labels = T.link_groups(catalog.select(F.col("column_id").alias("node")), edges)
    return T.linked_subtypes(T.column_classify(values), T.group_keys(labels))


def replica(
    tables_by_name: dict[str, DataFrame], min_overlap: float = 0.2, salt: str = "", null_policy: str = "keep"
) -> dict[str, DataFrame]:
    """A clean copy of a table set: discover, then anonymize. Only the column plan reaches the driver."""
    found = plan_set(tables_by_name, min_overlap).collect()  # schema-sized: one row per column
    by_table: dict[str, dict[str, str]] = {}
    for row in found:
        table, column = row["node"].split(".", 1)
        by_table.setdefault(table, {})[column] = row["subtype"]
    return {
        name: anonymize_table(df, by_table.get(name, {}), null_policy, True, salt) for name, df in tables_by_name.items()
    }
