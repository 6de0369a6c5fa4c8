"""Detection, plan building and masking over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

import checks.inputs  # noqa: F401 - defines the derived inputs
from checks.base import derived, query, table
from checks.sqltext import DOCS, dedup_sql, entities_sql, masked_sql, strategy_sql
from veil.functions.patterns import REGISTRY, SECRET
from veil.operators import detect, mask, resolve
from veil.sources import readers

CUSTOM = [*REGISTRY, SECRET]
FOUND = entities_sql(DOCS, CUSTOM)
PLAN = f"(SELECT *, {strategy_sql('pii_type')} AS strategy FROM {dedup_sql(FOUND)})"
MASKED = masked_sql(DOCS, PLAN)


def docs(spark, sf):
    return readers.spread(readers.documents(table(spark, sf, "documents")))


def turns(spark, sf):
    return readers.pages(table(spark, sf, "conversations"), "conv_id", "turn", "text")


def plan_of(spark, sf):
    return resolve.mask_plan(detect.detect_patterns(docs(spark, sf), CUSTOM))


@query(
    "protect_documents",
    f"""WITH plan AS MATERIALIZED {PLAN}, masked AS {masked_sql(DOCS, 'plan')}
    SELECT pii_type, strategy, count(*) AS n_items, count(DISTINCT doc_id) AS n_docs,
        (SELECT CAST(sum(n_masked) AS BIGINT) FROM masked) AS total_masked
    FROM plan GROUP BY pii_type, strategy""",
)
def protect_documents(spark, sf):
    """Flagship: one narrow detect-and-mask pass, then counts."""
    from veil.plans.jobs import protect_report

    return protect_report(docs(spark, sf), CUSTOM)


@query("mask_text", f"SELECT doc_id, sha256(masked_text) AS masked_sha, n_masked, n_failed FROM {MASKED}")
def mask_text(spark, sf):
    """The reviewed route: entities -> plan table -> join back -> fold."""
    d = docs(spark, sf).select("doc_id", "text")
    out = mask.mask_text(d, plan_of(spark, sf))
    return out.select("doc_id", F.sha2("masked_text", 256).alias("masked_sha"), "n_masked", "n_failed")


@query(
    "detect_patterns",
    f"SELECT * FROM {entities_sql(DOCS, CUSTOM)} UNION ALL SELECT * FROM {entities_sql('pii_corpus', CUSTOM)}",
    ("pii_corpus",),
)
def detect_patterns(spark, sf):
    both = docs(spark, sf).unionByName(readers.spread(derived(spark, sf, "pii_corpus")))
    return detect.detect_patterns(both, CUSTOM)
