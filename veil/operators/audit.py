"""Quality audit of masked text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions import dims
from veil.functions.spans import all_spans
from veil.operators.mask import protect
from veil.session import cut_lineage

def luhn(text: str) -> str:
    """Whether the digits of a card number pass the check sum, as SQL text."""
    digits = f"reverse(regexp_replace({text}, '[^0-9]', ''))"
    return f"""aggregate(transform(sequence(1, length({digits})), i -> CAST(substr({digits}, i, 1) AS INT) * IF(i % 2 = 0, 2, 1)),
        0, (a, d) -> a + IF(d > 9, d - 9, d)) % 10 = 0"""


def invalid(kind: str, text: str) -> str:
    """Whether a value cannot be what its type says (SQL text): failed check sums and impossible fields."""
    return f"""CASE {kind}
        WHEN 'CREDIT_CARD' THEN NOT ({luhn(text)})
        WHEN 'IP_ADDRESS' THEN exists(split({text}, '[.]'), o -> coalesce(try_cast(o AS INT), 0) > 255)
        WHEN 'SSN' THEN rlike({text}, '^(000|666|9)') OR {text} LIKE '%-00-%' OR {text} LIKE '%-0000'
        ELSE false END"""


def issues(masked: DataFrame, registry, min_confidence: float = 0.0) -> DataFrame:
    """Issues of masked one-row documents (doc_id, text, plan, masked_text), one row each, row-local.

    missed_pii: a pattern still matches a text of the original. masking_error: a plan text is still
    there. false_positive: a masked value fails its type's validator.
    """
    missed = f"""transform(filter({all_spans('masked_text', registry)},
            s -> s.confidence >= {min_confidence}D AND contains(text, s.text)),
        s -> struct('missed_pii' AS issue_type, s.kind AS pii_type, s.text AS text))"""
    partial = """transform(filter(plan, p -> contains(masked_text, p.text)),
        p -> struct('masking_error' AS issue_type, p.pii_type AS pii_type, p.text AS text))"""
    false_hit = f"""transform(filter(plan, p -> {invalid('p.pii_type', 'p.text')}),
        p -> struct('false_positive' AS issue_type, p.pii_type AS pii_type, p.text AS text))"""
    found = masked.select(
        "doc_id", F.explode_outer(F.expr(f"array_distinct(concat({missed}, {partial}, {false_hit}))")).alias("i")
    ).where(F.col("i").isNotNull())
    return found.select(
        "doc_id",
        F.col("i.issue_type").alias("issue_type"),
        F.col("i.pii_type").alias("pii_type"),
        F.col("i.text").alias("text"),
        dims.severity_single(F.col("i.pii_type")).alias("severity"),
        F.lit("pending").alias("status"),
    )


def qa_loop(texts: DataFrame, registry, min_confidence: float = 0.0, max_rounds: int = 3, salt: str = "") -> tuple[DataFrame, int]:
    """Mask, audit, mask what is left, until nothing is missed or ``max_rounds`` is reached.

    Each round starts from a checkpoint, so lineage does not grow. Returns (doc_id, text,
    masked_text, n_masked, n_left, approved) and the rounds used: what a document still misses after
    the last round is counted, and it is approved only without.
    """
    current = texts.select("doc_id", "text", F.col("text").alias("masked_text"), F.lit(0).cast("bigint").alias("n_masked"))
    rounds = 0
    while rounds < max_rounds:
        rounds += 1
        again = protect(
            current.select("doc_id", F.col("masked_text").alias("text"), F.col("text").alias("original"), F.col("n_masked").alias("before")),
            registry,
            min_confidence,
            salt,
        )
        current = cut_lineage(
            again.select(
                "doc_id",
                F.col("original").alias("text"),
                "masked_text",
                (F.col("n_masked") + F.col("before")).alias("n_masked"),
                "plan",
            )
        )
        missed = issues(current, registry, min_confidence).where("issue_type = 'missed_pii'")
        left = cut_lineage(missed.groupBy("doc_id").agg(F.count("*").alias("n_left")))
        if left.isEmpty():
            break
    n_left = F.coalesce("n_left", F.lit(0))
    out = current.drop("plan").join(left, "doc_id", "left").withColumn("n_left", n_left)
    return out.withColumn("approved", F.col("n_left") == 0), rounds
