"""Masking: apply plan rows to text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions import dims
from veil.functions.patterns import NOUNS, NUMERIC
from veil.functions.pseudo import perturb_number, replace_noun, replacement
from veil.functions.spans import all_spans, keep_leftmost, let, resolve_overlaps, splice
from veil.functions.text import SPACE, fit_replacement
from veil.operators.detect import KEEP_NUMBER, keep_noun

ITEM = "struct<len:int,ord:int,text:string,repl:string,strategy:string>"


def fold(text: str, items: str) -> str:
    """Apply plan items to a text, longest first, every occurrence, each on the result of the last.

    An item whose text is absent at its turn counts as failed. Result:
    struct(text, masked, failed, redact, mask, pseudo).
    """
    body = f"""aggregate(
        array_sort(items),
        struct({text} AS text, 0L AS masked, 0L AS failed, 0L AS redact, 0L AS mask, 0L AS pseudo),
        (a, i) -> CASE WHEN i.text = '' OR NOT contains(a.text, i.text)
            THEN struct(a.text AS text, a.masked AS masked, a.failed + 1 AS failed, a.redact AS redact,
                        a.mask AS mask, a.pseudo AS pseudo)
            ELSE {let("CAST((length(a.text) - length(replace(a.text, i.text, ''))) / length(i.text) AS BIGINT)", "n", '''
                struct(replace(a.text, i.text, i.repl) AS text, a.masked + n AS masked, a.failed AS failed,
                       a.redact + IF(i.strategy = 'redact', n, 0L) AS redact,
                       a.mask + IF(i.strategy = 'mask', n, 0L) AS mask,
                       a.pseudo + IF(i.strategy = 'pseudo', n, 0L) AS pseudo)''')} END)"""
    return let(items, "items", body)


def plan_item(ord_: str, text: str, repl: str, strategy: str) -> str:
    """A plan row as a fold item; struct order gives longest first, then plan order."""
    return f"struct(-length({text}) AS len, {ord_} AS ord, {text} AS text, {repl} AS repl, {strategy} AS strategy)"


def mask_text(
    texts: DataFrame, plan: DataFrame, salt: str = "", custom: dict | None = None, fit: bool = False
) -> DataFrame:
    """Whole-text masking of one-row documents by a plan (doc_id, ord, pii_type, text, strategy[, replacement]).

    A document's plan is bounded by its text, which the upload limit bounds; plan rows with the same
    text stay separate rows, since the second of them counts as failed. ``fit`` shortens replacements
    to the room of the original. Adds masked_text and counters; documents without plan rows come back
    unchanged.
    """
    given = "replacement" if "replacement" in plan.columns else None
    repl = replacement("strategy", "pii_type", "text", given, salt, custom)
    if fit:
        plan = plan.withColumn("_fitted", fit_replacement(F.col("text"), F.expr(repl)))
        repl = "_fitted"
    items = (
        plan.select("doc_id", F.expr(plan_item("ord", "text", repl, "strategy")).alias("item"))
        .groupBy("doc_id")
        .agg(F.collect_list("item").alias("items"))
    )
    joined = texts.join(items, "doc_id", "left")
    return expand_fold(
        joined.withColumn("f", F.expr(fold("text", f"coalesce(items, cast(array() AS array<{ITEM}>))")))
    ).drop("items")


def expand_fold(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c != "f"]
    return df.select(
        *names,
        F.col("f.text").alias("masked_text"),
        F.col("f.masked").alias("n_masked"),
        F.col("f.failed").alias("n_failed"),
        F.col("f.redact").alias("n_redact"),
        F.col("f.mask").alias("n_mask"),
        F.col("f.pseudo").alias("n_pseudo"),
    )


def row_plan(registry, min_confidence: float = 0.0, text: str = "text") -> str:
    """The masking plan of one text from its own matches, as an array of fold items.

    The row-local form of detect -> filter -> best type per text -> strategy -> replacement.
    """
    priority = ", ".join(f"'{k}', {v}" for k, v in dims.PRIORITY.items())
    strategy = ", ".join(f"'{k}', '{v}'" for k, v in dims.STRATEGY.items())
    key = f"lower(regexp_replace(s.text, r'^{SPACE}+|{SPACE}+$', ''))"
    ranked = f"""array_sort(transform(
        filter({all_spans(text, registry)}, s -> s.confidence >= {min_confidence}D),
        (s, i) -> struct(
            {key} AS key, -coalesce(try_element_at(map({priority}), s.kind), 0) AS priority,
            -s.confidence AS confidence, i AS ord, s.kind AS pii_type, s.text AS text,
            coalesce(try_element_at(map({strategy}), s.kind), 'redact') AS strategy)))"""
    return let(ranked, "r", "filter(r, (s, i) -> i = 0 OR s.key <> get(r, i - 1).key)")


def protect(texts: DataFrame, registry, min_confidence: float = 0.0, salt: str = "") -> DataFrame:
    """Detect and mask in one narrow pass: each row's plan comes from its own text.

    No shuffle, no join, no state, so it serves batch and streaming alike. Adds plan (array),
    masked_text and the counters.
    """
    planned = texts.withColumn("plan", F.expr(row_plan(registry, min_confidence)))
    repl = replacement("p.strategy", "p.pii_type", "p.text", None, salt)
    items = F.expr(f"transform(plan, p -> {plan_item('p.ord', 'p.text', repl, 'p.strategy')})")
    return expand_fold(
        planned.withColumn("items", items).withColumn("f", F.expr(fold("text", "items")))
    ).drop("items")


def mask_spans(pages: DataFrame, entities: DataFrame, salt: str = "") -> DataFrame:
    """Mask only the detected occurrences at (page, start, end); overlaps go to the earlier entity.

    Spans are grouped per page, so the page size bounds the group.
    """
    repl = F.expr(replacement("strategy", "pii_type", "text", None, salt))
    spans = entities.groupBy("doc_id", "page_num").agg(
        F.array_sort(
            F.collect_list(F.struct("ord", "start", "end", repl.alias("repl")))
        ).alias("spans")
    )
    disjoint = """aggregate(spans, filter(spans, s -> false), (kept, s) ->
        CASE WHEN exists(kept, k -> k.start < s.end AND k.end > s.start) THEN kept ELSE concat(kept, array(s)) END)"""
    kept = pages.join(spans, ["doc_id", "page_num"], "left").withColumn("spans", F.expr(disjoint))
    return kept.select(
        "doc_id",
        "page_num",
        F.when(F.col("spans").isNull(), F.col("text"))
        .otherwise(F.expr(splice("text", "spans", "s.repl")))
        .alias("masked_text"),
        F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"),
    )


def protect_spans(texts: DataFrame, registry, min_confidence: float = 0.0, salt: str = "") -> DataFrame:
    """Detect and mask exact occurrences in one narrow pass: the row-local form of ``mask_spans``."""
    strategy = ", ".join(f"'{k}', '{v}'" for k, v in dims.STRATEGY.items())
    chosen = f"coalesce(try_element_at(map({strategy}), s.kind), 'redact')"
    sure = f"filter({all_spans('text', registry)}, s -> s.confidence >= {min_confidence}D)"
    repl = replacement(chosen, "s.kind", "s.text", None, salt)
    kept = texts.withColumn("spans", F.expr(let(sure, "found", resolve_overlaps("found"))))
    return kept.withColumn("masked_text", F.expr(splice("text", "spans", repl))).withColumn(
        "n_spans", F.size("spans")
    ).drop("spans")


def anonymize_blocks(blocks: DataFrame, salt: str = "") -> DataFrame:
    """Numbers perturbed and proper nouns replaced inside text blocks, in one narrow pass.

    Numbers and nouns are found separately, each with its own overlap rule; where the two collide
    the one that starts first stays.
    """
    numbers = f"filter({all_spans('text', NUMERIC)}, s -> {KEEP_NUMBER})"
    nouns = f"filter({all_spans('text', NOUNS)}, s -> {keep_noun()})"
    found = f"concat({let(numbers, 'a', resolve_overlaps('a'))}, {let(nouns, 'b', resolve_overlaps('b'))})"
    repl = f"IF(s.kind = 'numerical', {perturb_number('s.text', salt)}, {replace_noun('s.kind', 's.text', salt)})"
    kept = blocks.withColumn("items", F.expr(keep_leftmost(found)))
    return kept.withColumn("anonymized", F.expr(splice("text", "items", repl))).withColumn(
        "n_items", F.size("items")
    ).drop("items")


def masking_stats(masked: DataFrame) -> DataFrame:
    """Totals over masked documents: occurrences, per strategy, failed plan rows."""
    return masked.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("n_masked") > 0).alias("documents_changed"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_masked", "n_failed", "n_redact", "n_mask", "n_pseudo")],
    )


SALTS = 16  # parts over which the pages of one document are dealt
PAGES_A_PART, PAGES_A_LIST = 64, 16  # consecutive pages that share a part; whose first texts share a list


def mask_document(pages: DataFrame, plan: DataFrame, salt: str = "") -> DataFrame:
    """Masked pages of multi-page documents: every plan text of a document is masked on all its pages.

    Of plan rows with the same text the first counts, by page, then by order on the page. The texts of a
    document travel as lists, one for every ``PAGES_A_LIST`` pages they come from, and a page keeps what it
    holds of each. Runs of pages are dealt over at most ``SALTS`` parts of the join, and a document's lists
    are given to the parts it has, so a document with most of all pages is no single task. Both sides are
    sorted: texts found on pages outgrow the scan that their size would be estimated from.
    """
    given = F.col("replacement") if "replacement" in plan.columns else F.lit(None).cast("string")
    page = F.col("page_num") if "page_num" in plan.columns else F.lit(0)
    first = F.min(F.struct(page.alias("page"), "ord", "pii_type", "strategy", given.alias("replacement")))
    one = plan.where("text <> ''").groupBy("doc_id", "text").agg(first.alias("p")).select("doc_id", "text", "p.*")
    item = F.expr(plan_item("ord", "text", replacement("strategy", "pii_type", "text", "replacement", salt), "strategy"))
    lists = one.groupBy("doc_id", F.floor(F.coalesce("page", F.lit(0)) / PAGES_A_LIST).alias("_list")).agg(F.collect_list(item).alias("texts"))
    run = F.floor(F.coalesce("page_num", F.lit(0)) / PAGES_A_PART)
    dealt = pages.withColumn("_salt", F.pmod(F.xxhash64(run), F.lit(SALTS)).cast("int"))
    parts = dealt.select("doc_id", "_salt").distinct()
    given_to = lists.hint("merge").join(parts.hint("merge"), "doc_id").select(F.col("doc_id").alias("_doc"), F.col("_salt").alias("_part"), "texts")
    same = (dealt.doc_id == F.col("_doc")) & (F.col("_salt") == F.col("_part"))
    held = dealt.join(given_to.hint("merge"), same, "left").withColumn(
        "texts", F.expr(f"filter(coalesce(texts, cast(array() AS array<{ITEM}>)), i -> contains(text, i.text))")
    )
    rest = [F.first(c).alias(c) for c in pages.columns if c not in ("doc_id", "page_num")]
    gathered = held.groupBy("doc_id", "_salt", "page_num").agg(*rest, F.flatten(F.collect_list("texts")).alias("items"))
    return expand_fold(gathered.withColumn("f", F.expr(fold("text", "items")))).drop("items", "_salt").select(
        *pages.columns, "masked_text", "n_masked", "n_failed", "n_redact", "n_mask", "n_pseudo"
    )
