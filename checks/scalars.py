"""Scalar rules, plan review and configuration lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import DERIVED, case, derived, query, table
from checks.inputs import O
from checks.sqltext import (
    category_sql,
    dedup_sql,
    lookup_sql,
    priority_sql,
    quote,
    replacement_sql,
    squeeze_sql,
    strategy_sql,
    strip_sql,
)
from veil.functions import dims, pseudo, text
from veil.operators import detect, resolve
from veil.sources import config_lines

# --- text and file rules -------------------------------------------------------------------------

DERIVED["upload_names"] = """SELECT page_id, CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN url || '.pdf' WHEN 2 THEN url || '.DOCX'
    WHEN 3 THEN url || '.tar.gz' WHEN 4 THEN replace(url, '.', '') WHEN 5 THEN replace(url, url, '') WHEN 6 THEN url || '.v2.csv' WHEN 7 THEN url || '.xml' ELSE url || '.txt' END AS name,
    CAST(page_id * 1234567 % 90000000 AS BIGINT) AS file_size, html FROM {pages}"""
EXT = "CASE WHEN contains(name, '.') THEN lower(split_part(name, '.', -1)) END"


def error_sql(allowed) -> str:
    names = ", ".join(quote(a) for a in allowed)
    return f"""CASE WHEN name IS NULL OR name = '' THEN 'No file provided' WHEN NOT contains(name, '.') THEN 'File must have an extension'
        WHEN {EXT} NOT IN ({names}) THEN 'File type ''' || {EXT} || ''' not allowed'
        WHEN file_size > 52428800 THEN 'File exceeds the upload limit' END"""


@query(
    "file_validate",
    f"SELECT page_id, {error_sql(text.ALLOWED_EXTENSIONS)} AS error, {error_sql(text.SIMPLE_EXTENSIONS)} AS simple_error FROM upload_names",
    ("upload_names",),
)
def file_validate(spark, sf):
    name, size = F.col("name"), F.col("file_size")
    return derived(spark, sf, "upload_names").select(
        "page_id", text.file_error(name, size).alias("error"), text.file_error(name, size, simple=True).alias("simple_error")
    )


SIZE = " ".join(
    f"WHEN file_size < {1024 ** (i + 1)} THEN printf('%.1f {u}', file_size / {1024.0 ** i})" for i, u in enumerate(text.SIZE_UNITS[:-1])
)


@query(
    "file_meta",
    f"""SELECT page_id, {EXT} AS ext, {lookup_sql(f'({EXT})', text.CONTENT_TYPES, "'application/octet-stream'")} AS content_type,
    CASE WHEN file_size = 0 THEN '0 B' {SIZE} END AS size_formatted, sha256(html) AS hash FROM upload_names""",
    ("upload_names",),
)
def file_meta(spark, sf):
    name = F.col("name")
    return derived(spark, sf, "upload_names").select(
        "page_id",
        text.file_extension(name).alias("ext"),
        text.content_type(name).alias("content_type"),
        text.human_size(F.col("file_size")).alias("size_formatted"),
        F.sha2("html", 256).alias("hash"),
    )


@query(
    "clean_text",
    f"SELECT page_id, sha256(regexp_replace({squeeze_sql('html')}, '[\\x00-\\x1f]', '', 'g')) AS clean_sha FROM pages",
)
def clean_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(text.clean_text(F.col("html")), 256).alias("clean_sha"))


@query(
    "partial_mask",
    """SELECT c_custkey, CASE WHEN length(v) <= 4 THEN repeat('*', length(v)) ELSE left(v, 2) || repeat('*', length(v) - 4) || right(v, 2) END AS masked
    FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE CAST(c_custkey AS VARCHAR) END AS v FROM customer)""",
)
def partial_mask(spark, sf):
    v = F.expr("CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE CAST(c_custkey AS STRING) END")
    return table(spark, sf, "customer").select("c_custkey", text.partial_mask(v).alias("masked"))


DERIVED["fit_cases"] = """SELECT c_custkey, substr('Abcdefghij klmnop', 1, CAST(c_custkey % 15 + 1 AS INT)) AS original,
    CASE c_custkey % 7 WHEN 0 THEN '[REDACTED]' WHEN 1 THEN 'Milo Abbott' WHEN 2 THEN 'Rhea Zeller' WHEN 3 THEN 'Wintergreen'
    WHEN 4 THEN '12 Alder Street North' WHEN 5 THEN 'Bo Li' ELSE 'Nicolette Fitzgerald' END AS replacement FROM {customer}"""
N, R = f"length({strip_sql('original')})", "replacement"
A, B = "split_part(replacement, ' ', 1)", "split_part(replacement, ' ', 2)"


@query(
    "fit_replacement",
    f"""SELECT c_custkey, CASE WHEN length({R}) <= {N} THEN {R}
    WHEN {R} = '[REDACTED]' THEN CASE WHEN {N} <= 2 THEN '**' WHEN {N} <= 4 THEN '[*]' WHEN {N} <= 6 THEN '[RED]' WHEN {N} <= 8 THEN '[REDACT]' ELSE {R} END
    WHEN length({R}) - length(replace({R}, ' ', '')) = 1 THEN CASE WHEN {N} <= 4 THEN left({A}, 3)
        WHEN {N} <= 6 AND length({A}) <= 4 THEN {A} || ' ' || left({B}, 1) WHEN {N} <= 6 THEN left({A}, 4)
        WHEN {N} <= 10 THEN left({A}, 4) || ' ' || left({B}, 4) ELSE left({A}, 5) || ' ' || left({B}, 6) END
    WHEN NOT contains({R}, ' ') THEN CASE WHEN {N} <= 3 THEN left({R}, 3) WHEN {N} <= 5 THEN left({R}, 4) WHEN {N} <= 8 THEN left({R}, 6) ELSE left({R}, 8) END
    WHEN length({R}) <= greatest({N}, 4) THEN {R}
    WHEN greatest({N}, 4) > 6 THEN left({R}, greatest({N}, 4) - 2) || '..' ELSE left({R}, greatest({N}, 4)) END AS fitted FROM fit_cases""",
    ("fit_cases",),
)
def fit_replacement(spark, sf):
    return derived(spark, sf, "fit_cases").select(
        "c_custkey", text.fit_replacement(F.col("original"), F.col("replacement")).alias("fitted")
    )


# --- entity rules --------------------------------------------------------------------------------

STOP = ", ".join(quote(w) for w in dims.NER_STOP_WORDS)
NER_OK = f"""NOT starts_with({strip_sql('word')}, '##') AND length({strip_sql('word')}) > 2 AND score >= 0.7
    AND lower({strip_sql('word')}) NOT IN ({STOP}) AND entity_group IN ('PER', 'ORG', 'LOC', 'MISC')"""


@query("ner_filter", f"SELECT doc_id, ord, word, score FROM ner_raw WHERE {NER_OK}", ("ner_raw",))
def ner_filter(spark, sf):
    return derived(spark, sf, "ner_raw").where(detect.ner_valid()).select("doc_id", "ord", "word", "score")


@query(
    "ner_type_map",
    "SELECT entity_group, CASE entity_group WHEN 'PER' THEN 'PERSON' ELSE entity_group END AS pii_type, count(*) AS n FROM ner_raw GROUP BY 1, 2",
    ("ner_raw",),
)
def ner_type_map(spark, sf):
    group = F.col("entity_group")
    return derived(spark, sf, "ner_raw").groupBy("entity_group", detect.ner_type(group).alias("pii_type")).agg(F.count("*").alias("n"))


HIGH, MED = (", ".join(quote(t) for t in ts) for ts in (dims.HIGH_TYPES, dims.MEDIUM_TYPES))


def by_type(key, build, sql):
    @query(key, f"SELECT doc_id, ord, pii_type, {sql} FROM entities", ("entities",))
    def run(spark, sf):
        return derived(spark, sf, "entities").select("doc_id", "ord", "pii_type", *build())


by_type("suggest_strategy", lambda: [dims.suggest_strategy(F.col("pii_type")).alias("strategy")], strategy_sql("pii_type") + " AS strategy")
by_type("type_priority", lambda: [dims.type_priority(F.col("pii_type")).alias("priority")], priority_sql("pii_type") + " AS priority")
by_type(
    "severity_single",
    lambda: [dims.severity_single(F.col("pii_type")).alias("severity")],
    f"CASE WHEN pii_type IN ({HIGH}) THEN 'high' WHEN pii_type IN ({MED}) THEN 'medium' ELSE 'low' END AS severity",
)
by_type(
    "severity_bulk",
    lambda: [dims.severity_bulk(F.col("pii_type")).alias("severity")],
    f"CASE WHEN regexp_matches(lower(pii_type), '{'|'.join(dims.HIGH_FRAGMENTS)}') THEN 'high' WHEN regexp_matches(lower(pii_type), '{'|'.join(dims.MEDIUM_FRAGMENTS)}') THEN 'medium' ELSE 'low' END AS severity",
)
by_type("category", lambda: [dims.category(F.col("pii_type")).alias("category")], category_sql("pii_type") + " AS category")
by_type(
    "display_name",
    lambda: [dims.display_name(F.col("pii_type")).alias("label"), dims.location(F.col("page_num")).alias("location")],
    lookup_sql("pii_type", dims.LABEL, "pii_type") + " AS label, 'Page ' || (page_num + 1) AS location",
)


@query(
    "request_filter",
    f"""SELECT doc_id, count(*) AS total_items, count(*) FILTER (pii_type IN ({HIGH})) AS high_severity_count
    FROM entities WHERE confidence >= 0.8 AND pii_type IN ('SSN', 'EMAIL', 'PHONE', 'PERSON', 'PASSPORT') GROUP BY doc_id""",
    ("entities",),
)
def request_filter(spark, sf):
    types = ["SSN", "EMAIL", "PHONE", "PERSON", "PASSPORT"]
    kept = detect.request_filter(derived(spark, sf, "entities"), types, min_confidence=0.8)
    high = dims.severity_single(F.col("pii_type")) == "high"
    return kept.groupBy("doc_id").agg(F.count("*").alias("total_items"), F.count_if(high).alias("high_severity_count"))


DERIVED["labels_raw"] = f"""SELECT {O} AS id, {case(O, "'PII'", "'PII|PHI'", "'phi'", "'None'", "'PHI | NONE'", "'secret'", "CAST(NULL AS STRING)", "'pii|x'")} AS label,
    {case(f'({O} + 1)', "'name'", "'null'", "CAST(NULL AS STRING)", "'email'")} AS subtype FROM {{orders}}"""


@query(
    "label_normalize",
    f"""SELECT id, CASE WHEN v IN ('PII', 'PHI', 'NONE') THEN v ELSE 'NONE' END AS label, CASE WHEN subtype IS NULL OR subtype = 'null' THEN 'other' ELSE subtype END AS subtype
    FROM (SELECT id, subtype, CASE WHEN contains(label, '|') THEN upper({strip_sql("split_part(label, '|', 1)")}) ELSE upper(label) END AS v FROM labels_raw)""",
    ("labels_raw",),
)
def label_normalize(spark, sf):
    return derived(spark, sf, "labels_raw").select(
        "id",
        text.normalize_label(F.col("label")).alias("label"),
        text.normalize_subtype(F.col("subtype")).alias("subtype"),
    )


@query(
    "dedup_best_type",
    f"SELECT doc_id, page_num, ord, pii_type, text, \"start\", \"end\", confidence FROM {dedup_sql('entities')}",
    ("entities",),
)
def dedup_best_type(spark, sf):
    return resolve.dedup_best_type(derived(spark, sf, "entities")).drop("n_detected")


@query(
    "entities_union",
    f"""SELECT source, pii_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, pii_type, source FROM entities
    UNION ALL SELECT doc_id, CASE entity_group WHEN 'PER' THEN 'PERSON' ELSE entity_group END, 'NER' FROM ner_raw WHERE {NER_OK}) GROUP BY 1, 2""",
    ("entities", "ner_raw"),
)
def entities_union(spark, sf):
    both = detect.entities_union(derived(spark, sf, "entities"), detect.ner_entities(derived(spark, sf, "ner_raw")))
    per_doc = both.groupBy("source", "pii_type", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("source", "pii_type").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


# --- plan review ---------------------------------------------------------------------------------


@query(
    "plan_order",
    "SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, y0, x0, ord) AS pos FROM mask_plan",
    ("mask_plan",),
)
def plan_order(spark, sf):
    """Where each item of a document stands in the sorted plan."""
    from veil.operators.running import block_rank
    from veil.session import cut_lineage

    plan = resolve.plan_order(derived(spark, sf, "mask_plan"))
    placed = cut_lineage(plan.withColumn("at", F.monotonically_increasing_id()))  # follows the sorted output
    ranked = block_rank(placed, ["doc_id"], F.col("at"), F.shiftright("at", 33), "pos")
    return ranked.select("doc_id", "ord", (F.col("pos") + 1).alias("pos"))


DERIVED["reviews"] = f"""SELECT o_custkey AS doc_id, 'pii_' || CAST({O} AS STRING) AS pii_id,
    {case(f'({O} * 7 % 13)', "'mask'", "'redact'", "'pseudo'", "CAST(NULL AS STRING)")} AS strategy, o_orderstatus = 'F' AS selected FROM {{orders}} WHERE o_orderpriority <> '5-LOW'"""


@query(
    "review_override",
    "SELECT p.doc_id, p.pii_id, coalesce(r.strategy, p.strategy, 'redact') AS strategy FROM mask_plan p LEFT JOIN reviews r ON p.doc_id = r.doc_id AND p.pii_id = r.pii_id",
    ("mask_plan", "reviews"),
)
def review_override(spark, sf):
    out = resolve.review_override(derived(spark, sf, "mask_plan"), derived(spark, sf, "reviews"))
    return out.select("doc_id", "pii_id", "strategy")


TOGGLE = f"""SELECT p.doc_id, p.pii_id, p.pii_type, {category_sql('p.pii_type')} AS category, coalesce(r.selected, true) AS selected
    FROM mask_plan p LEFT JOIN reviews r ON p.doc_id = r.doc_id AND p.pii_id = r.pii_id"""


@query(
    "review_select",
    f"""WITH base AS ({TOGGLE}), flip AS (SELECT doc_id, bool_and(selected) AS all_on FROM base WHERE category = 'codes' GROUP BY doc_id),
    done AS (SELECT b.doc_id, b.pii_id, b.category, CASE WHEN b.category = 'codes' THEN NOT f.all_on ELSE b.selected END AS selected FROM base b LEFT JOIN flip f ON b.doc_id = f.doc_id)
    SELECT doc_id, category, count(*) AS items, count(*) FILTER (selected) AS selected_items,
        CASE WHEN count(*) FILTER (selected) = 0 THEN 'none' WHEN count(*) FILTER (selected) = count(*) THEN 'all' ELSE 'partial' END AS state
    FROM done GROUP BY doc_id, category""",
    ("mask_plan", "reviews"),
)
def review_select(spark, sf):
    """Default selection, toggle one category, state per category."""
    plan, reviews = derived(spark, sf, "mask_plan"), derived(spark, sf, "reviews")
    picked = plan.join(reviews.select("doc_id", "pii_id", "selected"), ["doc_id", "pii_id"], "left").withColumn(
        "selected", F.coalesce("selected", F.lit(True))
    )
    return resolve.selection_state(resolve.toggle_category(picked, "codes"))


@query(
    "review_masked",
    """SELECT doc_id, strategy, count(*) AS n FROM mask_plan WHERE (doc_id, pii_id) IN (SELECT (doc_id, pii_id) FROM reviews WHERE selected) GROUP BY 1, 2""",
    ("mask_plan", "reviews"),
)
def review_masked(spark, sf):
    """Only selected items reach the masker."""
    kept = resolve.review_select(derived(spark, sf, "mask_plan"), derived(spark, sf, "reviews").where("selected"))
    return kept.groupBy("doc_id", "strategy").agg(F.count("*").alias("n"))


# --- configuration lines -------------------------------------------------------------------------


@query(
    "config_write",
    "SELECT doc_id, text || ':' || pii_type || ':' || strategy || ':' || page_num || printf(':%.2f:%.2f:%.2f:%.2f', x0, y0, x1, y1) AS line FROM mask_plan",
    ("mask_plan",),
)
def config_write(spark, sf):
    return config_lines.config_write(derived(spark, sf, "mask_plan")).select("doc_id", "line")


C = f"CAST({O} AS STRING)"
DERIVED["lines"] = f"""SELECT o_custkey AS doc_id, {O} AS line_num, {case(
    O,
    f"'John Doe ' || {C} || ':PERSON:pseudo:' || CAST({O} % 5 AS STRING) || ':100.5:200.25:180.75:220'",
    f"'user' || {C} || '@email.com:EMAIL:mask'",
    f"'  00:1A:2B:3C:4D:' || {C} || ':MAC_ADDRESS:redact:1:1:2:3:4  '",
    "'# comment: with: colons'",
    "''",
    f"'http://x/' || {C} || ':url:Mask'",
    f"'bad' || {C} || ':SSN:redact:one:1:2:3:4'",
    f"'bad' || {C} || ':SSN:redact:1:1.5:x:3:4'",
    f"'Jane ' || {C} || ':Person:Pseudo: Rhea Zeller '",
    "'only:two'",
    f"'a:b:c' || {C} || ':LOC:pseudo'",
)} AS line FROM {{orders}}"""
INT, NUM = quote(config_lines.INTEGER), quote(config_lines.NUMBER)


def part(k: str) -> str:
    return f"p[{k}]"


def num_sql(cell: str, pattern: str, kind: str) -> str:
    return f"CASE WHEN regexp_matches({strip_sql(cell)}, {pattern}) THEN CAST({strip_sql(cell)} AS {kind}) END"


LINES = f"(SELECT *, string_split(s, ':') AS p, len(string_split(s, ':')) AS n FROM (SELECT doc_id, line_num, {strip_sql('line')} AS s FROM lines) WHERE s <> '' AND NOT starts_with(s, '#'))"
COORDS = [num_sql(f"p[n - {3 - i}]", NUM, "DOUBLE") for i in range(4)]
PAGE = num_sql("p[n - 4]", INT, "INTEGER")


@query(
    "config_parse",
    f"""SELECT * FROM (SELECT doc_id, 'pii_' || line_num AS pii_id, array_to_string(p[1:CASE WHEN n >= 8 THEN n - 7 ELSE n - 2 END], ':') AS text,
        CASE WHEN n >= 8 THEN p[n - 6] ELSE p[n - 1] END AS pii_type, CASE WHEN n >= 8 THEN p[n - 5] ELSE p[n] END AS strategy,
        CASE WHEN n >= 8 THEN {PAGE} ELSE 0 END AS page_num,
        {', '.join(f"CASE WHEN n >= 8 THEN {c} ELSE 0 END AS {name}" for c, name in zip(COORDS, ('x0', 'y0', 'x1', 'y1')))}
        FROM {LINES} WHERE n >= 3) WHERE page_num IS NOT NULL AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL""",
    ("lines",),
)
def config_parse(spark, sf):
    return config_lines.config_parse(derived(spark, sf, "lines"))


K3 = "CASE WHEN n >= 8 THEN 7 WHEN n = 3 THEN 2 ELSE 3 END"
GOOD, CUM = "n >= 8", []
for value, name, zero in zip([PAGE, *COORDS], ("page_num", "x0", "y0", "x1", "y1"), ("0", "0.0", "0.0", "0.0", "0.0")):
    GOOD += f" AND {value} IS NOT NULL"
    CUM.append(f"CASE WHEN {GOOD} THEN {value} ELSE {zero} END AS {name}")


@query(
    "config_parse_masker",
    f"""SELECT doc_id, line_num, {strip_sql(f"array_to_string(p[1:n - {K3}], ':')")} AS text, upper({strip_sql(f'p[n - {K3} + 1]')}) AS pii_type,
    lower({strip_sql(f'p[n - {K3} + 2]')}) AS strategy, {', '.join(CUM)}, CASE WHEN n BETWEEN 4 AND 7 THEN {strip_sql('p[n]')} END AS replacement
    FROM {LINES} WHERE n >= 3""",
    ("lines",),
)
def config_parse_masker(spark, sf):
    return config_lines.config_parse_replacement(derived(spark, sf, "lines"))


# --- replacements --------------------------------------------------------------------------------

DERIVED["named"] = f"""SELECT {O} AS id, {case(O, "'PERSON'", "'LOC'", "'ADDRESS'", "'ORG'", "'PHONE'", "'SSN'", "'CREDIT_CARD'", "'BANK_ACCOUNT'", "'URL'")} AS pii_type,
    {case(f'({O} + 1)', "'redact'", "'mask'", "'pseudo'", "'Mask'", "'unknown'", "'pseudo'", "'pseudo'")} AS strategy,
    {case(f'({O} * 5 % 17)', "'Aaron Mehta'", "'Aaron'", "'Maria  Lund Novak'", "'78 Oak Street'", "'Jacksonville'", "'Suite 9'", "'Oslo'", "'Acme Inc'", "'+1 (415) 555-0199'", "'123-45-6789'", "'4111 1111 1111 1111'")} || CASE WHEN {O} % 2 = 0 THEN ' ' || CAST({O} % 300 AS STRING) ELSE '' END AS text FROM {{orders}}"""


@query(
    "pseudo_dispatch",
    f"SELECT id, pii_type, text, {replacement_sql('strategy', 'pii_type', 'text')} AS replacement FROM named",
    ("named",),
)
def pseudo_dispatch(spark, sf):
    out = F.expr(pseudo.replacement("strategy", "pii_type", "text"))
    return derived(spark, sf, "named").select("id", "pii_type", "text", out.alias("replacement"))


def named_sql():
    from checks.sqltext import pseudonym_sql

    sq = squeeze_sql("text")
    return f"""SELECT id, CASE WHEN lower(strategy) = 'mask' AND pii_type = 'PERSON' AND contains({sq}, ' ') THEN regexp_replace({sq}, '[^ ]', '*', 'g')
        WHEN lower(strategy) = 'mask' THEN repeat('*', length(text)) WHEN lower(strategy) = 'redact' THEN '[REDACTED]'
        WHEN lower(strategy) = 'pseudo' THEN {pseudonym_sql('pii_type', 'text')} ELSE text END AS masked FROM named"""


@query("mask_named", named_sql(), ("named",))
def mask_named(spark, sf):
    out = F.expr(pseudo.mask_named("text", "strategy", "pii_type"))
    return derived(spark, sf, "named").select("id", out.alias("masked"))
