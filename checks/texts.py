"""Chunks, model answers, items in text blocks, synthesis and audits over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import DERIVED, case, derived, query
from checks.detection import docs, turns
from checks.inputs import EMAIL, K, SSN
from checks.sqltext import (
    DOCS,
    TURNS,
    entities_sql,
    hash_sql,
    pick_sql,
    quote,
    spans_sql,
    squeeze_sql,
    strip_sql,
)
from veil.functions import dims, hashing, pseudo
from veil.functions.patterns import NOUNS, NUMERIC, REGISTRY
from veil.functions.text import SPACE
from veil.operators import chunk, detect, layout
from veil.sources import readers

SPACES = quote(f"{SPACE}+")

# --- pages and chunks ----------------------------------------------------------------------------


@query(
    "src_pages",
    f"SELECT doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY page_num) || chr(10) || chr(10)) AS text_sha, count(*) AS n_pages FROM {TURNS} GROUP BY doc_id",
)
def src_pages(spark, sf):
    full = readers.full_text(turns(spark, sf))
    return full.select("doc_id", F.sha2("text", 256).alias("text_sha"), "n_pages")


WORDS = f"list_filter(regexp_split_to_array(text, {SPACES}), lambda w: w <> '')"
PACK = f"""list_reduce(list_transform({WORDS}, lambda w: {{'done': ['']::VARCHAR[], 'cur': w, 'n': length(w)}}),
    lambda a, x: CASE WHEN a.n + length(x.cur) > 4000 AND a.cur <> '' THEN {{'done': list_append(a.done, a.cur), 'cur': x.cur, 'n': length(x.cur)}}
        ELSE {{'done': a.done, 'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || ' ' || x.cur END, 'n': a.n + length(x.cur) + 1}} END,
    {{'done': []::VARCHAR[], 'cur': '', 'n': 0::BIGINT}})"""
CHUNKS = f"""(SELECT doc_id, page_num, CASE WHEN length(text) <= 4000 THEN [text] ELSE list_append(r.done, r.cur) END AS cs
    FROM (SELECT doc_id, page_num, text, CASE WHEN length(text) > 4000 THEN {PACK} END AS r FROM {DOCS}))"""


@query(
    "chunk_words",
    f"SELECT doc_id, CAST(g - 1 AS INTEGER) AS chunk_idx, sha256(cs[g]) AS chunk_sha, length(cs[g]) AS n FROM {CHUNKS} q, unnest(generate_series(1, len(cs))) AS u(g)",
)
def chunk_words(spark, sf):
    c = chunk.chunk_words(docs(spark, sf))
    return c.select("doc_id", "chunk_idx", F.sha2("chunk", 256).alias("chunk_sha"), F.length("chunk").cast("bigint").alias("n"))


@query(
    "chunk_offsets",
    f"""SELECT doc_id, chunk_idx, CAST(coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk_offset
    FROM (SELECT doc_id, CAST(g - 1 AS INTEGER) AS chunk_idx, length(cs[g]) AS n FROM {CHUNKS} q, unnest(generate_series(1, len(cs))) AS u(g))""",
)
def chunk_offsets(spark, sf):
    return chunk.chunk_words(docs(spark, sf)).select("doc_id", "chunk_idx", "chunk_offset")


STRIDES = f"(SELECT doc_id, CAST(a / 1850 AS INTEGER) AS chunk_idx, substr(text, a + 1, 2000) AS chunk, text FROM {DOCS} d, unnest(range(0, greatest(length(text) - 150, 1), 1850)) AS u(a))"


@query("chunk_overlap", f"SELECT doc_id, chunk_idx, sha256(chunk) AS chunk_sha FROM {STRIDES}")
def chunk_overlap(spark, sf):
    c = chunk.chunk_overlap(docs(spark, sf))
    return c.select("doc_id", "chunk_idx", F.sha2("chunk", 256).alias("chunk_sha"))


# the cut behind the last separator of a window's second half, by a greedy match
LAST_CUT = "coalesce(" + ", ".join(
    f"nullif(length(regexp_extract(w, '(?s)^.*{sep}', 0)), 0)" for sep in (r"\n\n", r"\n", r"\. ", "! ", r"\? ", "; ", ", ", " ")
) + ", 1000)"
WINDOWS = f"""WITH RECURSIVE cuts AS (
    SELECT doc_id, 0 AS chunk_idx, 0::BIGINT AS pos, text, length(text) AS len, substr(text, 1001, 1000) AS w FROM {DOCS}
    UNION ALL
    SELECT doc_id, chunk_idx + 1, nxt, text, len, substr(text, nxt + 1001, 1000)
    FROM (SELECT *, pos + 1000 + {LAST_CUT} - 150 AS nxt FROM cuts WHERE len - pos > 2000))
SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(length(chunk) AS INTEGER) AS n, sha256(chunk) AS chunk_sha
FROM (SELECT doc_id, chunk_idx, substr(text, pos + 1, CASE WHEN len - pos > 2000 THEN 1000 + {LAST_CUT} ELSE len END) AS chunk FROM cuts)"""


@query("chunk_separators", WINDOWS)
def chunk_separators(spark, sf):
    c = chunk.chunk_at_separators(docs(spark, sf))
    return c.select("doc_id", "chunk_idx", F.length("chunk").alias("n"), F.sha2("chunk", 256).alias("chunk_sha"))


# --- model stages --------------------------------------------------------------------------------

ITEM1 = f"'{{\"text\": \"' || {EMAIL} || '\", \"pii_type\": \"EMAIL\", \"confidence\": 0.95}}'"
ITEM2 = f"'{{\"text\": \"' || {SSN} || '\", \"pii_type\": \"SSN\", \"start\": 4, \"end\": 15, \"confidence\": 0.99, \"context_info\": \"tax\"}}'"
ITEM3 = "'{\"text\": \"not in the text\", \"pii_type\": \"PERSON\"}'"
ITEM4 = "'{\"text\": \"Acme   Inc\", \"pii_type\": \"ORG\"}'"
ITEM5 = "'{\"text\": \"Acme\"}'"
FENCE = "'```json' || chr(10)"
DERIVED["llm_raw"] = f"""SELECT {K} AS doc_id, CAST({K} % 4 AS INT) AS page_num, CAST({K} % 3 AS INT) AS chunk_idx, CAST({K} % 3 * 1000 AS BIGINT) AS chunk_offset,
    'SSN ' || {SSN} || ' and mail ' || {EMAIL} || ' of Acme Inc.' AS chunk, {case(
    K,
    f"'[' || {ITEM1} || ', ' || {ITEM2} || ']'",
    f"{FENCE} || '[' || {ITEM1} || ', ' || {ITEM3} || ']' || chr(10) || '```'",
    f"'[' || {ITEM1} || ', {{\"text\": \"trunc'",
    "'I found no personal data.'",
    f"'```' || chr(10) || '[' || {ITEM4} || ', ' || {ITEM5} || ', ' || {ITEM2} || ']```  '",
    "'[]'",
    "''",
)} AS response FROM {{customer}}"""
BARE = f"""regexp_replace(regexp_replace({strip_sql('response')}, '^```(json)?', ''), '```$', '')"""
SHAPE = '[{"text":"VARCHAR","pii_type":"VARCHAR","start":"INTEGER","end":"INTEGER","confidence":"DOUBLE"}]'
ANSWERS = f"""(SELECT doc_id, page_num, chunk_idx, chunk_offset, chunk, items, g FROM (SELECT *, from_json(CASE WHEN json_valid({strip_sql(BARE)}) THEN {strip_sql(BARE)} ELSE '[]' END, '{SHAPE}') AS items FROM llm_raw) q,
    unnest(generate_series(1, len(items))) AS u(g))"""


@query(
    "llm_json_parse",
    f"SELECT doc_id, CAST(g - 1 AS INTEGER) AS item_idx, items[g].text AS text, items[g].pii_type AS pii_type, items[g].start AS start_pos, items[g].end AS end_pos, items[g].confidence AS confidence FROM {ANSWERS}",
    ("llm_raw",),
)
def llm_json_parse(spark, sf):
    rows = detect.parse_responses(derived(spark, sf, "llm_raw"))
    return rows.select(
        "doc_id", "item_idx", "item.text", "item.pii_type", F.col("item.start").alias("start_pos"),
        F.col("item.end").alias("end_pos"), "item.confidence",
    )


@query(
    "llm_entities",
    f"""SELECT doc_id, page_num, CAST(chunk_idx AS BIGINT) * 4294967296 + g - 1 AS ord, t AS text, items[g].pii_type AS pii_type,
        CAST((CASE WHEN given THEN items[g].start ELSE loc END) + chunk_offset AS INTEGER) AS start_pos,
        CAST((CASE WHEN given THEN items[g]."end" ELSE loc + length(t) END) + chunk_offset AS INTEGER) AS end_pos, coalesce(items[g].confidence, 0.8) AS confidence
    FROM (SELECT *, items[g].text AS t, greatest(instr(chunk, items[g].text) - 1, 0) AS loc, items[g].start IS NOT NULL AND items[g]."end" IS NOT NULL AS given FROM {ANSWERS})
    WHERE t IS NOT NULL AND items[g].pii_type IS NOT NULL AND (contains(chunk, t) OR contains({squeeze_sql('chunk')}, {squeeze_sql('t')}))""",
    ("llm_raw",),
)
def llm_entities(spark, sf):
    out = detect.llm_entities(derived(spark, sf, "llm_raw"))
    return out.select(
        "doc_id", "page_num", "ord", "text", "pii_type", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "confidence"
    )


DERIVED["column_raw"] = f"""SELECT {K} AS answer_id, {case(
    K,
    "'Here: ```json' || chr(10) || '[{\"column\": \"c' || CAST(c_custkey AS STRING) || '\", \"label\": \"PII|PHI (HIPAA)\", \"subtype\": null, \"confidence\": 0.9}]```'",
    "'[{\"column\": \"b\", \"label\": \"phi\", \"subtype\": \"medical_condition\", \"confidence\": 0.75}, {\"label\": \"weird\"}] done'",
    "'column: \"x\", label: \"pii\", subtype: \"email\" (no JSON)'",
    "'nothing to say'",
)} AS response FROM {{customer}}"""
CFENCE = "regexp_extract(response, '(?s)```(?:json)?(.*?)```', 1)"
CJSON = strip_sql(f"(CASE WHEN {CFENCE} <> '' THEN {CFENCE} ELSE regexp_extract(response, '(?s)([\\[{{].*[\\]}}])', 1) END)")
CSHAPE = '[{"column":"VARCHAR","label":"VARCHAR","subtype":"VARCHAR","confidence":"DOUBLE"}]'
FL = "upper(regexp_extract(response, '(?is)label[\"'']?\\s*[:\\s]*[\"'']([A-Z]+)[\"'']', 1))"
FS = "regexp_extract(response, '(?is)subtype[\"'']?\\s*[:\\s]*[\"'']([^\"'']+)[\"'']', 1)"
FC = "regexp_extract(response, '(?is)column[\"'']?\\s*[:\\s]*[\"'']([^\"'']+)[\"'']', 1)"
KNOWN = f"{FL} IN ('PII', 'PHI', 'NONE')"


@query(
    "column_answers",
    f"""SELECT answer_id, coalesce(i.column, '') AS column_name,
        CASE WHEN coalesce(CASE WHEN contains(i.label, '|') THEN upper({strip_sql("split_part(i.label, '|', 1)")}) ELSE upper(i.label) END, 'NONE') IN ('PII', 'PHI')
            THEN CASE WHEN contains(i.label, '|') THEN upper({strip_sql("split_part(i.label, '|', 1)")}) ELSE upper(i.label) END ELSE 'NONE' END AS label,
        CASE WHEN i.subtype IS NULL OR i.subtype = 'null' THEN 'other' ELSE i.subtype END AS subtype, coalesce(i.confidence, 0.0) AS confidence
    FROM (SELECT answer_id, unnest(CASE WHEN json_valid({CJSON}) AND {CJSON} <> '' THEN from_json({CJSON}, '{CSHAPE}')
        ELSE [{{'column': {FC}, 'label': CASE WHEN {KNOWN} THEN {FL} ELSE 'NONE' END, 'subtype': CASE WHEN {KNOWN} AND {FS} <> '' THEN {FS} ELSE 'other' END, 'confidence': CASE WHEN {KNOWN} THEN 0.8 ELSE 0.0 END::DOUBLE}}] END) AS i FROM column_raw)""",
    ("column_raw",),
)
def column_answers(spark, sf):
    return detect.column_answers(derived(spark, sf, "column_raw"))


PAIRS = [p for p in REGISTRY if p.kind == "PERSON"]


@query(
    "detect_model",
    f"SELECT doc_id, page_num, ord, pii_type, text, CAST(\"start\" AS INTEGER) AS start_pos, 0.9 AS confidence, 'NER' AS source FROM {entities_sql(DOCS, PAIRS)}".replace("0.9 AS", "CAST(0.9 AS DOUBLE) AS"),
)
def detect_model(spark, sf):
    def title_scorer():
        """A stand-in recognizer for runs without a model: capitalised word pairs are persons."""
        import re

        pair = re.compile(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b")

        def recognize(body):
            return [
                {"entity_group": "PER", "word": m.group(), "score": 0.9, "start": m.start(), "end": m.end()}
                for m in pair.finditer(body)
            ]

        return recognize

    out = detect.detect_model(docs(spark, sf), title_scorer)
    return out.select("doc_id", "page_num", "ord", "pii_type", "text", F.col("start").alias("start_pos"), "confidence", "source")


# --- items in text blocks ------------------------------------------------------------------------

BLOCK_DOCS = f"(SELECT * FROM {DOCS} UNION ALL SELECT doc_id + 1000000000 AS doc_id, page_num, text FROM pii_corpus)"
BLOCKS = f"""(SELECT doc_id, page_num, CAST(g - 1 AS INTEGER) AS block_id, l[g] AS text, 50.0::DOUBLE AS x0, (g - 1) * 14.0::DOUBLE AS y0, 50.0 + 6.0 * length(l[g]) AS x1, (g - 1) * 14.0 + 12.0 AS y1, 'text' AS source
    FROM (SELECT doc_id, page_num, string_split(text, chr(10)) AS l FROM {BLOCK_DOCS}) q, unnest(generate_series(1, len(l))) AS u(g) WHERE l[g] <> '')"""


def blocks(spark, sf):
    corpus = readers.spread(derived(spark, sf, "pii_corpus")).withColumn("doc_id", F.col("doc_id") + 1000000000)
    lines = docs(spark, sf).unionByName(corpus).select(
        "doc_id", "page_num", F.posexplode(F.split("text", "\n")).alias("block_id", "text")
    ).where("text <> ''")
    n = F.length("text")
    return lines.select(
        "doc_id", "page_num", "block_id", "text", F.lit(50.0).alias("x0"), (F.col("block_id") * 14.0).alias("y0"),
        (50.0 + 6.0 * n).alias("x1"), (F.col("block_id") * 14.0 + 12.0).alias("y1"), F.lit("text").alias("source"),
    )


def disjoint_sql(spans: str) -> str:
    return f"""(list_reduce(list_transform({spans}, lambda s: {{'k': [s]}}), lambda a, x: CASE WHEN len(list_filter(a.k, lambda y: y.s < x.k[1].e AND y.e > x.k[1].s)) > 0
        THEN a ELSE {{'k': list_concat(a.k, x.k)}} END)).k"""


def items_in_blocks(registry, keep: str) -> str:
    return f"""(SELECT doc_id, page_num, block_id, CAST(g - 1 AS INTEGER) AS item_idx, k[g].kind AS item_type, k[g].v AS value, k[g].s AS start_pos, k[g].e AS end_pos
        FROM (SELECT doc_id, page_num, block_id, {disjoint_sql('l')} AS k FROM
            (SELECT doc_id, page_num, block_id, list({{'s': "start", 'e': "end", 'v': text, 'kind': kind}} ORDER BY rank, i) AS l
             FROM {spans_sql(BLOCKS, registry, ('doc_id', 'page_num', 'block_id'))} WHERE {keep} GROUP BY 1, 2, 3)) q, unnest(generate_series(1, len(k))) AS u(g))"""


BARE_NUM = "replace(replace(replace(text, '$', ''), ',', ''), '.', '')"
KEEP_NUM = f"""NOT (length({BARE_NUM}) = 1 OR (length({BARE_NUM}) = 4 AND coalesce(try_cast({BARE_NUM} AS INTEGER) BETWEEN 1900 AND 2100, false))
    OR (length({BARE_NUM}) = 2 AND coalesce(try_cast({BARE_NUM} AS INTEGER) <= 50, false)))"""
KEEP_NOUN = f"NOT ((length(text) < 4 AND NOT regexp_matches(text, '{SPACE}')) OR lower(text) IN ({', '.join(quote(w) for w in dims.NOUN_STOP_WORDS)}))"
NUM_ITEMS, NOUN_ITEMS = items_in_blocks(NUMERIC, KEEP_NUM), items_in_blocks(NOUNS, KEEP_NOUN)
COLS = "doc_id, page_num, block_id, item_idx, item_type, value, start_pos, end_pos"
SHOWN = ["doc_id", "page_num", "block_id", "item_idx", "item_type", "value", "start_pos", "end_pos"]


@query("detect_numeric", f"SELECT {COLS} FROM {NUM_ITEMS}", ("pii_corpus",))
def detect_numeric(spark, sf):
    return detect.detect_numeric(blocks(spark, sf)).select(*SHOWN)


@query("detect_nouns", f"SELECT {COLS} FROM {NOUN_ITEMS}", ("pii_corpus",))
def detect_nouns(spark, sf):
    return detect.detect_nouns(blocks(spark, sf)).select(*SHOWN)


@query(
    "numeric_filter",
    f"SELECT doc_id, count(*) AS matches, count(*) FILTER ({KEEP_NUM}) AS kept FROM {spans_sql(BLOCKS, NUMERIC, ('doc_id', 'page_num', 'block_id'))} GROUP BY doc_id",
    ("pii_corpus",),
)
def numeric_filter(spark, sf):
    from veil.functions.spans import all_spans

    spans = blocks(spark, sf).select("doc_id", F.explode_outer(F.expr(all_spans("text", NUMERIC))).alias("s"))
    found = spans.where(F.col("s").isNotNull())
    return found.groupBy("doc_id").agg(F.count("*").alias("matches"), F.count_if(F.expr(detect.KEEP_NUMBER)).alias("kept"))


@query(
    "noun_filter",
    f"SELECT kind, count(*) AS matches, count(*) FILTER ({KEEP_NOUN}) AS kept FROM {spans_sql(BLOCKS, NOUNS, ('doc_id', 'page_num', 'block_id'))} GROUP BY kind",
    ("pii_corpus",),
)
def noun_filter(spark, sf):
    from veil.functions.spans import all_spans

    spans = blocks(spark, sf).select(F.explode_outer(F.expr(all_spans("text", NOUNS))).alias("s"))
    found = spans.where(F.col("s").isNotNull())
    return found.groupBy("s.kind").agg(F.count("*").alias("matches"), F.count_if(F.expr(detect.keep_noun())).alias("kept"))


@query(
    "bbox_interpolate",
    f"SELECT doc_id, page_num, block_id, item_idx, 50.0 + start_pos * 6.0 AS bx0, block_id * 14.0::DOUBLE AS by0, 50.0 + end_pos * 6.0 AS bx1, block_id * 14.0::DOUBLE + 12 AS by1 FROM {NUM_ITEMS}".replace("50.0 +", "50.0::DOUBLE +"),
    ("pii_corpus",),
)
def bbox_interpolate(spark, sf):
    items = detect.detect_numeric(blocks(spark, sf))
    return items.select("doc_id", "page_num", "block_id", "item_idx", *[F.round(c, 4).alias(c) for c in ("bx0", "by0", "bx1", "by1")])


@query("overlap_resolve", f"SELECT doc_id, page_num, block_id, count(*) AS n, CAST(sum(start_pos * 31 + end_pos) AS BIGINT) AS checksum FROM (SELECT * FROM {NUM_ITEMS} UNION ALL SELECT * FROM {NOUN_ITEMS}) GROUP BY 1, 2, 3", ("pii_corpus",))
def overlap_resolve(spark, sf):
    b = blocks(spark, sf)
    both = detect.detect_numeric(b).unionByName(detect.detect_nouns(b))
    return both.groupBy("doc_id", "page_num", "block_id").agg(
        F.count("*").alias("n"), F.sum(F.col("start_pos") * 31 + F.col("end_pos")).alias("checksum")
    )


BOXES = f"""(SELECT doc_id, page_num, item_id, 50.0 + start_pos * 6.0 AS bx0, CAST(floor(block_id / 2) AS INTEGER) * 10.0::DOUBLE AS by0, 50.0 + end_pos * 6.0 AS bx1, CAST(floor(block_id / 2) AS INTEGER) * 10.0::DOUBLE + 9 AS by1 FROM
    (SELECT *, 'n' || block_id || '.' || item_idx AS item_id FROM {NUM_ITEMS} UNION ALL SELECT *, 'p' || block_id || '.' || item_idx AS item_id FROM {NOUN_ITEMS}))"""
PLACED = f"""(SELECT doc_id, page_num, l, (list_reduce(list_transform(l, lambda s: {{'k': [s]}}), lambda a, x: CASE WHEN len(list_filter(a.k, lambda y:
        NOT (x.k[1].x1 + 2 < y.x0 - 1 OR x.k[1].x0 - 2 > y.x1 + 1 OR x.k[1].y1 + 2 < y.y0 OR x.k[1].y0 - 2 > y.y1))) > 0 THEN a ELSE {{'k': list_concat(a.k, x.k)}} END)).k AS k
    FROM (SELECT doc_id, page_num, list({{'id': item_id, 'x0': bx0, 'y0': by0, 'x1': bx1, 'y1': by1}} ORDER BY by0, bx0, bx1, by1, item_id) AS l FROM {BOXES} GROUP BY 1, 2))"""


@query(
    "bbox_overlap",
    f"SELECT doc_id, page_num, l[g].id AS item_id, list_contains(list_transform(k, lambda y: y.id), l[g].id) AS applied FROM {PLACED} q, unnest(generate_series(1, len(l))) AS u(g)",
    ("pii_corpus",),
)
def bbox_overlap(spark, sf):
    """Numbers and nouns on tight lines, so that boxes do collide."""
    b = blocks(spark, sf)

    def boxed(items, tag):
        row = F.floor(F.col("block_id") / 2) * 10.0
        return items.select(
            "doc_id", "page_num", F.concat(F.lit(tag), F.concat_ws(".", "block_id", "item_idx")).alias("item_id"),
            F.round("bx0", 4).alias("bx0"), row.alias("by0"), F.round("bx1", 4).alias("bx1"), (row + 9).alias("by1"),
        )

    return layout.bbox_overlap(boxed(detect.detect_numeric(b), "n").unionByName(boxed(detect.detect_nouns(b), "p")))


DERIVED["ocr_words"] = """SELECT o_custkey AS doc_id, 0 AS page_num, CAST(o_orderkey AS INT) AS word_id, CASE o_orderkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN ' Total ' ELSE 'w' || CAST(o_orderkey AS STRING) END AS text,
    CAST(o_orderkey % 100 - 1 AS INT) AS conf, CAST(o_orderkey % 800 AS INT) AS "left", CAST(o_orderkey % 900 AS INT) AS top, 40 AS width, 16 AS height,
    1600 AS img_w, 2000 AS img_h, CAST(100 AS DOUBLE) AS ix0, CAST(50 AS DOUBLE) AS iy0, CAST(500 AS DOUBLE) AS ix1, CAST(550 AS DOUBLE) AS iy1 FROM {orders}"""


@query(
    "ocr_word_project",
    f"""SELECT doc_id, page_num, word_id AS block_id, {strip_sql('text')} AS text, round(100 + "left" * 0.25, 6) AS x0, round(50 + top * 0.25, 6) AS y0, round(100 + "left" * 0.25 + 10, 6) AS x1,
    round(50 + top * 0.25 + 4, 6) AS y1, 'ocr' AS source, conf AS confidence FROM ocr_words WHERE {strip_sql('text')} <> '' AND conf > 15""".replace("0.25", "0.25::DOUBLE"),
    ("ocr_words",),
)
def ocr_word_project(spark, sf):
    out = detect.ocr_blocks(derived(spark, sf, "ocr_words"))
    return out.select("doc_id", "page_num", "block_id", "text", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")], "source", "confidence")


@query(
    "perturb_number",
    f"""SELECT doc_id, value, count(*) AS n, max(CASE WHEN b IS NULL THEN repeat('*', length(value)) WHEN contains(value, '$') THEN '$' || format('{{:,.2f}}', m)
        WHEN contains(value, '.') THEN printf('%.2f', m) ELSE format('{{:,}}', CAST(floor(m) AS BIGINT)) END) AS replacement
    FROM (SELECT doc_id, value, b, b * (0.8::DOUBLE + 0.4::DOUBLE * {hash_sql('value')} / 4294967296.0::DOUBLE) AS m FROM (SELECT *, try_cast(replace(replace(value, '$', ''), ',', '') AS DOUBLE) AS b FROM {NUM_ITEMS})) GROUP BY 1, 2""",
    ("pii_corpus",),
)
def perturb_number(spark, sf):
    items = detect.detect_numeric(blocks(spark, sf)).groupBy("doc_id", "value").agg(F.count("*").alias("n"))
    return items.select("doc_id", "value", "n", F.expr(pseudo.perturb_number("value")).alias("replacement"))


@query(
    "replace_noun",
    f"""SELECT item_type, value, count(*) AS n, max(CASE item_type WHEN 'name' THEN {pick_sql(hashing.FIRST_NAMES, 'value')} || ' ' || {pick_sql(hashing.LAST_NAMES, 'value', '', 9)}
        WHEN 'address' THEN {pick_sql(hashing.ADDRESSES, 'value')} ELSE repeat('*', length(value)) END) AS replacement FROM {NOUN_ITEMS} GROUP BY 1, 2""",
    ("pii_corpus",),
)
def replace_noun(spark, sf):
    items = detect.detect_nouns(blocks(spark, sf)).groupBy("item_type", "value").agg(F.count("*").alias("n"))
    return items.select("item_type", "value", "n", F.expr(pseudo.replace_noun("item_type", "value")).alias("replacement"))
