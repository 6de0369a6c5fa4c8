"""Masking variants, synthesis and audits over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import DERIVED, case, derived, query, table
from checks.detection import CUSTOM, FOUND, MASKED, PLAN, docs
from checks.inputs import CARD, EMAIL, PHONE, SSN, K
from checks.sqltext import (
    DOCS,
    dedup_sql,
    entities_sql,
    fold_sql,
    hash_sql,
    masked_sql,
    pick_sql,
    pool_sql,
    quote,
    re2,
    replacement_sql,
    strategy_sql,
    strip_sql,
)
from checks.texts import BLOCKS, NOUN_ITEMS, NUM_ITEMS, STRIDES, blocks, disjoint_sql
from veil.functions import dims, hashing, permute
from veil.functions.patterns import FALLBACK
from veil.functions.text import SPACE
from veil.operators import audit, chunk, detect, mask, people, report, resolve, scan, synth
from veil.sources import readers



@query(
    "masking_stats",
    f"""SELECT count(*) AS documents, count(*) FILTER (n_masked > 0) AS documents_changed, CAST(sum(n_masked) AS BIGINT) AS n_masked, CAST(sum(n_failed) AS BIGINT) AS n_failed,
    CAST(sum(n_redact) AS BIGINT) AS n_redact, CAST(sum(n_mask) AS BIGINT) AS n_mask, CAST(sum(n_pseudo) AS BIGINT) AS n_pseudo FROM {MASKED}""",
)
def masking_stats(spark, sf):
    return mask.masking_stats(mask.protect(docs(spark, sf), CUSTOM))


SPANS = f"(SELECT *, {strategy_sql('pii_type')} AS strategy FROM {entities_sql(DOCS, CUSTOM)} WHERE confidence >= 0.6)"
SPLICED = f"""(SELECT doc_id, len(k) AS n_spans, list_reduce(list_transform(list_sort(k), lambda x: {{'t': x.r, 's': x.s, 'e': x.e}}),
    lambda a, x: {{'t': a.t || substr(text, a.e + 1, x.s - a.e) || x.t, 's': 0, 'e': x.e}}, {{'t': '', 's': 0, 'e': 0}}) AS f, text
    FROM (SELECT d.doc_id, d.text, {disjoint_sql('l')} AS k FROM {DOCS} d JOIN (SELECT doc_id, list({{'s': "start", 'e': "end", 'r': {replacement_sql('strategy', 'pii_type', 'text')}}} ORDER BY ord) AS l FROM {SPANS} GROUP BY doc_id) p ON d.doc_id = p.doc_id))"""


@query(
    "mask_spans",
    f"""SELECT d.doc_id, sha256(CASE WHEN s.doc_id IS NULL THEN d.text ELSE s.f.t || substr(d.text, s.f.e + 1) END) AS masked_sha, CAST(coalesce(s.n_spans, 0) AS INTEGER) AS n_spans
    FROM {DOCS} d LEFT JOIN {SPLICED} s ON d.doc_id = s.doc_id""",
)
def mask_spans(spark, sf):
    found = detect.detect_patterns(docs(spark, sf), CUSTOM).where("confidence >= 0.6")
    found = found.withColumn("strategy", dims.suggest_strategy(F.col("pii_type")))
    out = mask.mask_spans(docs(spark, sf), found)
    return out.select("doc_id", F.sha2("masked_text", 256).alias("masked_sha"), "n_spans")


@query(
    "mask_spans_local",
    f"""SELECT d.doc_id, sha256(CASE WHEN s.doc_id IS NULL THEN d.text ELSE s.f.t || substr(d.text, s.f.e + 1) END) AS masked_sha, CAST(coalesce(s.n_spans, 0) AS INTEGER) AS n_spans
    FROM {DOCS} d LEFT JOIN {SPLICED} s ON d.doc_id = s.doc_id""",
)
def mask_spans_local(spark, sf):
    """The same result without any shuffle."""
    out = mask.protect_spans(docs(spark, sf), CUSTOM, min_confidence=0.6)
    return out.select("doc_id", F.sha2("masked_text", 256).alias("masked_sha"), "n_spans")


CORPUS = "(SELECT doc_id, page_num, text FROM pii_corpus)"
CORPUS_PLAN = f"(SELECT *, {strategy_sql('pii_type')} AS strategy FROM {dedup_sql(entities_sql(CORPUS, CUSTOM))} WHERE confidence >= 0.6)"
ONE = f"(SELECT doc_id, text, min({{'g': page_num, 'o': ord, 't': pii_type, 's': strategy}}) AS p FROM {CORPUS_PLAN} GROUP BY doc_id, text)"
PAGE_ITEMS = f"""(SELECT c.doc_id, c.page_num, list({{'t': p.text, 'r': p.repl, 's': p.strategy}} ORDER BY length(p.text) DESC, p.ord) AS items FROM {CORPUS} c
    JOIN (SELECT doc_id, text, p.o AS ord, p.s AS strategy, {replacement_sql('p.s', 'p.t', 'text')} AS repl FROM {ONE}) p ON c.doc_id = p.doc_id AND contains(c.text, p.text) GROUP BY 1, 2)"""


@query(
    "mask_document",
    f"""SELECT doc_id, page_num, sha256(f.t) AS masked_sha, f.masked AS n_masked FROM (SELECT c.doc_id, c.page_num, {fold_sql('c.text', 'coalesce(i.items, [])')} AS f
    FROM {CORPUS} c LEFT JOIN {PAGE_ITEMS} i ON c.doc_id = i.doc_id AND c.page_num = i.page_num)""",
    ("pii_corpus",),
)
def mask_document(spark, sf):
    """Multi-page documents: what is found on one page is masked on all."""
    pages = readers.spread(derived(spark, sf, "pii_corpus"))
    plan = resolve.mask_plan(detect.detect_patterns(pages, CUSTOM)).where("confidence >= 0.6")
    out = mask.mask_document(pages, plan)
    return out.select("doc_id", "page_num", F.sha2("masked_text", 256).alias("masked_sha"), "n_masked")


def blocks_query() -> str:
    from veil.functions import hashing as H

    moved = f"(try_cast(replace(replace(v, '$', ''), ',', '') AS DOUBLE) * (0.8::DOUBLE + 0.4::DOUBLE * {hash_sql('v')} / 4294967296.0::DOUBLE))"
    repl = f"""CASE kind WHEN 'numerical' THEN CASE WHEN {moved} IS NULL THEN repeat('*', length(v)) WHEN contains(v, '$') THEN '$' || format('{{:,.2f}}', {moved})
        WHEN contains(v, '.') THEN printf('%.2f', {moved}) ELSE format('{{:,}}', CAST(floor({moved}) AS BIGINT)) END
        WHEN 'name' THEN {pick_sql(H.FIRST_NAMES, 'v')} || ' ' || {pick_sql(H.LAST_NAMES, 'v', '', 9)} WHEN 'address' THEN {pick_sql(H.ADDRESSES, 'v')} ELSE repeat('*', length(v)) END"""
    items = f"""SELECT doc_id, page_num, block_id, start_pos AS s, end_pos AS e, value AS v, item_type AS kind, 0 AS side FROM {NUM_ITEMS}
        UNION ALL SELECT doc_id, page_num, block_id, start_pos, end_pos, value, item_type, 1 FROM {NOUN_ITEMS}"""
    listed = f"""SELECT doc_id, page_num, block_id, {disjoint_sql('l')} AS k FROM (SELECT doc_id, page_num, block_id, list({{'s': s, 'e': e, 'r': {repl}}} ORDER BY s, side) AS l FROM ({items}) GROUP BY 1, 2, 3)"""
    folded = """list_reduce(list_transform(k, lambda x: {'t': x.r, 's': x.s, 'e': x.e}), lambda a, x: {'t': a.t || substr(text, a.e + 1, x.s - a.e) || x.t, 's': 0, 'e': x.e}, {'t': '', 's': 0, 'e': 0})"""
    return f"""SELECT b.doc_id, b.page_num, b.block_id, CASE WHEN k IS NULL THEN text ELSE f.t || substr(text, f.e + 1) END AS anonymized, CAST(coalesce(len(k), 0) AS INTEGER) AS n_items
        FROM (SELECT b.doc_id, b.page_num, b.block_id, b.text, i.k, {folded.replace('text', 'b.text').replace('list_transform(k', 'list_transform(i.k')} AS f FROM {BLOCKS} b LEFT JOIN ({listed}) i ON b.doc_id = i.doc_id AND b.page_num = i.page_num AND b.block_id = i.block_id) b"""


@query("anonymize_blocks", blocks_query(), ("pii_corpus",))
def anonymize_blocks(spark, sf):
    """Numbers and proper nouns of text blocks replaced in place."""
    out = mask.anonymize_blocks(blocks(spark, sf))
    return out.select("doc_id", "page_num", "block_id", "anonymized", "n_items")


# --- names ---------------------------------------------------------------------------------------

DERIVED["names"] = """SELECT CAST(floor(c_custkey / 20) AS BIGINT) AS doc_id, CAST(c_custkey % 20 AS INT) AS ord,
    CASE c_custkey % 4 WHEN 0 THEN f WHEN 1 THEN f || '  ' || l WHEN 2 THEN l || ' ' || f ELSE f || ' ' || l || ' ' || m END AS text FROM
    (SELECT c_custkey, 'Fn' || CAST(c_custkey * 7 % 23 AS STRING) AS f, 'Ln' || CAST(c_custkey * 5 % 19 AS STRING) AS l, 'Mn' || CAST(c_custkey % 11 AS STRING) AS m FROM {customer})"""
PARTS = """(SELECT doc_id, ord, text, g - 1 AS pos, ps[g] AS part, CASE WHEN len(ps) = 2 AND g = 2 THEN 'last' ELSE 'first' END AS role
    FROM (SELECT *, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS ps FROM names) q, unnest(generate_series(1, len(ps))) AS u(g))"""
ROLES = f"(SELECT doc_id, part, role FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY length(text) DESC, ord, pos) AS rn FROM {PARTS}) WHERE rn = 1)"


@query("first_role", f"SELECT doc_id, part, role FROM {ROLES}", ("names",))
def first_role(spark, sf):
    return people.first_role(people.name_parts(derived(spark, sf, "names")))


def pool(names, index):
    from checks.sqltext import pool_sql

    return f"{pool_sql(names)}[{index} % {len(names)} + 1]"


def person_query():
    from veil.functions import hashing as H

    ranked = f"(SELECT doc_id, part, role, row_number() OVER (PARTITION BY doc_id, role ORDER BY sha256(part)) - 1 AS r FROM {ROLES})"
    return f"""SELECT p.doc_id, p.ord, p.text, string_agg(CASE WHEN r.role = 'last' THEN {pool(H.LAST_NAMES, 'r.r')} ELSE {pool(H.FIRST_NAMES, 'r.r')} END, ' ' ORDER BY p.pos) AS pseudonym
    FROM {PARTS} p JOIN {ranked} r ON p.doc_id = r.doc_id AND p.part = r.part GROUP BY 1, 2, 3"""


@query("pseudo_person", person_query(), ("names",))
def pseudo_person(spark, sf):
    return people.pseudo_person(derived(spark, sf, "names"))


DERIVED["digit_texts"] = """SELECT c_custkey, '+1 (' || CAST(c_custkey % 1000 AS STRING) || ') 555-' || CAST(c_custkey AS STRING) || ' ext ' || c_name AS text FROM {customer}"""


def digits_query():
    from checks.sqltext import replace_digits_sql

    return f"SELECT c_custkey, {replace_digits_sql('text')} AS replaced FROM digit_texts"


@query("pseudo_digits", digits_query(), ("digit_texts",))
def pseudo_digits(spark, sf):
    from veil.functions.hashing import replace_digits

    return derived(spark, sf, "digit_texts").select("c_custkey", F.expr(replace_digits("text")).alias("replaced"))


def feistel_sql(source: str, left: str, right: str, a: str, b: str, domain: str, salt: str) -> str:
    """All columns of the source with the permuted pair as ``l`` and ``r``; ``left`` and the rest may name its columns."""
    out = f"SELECT *, CAST({left} AS BIGINT) AS l, CAST({right} AS BIGINT) AS r, CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b FROM {source}"
    for i in range(1, permute.ROUNDS + 1):
        this, other, base = ("l", "r", "a") if i % 2 else ("r", "l", "b")
        h = f"CAST('0x' || substr(sha256({quote(salt)} || {domain} || ':{i}:' || {other}), 1, 15) AS BIGINT)"
        out = f"SELECT * REPLACE (({this} + {h} % {base}) % {base} AS {this}) FROM ({out})"
    return f"({out})"


def permuted_sql(source: str, salt: str) -> str:
    """(c_custkey, permuted) of texts with 1 to 36 digits."""
    digits = f"(SELECT *, length(v) // 2 AS nl, length(v) - length(v) // 2 AS nr FROM (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS v FROM {source}))"
    pairs = feistel_sql(digits, "substr(v, 1, nl)", "substr(v, nl + 1)", "rpad('1', CAST(nl + 1 AS INTEGER), '0')", "rpad('1', CAST(nr + 1 AS INTEGER), '0')", "(nl + nr)", salt)
    return f"""(SELECT c_custkey, array_to_string(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN substr(text, i, 1) BETWEEN '0' AND '9'
        THEN substr(z, length(regexp_replace(substr(text, 1, i), '[^0-9]', '', 'g')), 1) ELSE substr(text, i, 1) END), '') AS permuted
        FROM (SELECT *, lpad(CAST(l AS VARCHAR), CAST(nl AS INTEGER), '0') || lpad(CAST(r AS VARCHAR), CAST(nr AS INTEGER), '0') AS z FROM {pairs}))"""


DERIVED["keyed_texts"] = f"SELECT {K} AS c_custkey, {case(K, CARD, PHONE, SSN, EMAIL)} || ' / ' || CAST({K} AS STRING) AS text FROM {{customer}}"


@query("permute_digits", permuted_sql("keyed_texts", "fp"), ("keyed_texts",))
def permute_digits(spark, sf):
    """Cards, phones, numbers and e-mails with their digits permuted: as many results as originals."""
    return derived(spark, sf, "keyed_texts").select("c_custkey", F.expr(permute.permute_digits("text", "fp")).alias("permuted"))


@query(
    "permute_person",
    f"""SELECT o_orderkey, {pool_sql(hashing.FIRST_NAMES)}[l + 1] || ' ' || {pool_sql(hashing.LAST_NAMES)}[r % 32 + 1] || CASE WHEN r < 32 THEN '' ELSE ' ' || (r // 32) END AS pseudonym
    FROM {feistel_sql('orders', 'o_orderkey % 32', 'o_orderkey // 32', '32', '32000000', "'person32000000'", 'fp')}""",
)
def permute_person(spark, sf):
    """A name per order that no other order has."""
    return table(spark, sf, "orders").select("o_orderkey", F.expr(permute.permute_person("o_orderkey", "fp")).alias("pseudonym"))


# --- synthesis -----------------------------------------------------------------------------------


def fallback_text(body: str, plain: str | None = None) -> str:
    """The substitutions on text whose letters outside ASCII are kept: boundaries are tested by class."""
    for regex, constant in FALLBACK:
        rx = re2(regex, True)
        if rx.startswith(r"\b"):
            rx = r"(^|[^\p{L}\p{N}_])" + "(?:" + rx[2:] + ")"
            body = f"regexp_replace({body}, {quote(rx)}, {quote(chr(92) + '1' + constant)}, 'g')"
        else:
            body = f"regexp_replace({body}, {quote(rx)}, {quote(constant)}, 'g')"
    return body


@query(
    "anonymize_fallback",
    f"SELECT doc_id, page_num, {fallback_text('text')} AS anonymized FROM {CORPUS}",
    ("pii_corpus",),
)
def anonymize_fallback(spark, sf):
    return derived(spark, sf, "pii_corpus").select("doc_id", "page_num", synth.anonymize_fallback("text").alias("anonymized"))


DERIVED["rewrites"] = """SELECT doc_id, page_num, 0 AS chunk_idx, text AS chunk,
    CASE doc_id % 4 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '  ' WHEN 2 THEN '```text' || chr(10) || 'A new text ' || CAST(doc_id AS STRING) || chr(10) || '```' ELSE 'Plain ' || CAST(doc_id AS STRING) END AS rewritten FROM {pii_corpus}"""
UNFENCED = "regexp_replace(regexp_replace(rewritten, '```[0-9A-Za-z_]*\\n', '', 'g'), '\\n```', '', 'g')"


@query(
    "synth_rewrite",
    f"SELECT doc_id, page_num, CASE WHEN rewritten IS NULL OR {strip_sql(UNFENCED)} = '' THEN {fallback_text('chunk')} ELSE {UNFENCED} END AS synthetic FROM rewrites",
    ("rewrites",),
)
def synth_rewrite(spark, sf):
    return synth.synth_rewrite(derived(spark, sf, "rewrites")).select("doc_id", "page_num", "synthetic")


JOINED = f"(SELECT doc_id, string_agg({strip_sql('chunk')}, chr(10) || chr(10) ORDER BY chunk_idx) AS j FROM {STRIDES} WHERE {strip_sql('chunk')} <> '' GROUP BY doc_id)"
TIDY = strip_sql("regexp_replace(j, '\\n{4,}', chr(10) || chr(10) || chr(10), 'g')")


@query(
    "assemble",
    f"SELECT d.doc_id, sha256(CASE WHEN coalesce({TIDY}, '') = '' THEN {quote(synth.EMPTY_RESULT)} ELSE {TIDY} END) AS content_sha FROM {DOCS} d LEFT JOIN {JOINED} j ON d.doc_id = j.doc_id",
)
def assemble(spark, sf):
    chunks = chunk.chunk_overlap(docs(spark, sf)).withColumnRenamed("chunk", "synthetic")
    return synth.assemble(chunks, ["doc_id"]).select("doc_id", F.sha2("content", 256).alias("content_sha"))




@query(
    "replicate",
    f"SELECT doc_id, page_num, n AS dataset_number, sha256({strip_sql(fallback_text('text'))}) AS content_sha FROM {CORPUS} c, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS n) r",
    ("pii_corpus",),
)
def replicate(spark, sf):
    """Three synthetic datasets per page, all stages in one narrow pass."""
    pages = readers.spread(derived(spark, sf, "pii_corpus"))
    return synth.synthesize(pages, datasets=3).select(
        "doc_id", "page_num", "dataset_number", F.sha2("content", 256).alias("content_sha")
    )


@query(
    "dataset_sink",
    f"""SELECT doc_id, n AS dataset_number, 'synthetic_' || n || '_file' || doc_id || CASE doc_id % 2 WHEN 0 THEN '.PDF' ELSE '.txt' END AS synthetic_name,
    CAST(octet_length(encode({strip_sql(fallback_text('text'))})) AS INTEGER) AS size, CASE doc_id % 2 WHEN 0 THEN 'application/pdf' ELSE 'text/plain' END AS original_mime_type
    FROM {CORPUS} c, (SELECT CAST(unnest(range(1, 3)) AS INTEGER) AS n) r""",
    ("pii_corpus",),
)
def dataset_sink(spark, sf):
    ext = F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".txt")
    pages = readers.spread(derived(spark, sf, "pii_corpus")).withColumn("file_type", ext)
    pages = pages.withColumn("original_name", F.concat(F.lit("file"), F.col("doc_id").cast("string"), ext))
    return synth.dataset_rows(synth.synthesize(pages, datasets=2)).drop("content")


# --- scans, running totals, audits ---------------------------------------------------------------

SCAN_PAGES = f"(SELECT conv_id AS doc_id, turn AS page_num, text, CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS n_images FROM conversations)"
ST = strip_sql("text")
SCAN = f"""(SELECT doc_id, sum(length({ST})) AS c, sum(len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> ''))) AS w, count(*) AS p, 612.0 * 792.0 AS area, max(n_images) > 0 AS img FROM {SCAN_PAGES} GROUP BY doc_id)"""
V = ["c < 50", "c / area < 0.1", "w / p < 10", "img AND c / p < 100"]
YES = " + ".join(f"CAST({v} AS INTEGER)" for v in V)
FOR = " + ".join(f"CASE WHEN {v} THEN {w[0]} ELSE 0 END" for v, w in zip(V, scan.WEIGHTS))
AGAINST = " + ".join(f"CASE WHEN {v} THEN 0 ELSE {w[1]} END" for v, w in zip(V, scan.WEIGHTS))


@query(
    "scan_classify",
    f"""SELECT doc_id, ({YES}) >= 2 AS is_scanned, round(CAST(CASE WHEN ({YES}) >= 2 THEN ({FOR}) / ({YES}) ELSE ({AGAINST}) / greatest(4 - ({YES}), 1) END AS DOUBLE), 3) AS confidence,
    CAST(c AS BIGINT) AS total_chars, p AS total_pages, round(CAST(c AS DOUBLE) / p, 1) AS avg_chars_per_page, round(CAST(w AS DOUBLE) / p, 1) AS avg_words_per_page, round(CAST(c AS DOUBLE) / 484704.0::DOUBLE, 6) AS text_density, img AS has_images,
    CASE WHEN ({YES}) >= 2 THEN '{scan.NEEDS_OCR}' ELSE '{scan.DIRECT}' END AS action FROM {SCAN}""",
)
def scan_classify(spark, sf):
    """Conversations as documents, turns as letter-sized pages, an image on every third."""
    pages = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("page_num"),
        "text",
        F.lit(612.0).alias("width"),
        F.lit(792.0).alias("height"),
        F.when(F.col("turn") % 3 == 0, 1).otherwise(0).alias("n_images"),
    )
    return scan.scan_classify(pages)


@query(
    "page_running",
    "SELECT doc_id, page_num, n_items, CAST(sum(n_items) OVER (PARTITION BY doc_id ORDER BY page_num) AS BIGINT) AS running_items FROM (SELECT doc_id, page_num, count(*) AS n_items FROM entities GROUP BY 1, 2)",
    ("entities",),
)
def page_running(spark, sf):
    return report.page_running(derived(spark, sf, "entities"), block=2)


@query(
    "job_progress",
    f"""SELECT doc_id, chunk_idx, dataset_number, progress, dataset_progress, assembling FROM (SELECT doc_id, chunk_idx, n AS dataset_number, round((chunk_idx + 1) * 90.0::DOUBLE / n_chunks, 6) AS progress,
    CASE WHEN chunk_idx + 1 = n_chunks THEN round(n * 100.0::DOUBLE / 3, 6) END AS dataset_progress, CASE WHEN chunk_idx + 1 = n_chunks THEN 95.0::DOUBLE END AS assembling
    FROM (SELECT doc_id, chunk_idx, count(*) OVER (PARTITION BY doc_id) AS n_chunks FROM {STRIDES}) s, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS n) r)""",
)
def job_progress(spark, sf):
    chunks = docs(spark, sf).withColumn("c", F.expr(chunk.stride_chunks("text")))
    rows = synth.replicate(chunks, 3).select(
        "doc_id", "dataset_number", F.size("c").alias("n_chunks"), F.posexplode("c").alias("chunk_idx", "chunk")
    )
    return report.job_progress(rows.withColumn("num_datasets", F.lit(3))).select(
        "doc_id", "chunk_idx", "dataset_number", "progress", "dataset_progress", "assembling"
    )


LUHN = "list_sum(list_transform(range(1, length(dg) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(substr(dg, i, 1) AS INTEGER) * 2 > 9 THEN CAST(substr(dg, i, 1) AS INTEGER) * 2 - 9 ELSE CAST(substr(dg, i, 1) AS INTEGER) * 2 END ELSE CAST(substr(dg, i, 1) AS INTEGER) END)) % 10"
FALSE_HITS = f"""SELECT doc_id, 'false_positive' AS issue_type, pii_type, text FROM (SELECT *, reverse(regexp_replace(text, '[^0-9]', '', 'g')) AS dg FROM plan)
    WHERE (pii_type = 'CREDIT_CARD' AND {LUHN} <> 0) OR (pii_type = 'IP_ADDRESS' AND len(list_filter(string_split(text, '.'), lambda o: CAST(o AS INTEGER) > 255)) > 0)
    OR (pii_type = 'SSN' AND (regexp_matches(text, '^(000|666|9)') OR text LIKE '%-00-%' OR text LIKE '%-0000'))"""
HIGHS, MEDIUMS = (", ".join(quote(t) for t in ts) for ts in (dims.HIGH_TYPES, dims.MEDIUM_TYPES))
AFTER = "(SELECT doc_id, 0 AS page_num, masked_text AS text FROM weak)"


@query(
    "qa_audit",
    f"""WITH found AS MATERIALIZED (SELECT * FROM {FOUND} WHERE confidence >= 0.95), plan AS MATERIALIZED (SELECT *, {strategy_sql('pii_type')} AS strategy FROM {dedup_sql('found')}),
    weak AS MATERIALIZED (SELECT doc_id, text, masked_text FROM {MASKED.replace(PLAN, 'plan')}),
    missed AS (SELECT e.doc_id, 'missed_pii' AS issue_type, e.pii_type, e.text FROM {entities_sql(AFTER, CUSTOM)} e JOIN weak w ON e.doc_id = w.doc_id WHERE e.confidence >= 0.8 AND contains(w.text, e.text)),
    partly AS (SELECT p.doc_id, 'masking_error' AS issue_type, p.pii_type, p.text FROM plan p JOIN weak w ON p.doc_id = w.doc_id WHERE contains(w.masked_text, p.text)),
    wrong AS ({FALSE_HITS})
    SELECT DISTINCT doc_id, issue_type, pii_type, text, CASE WHEN pii_type IN ({HIGHS}) THEN 'high' WHEN pii_type IN ({MEDIUMS}) THEN 'medium' ELSE 'low' END AS severity, 'pending' AS status
    FROM (SELECT * FROM missed UNION ALL SELECT * FROM partly UNION ALL SELECT * FROM wrong)""",
)
def qa_audit(spark, sf):
    """Audit of a masking run that only used the surest patterns, so that something is left to find."""
    return audit.issues(mask.protect(docs(spark, sf), CUSTOM, min_confidence=0.95), CUSTOM, 0.8)


def rounds_sql() -> str:
    """Three rounds of plan, mask and audit; the first without anything missed is the last that counts."""
    parts, texts = [], DOCS
    for k in (1, 2, 3):
        parts.append(f"""p{k} AS MATERIALIZED (SELECT *, {strategy_sql('pii_type')} AS strategy FROM {dedup_sql(entities_sql(texts, CUSTOM))}),
        c{k} AS MATERIALIZED (SELECT * FROM {masked_sql(texts, f'p{k}')}),
        t{k} AS MATERIALIZED (SELECT doc_id, 0 AS page_num, masked_text AS text FROM c{k}),
        m{k} AS MATERIALIZED (SELECT e.doc_id, count(DISTINCT (e.pii_type, e.text)) AS n FROM {entities_sql(f't{k}', CUSTOM)} e JOIN {DOCS} d ON e.doc_id = d.doc_id WHERE contains(d.text, e.text) GROUP BY 1)""")
        texts = f"t{k}"
    used = "CASE WHEN (SELECT count(*) FROM m1) = 0 THEN 1 WHEN (SELECT count(*) FROM m2) = 0 THEN 2 ELSE 3 END"
    rows = " UNION ALL ".join(
        f"SELECT c{k}.doc_id, c{k}.masked_text, {' + '.join(f'c{j}.n_masked' for j in range(1, k + 1))} AS n_masked, coalesce(m{k}.n, 0) AS n_left, {k} AS rounds FROM c{k} "
        + " ".join(f"JOIN c{j} ON c{j}.doc_id = c{k}.doc_id" for j in range(1, k)) + f" LEFT JOIN m{k} ON m{k}.doc_id = c{k}.doc_id"
        for k in (1, 2, 3)
    )
    return f"""WITH {', '.join(parts)} SELECT doc_id, sha256(masked_text) AS masked_sha, CAST(n_masked AS BIGINT) AS n_masked, n_left, n_left = 0 AS approved, rounds
        FROM ({rows}) WHERE rounds = {used}"""


@query("qa_loop", rounds_sql())
def qa_loop(spark, sf):
    """Mask, audit and mask again until nothing is missed, three rounds at most; what is left is counted."""
    out, rounds = audit.qa_loop(docs(spark, sf).select("doc_id", "text"), CUSTOM)
    return out.select("doc_id", F.sha2("masked_text", 256).alias("masked_sha"), "n_masked", "n_left", "approved", F.lit(rounds).alias("rounds"))


WORD = "regexp_extract(text, '[A-Za-z]+', 0)"
DERIVED["doc_answers"] = f"""SELECT doc_id, CAST(0 AS INT) AS page_num, CAST(0 AS INT) AS chunk_idx, CAST(0 AS BIGINT) AS chunk_offset, text AS chunk,
    '[{{"text": "' || {WORD} || '", "pii_type": "PERSON", "confidence": 0.9, "suggested_strategy": "mask"}}, {{"text": "' || {WORD} || '", "pii_type": "ORG"}}]' AS response
    FROM {{documents}} WHERE {WORD} <> ''"""


@query(
    "protect_all_sources",
    f"""WITH e AS MATERIALIZED (SELECT doc_id, page_num, CAST(ord AS BIGINT) AS ord, pii_type, text, confidence, CAST(NULL AS VARCHAR) AS strategy FROM {FOUND}
        UNION ALL SELECT doc_id, 0, 4503599627370496 + i, t, {WORD}, c, s FROM {DOCS}, (VALUES (0, 'PERSON', 0.9, 'mask'), (1, 'ORG', 0.8, NULL)) v(i, t, c, s) WHERE {WORD} <> ''),
    plan AS MATERIALIZED (SELECT doc_id, page_num, ord, pii_type, text, coalesce(strategy, {strategy_sql('pii_type')}) AS strategy FROM {dedup_sql('e')})
    SELECT doc_id, sha256(masked_text) AS masked_sha, n_masked FROM {masked_sql(DOCS, 'plan')}""",
)
def protect_all_sources(spark, sf):
    """Patterns and model answers in one plan; a suggested strategy wins over the rule."""
    from veil.plans.jobs import protect_all

    out = protect_all(docs(spark, sf), CUSTOM, responses=derived(spark, sf, "doc_answers"))
    return out.select("doc_id", F.sha2("masked_text", 256).alias("masked_sha"), "n_masked")
