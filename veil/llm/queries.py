"""One query per operator, over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm import bpe, chat, leaks, minhash, ngrams, quality, repair, repeats, search, secrets, tokens, urls, warc
from veil.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return add


@query("op1_warc_archives", """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits FROM p),
e AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT)
   + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
   + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM m""")
def op1(spark, sf_dir):
    rows = warc.warc_archives(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query("op2_url_filters", r"""
WITH r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
f AS (SELECT page_id, max(struct_pack(n := length(rh || rp), v := v, r := rh || rp)) AS best
  FROM c JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT c.page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM c LEFT JOIN f USING (page_id)""")
def op2(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


@query("op3_quality_rules")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op4_token_counts")
def op4(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), path)
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op5_lm_scoring")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = ngrams.train(docs.where(~ngrams.held_out(docs.doc_id)))
    rows = ngrams.score(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))
    out = rows.withColumn("held_out", ngrams.held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def secret_sql() -> str:
    """Spans by the same patterns: the texts between matches give the places."""
    parts, columns = [], []
    for number, kind in enumerate(secrets.KINDS):
        pattern = "'" + kind.pattern.replace("'", "''") + "'"
        parts.append(f"""SELECT doc_id, source, text, {number} AS k, '{kind.name}' AS kind, i,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s,
  length(m[i]) AS size, v[i] AS v FROM (SELECT doc_id, source, text, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT doc_id, source, text, regexp_extract_all(text, {pattern}) AS m, regexp_extract_all(text, {pattern}, {kind.value}) AS v,
  string_split_regex(text, {pattern}) AS g FROM d)) WHERE length(v[i]) >= {kind.least}""")
    for kind in secrets.BASE:
        columns.append(f"count(*) FILTER (kind = '{kind.name}') AS n_{kind.name}")
    return f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
s AS ({' UNION ALL '.join(parts)}),
u AS (SELECT v, md5(text) AS copy, min(doc_id::VARCHAR) AS repository FROM s GROUP BY v, copy),
n AS (SELECT v, count(DISTINCT repository) AS repositories FROM u GROUP BY v),
o AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners FROM s GROUP BY v),
t AS (SELECT s.*, owners, repositories, owners <= {secrets.FEW_OWNERS} AND repositories <= {secrets.FEW_REPOSITORIES} AS live
  FROM s JOIN o USING (v) JOIN n USING (v)),
r AS (SELECT doc_id, {', '.join(columns)},
  string_agg(kind || ':' || s || ':' || (s + size), ',' ORDER BY s, k) FILTER (k < {len(secrets.BASE)}) AS base,
  string_agg(kind || ':' || s || ':' || (s + size), ',' ORDER BY s, k) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(owners) AS owners, max(repositories) AS repositories
  FROM t GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k.name}, 0) AS n_{k.name}' for k in secrets.BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_example, 0) AS n_example, coalesce(owners, 0) AS n_owners, coalesce(repositories, 0) AS n_repositories
  FROM d LEFT JOIN r USING (doc_id)"""


@query("op6_secret_scans", secret_sql())
def op6(spark, sf_dir):
    rows = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind < len(secrets.BASE))
    counts = [
        F.size(F.array_remove(F.transform("spans.kind", lambda k: k == number), False)).cast("bigint").alias(f"n_{kind.name}")
        for number, kind in enumerate(secrets.BASE)
    ]
    return rows.select(
        "doc_id", *counts, F.sha2(secrets.named(base), 256).alias("base_sha256"),
        secrets.named(F.col("spans")).alias("spans"), "n_live", "n_example",
        *[F.coalesce(F.array_max(F.col(f"judged.{n}")), F.lit(0)).cast("bigint").alias(n) for n in ("n_owners", "n_repositories")],
    )


@query("op7_byte_bpe")
def op7(spark, sf_dir):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.recoded(table(spark, sf_dir, "documents"), path, pattern)
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_substring_dedup", r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t)),
m AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h),
c AS (SELECT doc_id, list(i) AS hits FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (h) WHERE low < doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n, CASE WHEN hits IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(hits, j)) END AS left_
  FROM t LEFT JOIN c USING (doc_id))
SELECT doc_id, n AS n_words, n - len(left_) AS n_removed, sha256(array_to_string(left_, ' ')) AS kept_sha256 FROM k""")
def op8(spark, sf_dir):
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_benchmark_decontamination")
def op9(spark, sf_dir):
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_minhash_dedup", r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
  ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM t),
k AS (SELECT md5(CAST(list_sort(g) AS VARCHAR)) AS c, min(doc_id) AS rep, len(any_value(g)) AS n, any_value(list_sort(g)) AS h
  FROM s WHERE len(g) > 0 GROUP BY c),
p AS (SELECT rep, n, unnest(h) AS x FROM k),
e AS (SELECT a.rep AS u, b.rep AS v FROM p a JOIN p b ON a.x = b.x AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(u, v) AS (SELECT rep, rep FROM k UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
m AS (SELECT u AS rep, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, len(s.g) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM s LEFT JOIN k ON md5(CAST(list_sort(s.g) AS VARCHAR)) = k.c AND len(s.g) > 0 LEFT JOIN m USING (rep)""")
def op10(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


CRC_OF_KEYS = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) % 20 AS fate FROM conversations, crc)"""


@query("op11_conversation_repair", f"""
WITH RECURSIVE {CRC_OF_KEYS},
i AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
d AS (SELECT g, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h JOIN i ON h.conv_id IS NOT DISTINCT FROM i.conv_id WHERE fate <> 0),
k AS MATERIALIZED (SELECT g, turn, role, text, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare,
  row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, md5(role || chr(10) || text)) AS k FROM d),
f AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS r, lag(role) OVER (PARTITION BY g ORDER BY k) AS before, CASE WHEN bare = '' THEN 'blank'
  WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY k) > 1 THEN 'duplicate'
  WHEN suffix(bare, '.') OR suffix(bare, '!') OR suffix(bare, '?') THEN '' ELSE 'truncated' END AS fault FROM k),
ins(s, c, e, t) AS (VALUES (0, 0, '', 0), (0, 5, 'I', 2), (0, 10, 'II', 3), (1, 0, '', 1), (1, 5, 'I', 2), (1, 10, 'II', 3),
  (2, 0, '', 2), (2, 5, 'I', 3), (3, 0, '', 3), (3, 5, 'I', 2)),
act(s, r, c, e, t) AS (VALUES (0, 's', 0, 'K', 1), (0, 'u', 0, 'K', 2), (1, 'u', 0, 'K', 2), (3, 'u', 0, 'K', 2), (2, 'a', 0, 'K', 3),
  (0, NULL, 1, 'R', 2), (1, NULL, 1, 'R', 2), (2, NULL, 1, 'R', 3), (3, NULL, 1, 'R', 2),
  (0, NULL, 2, 'D', 0), (1, NULL, 2, 'D', 1), (2, NULL, 2, 'D', 2), (3, NULL, 2, 'D', 3)),
w(g, k, s, best) AS (SELECT DISTINCT g, 0::BIGINT, 0, struct_pack(c := 0, e := '') FROM f UNION ALL
  SELECT w.g, f.k, act.t, min(struct_pack(c := w.best.c + ins.c + act.c + CASE WHEN fault = 'truncated' AND act.e <> 'D' THEN 5 ELSE 0 END,
    e := w.best.e || ins.e || act.e)) FROM w JOIN ins ON ins.s = w.s JOIN f ON f.g = w.g AND f.k = w.k + 1
  JOIN act ON act.s = ins.t AND (act.r IS NULL OR act.r = f.r) AND (act.e = 'D' OR fault NOT IN ('blank', 'duplicate')) GROUP BY w.g, f.k, act.t),
n AS (SELECT g, max(k) AS n FROM f GROUP BY g),
e AS (SELECT w.g, min(struct_pack(c := best.c + CASE w.s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END,
  e := best.e || CASE w.s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END)) AS best FROM w JOIN n ON n.g = w.g AND n.n = w.k GROUP BY w.g),
p AS (SELECT g, substr(a, j, 1) AS x, length(replace(substr(a, 1, j), 'I', '')) AS at, length(replace(substr(a, 1, j), 'D', '')) AS p
  FROM (SELECT g, best.e AS a, unnest(range(1, length(best.e) + 1)) AS j FROM e)),
q AS (SELECT p.g, p, x, role, CASE WHEN x = 'I' THEN '' ELSE text END AS text, max(CASE WHEN p = 1 AND x = 'K' AND r = 's' THEN 1 ELSE 0 END)
  OVER (PARTITION BY p.g) AS led FROM p LEFT JOIN f ON f.g = p.g AND f.k = p.at WHERE x <> 'D'),
o AS (SELECT g, string_agg(CASE WHEN x = 'K' THEN role WHEN (p - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS body
  FROM q GROUP BY g),
c AS (SELECT g, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND substr(before, 1, 1) || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM i LEFT JOIN c USING (g) LEFT JOIN e USING (g) LEFT JOIN o USING (g)""")
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    found = repair.digests(repair.repaired(repair.damaged(rows))).withColumnRenamed("conv_id", "found_id")
    ids = rows.select("conv_id").distinct()
    zero = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return ids.join(found, ids.conv_id.eqNullSafe(found.found_id), "left").select(
        "conv_id", *[F.coalesce(c, zero.get(c, F.lit(0))).alias(c) for c in (*repair.COUNTS, "audit", "repaired_sha256")]
    )


@query("op12_ranked_search", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT r, doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM n) GROUP BY r, t),
q AS (SELECT item_id, text, t, count(*) AS times FROM (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text,
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t,
  unnest(range(length(text))) AS i FROM benchmark) WHERE t IS NOT NULL GROUP BY item_id, text, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
v AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM f, c),
m AS (SELECT r, doc_id, 75 + (25 * n * docs) // terms AS m FROM n, c),
s AS (SELECT item_id, q.text, m.r, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN v USING (t) JOIN p USING (t) JOIN m ON m.r = p.r GROUP BY item_id, q.text, m.r),
k AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20""")
def op12(spark, sf_dir):
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_chat_formatting", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(10) || text)) AS k FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + len(regexp_extract_all(role, '[\\\n<\[]')) + 1 + length(text)
   + len(regexp_extract_all(text, '<\\*\|im_(?:start|end)\|>|<\\*/?s>|\[\\*/?INST\]')) + 11)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id""")
def op13(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.formatted(turns.unionByName(own)))
