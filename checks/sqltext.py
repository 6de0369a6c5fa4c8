"""Pieces of check SQL (DuckDB) that several queries share."""

from __future__ import annotations

import re

from veil.functions import dims
from veil.functions.patterns import REGISTRY
from veil.functions.text import SPACE

# RE2 knows only ASCII word boundaries: letters outside ASCII become "_" where patterns run.
PLAIN = r"regexp_replace({t}, '[^\x00-\x7F\P{{L}}]', '_', 'g')"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(regex: str, any_digit: bool = False) -> str:
    digit, space = (r"\p{Nd}" if any_digit else "0-9"), SPACE[1:-1]
    out = regex.replace(r"(?=\w)", r"\b")
    out = re.sub(r"\[[^\]]*\]", lambda m: m.group(0).replace(r"\d", digit).replace(r"\s", "\0"), out)
    return out.replace(r"\d", f"[{digit}]").replace(r"\s", f"[{space}]").replace("\0", space)


def spans_sql(source: str, registry, keys=("doc_id", "page_num")) -> str:
    """rank, i (1-based), kind, start, end, text, confidence per match of every pattern."""
    k = ", ".join(keys)
    parts = []
    for rank, p in enumerate(registry):
        rx = quote(re2(p.regex, p.any_digit))
        parts.append(f"""
        SELECT {k}, {rank} AS rank, {quote(p.kind)} AS kind, CAST({p.confidence} AS DOUBLE) AS confidence, g AS i, text AS whole,
            CAST(list_sum(list_transform(s[1:g], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:g], lambda x: length(x))), 0) - length(v[g]) AS INTEGER) AS "start",
            length(v[g]) AS n
        FROM (SELECT {k}, text, regexp_extract_all(nt, {rx}, 0) AS m, regexp_extract_all(nt, {rx}, {p.group}) AS v, regexp_split_to_array(nt, {rx}) AS s
              FROM src WHERE regexp_matches(nt, {rx})) q, unnest(generate_series(1, len(m))) AS u(g)""")
    body = " UNION ALL ".join(parts)
    return f"""(WITH src AS MATERIALIZED (SELECT {k}, text, {PLAIN.format(t='text')} AS nt FROM {source})
        SELECT {k}, rank, i, kind, "start", CAST("start" + n AS INTEGER) AS "end", substr(whole, "start" + 1, n) AS text, confidence FROM ({body}))"""


def entities_sql(source: str, registry=REGISTRY) -> str:
    return f"""(SELECT doc_id, page_num, CAST(row_number() OVER (PARTITION BY doc_id, page_num ORDER BY rank, i) - 1 AS INTEGER) AS ord,
        kind AS pii_type, text, "start", "end", confidence, 'REGEX' AS source FROM {spans_sql(source, registry)})"""


DOCS = f"(SELECT doc_id, 0 AS page_num, text FROM documents WHERE regexp_matches(text, {quote('[^' + SPACE[1:-1] + ']')}))"
TURNS = f"(SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_num, text FROM conversations WHERE regexp_matches(text, {quote('[^' + SPACE[1:-1] + ']')}))"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, {quote(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def squeeze_sql(c: str) -> str:
    return strip_sql(f"regexp_replace({c}, {quote(f'{SPACE}+')}, ' ', 'g')")


def lookup_sql(column: str, table: dict, default: str) -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {v if isinstance(v, int) else quote(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def priority_sql(column: str) -> str:
    return lookup_sql(column, dims.PRIORITY, "0")


def strategy_sql(column: str) -> str:
    return lookup_sql(column, dims.STRATEGY, "'redact'")


def category_sql(column: str) -> str:
    return lookup_sql(column, dims.CATEGORY, "'others'")


def dedup_sql(source: str) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, lower({strip_sql('text')})
        ORDER BY {priority_sql('pii_type')} DESC, confidence DESC, ord) AS rn FROM {source}) WHERE rn = 1)"""


def pool_sql(pool) -> str:
    return "[" + ", ".join(quote(p) for p in pool) + "]"


def hash_sql(value: str, salt: str = "", start: int = 1) -> str:
    return f"CAST('0x' || substr(sha256({quote(salt)} || {value}), {start}, 8) AS BIGINT)"


def pick_sql(pool, value: str, salt: str = "", start: int = 1) -> str:
    return f"{pool_sql(pool)}[{hash_sql(value, salt, start)} % {len(pool)} + 1]"


def digits_sql(value: str, salt: str = "") -> str:
    return f"translate(sha256({quote(salt)} || {value}), 'abcdef', '012345')"


def replace_digits_sql(text: str) -> str:
    return f"""array_to_string(list_transform(range(1, length({text}) + 1), lambda i: CASE WHEN substr({text}, i, 1) BETWEEN '0' AND '9'
        THEN substr({digits_sql(text)}, (i - 1) % 64 + 1, 1) ELSE substr({text}, i, 1) END), '')"""


def person_sql(text: str) -> str:
    from veil.functions import hashing as H

    parts = f"string_split({squeeze_sql(text)}, ' ')"
    last = pick_sql(H.LAST_NAMES, f"{parts}[2]")
    return f"""CASE WHEN len({parts}) = 2 THEN {pick_sql(H.FIRST_NAMES, f'{parts}[1]')} || ' ' || {last}
        ELSE array_to_string(list_transform({parts}, lambda p: {pick_sql(H.FIRST_NAMES, 'p')}), ' ') END"""


def pseudonym_sql(pii_type: str, text: str) -> str:
    from veil.functions import hashing as H
    from veil.functions import pseudo as P

    low = f"lower({text})"
    return f"""CASE WHEN {pii_type} = 'PERSON' THEN {person_sql(text)}
        WHEN {pii_type} IN ('LOC', 'ADDRESS') AND regexp_matches({low}, '{P.STREET_WORDS}') THEN {pick_sql(H.ADDRESSES, text)}
        WHEN {pii_type} IN ('LOC', 'ADDRESS') AND regexp_matches({low}, '{P.CITY_WORDS}') THEN {pick_sql(H.CITIES, text)}
        WHEN {pii_type} IN ('LOC', 'ADDRESS') AND regexp_matches({low}, '{P.UNIT_WORDS}') THEN {pick_sql(H.APT_TYPES, text)}
        WHEN {pii_type} IN ('LOC', 'ADDRESS') THEN {pick_sql(H.LOCATIONS, text)}
        WHEN {pii_type} = 'ORG' THEN {pick_sql(H.ORGANIZATIONS, text)}
        WHEN {pii_type} IN ('PHONE', 'CREDIT_CARD', 'SSN', 'BANK_ACCOUNT') THEN {replace_digits_sql(text)}
        ELSE {pick_sql(H.MISC_LABELS, text)} END"""


def replacement_sql(strategy: str, pii_type: str, text: str) -> str:
    return f"""CASE {strategy} WHEN 'redact' THEN '[REDACTED]' WHEN 'mask' THEN repeat('*', length({text}))
        WHEN 'pseudo' THEN {pseudonym_sql(pii_type, text)} ELSE '[UNKNOWN_STRATEGY]' END"""


def items_sql(plan: str) -> str:
    """doc_id, items: fold items longest first, then in plan order."""
    return f"""(SELECT doc_id, list({{'t': text, 'r': repl, 's': strategy}} ORDER BY length(text) DESC, ord) AS items
        FROM (SELECT doc_id, ord, text, strategy, {replacement_sql('strategy', 'pii_type', 'text')} AS repl FROM {plan}) GROUP BY doc_id)"""


def fold_sql(text: str, items: str) -> str:
    """Struct (t, masked, failed, redact, mask, pseudo) after applying the items in order."""
    n = "CAST((length(a.t) - length(replace(a.t, i.t, ''))) / length(i.t) AS BIGINT)"
    start = f"{{'t': {text}, 'masked': 0::BIGINT, 'failed': 0::BIGINT, 'redact': 0::BIGINT, 'mask': 0::BIGINT, 'pseudo': 0::BIGINT, 'r': '', 's': ''}}"
    elems = f"list_transform({items}, lambda i: {{'t': i.t, 'masked': 0::BIGINT, 'failed': 0::BIGINT, 'redact': 0::BIGINT, 'mask': 0::BIGINT, 'pseudo': 0::BIGINT, 'r': i.r, 's': i.s}})"
    return f"""list_reduce({elems}, lambda a, i: {{
        't': CASE WHEN contains(a.t, i.t) THEN replace(a.t, i.t, i.r) ELSE a.t END,
        'masked': a.masked + CASE WHEN contains(a.t, i.t) THEN {n} ELSE 0 END,
        'failed': a.failed + CASE WHEN contains(a.t, i.t) THEN 0 ELSE 1 END,
        'redact': a.redact + CASE WHEN i.s = 'redact' THEN {n} ELSE 0 END,
        'mask': a.mask + CASE WHEN i.s = 'mask' THEN {n} ELSE 0 END,
        'pseudo': a.pseudo + CASE WHEN i.s = 'pseudo' THEN {n} ELSE 0 END, 'r': '', 's': ''}}, {start})"""


def masked_sql(texts: str, plan: str) -> str:
    """doc_id, text, masked_text and counters for one-row documents."""
    return f"""(SELECT doc_id, text, f.t AS masked_text, f.masked AS n_masked, f.failed AS n_failed, f.redact AS n_redact, f.mask AS n_mask, f.pseudo AS n_pseudo
        FROM (SELECT d.doc_id, d.text, {fold_sql('d.text', 'coalesce(p.items, [])')} AS f FROM {texts} d LEFT JOIN {items_sql(plan)} p ON d.doc_id = p.doc_id))"""
