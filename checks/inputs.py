"""Inputs derived from the given tables; every one grows with its table."""

from __future__ import annotations

from checks.base import DERIVED, case
from veil.functions import dims


def d(width: int, expression: str) -> str:
    return f"lpad(CAST({expression} AS STRING), {width}, '0')"


K = "c_custkey"
FIRST = case(K, "'Aaron'", "'Maria'", "'John'", "'Wei'", "'Fatima'", "'Lars'", "'Priya'")
LAST = case(f"({K} + 3)", "'Mehta'", "'Clarke'", "'Novak'", "'Okafor'", "'Silva'")
ADDRESS = f"CAST({K} % 900 + 1 AS STRING) || ' ' || {case(K, chr(39)+'Oak'+chr(39), chr(39)+'Maple Hill'+chr(39), chr(39)+'Cedar'+chr(39))} || ' ' || {case(f'({K} + 1)', chr(39)+'Street'+chr(39), chr(39)+'Avenue'+chr(39), chr(39)+'Road'+chr(39))}"
SSN = f"{d(3, f'{K} % 900 + 100')} || '-' || {d(2, f'{K} % 90 + 10')} || '-' || {d(4, f'{K} % 9000 + 1000')}"
PHONE = f"'+1 (' || {d(3, f'{K} % 800 + 200')} || ') 555-' || {d(4, f'{K} % 10000')}"
EMAIL = f"lower({FIRST}) || CAST({K} AS STRING) || '@example.org'"
CARD = f"{d(4, f'{K} % 9000 + 1000')} || '-' || {d(4, f'{K} % 8000 + 1000')} || '-' || {d(4, f'{K} % 7000 + 1000')} || '-' || {d(4, f'{K} % 6000 + 1000')}"

# Four pages per document, one sentence per kind of identifier.
SENTENCES = [
    f"'Client ' || {FIRST} || ' ' || {LAST} || ', born on ' || CAST({K} % 12 + 1 AS STRING) || '/' || CAST({K} % 28 + 1 AS STRING) || '/1980, SSN ' || {SSN} || '.\n'",
    f"'write to ' || {EMAIL} || ' or call ' || {PHONE} || ', card ' || {CARD} || '.\n'",
    f"'record MRN-' || {d(6, f'{K} % 1000000')} || ', badge EMP-' || {d(4, f'{K} % 10000')} || '-' || {d(4, f'{K} * 7 % 10000')} || ', policy INS-' || {d(2, f'{K} % 100')} || '-' || {d(6, f'{K} * 3 % 1000000')} || '-' || {d(4, f'{K} % 10000')} || '.\n'",
    f"'lot VAX-' || {d(4, f'{K} % 10000')} || '-' || {d(4, f'{K} * 3 % 10000')} || ', receipt RN-' || {d(4, f'{K} % 10000')} || '-' || {d(6, f'{K} * 11 % 1000000')} || ', code VOL-' || {d(2, f'{K} % 100')} || '-' || {d(3, f'{K} % 1000')} || ', parcel TRK-' || {d(10, f'{K} * 17')} || '.\n'",
    f"'tax ABCDE' || {d(4, f'{K} % 10000')} || 'F, id ' || {d(4, f'{K} % 10000')} || ' ' || {d(4, f'{K} * 3 % 10000')} || ' ' || {d(4, f'{K} * 7 % 10000')} || ', passport no. P' || {d(7, f'{K} * 13')} || ', account number ' || {d(10, f'{K} * 19')} || '.\n'",
    f"'host 10.' || CAST({K} % 256 AS STRING) || '.0.' || CAST({K} * 3 % 256 AS STRING) || ' at 00:1A:2B:3C:4D:' || {d(2, f'{K} % 100')} || ', see https://example.org/u/' || CAST({K} AS STRING) || ' near 40.712' || CAST({K} % 10 AS STRING) || ', -74.006' || CAST({K} % 10 AS STRING) || '.\n'",
    f"'lives at ' || {ADDRESS} || ', Springfield, IL ' || {d(5, f'{K} % 90000 + 10000')} || ', works for Acme Trading Inc, paid $' || CAST({K} % 900 + 1 AS STRING) || ',' || {d(3, f'{K} % 1000')} || '.50 in 1999, barcode ' || {d(13, f'{K} * 23')} || '.\n'",
]
DERIVED["pii_corpus"] = f"""SELECT CAST(floor({K} / 4) AS BIGINT) AS doc_id, CAST({K} % 4 AS INT) AS page_num,
    {' || '.join(SENTENCES)} AS text FROM {{customer}}"""

ALL_TYPES = [*dims.PRIORITY, "ORGANISATIONS", "UNLISTED"]
O = "o_orderkey"
# Detector output: repeats of a text in other spelling, several types per text, ties.
DERIVED["entities"] = f"""SELECT o_custkey AS doc_id, CAST({O} % 3 AS INT) AS page_num, CAST({O} AS INT) AS ord,
    {case(O, *[f"'{t}'" for t in ALL_TYPES])} AS pii_type,
    CASE WHEN {O} % 5 = 0 THEN ' VALUE ' || CAST({O} % 7 AS STRING) || ' ' ELSE 'Value ' || CAST({O} % 7 AS STRING) END AS text,
    CAST({O} % 97 AS INT) AS "start", CAST({O} % 97 + 7 AS INT) AS "end",
    CAST({O} % 50 AS DOUBLE) / 100 + 0.5 AS confidence, 'REGEX' AS source FROM {{orders}}"""
DERIVED["mask_plan"] = f"""SELECT o_custkey AS doc_id, 'pii_' || CAST({O} AS STRING) AS pii_id, CAST({O} % 3 AS INT) AS page_num, CAST({O} AS INT) AS ord,
    {case(O, *[f"'{t}'" for t in ALL_TYPES])} AS pii_type, 'Value:' || CAST({O} % 1000 AS STRING) AS text,
    {case(f'({O} + 1)', "'redact'", "'mask'", "'pseudo'")} AS strategy,
    CAST({O} % 400 AS DOUBLE) + 0.25 AS x0, CAST({O} % 700 AS DOUBLE) + 0.5 AS y0,
    CAST({O} % 400 AS DOUBLE) + 40.75 AS x1, CAST({O} % 700 AS DOUBLE) + 12.0 AS y1 FROM {{orders}}"""
DERIVED["ner_raw"] = f"""SELECT o_custkey AS doc_id, CAST({O} % 3 AS INT) AS page_num, CAST({O} AS INT) AS ord,
    {case(O, "'PER'", "'ORG'", "'LOC'", "'MISC'", "'DATE'")} AS entity_group,
    {case(f'({O} + 2)', "'##ing'", "'Al'", "' Oslo '", "'America'", "'Pan'", "'Mehta'", "'Zürich'", "'Investment'", "'NewCo'", "'Fatima'", "' us '")} AS word,
    CAST({O} % 100 AS DOUBLE) / 100 AS score, CAST({O} % 97 AS INT) AS "start", CAST({O} % 97 + 7 AS INT) AS "end" FROM {{orders}}"""
DERIVED["registry"] = f"""SELECT 'doc' || CAST({O} % 5000 AS STRING) AS document_id, 'user' || CAST(o_custkey AS STRING) AS user_id,
    'File_' || CAST({O} AS STRING) || {case(O, "'.pdf'", "'.docx'", "'.txt'", "'.TXT'")} AS original_name,
    {case(O, "'.pdf'", "'.docx'", "'.txt'", "'.txt'", "CAST(NULL AS STRING)")} AS file_type,
    CAST({O} * 37 % 100000000 AS BIGINT) AS file_size,
    {case(f'({O} * 7 % 11)', "'uploaded'", "'masked'", "'uploaded'", "'masked'", "'ocr_processed'")} AS status,
    o_orderdate AS upload_date, {O} AS row_id FROM {{orders}}"""
DERIVED["jobs"] = """SELECT 'job' || CAST(event_id AS STRING) AS job_id, 'user' || CAST(user_id AS STRING) AS user_id,
    CAST(event_id % 10 + 1 AS INT) AS num_datasets,
    CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'processing' ELSE 'completed' END AS status,
    ts AS created_at, event_id FROM {events}"""
