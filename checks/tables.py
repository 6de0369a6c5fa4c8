"""Table sets: links, classification, stand-ins, preserved joins; registry, reports and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from checks.base import DERIVED, case, derived, query, table
from checks.inputs import O
from checks.sqltext import hash_sql, pool_sql, quote
from veil.functions import dims, hashing, pseudo
from veil.operators import report, tables
from veil.plans import jobs
from veil.session import cut_lineage, shared_path
from veil.sources import mapping_store

TABLES = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}


def table_set(spark, sf):
    return {t: table(spark, sf, t) for t in TABLES}


CELLS = " UNION ALL ".join(
    f"SELECT DISTINCT '{t}.{c}' AS column_id, CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL" for t, cs in TABLES.items() for c in cs
)
PAIRS = f"""cells AS MATERIALIZED ({CELLS}), sizes AS (SELECT column_id, count(*) AS n FROM cells GROUP BY 1),
    shared AS (SELECT a.column_id AS a, b.column_id AS b, count(*) AS n_shared FROM cells a JOIN cells b ON a.value = b.value AND a.column_id < b.column_id
        WHERE split_part(a.column_id, '.', 1) <> split_part(b.column_id, '.', 1) AND split_part(a.column_id, '.', 2) <> split_part(b.column_id, '.', 2) GROUP BY 1, 2),
    pairs AS (SELECT s.a, s.b, s.n_shared, least(x.n, y.n) AS n_smaller FROM shared s JOIN sizes x ON s.a = x.column_id JOIN sizes y ON s.b = y.column_id WHERE s.n_shared / least(x.n, y.n) >= 0.2)"""


@query("src_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(DISTINCT {cs[0]}) AS n_keys FROM {t}" for t, cs in TABLES.items()))
def src_tables(spark, sf):
    """Every table of the set, counted."""
    parts = [
        d.groupBy(TABLES[t][0]).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys")).select(F.lit(t).alias("table_name"), "n_rows", "n_keys")
        for t, d in table_set(spark, sf).items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("column_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def column_pairs(spark, sf):
    return tables.column_pairs(table_set(spark, sf))


def synth_sql(subtype: str, value: str, unique: bool = False) -> str:
    H = hashing
    sha, num = f"sha256({value})", f"translate(sha256({value}), 'abcdef', '012345')"
    a, b = hash_sql(value), hash_sql(value, "", 9)

    def pool(names, h):
        return f"{pool_sql(names)}[{h} % {len(names)} + 1]"

    tail = f" || '-' || substr({sha}, 9, 24)" if unique else ""
    mail = f" || '.' || substr({sha}, 9, 24)" if unique else ""
    call = f" || ' x' || substr({num}, 9, 32)" if unique else ""
    return f"""CASE WHEN {subtype} = 'name' THEN {pool(H.FIRST_NAMES, a)} || ' ' || {pool(H.LAST_NAMES, b)}{tail}
        WHEN {subtype} = 'email' THEN lower({pool(H.FIRST_NAMES, a)}) || '.' || lower({pool(H.LAST_NAMES, b)}) || substr({num}, 17, 4){mail} || '@example.com'
        WHEN {subtype} IN ('phone', 'phone_number') THEN '555-' || substr({num}, 1, 3) || '-' || substr({num}, 4, 4){call}
        WHEN {subtype} IN ('ssn', 'national_id') THEN substr({num}, 1, 3) || '-' || substr({num}, 4, 2) || '-' || substr({num}, 6, 4){tail}
        WHEN {subtype} = 'address' THEN {pool(H.ADDRESSES, a)} || ', ' || {pool(H.CITIES, b)}{tail}
        WHEN {subtype} IN ('date_of_birth', 'date') THEN CAST(DATE '1940-01-01' + CAST({a} % 25000 AS INTEGER) AS VARCHAR){tail}
        WHEN {subtype} IN ('medical_record_number', 'medical_condition') THEN 'MRN-' || upper(translate(substr({sha}, 17, 4), '0123456789', 'ghjkmnpqrs')) || '-' || substr({num}, 1, 5){tail}
        WHEN {subtype} IN ('generic_id', 'id', 'account_number') THEN 'ACC-' || substr({num}, 1, 8){tail}
        ELSE {pool(H.WORDS, a)} || '_anon'{tail} END"""


# plain column names, so that names repeat across tables: name, source column
NAMED = {
    "customer": {"cust_id": "c_custkey", "full_name": "c_name", "nation_id": "c_nationkey", "balance": "c_acctbal", "segment": "c_mktsegment"},
    "orders": {"order_id": "o_orderkey", "cust_id": "o_custkey", "status": "o_orderstatus", "total": "o_totalprice", "placed_on": "o_orderdate", "priority": "o_orderpriority"},
    "supplier": {"supp_id": "s_suppkey", "full_name": "s_name", "nation_id": "s_nationkey", "balance": "s_acctbal"},
}


def renamed(spark, sf):
    """Three of the given tables, whole, under plain column names."""
    return {t: table(spark, sf, t).select(*[F.col(c).alias(n) for n, c in names.items()]) for t, names in NAMED.items()}


AMOUNTS = ("balance", "total")


def listed(tables_by_name):
    """All rows of a table set as (table_name, cells); amounts in cents."""
    parts = [
        df.select(F.lit(t).alias("table_name"), F.concat_ws("|", *[
            F.coalesce((F.round(F.col(c) * 100).cast("bigint") if c in AMOUNTS else F.col(c)).cast("string"), F.lit("-")) for c in df.columns
        ]).alias("cells"))
        for t, df in tables_by_name.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def listed_sql(subtypes: dict[str, str]) -> str:
    """The same rows with stand-ins computed in SQL."""

    def cell(name, column):
        if name in subtypes:
            return synth_sql(quote(subtypes[name]), f"CAST({column} AS VARCHAR)", True)
        return f"CAST(CAST(round({column} * 100) AS BIGINT) AS VARCHAR)" if name in AMOUNTS else f"CAST({column} AS VARCHAR)"

    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, concat_ws('|', {', '.join(f"coalesce({cell(n, c)}, '-')" for n, c in names.items())}) AS cells FROM {t}" for t, names in NAMED.items()
    )


COUNTED = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{n}' AS column_name, count(DISTINCT {c}) AS n_values FROM {t}" for t, names in NAMED.items() for n, c in names.items()
)


@query(
    "column_names_link",
    f"SELECT column_name, count(*) AS n_tables, string_agg(table_name, ',' ORDER BY table_name) AS tables, CAST(max(n_values) AS BIGINT) AS most_values FROM ({COUNTED}) GROUP BY column_name HAVING count(*) > 1",
)
def column_names_link(spark, sf):
    """Columns linked by name, with the largest distinct count among them."""
    t = renamed(spark, sf)
    links = tables.same_name_links(tables.column_catalog(t))
    sizes = (
        tables.column_signatures(t).select(F.explode("columns").alias("id"), "n_values").groupBy("id").agg(F.sum("n_values").alias("n"))
        .groupBy(F.substring_index("id", ".", -1).alias("column_name")).agg(F.max("n").alias("most_values"))
    )
    return links.join(sizes, "column_name")


LINKS = f"""WITH RECURSIVE {PAIRS}, edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), nodes AS (SELECT column_id AS node FROM sizes),
    reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
    labels AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
    ranked AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS i FROM labels GROUP BY component HAVING count(*) > 1)"""


@query(
    "link_groups",
    LINKS + " SELECT l.node, coalesce('group_' || r.i, 'col::' || split_part(l.node, '.', 2)) AS group_key FROM labels l LEFT JOIN ranked r ON l.component = r.component",
)
def link_groups(spark, sf):
    t = table_set(spark, sf)
    return tables.group_keys(tables.link_groups(tables.column_catalog(t).select(F.col("column_id").alias("node")), tables.column_pairs(t)))


# --- classification ------------------------------------------------------------------------------

PEOPLE_COLUMNS = ["full_name", "email", "phone_no", "ssn", "dob", "segment", "cust_id", "notes"]
DERIVED["people"] = """SELECT c_custkey AS cust_id, CASE c_custkey % 3 WHEN 0 THEN 'Aaron Mehta' WHEN 1 THEN 'Maria Novak' ELSE 'Wei Silva' END AS full_name,
    'user' || CAST(c_custkey AS STRING) || '@example.org' AS email, '555-010-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS phone_no,
    lpad(CAST(c_custkey % 900 + 100 AS STRING), 3, '0') || '-12-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS ssn,
    CASE WHEN c_custkey % 10 = 0 THEN CAST(NULL AS STRING) ELSE '1980-0' || CAST(c_custkey % 9 + 1 AS STRING) || '-1' || CAST(c_custkey % 9 AS STRING) END AS dob,
    c_mktsegment AS segment, 'Note ' || c_name AS notes FROM {customer}"""
SAMPLE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM people WHERE {c} IS NOT NULL" for c in PEOPLE_COLUMNS
)


def classify_sql() -> str:
    scores = []
    for i, s in enumerate(tables.SUBTYPE_ORDER):
        v = f"round(avg(CAST(regexp_matches(value, {quote(tables.VALUE_RULES[s])}) AS DOUBLE)), 6)" if s in tables.VALUE_RULES else "0.0::DOUBLE"
        n = f"CASE WHEN regexp_matches(lower(column_name), {quote(tables.NAME_RULES[s])}) THEN {tables.NAME_CONFIDENCE}::DOUBLE ELSE 0.0::DOUBLE END"
        scores.append(f"{{'score': -greatest({v}, {n}), 'i': {i}, 'subtype': '{s}'}}")
    return f"""SELECT column_name, CASE WHEN b.score <= -0.5 AND starts_with(b.subtype, 'medical') THEN 'PHI' WHEN b.score <= -0.5 THEN 'PII' ELSE 'NONE' END AS label,
        CASE WHEN b.score <= -0.5 THEN b.subtype ELSE 'other' END AS subtype, CASE WHEN b.score <= -0.5 THEN -b.score ELSE 0.0 END AS confidence, examples
        FROM (SELECT column_name, list_sort([{', '.join(scores)}])[1] AS b, array_to_string(list_sort(list(DISTINCT value))[1:5], '|') AS examples FROM ({SAMPLE}) GROUP BY column_name)"""


@query("column_classify", classify_sql(), ("people",))
def column_classify(spark, sf):
    people = derived(spark, sf, "people")
    return tables.column_classify(tables.column_values({"people": people.select(*PEOPLE_COLUMNS)}))


# --- stand-ins -----------------------------------------------------------------------------------


DERIVED["subtyped"] = f"""SELECT {O} AS id, {case(O, *[f"'{s}'" for s in dims.COLUMN_SUBTYPES])} AS subtype, CASE WHEN {O} % 7 = 0 THEN CAST(NULL AS STRING) ELSE 'v' || CAST(o_custkey AS STRING) END AS value FROM {{orders}}"""


@query(
    "synth_by_subtype",
    f"SELECT id, subtype, CASE WHEN value IS NOT NULL THEN {synth_sql('subtype', 'value')} END AS kept_null, {synth_sql('subtype', chr(99) + 'oalesce(value, ' + chr(39) + '__NULL__' + chr(39) + ')')} AS drawn_null FROM subtyped",
    ("subtyped",),
)
def synth_by_subtype(spark, sf):
    return derived(spark, sf, "subtyped").select(
        "id", "subtype",
        F.expr(pseudo.synth_by_subtype("subtype", "value")).alias("kept_null"),
        F.expr(pseudo.synth_by_subtype("subtype", "coalesce(value, '__NULL__')")).alias("drawn_null"),
    )


@query("anonymize_tables", listed_sql({"cust_id": "generic_id", "full_name": "name"}))
def anonymize_tables(spark, sf):
    """A table set with named columns anonymized, all rows and columns: linked keys stay linked."""
    return listed(jobs.anonymize_set(renamed(spark, sf), {"cust_id": "generic_id", "full_name": "name"}))


KEY_SUBTYPES = ("generic_id", "name", "email", "phone")
LINKED = (("orders", "customer", "o_custkey", "c_custkey"), ("lineitem", "orders", "l_orderkey", "o_orderkey"))


def preserved_sql() -> str:
    parts = []
    for left, right, lk, rk in LINKED:
        for s in KEY_SUBTYPES:
            a, b = (synth_sql(quote(s), f"CAST({k} AS VARCHAR)", True) for k in (lk, rk))
            parts.append(f"""SELECT '{left}-{right}' AS link, '{s}' AS subtype, n AS rows_before, m AS rows_after, n = m AS preserved, least_key FROM
                (SELECT count(*) AS n FROM {left} JOIN {right} ON {lk} = {rk}),
                (SELECT sum(x.n * y.n)::BIGINT AS m FROM (SELECT {a} AS k, n FROM (SELECT {lk}, count(*) AS n FROM {left} GROUP BY 1)) x JOIN (SELECT {b} AS k, n FROM (SELECT {rk}, count(*) AS n FROM {right} GROUP BY 1)) y USING (k)),
                (SELECT min({b}) AS least_key FROM {right})""")
    return " UNION ALL ".join(parts)


@query("fk_preserved", preserved_sql())
def fk_preserved(spark, sf):
    """Join row counts before and after anonymizing both sides of a link, whatever the key is taken for."""
    out = None
    for left, right, lk, rk in LINKED:
        per_key = cut_lineage(tables.key_counts(table(spark, sf, left), table(spark, sf, right), lk, rk))
        before = tables.joined_rows(per_key).scalar()
        for s in KEY_SUBTYPES:
            after = tables.anonymized_keys(per_key, s)
            least = after.where("r > 0").agg(F.min("k"))
            row = tables.joined_rows(after).select(
                F.lit(f"{left}-{right}").alias("link"), F.lit(s).alias("subtype"), before.alias("rows_before"), F.col("n_rows").alias("rows_after"),
                (before == F.col("n_rows")).alias("preserved"), least.scalar().alias("least_key"),
            )
            out = row if out is None else out.unionByName(row)
    return out


DERIVED["mapping"] = """SELECT 'group_0' AS group_key, CAST(c_custkey AS STRING) AS original, 'C-' || CAST(c_custkey * 7 + 11 AS STRING) AS synthetic FROM {customer} WHERE c_mktsegment <> 'BUILDING'"""


@query(
    "apply_mapping",
    "SELECT o_orderkey, coalesce(m.synthetic, CAST(o_custkey AS VARCHAR)) AS o_custkey FROM orders LEFT JOIN mapping m ON CAST(o_custkey AS VARCHAR) = m.original",
    ("mapping",),
)
def apply_mapping(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return tables.apply_mapping(orders, "o_custkey", derived(spark, sf, "mapping"), "group_0")


@query(
    "mapping_io",
    f"""SELECT group_key, original, synthetic FROM mapping UNION ALL SELECT 'group_0', v, {synth_sql("'account_number'", 'v', True)} FROM
    (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders WHERE CAST(o_custkey AS VARCHAR) NOT IN (SELECT original FROM mapping))""",
    ("mapping",),
)
def mapping_io(spark, sf):
    """A stored mapping is loaded, extended by values it does not know, appended to and loaded again."""
    path = shared_path(spark, "mapping")
    mapping_store.append_mapping(derived(spark, sf, "mapping"), path)
    stored = mapping_store.load_mapping(spark, path)
    values = table(spark, sf, "orders").select(F.lit("group_0").alias("group_key"), F.col("o_custkey").cast("string").alias("original"))
    mapping_store.append_mapping(cut_lineage(tables.extend_mapping(stored, values, "account_number")), path)
    return mapping_store.load_mapping(spark, path).select("group_key", "original", "synthetic")


DERIVED["uploads"] = "SELECT DISTINCT document_id, 'f_' || document_id AS filename, CAST(length(document_id) * 1000 AS BIGINT) AS file_size, length(document_id) <> 5 AS ok FROM {registry}"
DERIVED["detections"] = "SELECT document_id, count(*) AS total_pii, count(*) % 2 = 1 OR min(row_id) % 3 = 0 AS ok FROM {registry} GROUP BY document_id HAVING length(document_id) <> 5"
DERIVED["maskings"] = "SELECT document_id, 'm_' || document_id AS masked_filename, min(row_id) % 2 = 0 AS ok FROM {registry} WHERE status = 'masked' GROUP BY document_id"
SUMMARY_DOCS = """SELECT u.document_id, u.filename, u.file_size, d.total_pii, m.masked_filename, coalesce(u.ok, false) AS uploaded, coalesce(d.ok, false) AS detected, coalesce(m.ok, false) AS masked,
    CASE WHEN coalesce(u.ok, false) AND coalesce(d.ok, false) AND coalesce(m.ok, false) THEN 'completed' ELSE 'failed' END AS status
    FROM uploads u LEFT JOIN detections d ON u.document_id = d.document_id LEFT JOIN maskings m ON u.document_id = m.document_id"""


def stages(spark, sf):
    return report.processing_summary(*(derived(spark, sf, n) for n in ("uploads", "detections", "maskings")))


@query("processing_documents", SUMMARY_DOCS, ("uploads", "detections", "maskings"))
def processing_documents(spark, sf):
    return stages(spark, sf)[0]


@query(
    "processing_summary",
    f"""SELECT *, CASE WHEN successful_maskings = total_files THEN 'completed' WHEN successful_maskings > 0 THEN 'partial_success' ELSE 'failed' END AS overall_status FROM
    (SELECT count(*) AS total_files, count(*) FILTER (uploaded) AS successful_uploads, count(*) FILTER (NOT uploaded) AS failed_uploads, count(*) FILTER (detected) AS successful_detections,
    count(*) FILTER (uploaded AND NOT detected) AS failed_detections, count(*) FILTER (masked) AS successful_maskings, count(*) FILTER (detected AND NOT masked) AS failed_maskings FROM ({SUMMARY_DOCS}))""",
    ("uploads", "detections", "maskings"),
)
def processing_summary(spark, sf):
    return stages(spark, sf)[1]


REPLICATED = {"cust_id": "generic_id", "order_id": "generic_id", "supp_id": "generic_id", "nation_id": "generic_id", "full_name": "name"}


@query("replica", listed_sql(REPLICATED))
def replica(spark, sf):
    """A clean copy of a table set: discovered by all values and links, then anonymized."""
    return listed(jobs.replica(renamed(spark, sf)))


SHAPE_OF = {
    "customer": ("c_custkey", ["c_acctbal"], ["c_name", "c_mktsegment"]),
    "orders": ("o_orderkey", ["o_totalprice"], ["o_orderstatus", "o_orderpriority"]),
}
UNIT = "1099511627776"  # 2^40


def bits_sql(row: str, column: str, start: int = 1) -> str:
    return f"CAST('0x' || substr(sha256('twin' || {quote(column + ':')} || CAST({row} AS VARCHAR)), {start}, 10) AS BIGINT)"


def shares_sql(source: str, column: str) -> str:
    counts = f"SELECT v, n, sum(n) OVER (ORDER BY sha256(coalesce('=' || CAST(v AS VARCHAR), ''))) AS until, sum(n) OVER () AS total FROM (SELECT {column} AS v, count(*) AS n FROM {source} GROUP BY 1)"
    end = f"CAST(floor(CAST({{}} AS DOUBLE) / CAST(total AS DOUBLE) * {UNIT}) AS BIGINT)"
    return f"(SELECT v, {end.format('(until - n)')} AS lo, {end.format('until')} AS hi FROM ({counts}))"


def cuts_sql(source: str, column: str) -> str:
    ranks = f"SELECT {column} AS v, row_number() OVER (ORDER BY {column}) - 1 AS r, count(*) OVER () AS n FROM {source} WHERE {column} IS NOT NULL"
    points = f"SELECT i, v FROM ({ranks}) q, generate_series(0, 100) u(i) WHERE r = (i * (n - 1)) // 100"
    return f"(SELECT i AS slot, v AS low, lead(v) OVER (ORDER BY i) AS high FROM ({points}))"


def drawn_sql(rows: str, key: str, parent: str, source: str) -> str:
    """Rows with the columns of the table drawn; every draw meets its interval."""
    _, numbers, categories = SHAPE_OF[source]
    joins, shown = [], []
    for c in numbers:
        x = f"{bits_sql(key, c)} * 100"
        joins.append(f"LEFT JOIN {cuts_sql(source, c)} AS t_{c} ON t_{c}.slot = ({x}) >> 40")
        shown.append(f"t_{c}.low + (t_{c}.high - t_{c}.low) * (CAST(({x}) & ({UNIT} - 1) AS DOUBLE) / {UNIT}) AS amount")
    for i, c in enumerate(categories):
        joins.append(f"LEFT JOIN {shares_sql(source, c)} AS t_{c} ON x_{c} >= t_{c}.lo AND x_{c} < t_{c}.hi")
        shown.append(f"t_{c}.v AS category{i + 1}")
    draws = ", ".join(f"{bits_sql(key, c)} AS x_{c}" for c in categories)
    return f"SELECT '{source}' AS tab, {key} AS row_key, {parent} AS parent_key, {', '.join(shown)} FROM (SELECT *, {draws} FROM {rows}) AS r {' '.join(joins)}"


FANS = "(SELECT CAST(count(o_orderkey) AS BIGINT) AS fan_out FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)"


@query(
    "synth_table",
    f"""WITH people AS (SELECT CAST(i AS BIGINT) AS c_custkey, {bits_sql('i', 'fan_out')} AS x FROM range((SELECT count(*) FROM customer)) u(i)),
    counted AS (SELECT c_custkey, f.v AS n, CAST(sum(f.v) OVER (ORDER BY c_custkey) AS BIGINT) AS until FROM people JOIN {shares_sql(FANS, 'fan_out')} f ON x >= f.lo AND x < f.hi),
    bought AS (SELECT CAST(k AS BIGINT) AS o_orderkey, c_custkey AS o_custkey FROM counted, unnest(range(until - n, until)) u(k))
    {drawn_sql('people', 'c_custkey', 'CAST(NULL AS BIGINT)', 'customer')} UNION ALL
    {drawn_sql('bought', 'o_orderkey', 'o_custkey', 'orders')}""",
)
def synth_table(spark, sf):
    """As many customers as given, and orders for them as the given ones have: shares, cut points and fan-out kept."""
    from veil.operators import mimic

    given = {t: table(spark, sf, t) for t in SHAPE_OF}
    fan = mimic.fan_out(given["customer"], "c_custkey", given["orders"], "o_custkey")
    people = spark.range(given["customer"].count()).withColumnRenamed("id", "c_custkey")
    bought = mimic.synth_children(people, "c_custkey", fan, "o_orderkey", "o_custkey", "twin")
    out = None
    for (name, (key, numbers, categories)), rows in zip(SHAPE_OF.items(), (people, bought)):
        made = mimic.synth_table(rows, key, mimic.profile(given[name], numbers, categories), "twin")
        parent = F.col("o_custkey") if name == "orders" else F.lit(None).cast("bigint")
        shown = made.select(
            F.lit(name).alias("tab"), F.col(key).alias("row_key"), parent.alias("parent_key"), F.col(numbers[0]).alias("amount"),
            *[F.col(c).alias(f"category{i + 1}") for i, c in enumerate(categories)],
        )
        out = shown if out is None else out.unionByName(shown)
    return out
