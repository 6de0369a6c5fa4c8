import random

import pytest
from pyspark.sql import functions as F

from veil.functions import dims, pseudo, text
from veil.operators import chunk, mimic, report, resolve, running, scan, synth, tables
from veil.sources import config_lines, mapping_store, readers, registry


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "n, want", [(2, "**"), (4, "[*]"), (6, "[RED]"), (8, "[REDACT]"), (9, "[REDACTED]"), (12, "[REDACTED]")]
)
def test_redaction_ladder(spark, n, want):
    assert one(spark, "x" * n, lambda c: text.fit_replacement(c, F.lit("[REDACTED]"))) == want


def test_partial_mask(spark):
    assert one(spark, "1234", text.partial_mask) == "****"
    assert one(spark, "12345678", text.partial_mask) == "12****78"


@pytest.mark.parametrize("size, want", [(0, "0 B"), (1023, "1023.0 B"), (1280, "1.2 KB"), (52428800, "50.0 MB")])
def test_human_size(spark, size, want):
    assert one(spark, size, text.human_size, "long") == want


def test_file_rules(spark):
    assert one(spark, "a.PDF", text.file_error) is None
    assert one(spark, "noext", text.file_error) == "File must have an extension"
    assert one(spark, "a.csv", lambda c: text.file_error(c, simple=True)) == "File type 'csv' not allowed"


def test_severities(spark):
    rows = spark.createDataFrame([("IP_ADDRESS",), ("AADHAAR",), ("DRIVER_LICENSE",)], "t string")
    got = rows.select(dims.severity_single(F.col("t")), dims.severity_bulk(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("low", "medium"), ("high", "low"), ("medium", "high")]


def test_labels(spark):
    assert one(spark, "PII|PHIGAH (HIPAA)", text.normalize_label) == "PII"
    assert one(spark, "nope", text.normalize_label) == "NONE"


def lines(spark, *rows):
    return spark.createDataFrame([(1, i + 1, r) for i, r in enumerate(rows)], "doc_id long, line_num int, line string")


def test_config_lines(spark):
    df = lines(
        spark, "John Doe:PERSON:pseudo:0:100.5:200.3:180.7:220.1", "user@email.com:EMAIL:mask", "# note", "",
        "00:1A:2B:3C:4D:5E:MAC_ADDRESS:redact:1:1:2:3:4", "http://x:URL:mask", "a:b", "t:SSN:redact:x:1:2:3:4",
    )
    got = {r.pii_id: (r.text, r.pii_type, r.strategy, r.page_num, r.x0) for r in config_lines.config_parse(df).collect()}
    assert got == {
        "pii_1": ("John Doe", "PERSON", "pseudo", 0, 100.5),
        "pii_2": ("user@email.com", "EMAIL", "mask", 0, 0.0),
        "pii_5": ("00:1A:2B:3C:4D:5E", "MAC_ADDRESS", "redact", 1, 1.0),
        "pii_6": ("http://x", "URL", "mask", 0, 0.0),
    }


def test_config_replacement_dialect(spark):
    df = lines(spark, "Jane:person:Pseudo:Rhea Z", "http://x:URL:mask", "t:ssn:redact:2:1.5:x:3:4")
    got = [(r.text, r.pii_type, r.strategy, r.replacement, r.page_num, r.x0, r.y0) for r in config_lines.config_parse_replacement(df).orderBy("line_num").collect()]
    assert got == [
        ("Jane", "PERSON", "pseudo", "Rhea Z", 0, 0.0, 0.0),
        ("http", "//X", "url", "mask", 0, 0.0, 0.0),
        ("t", "SSN", "redact", None, 2, 1.5, 0.0),
    ]


def test_config_round_trip(spark, tmp_path):
    plan = spark.createDataFrame(
        [(1, 0, "a:b", "URL", "mask", 1.0, 2.0, 3.0, 4.5), (1, 1, "c", "SSN", "redact", 0.0, 0.0, 0.0, 0.0)],
        "doc_id long, page_num int, text string, pii_type string, strategy string, x0 double, y0 double, x1 double, y1 double",
    )
    config_lines.save_config(plan, str(tmp_path / "c"))
    back = spark.read.text(str(tmp_path / "c")).select(
        F.split_part("value", F.lit("\t"), F.lit(1)).cast("long").alias("doc_id"), F.lit(1).alias("line_num"),
        F.split_part("value", F.lit("\t"), F.lit(2)).alias("line"),
    )
    assert back.where("line LIKE '#%'").count() == 3
    parsed = config_lines.config_parse(back)
    assert {(r.doc_id, r.text, r.page_num, r.y1) for r in parsed.collect()} == {(1, "a:b", 0, 4.5), (1, "c", 1, 0.0)}


def test_text_decoding(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("é".encode())
    (tmp_path / "l.txt").write_bytes("é".encode("latin-1"))
    rows = readers.read_text(spark, str(tmp_path)).collect()
    assert [r.text for r in rows] == ["é", "é"]


def test_chunks_match_a_model(spark):
    body = ("lorem ipsum dolor " * 40).strip()
    df = spark.createDataFrame([(1, 0, body), (2, 0, "short"), (3, 0, "w" * 90 + " x"), (4, 0, " " * 80)], "doc_id long, page_num int, text string")
    got = {}
    for r in chunk.chunk_words(df, 50).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r.doc_id, []).append((r.chunk, r.chunk_offset))

    def model(t, limit=50):
        if len(t) <= limit:
            return [t]
        out, cur, n = [], [], 0
        for w in t.split():
            if cur and n + len(w) > limit:
                out.append(" ".join(cur))
                cur, n = [w], len(w)
            else:
                cur.append(w)
                n += len(w) + 1
        return out + ([" ".join(cur)] if cur else [])

    for doc, t in ((1, body), (2, "short"), (3, "w" * 90 + " x")):
        want = model(t)
        assert [c for c, _ in got[doc]] == want
        assert [o for _, o in got[doc]] == [sum(len(c) + 1 for c in want[:i]) for i in range(len(want))]
    assert 4 not in got


def separator_model(text, size, overlap):
    out, at = [], 0
    while len(text) - at > size:
        end = at + size
        for sep in chunk.SEPARATORS:
            found = text.rfind(sep, at + size // 2, end)
            if found >= 0:
                end = found + len(sep)
                break
        out.append(text[at:end])
        at = end - overlap
    return [*out, text[at:]]


def test_separator_chunks_cover_the_text(spark):
    draw = random.Random(5)
    pieces = ["a", "é", "\U0001F600", "word", " ", ", ", ". ", "\n", "\n\n", "? ", "; ", "! ", ".", "e\u0301"]
    texts = ["One sentence. " * 30 + "\n\n" + "word " * 60, "", "short", "x" * 1000, "\n" * 350, "\U0001F600 " * 200]
    texts += ["".join(draw.choices(pieces, k=draw.randrange(600))) for _ in range(60)]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate([*texts, None])], "doc_id long, page_num int, text string")
    for size, overlap in ((100, 10), (33, 16), (7, 0)):
        got = {}
        for r in chunk.chunk_at_separators(df, size, overlap).orderBy("doc_id", "chunk_idx").collect():
            got.setdefault(r.doc_id, []).append(r.chunk)
        assert [got.get(i) for i in range(len(texts) + 1)] == [separator_model(t, size, overlap) for t in texts] + [None]
    with pytest.raises(ValueError):
        chunk.separator_chunks("text", 10, 6)


def test_separator_chunks_of_a_long_text(spark):
    df = spark.createDataFrame([(1, 0, "some words, more words. " * 200_000)], "doc_id long, page_num int, text string")
    row = chunk.chunk_at_separators(df).selectExpr("count(*) n", "sum(length(chunk)) - 150 * (count(*) - 1) total").first()
    assert row.total == 24 * 200_000 and row.n > 2500


def test_assembly(spark):
    df = spark.createDataFrame([(1, 1, " b \n\n\n\n\nc"), (1, 0, "a "), (1, 2, "  "), (2, 0, " ")], "doc_id long, chunk_idx int, synthetic string")
    got = {r.doc_id: r.content for r in synth.assemble(df, ["doc_id"]).collect()}
    assert got == {1: "a\n\nb \n\n\nc", 2: synth.EMPTY_RESULT}


def test_trimmed_are_all_spaces_and_nothing_else(spark):
    assert len(set(text.SPACE_CHARS)) == 29
    other = ["\x00", "\x08", "\x0e", "\x1b", "!", "\x84", "\x86", "\u180e", "\u200b", "\u2060", "\ufeff", "'", "\\"]
    rows = [(k, 0, f"{c}{c} a{c}b {c}\r\n") for k, c in enumerate([*text.SPACE_CHARS, *other])]
    df = spark.createDataFrame(rows, "doc_id long, chunk_idx int, synthetic string")
    wanted = df.select("doc_id", text.strip(F.col("synthetic")).alias("content"))
    assert sorted(synth.assemble(df, ["doc_id"]).collect()) == sorted(wanted.collect())


def test_synthesis_runs_no_regex_to_trim_and_gives_nothing_back(spark):
    df = spark.createDataFrame([(1, "see a.b@c.org or x@y, a_b.c%d")], "id long, text string")
    out = synth.synthesize(df)
    assert out.first().content == "see example@email.com or x@y, a_b.c%d"
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.SPACE + "+$" not in plan and "]++@" in plan


def test_rewriter_failures_fall_back(spark):
    df = spark.createDataFrame([(1, "Ann Lee"), (2, "x")], "id long, chunk string")

    def rewriter():
        def run(t):
            if t == "Ann Lee":
                raise RuntimeError
            return "```txt\nnew\n```"

        return run

    got = {r.id: r.synthetic for r in synth.synth_rewrite(synth.rewrite_with(df, rewriter)).collect()}
    assert got == {1: "John Smith", 2: "new"}


def test_dataset_count_is_checked(spark):
    with pytest.raises(ValueError):
        synth.replicate(spark.range(1), 11)


@pytest.mark.parametrize("chars, words, scanned", [(49, 1, True), (3000, 12, False), (200, 9, True)])
def test_scan_votes(spark, chars, words, scanned):
    body = " ".join(["w" * (chars // words)] * words)[:chars]
    df = spark.createDataFrame([(1, 0, body, 100.0, 100.0, 0)], "doc_id long, page_num int, text string, width double, height double, n_images int")
    assert scan.scan_classify(df).first().is_scanned is scanned


def test_running_sum_in_blocks(spark):
    df = spark.range(1000).selectExpr("id % 3 = 0 AS g", "id AS o", "id % 7 AS v")
    got = running.running_sum(df, ["g"], "o", "v", "s", F.floor(F.col("o") / 10)).collect()
    totals = {}
    for r in sorted(got, key=lambda r: r.o):
        totals[r.g] = totals.get(r.g, 0) + r.v
        assert r.s == totals[r.g]


def test_null_policies(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "name string, x int")
    keep = tables.anonymize_table(df, {"name": "name"}).orderBy("x").collect()
    draw = tables.anonymize_table(df, {"name": "name"}, "synthesize").orderBy("x").collect()
    assert keep[0].name is None and draw[0].name and keep[1].name == draw[1].name


def test_links_join_groups_that_meet_late(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdefg"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("c", "d"), ("d", "e"), ("b", "e")], "a string, b string")
    got = {r.node: r.component for r in tables.link_groups(nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "f": "f", "g": "g"}


def test_mapping_is_reused(spark, tmp_path):
    path = str(tmp_path / "m")
    values = spark.createDataFrame([("g", "x"), ("g", "y")], "group_key string, original string")
    mapping_store.append_mapping(tables.extend_mapping(mapping_store.load_mapping(spark, path), values, "name"), path)
    first = {r.original: r.synthetic for r in mapping_store.load_mapping(spark, path).collect()}
    more = spark.createDataFrame([("g", "x"), ("g", "z")], "group_key string, original string")
    new = tables.extend_mapping(mapping_store.load_mapping(spark, path), more, "name", salt="other")
    assert [r.original for r in new.collect()] == ["z"]
    mapping_store.append_mapping(new, path)
    again = {r.original: r.synthetic for r in mapping_store.load_mapping(spark, path).collect()}
    assert {k: again[k] for k in first} == first and set(again) == {"x", "y", "z"}


@pytest.mark.parametrize("subtype", ["generic_id", "name", "email", "phone", "address", "date_of_birth", "other"])
def test_linked_values_stay_distinct(spark, subtype):
    df = spark.range(50000).select(F.expr(pseudo.synth_by_subtype(f"'{subtype}'", "CAST(id AS STRING)", True)).alias("v"))
    assert df.distinct().count() == 50000


def test_columns_linked_to_a_sensitive_one_are_replaced(spark):
    info = spark.createDataFrame([("cust_id", "PII", "generic_id", 0.7), ("buyer", "NONE", "other", 0.0), ("note", "NONE", "other", 0.0)],
                                 "column_name string, label string, subtype string, confidence double")
    keys = spark.createDataFrame([("c.cust_id", "group_0"), ("o.buyer", "group_0"), ("o.note", "col::note")], "node string, group_key string")
    got = {(r.node, r.subtype) for r in tables.linked_subtypes(info, keys).collect()}
    assert got == {("c.cust_id", "generic_id"), ("o.buyer", "generic_id")}


def test_long_chains_of_links_settle(spark):
    nodes = spark.range(200).selectExpr("lpad(CAST(id AS STRING), 3, '0') AS node")
    edges = spark.range(199).selectExpr("lpad(CAST(id AS STRING), 3, '0') AS a", "lpad(CAST(id + 1 AS STRING), 3, '0') AS b")
    assert tables.link_groups(nodes, edges).select("component").distinct().collect() == [("000",)]


def test_all_values_decide_what_a_column_is(spark):
    rows = [(k, None if k < 40 else f"user{k}@example.org") for k in range(100)]
    values = tables.column_values({"t": spark.createDataFrame(rows, "n long, contact string")})
    assert {r.column_name: r.subtype for r in tables.column_classify(values).collect()} == {"n": "other", "contact": "email"}


def test_bad_numbers_drop_the_row(spark):
    lines = spark.createDataFrame([(1, 1, "a:SSN:mask:99999999999:1:2:3:4"), (1, 2, "b:SSN:mask:2:1:2:3:4")], "doc_id long, line_num int, line string")
    assert [r.text for r in config_lines.config_parse(lines).collect()] == ["b"]


def test_rows_without_status_are_kept(spark):
    from veil.sources.registry import retention

    rows = spark.createDataFrame([("d", None), ("d", "masked"), ("d", "uploaded")], "document_id string, status string")
    assert {r.status for r in retention(rows).collect()} == {None, "masked"}


def test_an_unreadable_mapping_is_an_error(spark, tmp_path):
    from pyspark.sql.utils import AnalysisException

    assert mapping_store.load_mapping(spark, str(tmp_path / "none")).isEmpty()
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception) as error:
        mapping_store.load_mapping(spark, str(tmp_path / "store")).collect()
    assert not isinstance(error.value, AnalysisException) or error.value.getCondition() != "PATH_NOT_FOUND"


def test_toggles(spark):
    plan = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", True)], "doc_id long, pii_id string, selected boolean")
    one = resolve.toggle_item(plan, spark.createDataFrame([(1, "a")], "doc_id long, pii_id string"))
    assert {(r.pii_id, r.selected) for r in one.collect()} == {("a", False), ("b", False), ("c", True)}
    assert {(r.pii_id, r.selected) for r in resolve.toggle_all(plan).collect()} == {("a", True), ("b", True), ("c", False)}


def test_perturbed_numbers_keep_format(spark):
    values = ["$1,234.50", "12.5", "1,234", "$,", "77"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(F.expr(pseudo.perturb_number("v"))).collect()]
    assert got[0].startswith("$") and got[3] == "**"
    for v, g in zip(values, got):
        if v != "$,":
            a, b = (float(x.replace("$", "").replace(",", "")) for x in (v, g))
            assert 0.8 * a - 1 <= b <= 1.2 * a + 0.01


def test_synthetic_table_shape(spark):
    df = spark.range(5000).selectExpr(
        "id", "IF(id % 5 = 0, NULL, CAST(id AS DOUBLE)) AS x", "IF(id % 4 = 0, 'it''s', 'b') AS c", "id AS many", "IF(id % 2 = 0, NULL, DATE'2020-01-01') AS d"
    )
    shape = mimic.profile(df, ["x"], ["c", "many", "d"])
    out = mimic.synth_table(spark.range(5000), "id", shape)
    assert dict(out.dtypes) == {"id": "bigint", "x": "double", "c": "string", "many": "bigint", "d": "date"}
    row = out.selectExpr(
        "count(*) n", "avg(x) m", "count(x) known", "avg(IF(c = 'it''s', 1, 0)) s", "count(DISTINCT many) v", "count(many) all", "count(d) dated"
    ).first()
    assert row.n == row.all == 5000 and abs(row.m - 2500) < 100 and abs(row.s - 0.25) < 0.03
    assert abs(row.known - 4000) < 150 and abs(row.dated - 2500) < 150
    assert 3000 < row.v < 3320  # distinct values of 5000 even draws out of 5000: 63.2 %


def test_interval_shares_tile_the_range(spark):
    """Every draw has one interval, also where one value has most rows and 3000 have one each."""
    df = spark.range(30000).selectExpr("IF(id < 27000, 'hot', CAST(id AS STRING)) AS c")
    shares, shifts = mimic.interval_shares(df, ["c"])
    rows = sorted({(r.lo, r.hi) for r in shares.collect()})
    assert rows[0][0] == 0 and rows[-1][1] == 1 << 40 and all(a[1] == b[0] for a, b in zip(rows, rows[1:]))
    blocks = 1 << (40 - shifts["c"])
    assert 3001 <= blocks <= 2 * 3001 and shares.count() <= 3001 + blocks


def test_children_keep_the_fan_out(spark):
    parents = spark.range(1000).withColumnRenamed("id", "p")
    kids = spark.range(20000).selectExpr("IF(id < 15000, 7, id % 500) AS q")  # one parent has three in four
    fan = mimic.fan_out(parents, "p", kids, "q")
    made = mimic.synth_children(parents, "p", fan, "k", "q").cache()
    keys = [r.k for r in made.orderBy("k").collect()]
    assert keys == list(range(len(keys)))
    sizes = {r["count"] for r in made.groupBy("q").count().collect()}
    assert sizes <= {10, 15010} and made.join(parents, made.q == parents.p, "left_anti").isEmpty()


def test_long_ranges_are_dealt(spark):
    df = spark.createDataFrame([("a", 3, 40), ("b", 5, 4), ("c", 1, 1)], "v string, f bigint, l bigint")
    got = sorted((r.v, r.k) for r in mimic.spread(df, "f", "l", "k", step=7).collect())
    assert got == [("a", k) for k in range(3, 41)] + [("c", 1)]


def test_shape_of_nothing(spark):
    empty = spark.range(0).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id AS STRING) AS c")
    out = mimic.synth_table(spark.range(3), "id", mimic.profile(empty, ["x"], ["c"]))
    assert sorted(map(tuple, out.collect())) == [(0, None, None), (1, None, None), (2, None, None)]
    one = spark.createDataFrame([(2.5, None)], "x double, c string")
    out = mimic.synth_table(spark.range(3), "id", mimic.profile(one, ["x"], ["c"]))
    assert sorted(map(tuple, out.collect())) == [(0, 2.5, None), (1, 2.5, None), (2, 2.5, None)]


def test_unknown_user_gets_zeros(spark):
    reg = spark.createDataFrame([("u", None, 2048)], "user_id string, file_type string, file_size long")
    users = spark.createDataFrame([("u",), ("v",)], "user_id string")
    got = {r.user_id: (r.total_documents, r.size_kb, r.file_types) for r in report.user_stats(reg, users).collect()}
    assert got == {"u": (1, 2.0, "unknown=1"), "v": (0, 0.0, "")}


def test_retention_modes(spark):
    rows = [("d1", "uploaded"), ("d1", "masked"), ("d2", "uploaded"), ("d3", "masked")]
    reg = spark.createDataFrame(rows, "document_id string, status string")
    kept = sorted(map(tuple, registry.retention(reg).collect()))
    assert kept == [("d1", "masked"), ("d2", "uploaded"), ("d3", "masked")]
    forced = spark.createDataFrame([("d3",)], "document_id string")
    assert ("d3", "masked") not in map(tuple, registry.retention(reg, forced).collect())


@pytest.mark.parametrize("score, status", [(85.0, "compliant"), (84.9, "at-risk"), (60.0, "at-risk"), (59.9, "non-compliant")])
def test_score_status(spark, score, status):
    assert one(spark, score, report.score_status, "double") == status
