import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import checks.catalog  # noqa: F401 - registers the queries
from checks import base
from tests.conftest import SMALL
from veil.functions import spans
from veil.functions.patterns import FALLBACK, NOUNS, NUMERIC, REGISTRY, SECRET, Pattern
from veil.functions.spans import INNER, MARK, all_spans
from veil.operators import layout
from veil.operators.synth import anonymize_fallback
from veil.sources import readers


def model(text, patterns):
    out = []
    for rank, p in enumerate(patterns):
        regex = p.regex if p.any_digit else p.regex.replace(r"[\d", "[0-9").replace(r"\d", "[0-9]")
        for m in re.finditer(regex, text):
            out.append((rank, m.start(p.group), m.end(p.group), m.group(p.group)))
    return out


def found(spark, texts, patterns):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", F.expr(all_spans("text", patterns)).alias("s")).collect()
    return {r.i: [(x["rank"], x["start"], x["end"], x["text"]) for x in r.s] for r in rows}


@pytest.mark.parametrize("patterns", [[*REGISTRY, SECRET], NUMERIC, NOUNS], ids=["registry", "numeric", "nouns"])
def test_same_spans_as_python(spark, patterns):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += ["Zoé Müller a Émile B. Zola, 12 Rue", "x123-45-6789 123-45-6789é 123-45-6789", "A. B. Cx Dy A.B", "$1,234.50 1,234 12.5 1999 42 7"]
    got = found(spark, texts, patterns)
    for i, text in enumerate(texts):
        assert got[i] == model(text, patterns), text[:200]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aZé9- .@(,/:1\n" + MARK + INNER, max_size=60), min_size=20, max_size=20))
def test_same_spans_on_noise(spark, texts):
    patterns = [*REGISTRY, *NUMERIC]
    got = found(spark, texts, patterns)
    for i, text in enumerate(texts):
        assert got[i] == model(text, patterns)


def test_marks_in_text_are_harmless(spark):
    text = f"a{MARK}b 123-45-6789 {INNER} https://x.org/{MARK}y end"
    spans = found(spark, [text], REGISTRY)[0]
    assert [s[3] for s in spans] == ["123-45-6789", f"https://x.org/{MARK}y"]
    assert all(text[s:e] == v for _, s, e, v in spans)


def test_fallback_substitutions(spark):
    texts = ["Zoé Smith met Mary Jones, 555-12-3456, 415.555.0199, a.b@c.org, $12.50, 78 Oak Street", ".x@y.org Ann Lee.", "éAnn Lee"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(anonymize_fallback("t")).collect()]
    for text, result in zip(texts, got):
        want = text
        for regex, constant in FALLBACK:
            want = re.sub(regex, constant, want)
        assert result == want


INNER_GROUPS = [
    Pattern('K"EY', r'key="([a-z0-9]+)"'), Pattern("IT'S", r"\b[A-Z]{2} (\d{2}(?:-\d)?) [a-z]+\b"), Pattern("LAST", r"no (\d+)"), Pattern("FIRST", r"([a-z]+)@"),
]


def test_values_inside_patterns_are_placed(spark):
    texts = ['a key="abc123" and key="z" é key=""', "XY 12-3 ab, ZZ 44 q no 7 no 8x", "é日 bob@x ann@y@", ""]
    got = found(spark, texts, INNER_GROUPS)
    assert [got[i] for i in range(4)] == [model(t, INNER_GROUPS) for t in texts]
    with pytest.raises(ValueError):
        all_spans("text", [Pattern("BAD", r"a|b(c)")])


def test_salts_may_hold_quotes(spark):
    from veil.operators import mask

    df = spark.createDataFrame([(1, "mail a.b@example.org now")], "doc_id long, text string")
    assert "a.b@" not in mask.protect(df, REGISTRY, salt="it's \\ one").first().masked_text


def test_narrow_rows_are_dealt_before_they_become_texts(spark):
    cores = spark.sparkContext.defaultParallelism
    assert base.derived(spark, SMALL, "pii_corpus").rdd.getNumPartitions() >= cores
    long = spark.range(100_000, numPartitions=1)
    assert readers.dealt(long, 1000).rdd.getNumPartitions() == 100


def test_leftmost_is_what_pairwise_comparison_keeps(spark):
    import random

    rnd = random.Random(5)
    rows = []
    for k in range(60):
        at = [(rnd.randrange(400), rnd.randrange(1, 9)) for _ in range(rnd.choice([0, 3, 30, 200]))]
        rows.append((k, [(0, "x", a, a + n, "t", 0.9, "REGEX") for a, n in at]))
    found = spark.createDataFrame(rows, f"k int, spans array<{spans.SPAN}>")
    pairwise = spans.let(spans.by_position("spans"), "p", spans.keep_disjoint("p"))
    both = found.select(F.expr(spans.keep_leftmost("spans")).alias("a"), F.expr(pairwise).alias("b")).collect()
    assert all(r.a == r.b for r in both) and any(len(r.a) > 20 for r in both)


def test_many_boxes_of_a_page_are_placed_as_by_pairwise_comparison(spark):
    import random

    rnd = random.Random(7)
    rows = []
    for k in range(1500):
        x, y, w, h = rnd.randrange(500), rnd.randrange(700), rnd.randrange(1, 60), rnd.choice([4, 9, 120])
        rows.append((1, 0, f"i{k}", float(x), float(y), float(x + w), float(y + h)))
    kept, want = [], set()
    for _, _, i, x0, y0, x1, y1 in sorted(rows, key=lambda r: (r[4], r[3], r[5], r[6], r[2])):
        if all(x1 + 2 < a0 - 1 or x0 - 2 > a1 + 1 or y1 + 2 < b0 or y0 - 2 > b1 for a0, b0, a1, b1 in kept):
            kept.append((x0, y0, x1, y1))
            want.add(i)
    boxes = spark.createDataFrame(rows, "doc_id long, page_num int, item_id string, bx0 double, by0 double, bx1 double, by1 double")
    got = layout.bbox_overlap(boxes).collect()
    assert len(got) == 1500 and {r.item_id for r in got if r.applied} == want


@pytest.mark.parametrize("patterns", [NUMERIC, NOUNS], ids=["numeric", "nouns"])
def test_every_match_contains_what_its_pattern_needs(spark, patterns):
    """Most lines hold no number or noun: a plain test spares them the regex and loses no match."""
    assert all(p.needs or "$" in p.hints for p in patterns)
    texts = ["$1,234.50 or 12,345.6 and $,", "999,123.45,678 1,950", "٣.١٤ and ٢٠", "Al B. Mehta", "J.Doe", "Al C. D.x", "Ann  Lee", "Jo Ann Smith",
             "May-Ann Smith", "12  Oak Street", "Old Town, IL12345-6789", "Old Town IL 12345", "Acme Co", "Foo Bar LLC", "First Trust", "no match"]
    got = found(spark, texts, patterns)
    assert all(got[i] == model(text, patterns) for i, text in enumerate(texts)) and sum(map(len, got.values())) > 12


def test_places_of_few_and_of_many_matches(spark):
    texts = ["é12 34 \U0001f600 56, 78.90 x" * n for n in (1, 5, 80)]
    got = found(spark, texts, NUMERIC)
    assert all(got[i] == model(text, NUMERIC) for i, text in enumerate(texts)) and len(got[2]) > 200
