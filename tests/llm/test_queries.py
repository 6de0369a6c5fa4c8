"""Registered queries against their SQL, and the pipeline against plain versions of its stages."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import compare, duck
from tests.conftest import SMALL
from tests.llm.test_corpus import linked_components, lowered
from tests.llm.test_texts import plain_spans, plain_stats
from veil.llm import bpe, leaks, queries, quality, secrets


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_same_as_sql(spark, con, key):
    message, _ = compare(spark, con, SMALL, key, queries.QUERIES[key], queries.SQL[key])
    assert message.startswith("ok"), message


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_dedup", "decontamination", "secret_scan", "byte_bpe"]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for k, y in enumerate(b):
            row[k + 1] = before[k] + 1 if x == y else max(before[k + 1], row[k])
    return row[-1]


def test_stages_are_those_of_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    kept = corpus_pipeline.quality_rules(spark, docs, SMALL)
    assert kept.columns == docs.columns
    rules = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    decided = {r.doc_id: r.rule for r in quality.judge(docs, rules).collect()}
    stats = {i: plain_stats(r.text or "") for i, r in rows.items()}
    good = {i for i, s in stats.items() if s[0] >= 50 and 100 * s[4] <= 50 * s[0] and decided[i] is None}
    assert {r.doc_id for r in kept.collect()} == good

    alone = corpus_pipeline.minhash_dedup(spark, kept, SMALL)
    assert alone.columns == docs.columns
    least = linked_components([(i, rows[i].text) for i in sorted(good)], 5)
    first = {i for i in good if least[i] == i}
    assert {r.doc_id for r in alone.collect()} == first

    clean = corpus_pipeline.decontamination(spark, alone, SMALL)
    assert clean.columns == docs.columns
    items = [lowered(r.text).split() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaked = set()
    for i in first:
        words = lowered(rows[i].text).split()
        places = defaultdict(list)
        for k, w in enumerate(words):
            places[w].append(k)
        for item in items:
            near = Counter(k // 32 for w in set(item) for k in places[w])
            if near and max(near.values()) >= 0.2 * min(len(item), 32):
                size = 2 * len(item)
                if any(common(item, words[k : k + size]) >= 0.9 * len(item) for k in range(0, len(words), max(1, len(item) // 2))):
                    leaked.add(i)
    found = first - {r.doc_id for r in clean.collect()}
    assert leaked <= found
    assert found - leaked == set()

    masked = corpus_pipeline.secret_scan(spark, clean, SMALL)
    assert masked.columns == docs.columns
    stay = first - found
    owners = defaultdict(set)
    for i in stay:
        for s in plain_spans(rows[i].text):
            owners[s[3]].add(rows[i].source)
    expected = {}
    for i in stay:
        text, at, out = rows[i].text, 0, []
        for start, _, end, value in plain_spans(text):
            if len(owners[value]) <= secrets.FEW_OWNERS and start >= at:
                out += [text[at:start], "[SECRET]"]
                at = end
            elif len(owners[value]) <= secrets.FEW_OWNERS:
                at = max(at, end)
        expected[i] = "".join(out) + text[at:]
    got = {r.doc_id: r for r in masked.collect()}
    assert {i: r.text for i, r in got.items()} == expected
    assert all(r.n_chars == len(r.text) for r in got.values())

    encoder = bpe.encoder(corpus_pipeline.public_tokenizers.path(corpus_pipeline.RANKS), corpus_pipeline.public_tokenizers.PATTERN)
    for r in corpus_pipeline.byte_bpe(spark, masked, SMALL).collect():
        assert b"".join(encoder.words[k] for k in r.ids) == expected[r.doc_id].encode()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(expected[r.doc_id].encode()).hexdigest()


def test_the_pipeline_takes_awkward_rows(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name != "byte_bpe":
                assert out.columns == docs.columns
                docs = out.select("*").cache()
                docs.count()
            else:
                assert out.where(F.col("doc_id").isNull()).count() <= 2


def test_recall_of_leaks_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = {r.item_id: lowered(r.text).split() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    grams = defaultdict(set)
    for k, w in items.items():
        for j in range(len(w) - 7):
            grams[tuple(w[j : j + 8])].add(k)
    whole = set()
    for r in docs.collect():
        w = lowered(r.text).split()
        hits = Counter(k for j in range(len(w) - 7) for k in grams.get(tuple(w[j : j + 8]), ()))
        whole |= {(r.doc_id, k) for k, n in hits.items() if n >= 0.8 * (len(items[k]) - 7)}
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert whole and len(whole & got) >= 0.9 * len(whole)
