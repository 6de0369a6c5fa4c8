"""Operators on single texts, held against the libraries or plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import awkward_rows, words
from veil.llm import bpe, quality, secrets, tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ALPHABET = ["a", "b", " ", "  ", "e", "th", "é", "\n", "日", "ing", "▁", "x", "1", "(", "</s>", "🙂", "\t", "the", "\x00", "AA"]


def random_texts(n, most=60, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_token_counts_are_those_of_the_library(awkward, pieces):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tokens.token_counts(awkward, PIECES).collect())
    assert got == sorted((r[0] or 0, len((r[1] or "").encode()), len(pieces.encode(r[1] or ""))) for r in awkward_rows())


def test_counts_at_every_prefix(spark, pieces):
    texts = random_texts(60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in tokens.prefix_table(docs, PIECES).collect():
        text = texts[r.doc_id]
        assert r.prefix_tokens == [len(pieces.encode(text[: k + 1])) for k in range(len(text))]


def test_truncation_and_budget_without_encoding(spark, pieces):
    texts = random_texts(40, seed=5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    table = tokens.prefix_table(docs, PIECES).select(
        "doc_id", tokens.longest_prefix(F.col("prefix_tokens"), 7).alias("cut"),
        tokens.tokens_between(F.col("prefix_tokens"), F.lit(5)).alias("five"),
    )
    for r in table.collect():
        text = texts[r.doc_id]
        fitting = [k for k in range(1, len(text) + 1) if len(pieces.encode(text[:k])) <= 7]
        assert r.cut == (max(fitting) if fitting else 0)
        assert (r.five or 0) == len(pieces.encode(text[:5]))


def test_units_without_blanks_cost_as_much_as_short_ones(pieces):
    unit = "thesea" * 30_000
    assert tokens.vocabulary(PIECES).counts("▁" + unit)[-1] == len(pieces.encode(unit))


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = bpe.encoder(RANKS, PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_ids_and_round_trip(awkward, library):
    rows = bpe.decode(bpe.encode(awkward, RANKS, PATTERN), RANKS, PATTERN).collect()
    got = sorted((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in rows)
    assert got == sorted((r[0] or 0, library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in awkward_rows())


def test_bpe_random_texts(library):
    own = bpe.encoder(RANKS, PATTERN)
    for text in random_texts(2000, seed=9):
        assert np.frombuffer(own.encode(text), np.int32).tolist() == library.encode_ordinary(text)


def test_bpe_very_long_pretoken(library):
    text = "".join(random.Random(3).choices("abcdeé", k=100_000))
    assert np.frombuffer(bpe.encoder(RANKS, PATTERN).encode(text), np.int32).tolist() == library.encode_ordinary(text)


def test_bpe_new_pretokens_share_a_queue(library):
    rng = random.Random(8)
    own = bpe.Encoder(RANKS, PATTERN)
    texts = ["".join(rng.choices("aaabé ü0'", k=rng.randrange(60))) for _ in range(800)] + [None, "", "a" * 63, "ab" * 40] * 2
    want = [library.encode_ordinary(t or "") for t in texts]
    assert [np.frombuffer(f, np.int32).tolist() for f in own.encode_many(texts)] == want
    pieces = sorted({t.encode() for t in texts if t} - set(own.ranks))
    assert [np.frombuffer(f, np.int32).tolist() for f in own.ids_of_many(pieces)] == [own.ids(p) for p in pieces]
    assert not own.queue.top and not own.queue.buckets and all(len(t) <= bpe.CACHED_CHARS for t in own)


def test_rank_queue_pops_in_order():
    rng, queue, waiting = random.Random(4), bpe.RankQueue(50_256), []
    for _ in range(3000):
        if waiting and rng.random() < 0.4:
            waiting.sort()
            assert queue.pop() == waiting.pop(0)
        else:
            item = (rng.randrange(50_256) if rng.random() < 0.7 else rng.randrange(5), rng.randrange(1000))
            waiting.append(item)
            queue.push(*item)
    while waiting:
        waiting.sort()
        assert queue.pop() == waiting.pop(0)
    assert not queue.top


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_statistics_and_base_rules(awkward):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
                  for r in quality.judge(awkward, []).collect())
    expected = []
    for r in awkward_rows():
        s = plain_stats(r[1] or "")
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        expected.append((r[0], *s, failed, not failed))
    assert got == Counter(expected)


def labelled(spark, n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice(["river", "stone", "cloud", "tree"]) + str(rng.randrange(999)) + ("###" if bad and rng.random() < 0.5 else "")
                 for _ in range(120)]
        rows.append((k, " ".join(words)))
        labels.append((k, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), labels


def test_rules_hold_on_texts_they_were_not_learned_from(spark):
    docs, labels = labelled(spark)
    known = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id bigint, quality int")
    rules = quality.fit(docs, known)
    kept = {r.doc_id: r.kept for r in quality.judge(docs, rules).collect()}
    held = [x for x in labels if not x[0] % 2]
    assert sum(kept[k] == bool(good) for k, good in held) >= 0.98 * len(held)
    assert {r.doc_id for r in quality.kept_only(docs, rules).collect()} == {k for k, v in kept.items() if v}


def test_rules_need_both_kinds_of_labels(spark, nothing, awkward):
    docs, labels = labelled(spark, 60)
    for rows in ([], [(1, None)], [(k, 1) for k, _ in labels], [(k, 0) for k, _ in labels], [(9999, 0)]):
        rules = quality.fit(docs, spark.createDataFrame(rows, "doc_id bigint, quality int"))
        assert not rules or all(r for r in rules)
    assert quality.fit(nothing, spark.createDataFrame([], "doc_id bigint, quality int")) == []
    assert quality.kept_only(awkward, []).columns == awkward.columns


def test_a_rule_is_grown_pruned_and_ordered():
    rng = np.random.default_rng(2)
    x = {"a": rng.random(600), "b": rng.random(600)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["b"] > 0.95)
    rules = quality.learn(x, bad)
    hit = np.logical_or.reduce([quality.covers(r, x) for r in rules])
    assert (hit == bad).mean() > 0.97 and any(len(r) > 1 for r in rules)


def plain_spans(text):
    out = []
    for number, kind in enumerate(secrets.KINDS):
        for m in re.finditer(kind.pattern, text):
            if len(m[kind.value]) >= kind.least:
                out.append((m.start(), number, m.end(), m[kind.value]))
    return sorted(out)


SECRET_TEXTS = [
    None, "", "password=abc", "x password: 'hunter22' and TOKEN =  \"a.b-c_d/e=\" é", "AKIA" + "Z9" * 10 + " AKIAshort AKIAAKIA" + "B" * 12,
    "0123456789abcdef01234567 deadbeef", "secret=token: abcdefgh", "api_key=api-key apikey=0123456 " * 200,
    "日本 token=abcdef 🙂 passwd:zzzzzz", "ghp_" + "a1" * 20 + " eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "-----BEGIN RSA PRIVATE KEY-----",
    "token=" + "f" * 40,
]


def test_spans_are_those_of_plain_scans(spark):
    rows = [(k, t, "s") for k, t in enumerate(SECRET_TEXTS)] + [(0, None, None), (3, SECRET_TEXTS[3], "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for r in secrets.scan(docs).collect():
        expected = plain_spans(SECRET_TEXTS[r.doc_id] or "")
        assert [(s.start, s.kind, s.end) for s in r.spans] == [e[:3] for e in expected]
        assert [s.candidate for s in r.spans] == [hashlib.sha256(e[3].encode()).hexdigest() for e in expected]


def test_examples_are_what_many_owners_hold(spark):
    rows = [(k, "key: token=examplevalue", f"owner{k}") for k in range(4)] + [(9, "token=onlymine99 token=examplevalue", "owner9")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.n_live, r.n_example) for r in secrets.scan(docs).collect()}
    assert got == {**{k: (0, 1) for k in range(4)}, 9: (1, 1)}
    texts = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert texts[9] == "[SECRET] token=examplevalue" and texts[0] == "key: token=examplevalue"


def test_private_keys_are_masked_whole_and_told_apart_by_their_bodies(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{}\n-----END RSA PRIVATE KEY-----"
    rows = [(k, f"a {key.format('MIIB' + 'GHIJ'[k] * 900)} z", f"o{k}") for k in range(4)]
    rows += [(10 + k, f"{k} {key.format('MIIBshared')}", f"o{k}") for k in range(4)] + [(20, "-----BEGIN PRIVATE KEY-----\n" * 300, "o9")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.n_live, r.n_example) for r in secrets.scan(docs).collect()}
    assert got == {**{k: (1, 0) for k in range(4)}, **{10 + k: (0, 1) for k in range(4)}, 20: (300, 0)}
    texts = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert all(texts[k] == "a [SECRET] z" and texts[10 + k] == rows[4 + k][1] for k in range(4))


def test_examples_are_what_many_repositories_of_one_owner_hold(spark):
    rows = [(k, f"file {k}: token=examplevalue", "big") for k in range(40)]  # different texts of one owner
    rows += [(100 + k, "the same: token=mirrored99", "big") for k in range(40)]  # exact copies count once
    rows += [(200 + k, f"file {k}: token=usedoften1", "big") for k in range(secrets.FEW_REPOSITORIES)]
    rows += [(300, "token=examplevalue token=onlymine99", "small"), (None, "token=nameless99", None), (None, "x token=nameless99", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    scanned = secrets.scan(docs).where("doc_id IS NOT NULL").collect()
    got = {r.doc_id: (r.n_live, r.n_example) for r in scanned}
    assert got == {**{k: (0, 1) for k in range(40)}, **{k: (1, 0) for k in got if 100 <= k < 300}, 300: (1, 1)}
    counts = {(j.n_repositories, j.n_owners, j.live) for r in scanned for j in r.judged}
    assert counts == {(41, 2, False), (1, 1, True), (secrets.FEW_REPOSITORIES, 1, True)}
    texts = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert texts[0] == "file 0: token=examplevalue" and texts[300] == "token=examplevalue [SECRET]"
    assert texts[100] == "the same: [SECRET]" and texts[205] == "file 5: [SECRET]"


def test_scans_of_awkward_rows(awkward, nothing):
    assert secrets.scan(awkward).count() == awkward.count() and secrets.scan(nothing).count() == 0
    clean = secrets.redacted(awkward)
    assert clean.columns == awkward.columns
    assert Counter(map(tuple, clean.collect())) == Counter(map(tuple, awkward.collect()))


def test_scans_stay_native(awkward):
    plan = secrets.scan(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(nothing):
    assert tokens.token_counts(nothing, PIECES).count() == 0
    assert tokens.prefix_table(nothing, PIECES).count() == 0
    assert bpe.decode(bpe.encode(nothing, RANKS, PATTERN), RANKS, PATTERN).count() == 0
    assert quality.judge(nothing, []).count() == 0


def test_ids_and_what_they_decode_to_in_one_pass(awkward, nothing):
    apart = bpe.decode(bpe.encode(awkward, RANKS, PATTERN), RANKS, PATTERN)
    one = bpe.recoded(awkward, RANKS, PATTERN)
    got, expected = (Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in df.collect()) for df in (one, apart))
    assert got == expected
    assert bpe.recoded(nothing, RANKS, PATTERN).count() == 0
    assert one._jdf.queryExecution().sparkPlan().toString().count("MapInArrow ") == 1


def test_known_pre_tokens_are_shared(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_TOKENS", 50)
    own, texts = bpe.Encoder(RANKS, PATTERN), [words(k, 60) for k in range(20)] + ["x" * 200, "", None]
    fresh = [bpe.Encoder(RANKS, PATTERN).encode(t) for t in texts]
    assert own.encode_many(texts) == fresh == own.encode_many(texts)
