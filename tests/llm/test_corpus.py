"""Operators over the whole corpus, held against brute force on small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import awkward_rows, words
from veil.llm import leaks, minhash, ngrams, repeats
from veil.llm.common import keep, passing, without_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size):
    w = WORD.findall(lowered(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def linked_components(rows, size, percent=80):
    """Least id that links reach, from all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and a != b and 100 * len(s & t) >= percent * len(s | t):
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    return {i: root(i) for i, _ in sets}


def family(seed, n, changes):
    """A text and copies of it, each with some words changed; copies of copies drift apart."""
    rng = random.Random(seed)
    texts = [words(seed, 200)]
    for _ in range(n):
        w = rng.choice(texts).split(" ")
        for _ in range(changes):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("size", [2, 5])
def test_components_are_those_of_all_pairs(spark, size):
    texts = family(1, 40, 9) + family(2, 25, 4) + [words(k, 30) for k in range(10, 30)] + ["a", "A", "a b", "", None]
    rng = random.Random(5)
    rng.shuffle(texts)
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size).collect()
    expected = linked_components(rows, size)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert all(r.kept == (r.doc_id == expected[r.doc_id]) and r.n_shingles == len(shingles(texts[r.doc_id // 3], size)) for r in got)


@pytest.mark.parametrize("few", [0, minhash.FEW])
def test_components_of_links(spark, monkeypatch, few):
    monkeypatch.setattr(minhash, "FEW", few)
    rng = random.Random(8)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(70, 70), (9, 3)]
    links = [p if rng.random() < 0.5 else p[::-1] for p in links]
    rng.shuffle(links)
    got = minhash.components(spark.createDataFrame(links, minhash.LINKS).repartition(5), "links").collect()
    expected = {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {70: 70}
    assert sorted(map(tuple, got)) == sorted(expected.items())


def test_few_links_are_joined_without_a_shuffle(spark, monkeypatch):
    links = keep(spark.createDataFrame([(k, k + 1) for k in range(50)], minhash.LINKS).repartition(5), "given")
    plans = []
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(minhash, "keep", lambda df, *rest: plans.append(planned(df)) or keep(df, *rest))
    assert minhash.components(links, "links").select("comp").distinct().count() == 1
    assert plans and not any("Exchange" in p for p in plans)


def test_a_task_of_near_dedup_has_one_python_worker(awkward, monkeypatch):
    plans = []
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(minhash, "keep", lambda df, *rest: plans.append(planned(df)) or keep(df, *rest))
    minhash.near_duplicates(awkward).collect()
    steps = [part.count("MapInArrow") for plan in plans for part in re.split("Exchange|Scan", plan)]
    assert max(steps) == 1


def test_leaks_read_no_rows_of_python_lists(spark, awkward):
    found = leaks.leaks(awkward, spark.createDataFrame([(7, words(1, 300)), (None, words(3, 80))], "item_id bigint, text string"))
    assert {r.item_id for r in found.collect()} == {7, None}
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    expected = linked_components(rows, 2)
    got = minhash.near_duplicates(awkward).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(r.component_id == (expected[r.doc_id] if r.doc_id is not None else None) for r in got)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)
    assert minhash.near_duplicates(nothing).count() == 0


def test_estimates_follow_similarities(spark):
    a = set(range(1, 1001))
    for shared in (200, 700, 900):
        b = set(range(1001 - shared, 2001 - shared))
        found = [minhash.minima(minhash.mix(np.array(sorted(s), np.uint64)), np.array([0, 1000])) for s in (a, b)]
        (_, x), (_, y) = map(minhash.signatures, found)
        df = spark.createDataFrame([(x.view(np.int64)[0].tolist(), y.view(np.int64)[0].tolist())], "a array<bigint>, b array<bigint>")
        assert abs(df.select(minhash.estimate(df.a, df.b)).collect()[0][0] - len(a & b) / len(a | b)) < 0.12


def plain_repeats(rows, size):
    least = {}
    key = lambda i: math.inf if i is None else i
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            least[g] = min(least.get(g, math.inf), key(i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - size + 1) if least[tuple(w[k : k + size])] < key(i) for j in range(size)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def test_repeats_of_awkward_rows(awkward, nothing):
    got = Counter(map(tuple, repeats.without_repeats(awkward).collect()))
    assert got == plain_repeats([(r[0], r[1]) for r in awkward_rows()], 13)
    assert repeats.without_repeats(nothing).count() == 0


def test_frequent_prefixes_and_windows_are_dealt_apart(spark):
    rng = random.Random(3)
    passage = words(7, 40)
    rows = [(k, " ".join([words(k, rng.randrange(30)), passage if k % 2 else "the " * 30, words(k % 9, 20)])) for k in range(300)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    plan = repeats.plan(repeats.named(docs, "doc_id", "text"), 13)
    assert len(plan.windows) and all(len(f) for f in plan.frequent)
    assert Counter(map(tuple, repeats.without_repeats(docs).collect())) == plain_repeats(rows, 13)


def plain_model(rows):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    tokens = [(i, [*(t or "").encode().translate(low).split(), b"\n"]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    ones, pairs = Counter(), Counter()
    for i, w in tokens:
        if not held(i):
            ones.update(w)
            pairs.update(zip([b"\t", *w], w))
    n, v = sum(ones.values()), len(ones)
    after, contexts = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (a, b), c in pairs.items():
        after[a][0] += c
        after[a][min(c, 3)] += 1
        contexts[b] += 1
    d = ngrams.discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    e = ngrams.discounts([sum(c == k for c in contexts.values()) for k in (1, 2, 3, 4)])
    spare = sum(e[min(c, 3)] for c in contexts.values()) / len(pairs) if pairs else 1.0

    def p(a, b):
        low_ = (max(contexts[b] - e[min(contexts[b], 3)], 0) / len(pairs) if pairs else 0) + spare / (v + 1)
        if a not in after:
            return low_
        t, *k = after[a]
        return max(pairs[a, b] - d[min(pairs[a, b], 3)], 0) / t + sum(x * y for x, y in zip(d[1:], k)) / t * low_

    out = []
    for i, w in tokens:
        base = sum(math.log10((ones[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((i, held(i), len(w), sum(ones[x] > 0 for x in w), n, base, sum(math.log10(p(a, b)) for a, b in zip([b"\t", *w], w))))
    return out, p, ones


def model_rows(docs):
    model = ngrams.train(docs.where(~ngrams.held_out(docs.doc_id)))
    rows = ngrams.score(docs, model).withColumn("held", ngrams.held_out(F.col("doc_id"))).collect()
    return sorted(((r.doc_id or 0, r.held, r.n_tokens, r.n_known, model.tokens, r.base_score, r.score) for r in rows), key=lambda r: (r[0], r[2]))


def same_scores(got, expected):
    expected = sorted(((i or 0, *r) for i, *r in expected), key=lambda r: (r[0], r[2]))
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for g, e in zip(got, expected) for a, b in zip(g[5:], e[5:]))


def test_scores_of_awkward_rows(awkward, nothing):
    expected, p, ones = plain_model([(r[0], r[1]) for r in awkward_rows()])
    same_scores(model_rows(awkward), expected)
    assert math.isclose(sum(p(b"word", w) for w in ones) + p(b"word", b"\x00new"), 1)
    assert model_rows(nothing) == []


def test_scores_with_nothing_to_learn_from(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    rows = [(held, "some words")]
    same_scores(model_rows(spark.createDataFrame(rows, "doc_id bigint, text string")), plain_model(rows)[0])


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    rows = [(k, " ".join(f"a{j} b{j}" for j in random.Random(k).choices(range(20), k=60))) for k in range(120)]
    held = [r for r in model_rows(spark.createDataFrame(rows, "doc_id bigint, text string")) if r[1]]
    assert held and sum(r[6] for r in held) > 0.7 * sum(r[5] for r in held)


def item(seed, n):
    return " ".join(f"q{random.Random(seed * 999 + k).randrange(5000)}" for k in range(n))


def test_leaks_are_found_whole_and_reworded(spark):
    items = [(k, item(k, n)) for k, n in enumerate([8, 9, 16, 17, 33, 64, 65, 150, 5])]
    rows, expected = [], set()
    rng = random.Random(6)
    for k, text in items:
        for shift in range(4):
            w = text.split(" ")
            if shift > 1 and len(w) > 8:  # paraphrases: a word changed, one left out, one put in
                w[len(w) // 2] = "other"
                del w[1]
                w.insert(5, "also")
            rows.append((100 * k + shift, f"{words(k * 9 + shift, rng.randrange(90))} {' '.join(w).upper() if shift == 1 else ' '.join(w)} {words(shift, 40)}"))
            expected.add((100 * k + shift, k))
    rows += [(5000 + k, words(k, 200)) for k in range(40)]
    rows += [(6000, " ".join(reversed(items[5][1].split(" ")))), (6001, " ".join(items[5][1].split(" ")[:20]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (None, item(77, 20))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, bench).collect()}
    assert got == expected


def test_leaks_among_other_items_and_repeated_words(spark):
    items = [(k, item(k, n)) for k, n in enumerate([16, 17, 24, 30, 33, 40, 45, 50, 58, 64] * 6)]
    rng = random.Random(8)
    rows, expected = [], set()
    for k in range(20):  # lists of items in a row
        chosen = rng.sample(range(len(items)), 12)
        rows.append((k, " ".join(items[c][1] for c in chosen)))
        expected |= {(k, c) for c in chosen}
    for k, text in items:  # an item beside a rare word of another, repeated
        rare = items[(k + 7) % len(items)][1].split(" ")[3]
        rows.append((100 + k, f"{words(k, 50)} {' '.join([rare] * 40)} {text} {' '.join([rare] * 40)}"))
        expected.add((100 + k, k))
    rows += [(1000 + k, words(k, 200)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == expected


def test_windows_and_items_in_parts_are_those_of_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 60, n) for n in (9, 12, 14, 16, 6)]
    judge = leaks.Judge(leaks.Items(list(range(5)), np.arange(60, dtype=np.uint64), sets), rng.random(60) + 0.1, rng.standard_normal((60, 8)))
    sizes = np.array([100, 3, 70])
    row, position = np.repeat(np.arange(3), sizes), np.concatenate([np.arange(n) for n in sizes])
    cell, first = leaks.cells_of(row, position, sizes, 16)
    word = rng.integers(0, 60, len(row))
    plain = set()
    for w in range(first[-1]):
        d = np.searchsorted(first, w, "right") - 1
        held = set(word[(cell >= w) & (cell < w + 2) & (row == d)].tolist())
        plain |= {(w, k) for k in range(5) if len(judge.answers[k] & held) >= leaks.ANSWERED * len(judge.answers[k])}
    for limit in (1, 7, 50, leaks.FANNED):
        monkeypatch.setattr(leaks, "FANNED", limit)
        got = [p for ws, ks in judge.answering(np.arange(5), cell, word, first) for p in zip(ws.tolist(), ks.tolist())]
        assert len(got) == len(set(got)) and set(got) == plain


def test_leaks_of_blocks_and_awkward_rows(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 3)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate([words(1, 300), item(1, 20), words(3, 80), None, item(2, 9), words(1, 300), "", item(9, 30)])],
                                  "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(awkward, bench).collect()}
    copies = {5, 6, 7, 9, None, -7}  # the text, its near copy, and in capitals
    assert {p for p in got if p[1] in (0, 5)} == {(d, i) for d in copies for i in (0, 5)}
    assert {p[1] for p in got} <= {0, 2, 5}
    assert leaks.leaks(nothing, bench).count() == 0
    assert leaks.leaks(awkward, spark.createDataFrame([], bench.schema)).count() == 0


def test_common_subsequence_is_that_of_the_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        masks = defaultdict(int)
        for k, x in enumerate(a):
            masks[x] |= 1 << k
        assert leaks.common_subsequence(dict(masks), (1 << len(a)) - 1, b) == table[-1][-1]


def test_word_hashes_of_any_text():
    from veil.llm.common import SLICE_BYTES, hash_words

    rng = random.Random(9)
    raw = [bytes(rng.choice(b" \n\tabcXY\xc3\xa9\x00\x1f\x85") for _ in range(rng.randrange(200))) for _ in range(300)]
    raw.append(b"y" * (SLICE_BYTES + 100) + b" zz " + b"y" * (SLICE_BYTES + 100))
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    hashes, starts, ends, first = hash_words(np.frombuffer(b"".join(raw), np.uint8), bounds)
    seen, whole = {}, b"".join(raw)
    for k, text in enumerate(raw):
        own = [whole[a:b] for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])]
        assert own == text.split()
        for w, h in zip(own, hashes[first[k] : first[k + 1]].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert hashlib.sha1(whole).hexdigest()


def test_files_that_no_result_reads_are_deleted(spark):
    import os

    with passing(spark):
        with passing(spark):
            gone, inner, outer = (keep(spark.range(5), f"passing-{k}", k) for k in range(3))
            assert gone.count() == 5
        assert inner.count() == 5
    folders = [f.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] for f in (gone, inner, outer)]
    assert [os.path.exists(f) for f in folders] == [False, False, True] and outer.count() == 5


def test_stages_join_only_rows_that_may_leave(spark, awkward, tmp_path):
    found = minhash.near_duplicates(awkward, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.PERCENT).where("kept")
    kept = {r.doc_id for r in found.collect()}
    out = corpus_pipeline.minhash_dedup(spark, awkward, str(tmp_path))
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert out.columns == awkward.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(r for r in rows if r[0] in kept)
    spark.createDataFrame([(1, words(1, 300))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rest in (out, corpus_pipeline.decontamination(spark, awkward, str(tmp_path))):
        assert rest._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


@pytest.mark.parametrize("gone", [[], [3], [None], [None, 3, 3, 99], list(range(0, 100, 7))])
def test_rows_leave_by_key(spark, gone):
    ids = [None, None, *range(100), 3, 4]
    df = spark.createDataFrame([(k, f"t{k}") for k in ids], "doc_id bigint, text string").repartition(3)
    got = without_rows(df, spark.createDataFrame([(k,) for k in gone], "gone_id bigint"), "doc_id", "gone_id")
    assert Counter(map(tuple, got.collect())) == Counter((k, f"t{k}") for k in ids if k not in gone)
