"""A bigram language model with interpolated modified Kneser-Ney smoothing.

Counting: tasks reduce slices of texts to different (context, word) pairs and pack them by shards of
contexts; a frequent context is dealt to all shards by the words after it. A shard adds up its pairs, what
follows each context once, twice or more often, and the contexts each word follows; the last go on to shards
of words. Discounts come from the numbers of pairs and words seen once to four times.

Storage: each shard is a file of arrays sorted by hash, written by Spark's text sink (whose strings hold any
bytes) to the shared folder. Workers map the files into memory and look up sorted batches of hashes, so a
model larger than memory costs page reads, not memory. Where the folder is not mounted, files are read
through pyarrow's file systems.

Defined cases: null and empty texts have one token, their end; the first word follows a start that is never
scored; without training texts counts are zero, and every token has the probability of an unknown one; rows
repeated count and score each on their own; a null id counts as training.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.common import hash_words, mix, slices, text_bytes
from veil.session import shared_path

END, START = np.uint64(0x1), np.uint64(0x2)
ODD = np.uint64(0xD6E8FEB86659FD93)
SHARD_TOKENS = 3_000_000
BYTES_A_TOKEN = 6
FREQUENT = 1024  # a context with more than one in so many tokens is dealt to all shards
SLICE = 4 << 20
ADD = 0.1
WORD_BITS = 40  # of a word's hash, inside pairs
BLOCKS = "kind string, shard bigint, block binary"
KINDS = {"pairs": ("n",), "contexts": ("total", "once", "twice", "more"), "before": ("n",)}


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts with an end each, the token before each, and where each text starts."""
    data, bounds = text_bytes(texts)
    words, _, _, first = hash_words(data, bounds, lower=True)
    n = len(texts)
    starts = first + np.arange(n + 1)
    tokens = np.empty(len(words) + n, np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[starts[1:] - 1] = True
    tokens[is_end], tokens[~is_end] = END, words
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = START
    return tokens, before, starts


def word_part(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(64 - WORD_BITS)


def pair_keys(contexts: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return mix(contexts * ODD + mix(parts))


def shard_of(contexts: np.ndarray, parts: np.ndarray, frequent: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a pair: that of its context, or of both if the context is frequent."""
    often = np.isin(contexts, frequent)
    return (mix(np.where(often, pair_keys(contexts, parts), contexts)) % np.uint64(shards)).astype(np.int64)


def narrow(parts: np.ndarray) -> bytes:
    return np.ascontiguousarray(parts.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, : WORD_BITS // 8].tobytes()


def wide(raw) -> np.ndarray:
    found = np.zeros((len(raw) // (WORD_BITS // 8), 8), np.uint8)
    found[:, : WORD_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(len(found), -1)
    return found.view(np.uint64).ravel()


def small(counts: np.ndarray) -> bytes:
    """Counts, nearly all of them 1, packed."""
    return zlib.compress(counts.astype(np.uint32).tobytes(), 1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    ranked = keys[order]
    edges = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return ranked[edges], np.add.reduceat(counts[order], edges)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[c.split() for c in schema.split(", ")])
    types = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], list(names))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end in slices(batch, "text", SLICE):
            yield batch.slice(at, end - at)


# counting --------------------------------------------------------------------------------------

PACKED = "shard bigint, contexts binary, sizes binary, words binary, counts binary"


def frequent_contexts(texts: DataFrame, n_tokens: int) -> np.ndarray:
    """Contexts with more than about one in ``FREQUENT`` tokens: fewer than twice as many, whatever the data."""

    def run(batches):
        for batch in sliced(batches):
            contexts, counts = np.unique(token_hashes(batch.column("text"))[1], return_counts=True)
            often = counts * FREQUENT > counts.sum()
            yield pa.record_batch([pa.array(contexts[often].view(np.int64)), pa.array(counts[often])], ["context", "n"])

    found = texts.mapInArrow(run, "context bigint, n bigint").groupBy("context").agg(F.sum("n").alias("n"))
    kept = found.where(F.col("n") * 2 * FREQUENT > n_tokens).select("context").toArrow()
    return np.sort(kept.column("context").to_numpy().view(np.uint64))


def packed_pairs(texts: DataFrame, frequent: np.ndarray, shards: int) -> DataFrame:
    """Different pairs of each slice by shard: contexts, how many words each has, words, counts."""

    def run(batches):
        for batch in sliced(batches):
            tokens, before, _ = token_hashes(batch.column("text"))
            parts = word_part(tokens)
            order = np.lexsort((parts, before))
            b, w = before[order], parts[order]
            edges = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (w[1:] != w[:-1])]))
            counts, b, w = np.diff(np.append(edges, len(b))), b[edges], w[edges]
            shard = shard_of(b, w, frequent, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[k] : cuts[k + 1]]
                heads = np.flatnonzero(np.concatenate([[True], b[mine][1:] != b[mine][:-1]]))
                sizes = np.diff(np.append(heads, len(mine)))
                rows.append((int(k), b[mine][heads].tobytes(), small(sizes), narrow(w[mine]), small(counts[mine])))
            yield batch_of(rows, PACKED)

    return texts.mapInArrow(run, PACKED)


def block(*columns: np.ndarray) -> bytes:
    """Row count and columns, each a multiple of eight bytes; with the sink's line end the length is one, too."""
    out = [np.array([len(columns[0])], np.int64).tobytes()]
    for column in columns:
        raw = np.ascontiguousarray(column).tobytes()
        out.append(raw + b"\0" * (-len(raw) % 8))
    return b"".join(out) + b"\0" * 7


def tail_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def count_shard(table: pa.Table, frequent: np.ndarray) -> pa.Table:
    """The sorted arrays of one shard, its part of frequent contexts, the contexts of each word, its numbers."""
    contexts, parts, counts = [], [], []
    for row in table.to_batches():
        for c, s, w, n in zip(*[row.column(k) for k in ("contexts", "sizes", "words", "counts")]):
            sizes = np.frombuffer(zlib.decompress(s.as_py()), np.uint32)
            contexts.append(np.repeat(np.frombuffer(c.as_py(), np.uint64), sizes))
            parts.append(wide(w.as_py()))
            counts.append(np.frombuffer(zlib.decompress(n.as_py()), np.uint32))
    contexts, parts, counts = np.concatenate(contexts), np.concatenate(parts), np.concatenate(counts).astype(np.int64)
    keys = pair_keys(contexts, parts)
    order = np.argsort(keys)
    edges = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    first = order[edges]
    keys, contexts, parts, counts = keys[first], contexts[first], parts[first], np.add.reduceat(counts[order], edges)
    del order, first

    many = counts > 254
    pairs = block(keys, np.minimum(counts, 255).astype(np.uint8)) + block(keys[many], counts[many])
    by = np.argsort(contexts)
    heads = np.flatnonzero(np.concatenate([[True], contexts[by][1:] != contexts[by][:-1]]))
    stats = [np.add.reduceat(x[by].astype(np.int64), heads) for x in (counts, counts == 1, counts == 2, counts > 2)]
    heads = contexts[by][heads]
    often = np.isin(heads, frequent)
    words, followed = summed(parts, np.ones(len(parts), np.int64))
    shard = table.column("shard")[0].as_py()
    known = heads[~often & (heads != START)]
    numbers = np.array([*tail_counts(counts), len(counts), counts.sum(), len(known)], np.int64)
    rows = [
        ("pairs", shard, pairs),
        ("contexts", shard, block(heads[~often], *[x[~often].astype(np.uint32) for x in stats])),
        ("frequent", shard, block(heads[often], *[x[often] for x in stats])),
        ("followed", shard, block(words, followed)),
        ("numbers", shard, block(numbers)),
    ]
    return pa.Table.from_batches([batch_of(rows, BLOCKS)])


def columns_of(raw, *kinds) -> list[np.ndarray]:
    """The columns of a block; further blocks may follow after its padding."""
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += -(-n * np.dtype(kind).itemsize // 8) * 8
    return [*out, at]


def write_blocks(rows: DataFrame, path: str) -> None:
    """A file for every kind and shard: one value of the text sink each, bytes as they are."""
    rows.select("kind", "shard", F.col("block").cast("string")).write.partitionBy("kind", "shard").mode("append").text(path)


def read_blocks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/kind={kind}").select("content")


@dataclass(frozen=True)
class Model:
    """What tasks need besides the files: numbers, discounts, and the few frequent contexts."""

    path: str
    shards: int
    frequent: np.ndarray
    stats: tuple[np.ndarray, ...]  # of frequent contexts
    tokens: int
    words: int
    pairs: int
    discounts: np.ndarray  # of pairs seen once, twice, more often; 0 first
    lower: np.ndarray  # the same of words by the number of their contexts
    spare: float  # what the lower order leaves to all words alike


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts from the numbers seen once to four times; none where these are zero."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *[min(max(d, 0.1), k + 0.9) for k, d in enumerate(raw)]])


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count, smooth and store; the driver sees sums and the few frequent contexts."""
    spark = docs.sparkSession
    texts = docs.select(docs[text].cast("string").alias("text"))
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")).collect()[0][0] or 0
    n_tokens = size // BYTES_A_TOKEN
    shards = max(4, -(-n_tokens // SHARD_TOKENS))
    frequent = frequent_contexts(texts, n_tokens)
    shared = spark.sparkContext.broadcast(frequent)
    path = shared_path(spark, "ngrams")
    counted = packed_pairs(texts, frequent, shards).groupBy("shard").applyInArrow(lambda t: count_shard(t, shared.value), BLOCKS)
    none = np.zeros(0, np.int64)
    blank = [("frequent", block(none, none, none, none, none)), ("followed", block(none, none)), ("numbers", block(np.zeros(7, np.int64)))]
    write_blocks(counted.unionByName(spark.createDataFrame([(k, -1, bytearray(b)) for k, b in blank], BLOCKS)), path)

    def numbers(batches):
        for batch in batches:
            rows = [columns_of(c.as_py(), np.int64)[0] for c in batch.column(0)]
            yield pa.record_batch([pa.array(np.stack(rows)[:, k]) for k in range(7)], [f"n{k}" for k in range(7)])

    sums = read_blocks(spark, path, "numbers").mapInArrow(numbers, ", ".join(f"n{k} bigint" for k in range(7)))
    totals = np.array(sums.agg(*[F.sum(f"n{k}") for k in range(7)]).collect()[0], np.int64)

    def parts(batches):
        for batch in batches:
            for c in batch.column(0):
                *cells, _ = columns_of(c.as_py(), np.uint64, *[np.int64] * 4)
                yield pa.record_batch([pa.array(cells[0].view(np.int64)), *[pa.array(x) for x in cells[1:]]], ["context", *KINDS["contexts"]])

    names = KINDS["contexts"]
    often = read_blocks(spark, path, "frequent").mapInArrow(parts, ", ".join(f"{c} bigint" for c in ("context", *names)))
    table = often.groupBy("context").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    order = np.argsort(table.column("context").to_numpy().view(np.uint64))
    heads, *stats = [table.column(c).to_numpy()[order] for c in ("context", *names)]
    heads = heads.view(np.uint64)

    def by_word(batches):
        for batch in batches:
            for c in batch.column(0):
                words, n, _ = columns_of(c.as_py(), np.uint64, np.int64)
                shard = (mix(words) % np.uint64(shards)).astype(np.int64)
                rank = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[rank], np.arange(shards + 1))
                yield batch_of([(int(k), narrow(words[at := rank[cuts[k] : cuts[k + 1]]]), small(n[at]))
                                for k in np.flatnonzero(np.diff(cuts))], "shard bigint, words binary, counts binary")

    def merge(table: pa.Table) -> pa.Table:
        words = np.concatenate([wide(c.as_py()) for c in table.column("words")])
        n = np.concatenate([np.frombuffer(zlib.decompress(c.as_py()), np.uint32) for c in table.column("counts")]).astype(np.int64)
        words, n = summed(words, n)
        spread = np.array([*tail_counts(n), (n > 2).sum()], np.int64)
        shard = table.column("shard")[0].as_py()
        rows = [("before", shard, block(words, n.astype(np.uint32))), ("spread", shard, block(spread))]
        return pa.Table.from_batches([batch_of(rows, BLOCKS)])

    followed = read_blocks(spark, path, "followed").mapInArrow(by_word, "shard bigint, words binary, counts binary")
    rows = followed.groupBy("shard").applyInArrow(merge, BLOCKS)
    write_blocks(rows.unionByName(spark.createDataFrame([("spread", -1, bytearray(block(np.zeros(5, np.int64))))], BLOCKS)), path)

    def spreads(batches):
        for batch in batches:
            found = np.stack([columns_of(c.as_py(), np.int64)[0] for c in batch.column(0)])
            yield pa.record_batch([pa.array(found[:, k]) for k in range(5)], [f"n{k}" for k in range(5)])

    seen = read_blocks(spark, path, "spread").mapInArrow(spreads, ", ".join(f"n{k} bigint" for k in range(5)))
    u = np.array(seen.agg(*[F.sum(f"n{k}") for k in range(5)]).collect()[0], np.int64)
    lower = discounts(u[:4])
    n_pairs = int(totals[4])
    spare = float(lower[1] * u[0] + lower[2] * u[1] + lower[3] * u[4]) / n_pairs if n_pairs else 1.0
    n_words = int(totals[6] + (heads != START).sum() + (totals[5] > 0))  # contexts without the start, and the end
    return Model(path, shards, heads, tuple(stats), int(totals[5]), n_words, n_pairs, discounts(totals[:4]), lower, spare)


# lookups ---------------------------------------------------------------------------------------


@functools.lru_cache(4096)
def stored(path: str, kind: str, shard: int) -> np.ndarray:
    """The bytes of a shard, mapped into memory where the folder is mounted; empty if there is no such shard."""
    folder = f"{path}/kind={kind}/shard={shard}"
    local = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")
    if local.startswith("/"):
        names = [n for n in os.listdir(local) if n.startswith("part-")] if os.path.isdir(local) else []
        return np.memmap(f"{local}/{names[0]}", np.uint8, "r") if names else np.zeros(0, np.uint8)
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    names = [f.path for f in found if f.base_name.startswith("part-")]
    if not names:
        return np.zeros(0, np.uint8)
    with system.open_input_file(names[0]) as source:
        return np.frombuffer(source.read_buffer(), np.uint8)


def find(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted ``sought`` in sorted ``keys``, and which are there."""
    if not len(keys):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    place = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return place, keys[place] == sought


def looked_up(model: Model, kind: str, shard: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """Columns of ``kind`` for keys in their shards, zero where there is none."""
    width = len(KINDS[kind])
    order = np.lexsort((keys, shard))
    s, k = shard[order], keys[order]
    edges = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])) if len(k) else np.zeros(0, np.int64)
    once, at = k[edges], s[edges]
    out = [np.zeros(len(once), np.int64) for _ in range(width)]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])), len(at)) if len(at) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        raw = stored(model.path, kind, int(at[lo]))
        if not len(raw):
            continue
        types = [np.uint8] if kind == "pairs" else [np.uint32] * width
        own, *columns, end = columns_of(raw, np.uint64, *types)
        place, there = find(own, once[lo:hi])
        for target, column in zip(out, columns):
            target[lo:hi][there] = column[place[there]]
        if kind == "pairs":
            high = np.flatnonzero(out[0][lo:hi] == 255)
            if len(high):
                large, n, _ = columns_of(raw[end + 7 :], np.uint64, np.int64)
                place, there = find(large, once[lo:hi][high])
                out[0][lo:hi][high[there]] = n[place[there]]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(np.isin(np.arange(len(k)), edges, assume_unique=True)) - 1
    return [column[back] for column in out]


def context_stats(model: Model, contexts: np.ndarray) -> list[np.ndarray]:
    """How often each context was seen, and how many words follow it once, twice, more often."""
    place, often = find(model.frequent, contexts)
    found = looked_up(model, "contexts", shard_of(contexts, word_part(contexts), np.zeros(0, np.uint64), model.shards), contexts)
    return [np.where(often, s[place] if len(s) else 0, f) for s, f in zip(model.stats, found)]


def token_scores(model: Model, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: its count, the base log10 and the model's log10 probability."""
    distinct, back = np.unique(np.append(before, tokens), return_inverse=True)
    stats = [x[back] for x in context_stats(model, np.where(distinct == END, START, distinct))]  # as many ends as starts
    count = stats[0][len(tokens) :]
    total, once, twice, more = (x[: len(tokens)].astype(float) for x in stats)
    base = np.log10((count + ADD) / (model.tokens + ADD * (model.words + 1)))

    parts = word_part(tokens)
    n = looked_up(model, "before", (mix(parts) % np.uint64(model.shards)).astype(np.int64), parts)[0]
    low = model.spare / (model.words + 1)
    if model.pairs:
        low = low + np.maximum(n - model.lower[np.minimum(n, 3)], 0) / model.pairs
    c = looked_up(model, "pairs", shard_of(before, parts, model.frequent, model.shards), pair_keys(before, parts))[0]
    d = model.discounts
    some = np.maximum(total, 1)
    share = np.where(total > 0, (d[1] * once + d[2] * twice + d[3] * more) / some, 1.0)
    p = np.where(total > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / some, 0.0) + share * low
    return count, base, np.log10(p)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``n_tokens``, ``n_known``, ``base_score`` and ``score``; perplexity is 10 ** (-score / n_tokens)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            tokens, before, starts = token_hashes(batch.column("text"))
            count, base, full = token_scores(shared.value, tokens, before)
            sums = [np.add.reduceat(x, starts[:-1]) for x in ((count > 0).astype(np.int64), base, full)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(starts)), *[pa.array(x) for x in sums]],
                                  ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))
