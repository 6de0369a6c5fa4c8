"""Ranked lexical search of all documents for each of many items: pair-bound MaxScore over an impact index.

The index has shards of up to ``SHARD_DOCS`` documents: for each term that some item asks for, the documents
that hold it and how often. It is written to the shared folder; corpus statistics (documents, terms, document
frequencies) are sums over its rows, so texts are read once for a block of items.

A task searches its shards one after the other and keeps the best of each item, so thresholds rise from shard
to shard. A shard is cut into blocks of documents. Per block, a term has the maximum of its impact, and a pair
of terms that items often ask for together has a list of joint maxima over the documents that hold both.
An item's terms are matched into such pairs: a pair adds no more than its joint maximum, or than one of its
terms alone, where independent bounds would add both maxima. Blocks whose bounds stay below the threshold are
skipped; of the rest, the units (pairs and single terms) whose bounds together stay below it are
non-essential, and only documents of the others are scored, each until the remaining bounds can't lift it.
Bounds are never below a score, so results are exact, whatever pairs were chosen.

Score: terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased, of the whole
text. With N documents that have a term, L terms in all, n terms of a document, document frequency df and tf
occurrences: w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 75 + (25 n N) div L, and a term adds
w ((10^9 tf) div (1000 tf + 12 m)) for each time that the item has it.

Defined cases: null, empty and term-less texts match nothing and don't count in N; null and term-less items give no
rows; repeated rows of documents are documents of their own, items with equal id and text are one; equal
scores go by ascending id, null ids first. Ids of documents are integers. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veil.llm.common import hash_words, keep, slices, text_bytes

SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 20
BLOCK_DOCS = 512
ITEM_CHARS = 1 << 20  # characters of the items that share one reading of the documents
PAIR_TERMS = 16  # most frequent terms of an item that may be matched into pairs; only the speed depends on it

IS_GAP = np.ones(256, bool)
IS_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

SHARD = (
    "n_terms bigint, ids array<bigint>, lengths array<bigint>, slots array<int>, dfs array<int>, places binary, counts binary"
)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term, and for each text the number of its first term."""
    hashes, _, _, first = hash_words(*text_bytes(texts), lower=True, gaps=IS_GAP)
    return hashes, first


@dataclass(frozen=True)
class Items:
    """Items as slots of a sorted vocabulary of term hashes, with the times that each slot is asked for."""

    ids: list
    vocabulary: np.ndarray
    slots: list[np.ndarray]
    times: list[np.ndarray]


def blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """Items in blocks of about ``ITEM_CHARS`` characters, dealt by hash."""
    named = items.select(items[item_id].alias("item_id"), items[text].cast("string").alias("text")).where("text IS NOT NULL").distinct()
    chars = named.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = chars // ITEM_CHARS + 1
    for block in range(n):
        part = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).toArrow()
        if not part.num_rows:
            continue
        hashes, first = terms_of(part.column("text").combine_chunks())
        vocabulary, number = np.unique(hashes, return_inverse=True)
        found = [np.unique(number[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]
        full = [k for k, (slots, _) in enumerate(found) if len(slots)]
        if full:
            ids = part.column("item_id").to_pylist()
            yield Items([ids[k] for k in full], vocabulary, [found[k][0] for k in full], [found[k][1] for k in full])


class Gathered:
    """Postings of the shard that a task is filling."""

    def __init__(self):
        self.ids, self.lengths, self.places, self.slots, self.counts = [], [], [], [], []
        self.docs = self.postings = 0

    def add(self, ids: pa.Array, lengths: np.ndarray, place: np.ndarray, slot: np.ndarray, count: np.ndarray) -> None:
        self.ids.append(ids.cast(pa.int64()))
        self.lengths.append(lengths)
        self.places.append((place + self.docs).astype(np.int32))
        self.slots.append(slot.astype(np.int32))
        self.counts.append(count.astype(np.int32))
        self.docs += len(lengths)
        self.postings += len(slot)

    def row(self) -> pa.RecordBatch:
        lengths, slots = np.concatenate(self.lengths), np.concatenate(self.slots)
        order = np.argsort(slots, kind="stable")  # documents of a term stay in order
        used, dfs = np.unique(slots, return_counts=True)
        ids = pa.concat_arrays(self.ids)

        def one(values, kind):
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

        return pa.record_batch(
            [pa.array([int(lengths.sum())], pa.int64()), one(ids, pa.int64()), one(lengths, pa.int64()),
             one(used, pa.int32()), one(dfs.astype(np.int32), pa.int32()),
             pa.array([np.concatenate(self.places)[order].tobytes()], pa.binary()), pa.array([np.concatenate(self.counts)[order].tobytes()], pa.binary())],
            ["n_terms", "ids", "lengths", "slots", "dfs", "places", "counts"],
        )


def index(docs: DataFrame, items, doc_id: str, text: str) -> DataFrame:
    """Shards of the documents that have a term: lengths, and postings of the terms in the items' vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held = items.value.vocabulary, Gathered()
        for batch in batches:
            for at, end in slices(batch, "text"):
                part = batch.slice(at, end - at)
                hashes, first = terms_of(part.column("text"))
                lengths = np.diff(first)
                rows = np.flatnonzero(lengths)
                if not len(rows):
                    continue
                slot = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = np.flatnonzero(vocabulary[slot] == hashes)
                rank = np.zeros(len(lengths), np.int64)
                rank[rows] = np.arange(len(rows))
                doc = rank[np.repeat(np.arange(len(lengths)), lengths)[known]]
                keys, counts = np.unique(doc * len(vocabulary) + slot[known], return_counts=True)
                held.add(part.column("doc_id").take(pa.array(rows)), lengths[rows], keys // len(vocabulary), keys % len(vocabulary), counts)
                if held.docs >= SHARD_DOCS or held.postings >= SHARD_POSTINGS:
                    yield held.row()
                    held = Gathered()
        if held.docs:
            yield held.row()

    picked = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    return picked.mapInArrow(run, SHARD)


@dataclass(frozen=True)
class Asked:
    """What a search needs: items with their units, weights of slots, pairs with joint maxima, and the corpus' size."""

    slots: list[np.ndarray]
    times: list[np.ndarray]
    units: list[np.ndarray]  # per item, rows (place of a term, place of the other or -1, number of the pair or -1)
    weights: np.ndarray
    pairs: list[tuple[int, int]]
    docs: int
    terms: int
    k: int


def matched(items: Items, dfs: np.ndarray) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Terms of each item matched into pairs, those first that many items ask for; the rest stay single."""
    common, popular = [], Counter()
    for slots in items.slots:
        order = np.argsort(-dfs[slots], kind="stable")[:PAIR_TERMS]
        mine = sorted(int(slots[k]) for k in order if dfs[slots[k]])
        common.append(mine)
        popular.update((a, b) for i, a in enumerate(mine) for b in mine[i + 1 :])
    numbers: dict[tuple[int, int], int] = {}
    units = []
    for slots, mine in zip(items.slots, common):
        place = {int(s): k for k, s in enumerate(slots)}
        rows, free = [], set(mine)
        candidates = [(a, b) for i, a in enumerate(mine) for b in mine[i + 1 :]]
        for a, b in sorted(candidates, key=lambda p: (-popular[p], -min(dfs[p[0]], dfs[p[1]]), p)):
            if a in free and b in free:
                free -= {a, b}
                rows.append((place[a], place[b], numbers.setdefault((a, b), len(numbers))))
        taken = {r[0] for r in rows} | {r[1] for r in rows}
        rows += [(k, -1, -1) for k in range(len(slots)) if k not in taken]
        units.append(np.array(rows, np.int64))
    return units, list(numbers)


class Shard:
    """Impacts of one shard: per term its documents, per block the maxima of terms and of pairs of terms."""

    def __init__(self, own: Asked, ids: np.ndarray, lengths: np.ndarray, slots: np.ndarray, dfs: np.ndarray, places: np.ndarray, counts: np.ndarray):
        self.docs, self.blocks = len(lengths), -(-len(lengths) // BLOCK_DOCS)
        self.ids, self.places = ids, places
        scale = np.array([75 + 25 * n * own.docs // own.terms for n in lengths.tolist()], np.int64)
        tf = counts.astype(np.int64)
        owner = np.repeat(slots, dfs)
        self.impacts = own.weights[owner] * ((1_000_000_000 * tf) // (1000 * tf + 12 * scale[places]))
        self.ends = np.cumsum(dfs)
        self.row = np.full(len(own.weights), -1, np.int64)
        self.row[slots] = np.arange(len(slots))
        self.block = places // BLOCK_DOCS
        self.highest = np.zeros((len(slots) + 1, self.blocks), np.int64)  # the last row is that of absent terms
        if len(places):
            cell = np.repeat(np.arange(len(slots)), dfs) * self.blocks + self.block
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            self.highest.reshape(-1)[cell[starts]] = np.maximum.reduceat(self.impacts, starts)
        self.joint = np.zeros((len(own.pairs), self.blocks), np.int64)
        by_first: dict[int, list[tuple[int, int]]] = {}
        for number, (a, b) in enumerate(own.pairs):
            if self.row[a] >= 0 and self.row[b] >= 0:
                by_first.setdefault(a, []).append((number, b))
        dense = np.zeros(self.docs, np.int64)
        for a, others in by_first.items():
            mine, theirs = self.postings(a)
            dense[mine] = theirs + 1  # an impact may be 0
            for number, b in others:
                docs, impacts = self.postings(b)
                both = np.flatnonzero(dense[docs])
                if len(both):
                    block = docs[both] // BLOCK_DOCS
                    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                    self.joint[number, block[starts]] = np.maximum.reduceat(impacts[both] + dense[docs[both]] - 1, starts)
            dense[mine] = 0

    def postings(self, slot: int) -> tuple[np.ndarray, np.ndarray]:
        row = self.row[slot]
        if row < 0:
            return self.places[:0], self.impacts[:0]
        at = self.ends[row - 1] if row else 0
        return self.places[at : self.ends[row]], self.impacts[at : self.ends[row]]

    def bounds(self, slots: np.ndarray, times: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Per unit and block: no document of the block gets more from the unit's terms."""
        first, second, pair = units.T
        alone = self.highest[self.row[slots]] * times[:, None]
        other = np.where(second[:, None] >= 0, alone[second], 0)
        joint = np.where(pair[:, None] >= 0, self.joint[pair], 0) if len(self.joint) else np.zeros_like(other)
        joint *= np.maximum(times[first], times[second])[:, None]
        return np.maximum(np.maximum(alone[first], other), np.minimum(alone[first] + other, joint))

    def best(self, slots: np.ndarray, times: np.ndarray, units: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that score ``least`` or more, the best k of them at least, and their scores."""
        nothing = np.zeros(0, np.int64)
        bounds = self.bounds(slots, times, units)
        live = bounds.sum(axis=0) >= least
        if not live.any():
            return nothing, nothing
        highest = bounds[:, live].max(axis=1)
        order = np.argsort(highest, kind="stable")
        below = np.concatenate([[0], np.cumsum(highest[order])])  # of the units before
        spare = int(np.searchsorted(below[1:], least))
        score, seen = np.zeros(self.docs, np.int64), np.zeros(self.docs, bool)

        def terms(unit):
            return [p for p in units[unit][:2] if p >= 0]

        for unit in order[spare:]:
            for p in terms(unit):
                docs, impacts = self.postings(slots[p])
                score[docs] += times[p] * impacts
                seen[docs] = True
        found = np.flatnonzero(seen & np.repeat(live, BLOCK_DOCS)[: self.docs])
        for rest in range(spare - 1, -1, -1):
            found = found[score[found] + below[rest + 1] >= least]
            if not len(found):
                return nothing, nothing
            for p in terms(order[rest]):
                docs, impacts = self.postings(slots[p])
                if 8 * len(found) < len(docs):
                    at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                    score[found] += np.where(docs[at] == found, times[p] * impacts[at], 0)
                else:
                    score[docs] += times[p] * impacts
        found = found[score[found] >= least]
        scores = score[found]
        if len(found) > k:
            cut = np.partition(scores, len(found) - k)[len(found) - k]
            found, scores = found[scores >= cut], scores[scores >= cut]
        return found, scores


def searched(shards: DataFrame, asked) -> DataFrame:
    """The best documents of each item among the shards of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = asked.value
        best: list[list[tuple]] = [[] for _ in own.slots]
        for batch in batches:
            for r in range(batch.num_rows):
                lengths, slots, dfs = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("lengths", "slots", "dfs"))
                places, counts = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int32) for c in ("places", "counts"))
                shard = Shard(own, batch.column("ids")[r].values, lengths, slots, dfs, places, counts)
                for n, held in enumerate(best):
                    least = max(held[-1][0], 1) if len(held) == own.k else 1
                    found, scores = shard.best(own.slots[n], own.times[n], own.units[n], least, own.k)
                    if len(found):
                        ids = shard.ids.take(pa.array(found)).to_pylist()
                        best[n] = heapq.nsmallest(own.k, [*held, *zip(scores.tolist(), ids)], key=lambda h: (-h[0], h[1] is not None, h[1] or 0))
        rows = [(n, score, doc) for n, held in enumerate(best) for score, doc in held]
        columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.record_batch(columns, ["item", "score", "doc_id"])

    return shards.mapInArrow(run, "item int, score bigint, doc_id bigint")


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Per item its ``k`` highest-scoring documents: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for block in blocks(items, item_id, item_text):
        shards = keep(index(docs, spark.sparkContext.broadcast(block), doc_id, text), "search-index")
        n, terms = shards.agg(F.sum(F.size("ids")), F.sum("n_terms")).first()
        if not n:
            continue
        dfs = np.zeros(len(block.vocabulary), np.int64)
        counted = shards.select(F.explode(F.arrays_zip("slots", "dfs")).alias("t")).groupBy("t.slots").agg(F.sum("t.dfs").alias("df")).toArrow()
        dfs[counted.column("slots").to_numpy()] = counted.column("df").to_numpy()
        units, pairs = matched(block, dfs)
        weights = np.array([weight(n, int(d)) for d in dfs], np.int64)
        asked = spark.sparkContext.broadcast(Asked(block.slots, block.times, units, weights, pairs, n, terms, k))
        found = searched(shards, asked)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
        found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        first = Window.partitionBy("item", "part").orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        final = Window.partitionBy("item").orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
        out = out.unionByName(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
