"""Benchmark decontamination by latent semantic retrieval, confirmed word by word.

Documents are reduced once to the places of benchmark words: what other words stand between them matters to
none of the steps. From these come document frequencies over all passages, a randomised SVD of the TF-IDF
passages (one power iteration, sums in Spark, small factors on the driver), and latent vectors of windows.
Windows of two to four times an item's size, half overlapping, hold any copy of it whole. A window is compared
with an item by what it holds of that item's words, each as often as the item has it at most: neighbours, be
they other items or a word repeated often, change nothing, and a whole copy has a cosine of one. Windows whose
cosine is high enough are candidates; a candidate is a leak if most of the item's words stand in it in their
order and half of its answer, its rarest words, stands in it at all. So small changes of wording do not hide
a copy. Windows without half of the answer, or with too few of the item's words in any order, cannot be leaks
and are left out before. Items are the query set: they are taken in blocks of ``BLOCK_ITEMS``, each against
all documents.

Defined cases: null and empty texts and items have no words and match nothing; items that are equal match
alike; repeated rows give equal rows once; a null id is reported as null.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import hash_words, keep, mapped, text_bytes

BLOCK_ITEMS = 2000
PASSAGE = 64  # words of a passage in the statistics
DIMENSIONS, SPARE = 128, 8
MAX_SHARE = 0.003  # words in more than this share of passages have no weight,
LEAST_WEIGHTED = 8  # except the rarest words of each item
COSINE = 0.35
ORDERED = 0.6
ANSWER_WORDS, ANSWERED = 8, 0.5
LEAST_WORDS = 8  # shorter items must be there whole
CELL = 8
FANNED = 2_000_000  # pairs of windows and items looked at together


@dataclass(frozen=True)
class Items:
    """A block of benchmark items as numbers of their words in a sorted vocabulary of word hashes."""

    ids: list
    vocabulary: np.ndarray
    words: list[np.ndarray]

    @property
    def kind(self):
        return np.uint16 if len(self.vocabulary) < 1 << 16 else np.uint32


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """Items in a fixed order, at most ``BLOCK_ITEMS`` at a time; those without a text match nothing."""
    named = benchmark.select(benchmark[item_id].alias("item_id"), benchmark[text].cast("string").alias("text")).where("text IS NOT NULL").distinct()
    number = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    rows = named.withColumn("key", F.concat(F.col("item_id").isNotNull().cast("string"), number, F.lit("\x00"), "text"))
    last = ""
    while True:
        part = rows.where(F.col("key") > F.lit(last)).orderBy("key").limit(BLOCK_ITEMS).toArrow()
        if not part.num_rows:
            return
        last = part.column("key")[-1].as_py()
        data, bounds = text_bytes(part.column("text").combine_chunks())
        hashes, _, _, first = hash_words(data, bounds, lower=True)
        vocabulary, numbers = np.unique(hashes, return_inverse=True)
        words = [numbers[a:b] for a, b in zip(first[:-1], first[1:])]
        full = [k for k, w in enumerate(words) if len(w)]
        if full:
            ids = part.column("item_id").to_pylist()
            yield Items([ids[k] for k in full], vocabulary, [words[k] for k in full])
        if part.num_rows < BLOCK_ITEMS:
            return


def places(docs: DataFrame, items, doc_id: str, text: str) -> DataFrame:
    """Per document with benchmark words: their positions and numbers in the vocabulary."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = items.value
        data, bounds = text_bytes(batch.column("text"))
        hashes, _, _, first = hash_words(data, bounds, lower=True)
        number = np.minimum(np.searchsorted(own.vocabulary, hashes), len(own.vocabulary) - 1)
        known = np.flatnonzero(own.vocabulary[number] == hashes)
        edges = np.searchsorted(known, first)
        rows = np.flatnonzero(np.diff(edges))
        position = (known - np.repeat(first[:-1], np.diff(edges))).astype(np.uint32)
        words = number[known].astype(own.kind)
        spans = [(edges[r], edges[r + 1]) for r in rows]
        yield pa.record_batch(
            [batch.column("doc_id").take(pa.array(rows)), pa.array((first[rows + 1] - first[rows]).astype(np.int64)),
             pa.array([position[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([words[a:b].tobytes() for a, b in spans], pa.binary())],
            ["doc_id", "n_words", "position", "word"],
        )

    kind = docs.schema[doc_id].dataType.simpleString()
    return mapped(docs, {"doc_id": doc_id, "text": text}, f"doc_id {kind}, n_words bigint, position binary, word binary", work)


CHUNK_WORDS = 400_000


def chunks(batches: Iterator[pa.RecordBatch], kind) -> Iterator[tuple]:
    """Documents in chunks: ids, row, position and number of each benchmark word, words of each document."""
    ids, positions, words, sizes, held = [], [], [], [], 0
    for batch in batches:
        for doc, n, p, w in zip(*[batch.column(k) for k in range(4)]):
            ids.append(doc.as_py())
            sizes.append(n.as_py())
            positions.append(np.frombuffer(p.as_buffer(), np.uint32))
            words.append(np.frombuffer(w.as_buffer(), kind))
            held += len(words[-1])
            if held >= CHUNK_WORDS:
                yield packed(ids, positions, words, sizes)
                ids, positions, words, sizes, held = [], [], [], [], 0
    if ids:
        yield packed(ids, positions, words, sizes)


def packed(ids, positions, words, sizes):
    row = np.repeat(np.arange(len(ids)), [len(w) for w in words])
    return ids, row, np.concatenate(positions).astype(np.int64), np.concatenate(words).astype(np.int64), np.array(sizes)


def cells_of(row: np.ndarray, position: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of ``width`` words that each place is in, and the first cell of each document."""
    count = sizes // width + 1
    first = np.concatenate([[0], np.cumsum(count)])
    return first[row] + position // width, first


def summed(rows: DataFrame, key: str, width: int) -> np.ndarray:
    """Sums of vectors by key, as a matrix; there are as many keys as words of the block."""
    table = rows.groupBy(key).agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(width)]).toArrow()
    order = table.column(key).to_numpy()
    return order, np.stack([table.column(f"v{k}").to_numpy() for k in range(width)], axis=1) if len(order) else np.zeros((0, width))


def vectors(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    n, k = values.shape
    flat = pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel())
    return pa.record_batch([pa.array(keys.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), flat)],
                           ["key", "v"])


def by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    edges = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return ranked[edges], np.add.reduceat(values[order], edges) if len(edges) else values[:0]


def idf(found: DataFrame, items: Items) -> np.ndarray:
    """Weights from the share of passages of all documents that hold each word.

    Words in many passages have none, so that the latent space tells items apart; each item keeps its rarest.
    """
    kind = items.kind

    def run(batches):
        for _, row, position, word, sizes in chunks(batches, kind):
            cell, first = cells_of(row, position, sizes, PASSAGE)
            pairs = np.unique(cell * len(items.vocabulary) + word)
            keys, counts = np.unique(pairs % len(items.vocabulary), return_counts=True)
            yield vectors(np.append(keys, -1), np.append(counts, first[-1])[:, None])

    keys, sums = summed(found.mapInArrow(run, "key bigint, v array<double>"), "key", 1)
    total = sums[keys == -1].sum()
    df = np.zeros(len(items.vocabulary))
    df[keys[keys >= 0]] = sums[keys >= 0, 0]
    heavy = df <= MAX_SHARE * total
    for words in items.words:
        own = np.unique(words)
        heavy[own[np.argsort(df[own], kind="stable")[:LEAST_WEIGHTED]]] = True
    return np.where(heavy, np.log((total + 2) / (df + 1)), 0.0)


def passages(row, position, word, sizes, weight):
    """TF-IDF entries of passages: their number, the word, and the value, each passage of length one."""
    cell, _ = cells_of(row, position, sizes, PASSAGE)
    heavy = weight[word] > 0
    cell, word = cell[heavy], word[heavy]
    norms = np.sqrt(np.bincount(cell, weight[word] ** 2, minlength=int(cell[-1]) + 1 if len(cell) else 1))
    return cell, word, (weight[word] / norms[cell]).astype(np.float32)


def basis(found: DataFrame, items: Items, weight: np.ndarray, seed: int = 7) -> np.ndarray:
    """Right singular vectors of the passages' TF-IDF matrix A: Y = A'AX for random X, then the SVD of AQ.

    The items are passages of A, too, and together weigh as much as those of all documents: else the few
    directions that are kept would tell frequent words apart and not items.
    """
    kind, terms = items.kind, len(items.vocabulary)
    width = min(DIMENSIONS + SPARE, terms)
    context = found.sparkSession.sparkContext

    def product(batches, factor, transposed):
        total = np.zeros((terms if transposed else width, width))
        for _, row, position, word, sizes in chunks(batches, kind):
            cell, word, value = passages(row, position, word, sizes, weight)
            if not len(cell):
                continue
            own, image = by_key(cell, factor[word] * value[:, None])
            if transposed:
                keys, sums = by_key(word, image[np.searchsorted(own, cell)] * value[:, None])
                total[keys] += sums
            else:
                total += image.T @ image
        yield vectors(np.arange(len(total)), total)

    x = context.broadcast(np.random.default_rng(seed).standard_normal((terms, width)).astype(np.float32))
    keys, sums = summed(found.mapInArrow(lambda b: product(b, x.value, True), "key bigint, v array<double>"), "key", width)
    y = np.zeros((terms, width))
    y[keys] = sums
    own = np.zeros((len(items.words), terms), np.float32)
    for k, words in enumerate(items.words):
        np.add.at(own[k], words, weight[words])
    own = unit(own)
    y += own.T @ (own @ x.value) * share(y, own.T @ (own @ x.value))
    q, _ = np.linalg.qr(y)
    shared = context.broadcast(q.astype(np.float32))
    keys, sums = summed(found.mapInArrow(lambda b: product(b, shared.value, False), "key bigint, v array<double>"), "key", width)
    gram = np.zeros((width, width))
    gram[keys] = sums
    image = own @ q
    gram += image.T @ image * share(gram, image.T @ image)
    values, vectors_ = np.linalg.eigh(gram)
    best = np.argsort(values)[::-1][: min(DIMENSIONS, width)]
    return (q @ vectors_[:, best]).astype(np.float32)


def share(whole: np.ndarray, part: np.ndarray) -> float:
    """The factor that makes ``part`` weigh as much as ``whole``."""
    return max(1.0, float(np.linalg.norm(whole) / max(np.linalg.norm(part), 1e-9)))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), 1e-9)


def common_subsequence(masks: dict[int, int], full: int, words: list[int]) -> int:
    """Length of the longest common subsequence, with one bit for each word of the item."""
    v = full
    for word in words:
        m = masks.get(word)
        if m is not None:
            u = v & m
            v = (v + u | v - u) & full
    return (full & ~v).bit_count()


class Judge:
    """Decides candidates of a block of items."""

    def __init__(self, items: Items, weight: np.ndarray, vectors_: np.ndarray):
        self.items, self.embed = items, (weight[:, None] * vectors_).astype(np.float32)
        self.latent = unit(np.stack([self.embed[w].sum(axis=0) for w in items.words]))
        self.full = [(1 << len(w)) - 1 for w in items.words]
        self.masks, self.answers, self.own = [], [], []
        for words in items.words:
            own: dict[int, int] = {}
            for k, word in enumerate(words.tolist()):
                own[word] = own.get(word, 0) | 1 << k
            self.masks.append(own)
            self.answers.append(set(sorted(own, key=lambda w: (-weight[w], w))[:ANSWER_WORDS]))
            self.own.append(np.unique(words, return_counts=True))
        sizes = np.array([len(w) for w in items.words])
        self.scale = np.maximum(np.ceil(np.log2(sizes / CELL)), 0).astype(int)
        self.answered = np.array([ANSWERED * len(a) for a in self.answers])
        self.needed = np.where(sizes < LEAST_WORDS, 1.0, ORDERED) * sizes

    def leak(self, item: int, words: list[int]) -> float:
        """Share of the item's words found in order, if that and the answer make it a leak; else 0."""
        length = common_subsequence(self.masks[item], self.full[item], words)
        if length < self.needed[item] or len(self.answers[item].intersection(words)) < self.answered[item]:
            return 0.0
        return length / len(self.items.words[item])

    def near(self, item: int, words: np.ndarray, cosine: float) -> bool:
        """Whether what ``words`` hold of the item is enough of its words, and near to it in the latent space."""
        own, most = self.own[item]
        place = np.minimum(np.searchsorted(own, words), len(own) - 1)
        held = np.minimum(np.bincount(place[own[place] == words], minlength=len(own)), most)
        if held.sum() < self.needed[item]:
            return False
        covered = held.astype(np.float32) @ self.embed[own]
        return float(covered @ self.latent[item]) >= cosine * float(np.linalg.norm(covered))

    def answering(self, mine: np.ndarray, cell: np.ndarray, word: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        """Windows of two neighbouring cells and items of ``mine`` such that the window holds half of the answer."""
        terms, count = len(self.items.vocabulary), len(self.items.words)
        pairs = np.array(sorted((w, k) for k in mine.tolist() for w in self.answers[k]), np.int64)
        fan = np.bincount(pairs[:, 0], minlength=terms)
        begin = np.concatenate([[0], np.cumsum(fan)])
        some = fan[word] > 0
        held = np.unique(cell[some] * terms + word[some])
        later = held[~np.isin(held // terms, first)]  # the cell before the first of a document is another document's
        held = np.unique(np.concatenate([held, later - terms]))
        window, word = held // terms, held % terms
        size = np.concatenate([[0], np.cumsum(fan[word])])
        at = 0
        while at < len(held):
            end = max(at + 1, int(np.searchsorted(size, size[at] + FANNED, "right")) - 1)
            if end < len(held):  # a window stays whole
                cut = int(np.searchsorted(window, window[end]))
                end = cut if cut > at else int(np.searchsorted(window, window[end], "right"))
            n = fan[word[at:end]]
            inner = np.arange(n.sum()) - np.repeat(size[at:end] - size[at], n)
            item = pairs[np.repeat(begin[word[at:end]], n) + inner, 1]
            code, hits = np.unique(np.repeat(window[at:end], n) * count + item, return_counts=True)
            enough = code[hits >= self.answered[code % count]]
            yield enough // count, enough % count
            at = end

    def run(self, batches, cosine: float = COSINE) -> Iterator[pa.RecordBatch]:
        """Leaks of documents: for each size of items, windows of two neighbouring cells that hold enough of one."""
        for ids, row, position, word, sizes in chunks(batches, self.items.kind):
            out = []
            edges = np.searchsorted(row, np.arange(len(ids) + 1))
            for scale in np.unique(self.scale):
                mine, width = np.flatnonzero(self.scale == scale), CELL << int(scale)
                cell, first = cells_of(row, position, sizes, width)
                for windows, found in self.answering(mine, cell, word, first):
                    docs = np.searchsorted(first, windows, "right") - 1
                    for w, d, k in zip(windows.tolist(), docs.tolist(), found.tolist()):
                        lo, hi = np.searchsorted(cell[edges[d] : edges[d + 1]], [w, w + 2]) + edges[d]
                        if self.near(k, word[lo:hi], cosine) and (share := self.leak(k, word[lo:hi].tolist())):
                            out.append((ids[d], k, share))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                   pa.array([o[2] for o in out], pa.float64())], ["doc_id", "item", "share"])


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """Pairs (``doc_id``, ``item_id``) with the share of the item's words that the document holds in order."""
    spark = docs.sparkSession
    named = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    kind = benchmark.schema[item_id].dataType.simpleString()
    found = []
    for items in blocks(benchmark, item_id, item_text):
        own = spark.sparkContext.broadcast(items)
        rows = keep(places(named, own, "doc_id", "text"), "leak-places")
        weight = idf(rows, items)
        judge = spark.sparkContext.broadcast(Judge(items, weight, basis(rows, items, weight)))
        pairs = rows.mapInArrow(lambda b, judge=judge: judge.value.run(b), "doc_id bigint, item bigint, share double")
        best = pairs.groupBy("doc_id", "item").agg(F.max("share").alias("share"))
        # an Arrow table: rows of a Python list would start workers of another kind on every executor
        names = spark.createDataFrame(pa.table({"item": range(len(items.ids)), "item_id": items.ids}), f"item bigint, item_id {kind}")
        found.append(best.join(F.broadcast(names), "item").select("doc_id", "item_id", "share"))
    return functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"doc_id bigint, item_id {kind}, share double")
