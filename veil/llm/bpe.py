"""Byte-level BPE: encoding by a rank queue over a hierarchical bitmap, and decoding.

A pre-token of n bytes starts as a linked list of its bytes. Every pair of neighbours that has a rank waits
in the bucket of that rank; the bitmap finds the lowest rank that has a bucket by two find-first-set
steps. A merge changes two pairs at most, which get new entries; their old entries are stale and skipped.
So a pre-token costs about n log n, however long it is.

Short pre-tokens of a batch that were not seen before share one list and one queue: a bucket then holds the
places of many pre-tokens, of each of which the leftmost is merged, all at once. Pre-tokens do not touch, so
each still sees its own merges by rank, then from the left.

Defined cases: null and empty texts have no ids; repeated rows give one row each; ids decode to the exact
bytes of the text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veil.llm.common import mapped

CACHED_TOKENS = 300_000
CACHED_CHARS = 64
TOGETHER = 1 << 16  # short pre-tokens in one queue
BATCH_BYTES = 1 << 20


BITS = [1 << k for k in range(256)]


class RankQueue:
    """Positions by rank: a bucket for each rank, and two levels of 256-bit words over the ranks."""

    def __init__(self, n_ranks: int):
        if n_ranks > 1 << 16:
            raise ValueError("more than 2^16 ranks")
        self.low, self.top = [0] * 256, 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 8] |= BITS[rank & 255]
        self.top |= BITS[rank >> 8]

    def pop(self) -> tuple[int, int]:
        """The lowest rank that waits, and its leftmost position; only while ``top`` is not 0."""
        high = (self.top & -self.top).bit_length() - 1
        word = self.low[high]
        lowest = word & -word
        rank = (high << 8) + lowest.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.low[high] = word = word ^ lowest
        if not word:
            self.top ^= BITS[high]
        return rank, bucket[0]


    def add(self, rank: int, positions: list[int]) -> None:
        """``push`` for buckets that are taken whole: their order does not matter."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        self.low[rank >> 8] |= BITS[rank & 255]
        self.top |= BITS[rank >> 8]

    def add_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """``add`` of every position whose rank is not -1."""
        real = ranks >= 0
        ranks, positions = ranks[real], positions[real]
        if not len(ranks):
            return
        order = np.argsort(ranks)
        ranks, places = ranks[order], positions[order].tolist()
        starts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        a = 0
        for rank, b in zip(ranks[np.append(0, starts)].tolist(), [*starts.tolist(), len(places)]):
            self.add(rank, places[a:b])
            a = b

    def take(self) -> tuple[int, list[int]]:
        """The lowest rank that waits, and all its positions."""
        high = (self.top & -self.top).bit_length() - 1
        word = self.low[high]
        lowest = word & -word
        rank = (high << 8) + lowest.bit_length() - 1
        self.low[high] = word = word ^ lowest
        if not word:
            self.top ^= BITS[high]
        return rank, self.buckets.pop(rank)


FEW = 12  # merges of one rank that are made one by one


class Encoder(dict):
    """Ids of pre-tokens, as bytes of 32-bit numbers; those seen before are kept within a bound."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.words = {rank: token for token, rank in self.ranks.items()}
        self.queue = RankQueue(max(self.words) + 1)
        self.split = regex.compile(pattern).findall
        # every pair of tokens that together are a token: both ids in one number, sorted, and the rank
        get = self.ranks.get
        pairs = sorted(
            (a << 32 | b, rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None
        )
        pairs.append((1 << 62, -1))  # above all keys
        self.pair_keys, self.pair_ranks = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.byte_ids = np.array([get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("a byte is no token")

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 where a pair is no token or one of both is missing (-1)."""
        keys = a << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def ids_of_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of short pre-tokens that are no tokens themselves, merged in one queue."""
        sizes = np.array([len(p) for p in pieces])
        first = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)  # also the place that stands for none
        owner = np.append(np.repeat(np.arange(len(pieces)), sizes), -1)
        token = np.append(self.byte_ids[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[first + sizes - 1] = after[n] = before[first] = before[n] = n
        waiting = self.joined(token, token[after])
        queue, ranks, words = self.queue, self.ranks, self.words
        queue.add_all(waiting, np.arange(n + 1))
        owners, tokens, afters, befores, waits = map(memoryview, (owner, token, after, before, waiting))
        while queue.top:
            rank, places = queue.take()
            if len(places) <= FEW:
                seen = -1
                for at in sorted(places):
                    if waits[at] != rank:
                        continue
                    if owners[at] == seen:
                        queue.add(rank, [at])
                        continue
                    seen, gone, left = owners[at], afters[at], befores[at]
                    end = afters[gone]
                    waits[gone] = tokens[gone] = -1
                    tokens[at], afters[at] = rank, end
                    waits[at] = -1
                    if end < n:
                        befores[end] = at
                        if (more := ranks.get(words[rank] + words[tokens[end]])) is not None:
                            waits[at] = more
                            queue.add(more, [at])
                    if left < n:
                        waits[left] = -1
                        if (more := ranks.get(words[tokens[left]] + words[rank])) is not None:
                            waits[left] = more
                            queue.add(more, [left])
                continue
            at = np.array(places)
            at = at[waiting[at] == rank]
            at.sort()
            if not len(at):
                continue
            own = owner[at]
            if not (leftmost := np.append(True, own[1:] != own[:-1])).all():
                queue.add(rank, at[~leftmost].tolist())
                at = at[leftmost]
            gone, left = after[at], before[at]
            end = after[gone]
            waiting[gone] = token[gone] = -1
            token[at], after[at], before[end] = rank, end, at
            before[n] = n
            waiting[at] = self.joined(token[at], token[end])
            waiting[left] = self.joined(token[left], token[at])
            places = np.concatenate([at, left])
            queue.add_all(waiting[places], places)
        left = token[:n] >= 0
        flat = token[:n][left].astype(np.int32).tobytes()
        cuts = (4 * np.append(0, np.cumsum(np.add.reduceat(left, first, dtype=np.int64)))).tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def ids(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        get, push, pop, queue = ranks.get, self.queue.push, self.queue.pop, self.queue
        after, before = list(range(1, n + 2)), list(range(-1, n))
        waiting = [-1] * (n + 1)  # the rank of the pair that begins here; other entries are stale
        for at in range(n - 1):
            rank = get(piece[at : at + 2])
            if rank is not None:
                waiting[at] = rank
                push(rank, at)
        while queue.top:
            rank, at = pop()
            if waiting[at] != rank:
                continue
            gone = after[at]
            waiting[gone] = -1
            after[at] = end = after[gone]
            if end < n:
                before[end] = at
                rank = get(piece[at : after[end]])
                if rank is None:
                    waiting[at] = -1
                else:
                    waiting[at] = rank
                    push(rank, at)
            else:
                waiting[at] = -1
            left = before[at]
            if left >= 0:
                rank = get(piece[left:end])
                if rank is None:
                    waiting[left] = -1
                else:
                    waiting[left] = rank
                    push(rank, left)
        out, at = [], 0
        while at < n:
            end = after[at]
            out.append(ranks[piece[at:end]])
            at = end
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text; pre-tokens that are not known yet are encoded together.

        A text is held as the ids of its known pre-tokens, which all texts share, and not as its pre-tokens.
        """
        out, gaps, new = [], [], {}
        for text in texts:
            tokens = self.split(text) if text else []
            ids = list(map(self.get, tokens))
            try:
                out.append(b"".join(ids))
            except TypeError:  # some are not known
                places = [k for k, known in enumerate(ids) if known is None]
                gaps.append((len(out), ids, places, [new.setdefault(t, t) for t in map(tokens.__getitem__, places)]))
                out.append(b"")
        many = []
        for token in new:
            piece = token.encode()
            if piece in self.ranks or len(piece) > CACHED_CHARS:
                new[token] = np.asarray(self.ids(piece), np.int32).tobytes()
            else:
                many.append((token, piece))
        for at in range(0, len(many), TOGETHER):
            part = many[at : at + TOGETHER]
            new.update(zip([t for t, _ in part], self.ids_of_many([p for _, p in part])))
        for row, ids, places, tokens in gaps:
            for k, token in zip(places, tokens):
                ids[k] = new[token]
            out[row] = b"".join(ids)
        if len(self) + len(new) > CACHED_TOKENS:
            self.clear()
        self.update((t, ids) for t, ids in new.items() if len(t) <= CACHED_CHARS)
        return out


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def id_lists(found: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` of every text."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = encoder(path, pattern).encode_many(batch.column("text").to_pylist())
        yield pa.record_batch([batch.column("doc_id"), id_lists(found)], ["doc_id", "ids"])

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>"
    return mapped(docs, {"doc_id": doc_id, "text": text}, schema, work, BATCH_BYTES)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, pattern).words
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column("ids")
                texts = [b"".join(map(words.__getitem__, k.values.to_numpy().tolist())) if k.is_valid else None for k in ids]
                yield pa.record_batch([part.column("doc_id"), ids, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    types = dict(encoded.dtypes)
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {types['doc_id']}, ids array<int>, decoded binary")


def recoded(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``decode`` of ``encode`` in one pass: a task then has one Python worker with the ranks and not two."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        found = own.encode_many(batch.column("text").to_pylist())
        texts = [b"".join(map(own.words.__getitem__, np.frombuffer(f, np.int32).tolist())) for f in found]
        yield pa.record_batch([batch.column("doc_id"), id_lists(found), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>, decoded binary"
    return mapped(docs, {"doc_id": doc_id, "text": text}, schema, work, BATCH_BYTES)
