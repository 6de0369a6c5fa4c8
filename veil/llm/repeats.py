"""Substring dedup by suffix trees over groups of suffixes with a common prefix.

Every word of a text begins a suffix. A group takes the suffixes with one prefix: of a single word, or, if
that word is frequent, of two, four, or all words of the window. A prefix is frequent if it holds more than
its share of all suffixes, so there are few at each length whatever the data, and what is left fits a task's
memory. A subtree need not be deeper than the window: a suffix is cut after ``size`` words and carried as the
64-bit hash of these words, in the order of the text. Below one internal node of full depth hang the suffixes
with equal hashes: a repeat. The subtree answers with one bit a suffix, whether its node also holds a text
with a smaller id. Texts wait in buckets until the bits come back; runs of marked windows are the maximal
repeats. A window so frequent that it would fill a group by itself never becomes one: its least id is
aggregated where the texts are, and the few that there can be are known to all tasks.

Defined cases: null and empty texts have no words and none are removed; rows repeated with one id are one
document to each other (a window is removed only for a smaller id) and give one row each; rows without an id
come after all others; a text shorter than the window stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import hash_words, keep, mapped, mix, slices, text_bytes, windows

PREFIX_WORDS = (1, 2, 4)  # tried in this order before the whole window
GROUP_WORDS = 4_000_000
BYTES_A_WORD = 6
NO_ID = 1 << 62
BUCKET_BYTES = 8 << 20  # of texts that are finished together
COLUMNS = {"doc_id": "doc_id", "tag": "tag", "text": "text"}


@dataclass(frozen=True)
class Plan:
    """How suffixes are dealt: known to all tasks, of bounded size."""

    size: int
    groups: int
    buckets: int
    frequent: tuple[np.ndarray, ...]  # prefixes by length, sorted, fewer than twice ``share`` of each
    windows: np.ndarray  # frequent whole windows, sorted
    least: np.ndarray  # and the least id of each

    def own(self, found: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which windows are frequent ones, and which of these repeat a smaller id."""
        if not len(self.windows):
            return np.zeros(len(found), bool), np.zeros(len(found), bool)
        place = np.minimum(np.searchsorted(self.windows, found), len(self.windows) - 1)
        known = self.windows[place] == found
        return known, known & (owner > self.least[place])

    def deal(self, hashes: np.ndarray, first: np.ndarray, starts: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The group of each suffix: by its shortest prefix that is not frequent, else by the whole window."""
        group, undecided = found.copy(), np.ones(len(starts), bool)
        for length, often in zip(PREFIX_WORDS, self.frequent):
            prefix, at, _ = windows(hashes, first, length)
            place = np.zeros(len(hashes), np.uint64)
            place[at] = prefix
            mine = place[starts]
            light = undecided & ~np.isin(mine, often)
            group[light] = mine[light]
            undecided &= ~light
            if not undecided.any():
                break
        return (mix(group) % np.uint64(self.groups)).astype(np.int64)


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Id (``NO_ID`` for null), text, and a tag that tells rows with one id apart."""
    tag = F.xxhash64(docs[text]).bitwiseAND(0x7FFFFFFF).cast("int")
    return docs.select(F.coalesce(docs[doc_id].cast("bigint"), F.lit(NO_ID)).alias("doc_id"), tag.alias("tag"), docs[text].cast("string").alias("text"))


def ids_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), np.int64)


def plan(rows: DataFrame, size: int) -> Plan:
    """Numbers of suffixes and of frequent prefixes.

    A slice of texts reports what is frequent within itself. A prefix that never is, or that adds up to less
    than half a share where it is, holds less than one and a half shares of all suffixes.
    """
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    groups = max(4, -(-n_bytes // (BYTES_A_WORD * GROUP_WORDS)))
    buckets = max(16, -(-n_bytes // BUCKET_BYTES))
    share = min(max(1024, 4 * groups), 1 << 20)

    def often(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, bounds = text_bytes(batch.column("text"))
        hashes, _, _, first = hash_words(data, bounds)
        for length in (*PREFIX_WORDS, size):
            found, counts = np.unique(windows(hashes, first, length)[0], return_counts=True)
            many = (counts * share > len(hashes)) & (counts > 1)
            yield pa.record_batch([pa.array(np.full(many.sum(), length, np.int64)), pa.array(found[many].view(np.int64)),
                                   pa.array(counts[many])], ["length", "prefix", "n"])

    counted = mapped(rows, COLUMNS, "length bigint, prefix bigint, n bigint", often).groupBy("length", "prefix").agg(F.sum("n").alias("n"))
    heavy = counted.where(F.col("n") * 2 * share * BYTES_A_WORD > n_bytes).toArrow()  # fewer than 2 * share a length
    lengths, prefixes = heavy.column("length").to_numpy(), heavy.column("prefix").to_numpy().view(np.uint64)
    frequent = tuple(np.sort(prefixes[lengths == length]) for length in PREFIX_WORDS)
    whole = np.sort(prefixes[lengths == size])
    empty = np.zeros(0, np.int64)
    if not len(whole):
        return Plan(size, groups, buckets, frequent, whole, empty)

    def smallest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, bounds = text_bytes(batch.column("text"))
        hashes, _, _, first = hash_words(data, bounds)
        found, _, text = windows(hashes, first, size)
        mine = np.flatnonzero(np.isin(found, whole))
        order = mine[np.argsort(found[mine], kind="stable")]
        keys, edges = np.unique(found[order], return_index=True)
        ids = np.minimum.reduceat(ids_of(batch.column("doc_id"))[text[order]], edges) if len(order) else empty
        yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(ids)], ["prefix", "doc_id"])

    least = mapped(rows, COLUMNS, "prefix bigint, doc_id bigint", smallest).groupBy("prefix").agg(F.min("doc_id").alias("doc_id")).toArrow()
    keys = least.column("prefix").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Plan(size, groups, buckets, frequent, keys[order], least.column("doc_id").to_numpy()[order])


def suffixes(rows: DataFrame, deal) -> DataFrame:
    """Per slice of texts and group: ids and tags of the texts, how many suffixes each has there, their hashes."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = deal.value
        data, bounds = text_bytes(batch.column("text"))
        hashes, _, _, first = hash_words(data, bounds)
        found, starts, text = windows(hashes, first, own.size)
        ids, tags = ids_of(batch.column("doc_id")), np.asarray(batch.column("tag").to_numpy(zero_copy_only=False), np.int32)
        group = own.deal(hashes, first, starts, found)
        group[own.own(found, ids[text])[0]] = own.groups  # frequent windows stay
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(own.groups + 1))
        parts = []
        for g in np.flatnonzero(np.diff(edges)):
            mine = order[edges[g] : edges[g + 1]]
            texts, counts = np.unique(text[mine], return_counts=True)
            parts.append((int(g), ids[texts].tobytes(), tags[texts].tobytes(), counts.astype(np.int32).tobytes(), found[mine].tobytes()))
        names = ["group", "ids", "tags", "counts", "hashes"]
        types = [pa.int64(), *[pa.binary()] * 4]
        yield pa.record_batch([pa.array([p[k] for p in parts], t) for k, t in enumerate(types)], names)

    return mapped(rows, COLUMNS, "group bigint, ids binary, tags binary, counts binary, hashes binary", work)


def subtree(table: pa.Table, buckets: int) -> pa.Table:
    """One group: which of its suffixes end at a node that a text with a smaller id reaches, too.

    Answers are packed by buckets of texts: a bit for each suffix of the texts that have such ones.
    """

    def whole(name, kind):
        return np.concatenate([np.frombuffer(b.as_buffer(), kind) for c in table.column(name).chunks for b in c])

    ids, tags, counts, hashes = whole("ids", np.int64), whole("tags", np.int32), whole("counts", np.int32), whole("hashes", np.uint64)
    owner = np.repeat(ids, counts)
    order = np.argsort(hashes)
    ranked = hashes[order]
    node = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    del ranked
    least = np.minimum.reduceat(owner[order], np.flatnonzero(node))
    repeat = np.empty(len(hashes), bool)
    repeat[order] = owner[order] > least[np.cumsum(node, dtype=np.int32) - 1]
    cuts = np.concatenate([[0], np.cumsum(counts)])
    marked = np.flatnonzero(np.add.reduceat(repeat.astype(np.int32), cuts[:-1]))
    bucket = bucket_of(ids[marked], tags[marked], buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for k in np.flatnonzero(np.diff(edges)):
        mine = marked[order[edges[k] : edges[k + 1]]]
        bits = b"".join(np.packbits(repeat[cuts[m] : cuts[m + 1]]).tobytes() for m in mine)
        rows.append((int(k), ids[mine].tobytes(), tags[mine].tobytes(), counts[mine].tobytes(), bits))
    names, types = ["bucket", "ids", "tags", "counts", "bits"], [pa.int64(), *[pa.binary()] * 4]
    columns = {n: pa.array([r[j] for r in rows], t) for j, (n, t) in enumerate(zip(names, types))}
    group = pa.array([table.column("group")[0].as_py()] * len(rows), pa.int64())
    return pa.table({"bucket": columns.pop("bucket"), "group": group, **columns})


MARKS = "bucket bigint, group bigint, ids binary, tags binary, counts binary, bits binary"


def bucket_of(ids: np.ndarray, tags: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(ids + tags, buckets)


def marks_of(table: pa.Table) -> dict[tuple[int, int], list[tuple[int, np.ndarray]]]:
    """Per text of a bucket: its groups, and a bit for each suffix it has there."""
    found: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for row in table.to_pylist():
        ids, tags, counts = (np.frombuffer(row[k], t) for k, t in (("ids", np.int64), ("tags", np.int32), ("counts", np.int32)))
        bits, at = np.frombuffer(row["bits"], np.uint8), 0
        for doc, tag, n in zip(ids.tolist(), tags.tolist(), counts.tolist()):
            size = -(-n // 8)
            found.setdefault((doc, tag), []).append((row["group"], np.unpackbits(bits[at : at + size])[:n].astype(bool)))
            at += size
    return found


def repeated(own: Plan, batch: pa.RecordBatch, marks: dict) -> Iterator[tuple[bytes, np.ndarray]]:
    """Per text of a batch: its bytes, and which of its words lie in a marked window."""
    data, bounds = text_bytes(batch.column("text"))
    hashes, begin, end, first = hash_words(data, bounds)
    found, starts, text = windows(hashes, first, own.size)
    ids, tags = ids_of(batch.column("doc_id")), batch.column("tag").to_pylist()
    group = own.deal(hashes, first, starts, found)
    _, repeat = own.own(found, ids[text])
    group[own.own(found, ids[text])[0]] = own.groups
    edges = np.searchsorted(text, np.arange(batch.num_rows + 1))
    for row in range(batch.num_rows):
        a, b = edges[row], edges[row + 1]
        for number, bits in marks.get((int(ids[row]), tags[row]), ()):
            repeat[a + np.flatnonzero(group[a:b] == number)] |= bits
        n = int(first[row + 1] - first[row])
        step = np.zeros(n + 1, np.int64)
        hit = starts[a:b][repeat[a:b]] - first[row]
        step[hit] += 1
        step[hit + own.size] -= 1
        yield data[bounds[row] : bounds[row + 1]].tobytes(), np.cumsum(step)[:n] > 0


def without_repeats(docs: DataFrame, size: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the words left, joined by one space."""
    rows = named(docs, doc_id, text)
    own = plan(rows, size)
    deal = docs.sparkSession.sparkContext.broadcast(own)
    marks = suffixes(rows, deal).groupBy("group").applyInArrow(lambda t: subtree(t, deal.value.buckets), MARKS)
    marks = keep(marks, "repeats-marks")

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        found, out = marks_of(answers), []
        for batch in texts.select(["doc_id", "tag", "text"]).combine_chunks().to_batches():
            for at, end in slices(batch, "text"):
                for raw, gone in repeated(deal.value, batch.slice(at, end - at), found):
                    words = raw.split()
                    left = words if not gone.any() else [words[k] for k in np.flatnonzero(~gone)]
                    out.append((len(words), len(words) - len(left), b" ".join(left).decode()))
        ids = [None if i == NO_ID else i for i in texts.column("doc_id").to_pylist()]
        columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.table([pa.array(ids, pa.int64()), *columns], ["doc_id", "n_words", "n_removed", "kept"])

    bucket = F.pmod(F.col("doc_id") + F.col("tag"), F.lit(own.buckets))
    dealt = rows.withColumn("bucket", bucket).groupBy("bucket").cogroup(marks.groupBy("bucket"))
    return dealt.applyInArrow(finish, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
