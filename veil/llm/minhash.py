"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

A text's set holds the hashes of its shingles. Texts with equal sets form one class before anything else, so
groups of copies cost one row each. Every class has ``BANDS * ROWS`` minima: bands of ``ROWS`` minima give
candidates, and of every minimum the low ``BITS`` bits are packed into a signature. Two signatures agree by
chance once in ``2^BITS``; the estimate takes that out before a pair is compared in full.

Members of a band's bucket are not compared with one another: each meets a hub, and those that do not link
with it another hub. What then is still in different components meets in blocks: the smaller components of a
bucket are held, a block at a time, and all members stream past them. Signatures first join components that
could link to families; in a family, full sets are compared the same way, through an inverted index of the
block. Only what joins components is emitted, so results are linear in the members although no pair that
could link is skipped, and blocks and streams are dealt out, so no group is one task.

A pair at the threshold of 0.8 misses all bands with a probability of (1 - 0.8^5)^36 < 10^-6.

Defined cases: null and empty texts have an empty set and link with nothing; a text of fewer words than a
shingle is one shingle; rows repeated with the same id are one member; a row without id is its own component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm.common import ODD, hash_words, keep, key_filter, mapped, maybe, mix, passing, text_bytes, windows

BANDS, ROWS, BITS = 36, 5, 4
MINIMA = BANDS * ROWS
PER_LONG = 64 // BITS
LONGS = -(-MINIMA // PER_LONG)
FACTORS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(ODD)) | np.uint64(1)
CHUNK = 1 << 16


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of each text, one after the other, and where each set starts."""
    data, bounds = text_bytes(texts)
    hashes, _, _, first = hash_words(data, bounds, lower=True)
    found, _, text = windows(hashes, first, size)
    edges = np.searchsorted(text, np.arange(len(first)))
    sets = []
    for k in range(len(first) - 1):
        if edges[k] < edges[k + 1]:
            sets.append(np.unique(found[edges[k] : edges[k + 1]]))
        elif first[k] < first[k + 1]:
            whole = windows(hashes[first[k] : first[k + 1]], np.array([0, first[k + 1] - first[k]]), int(first[k + 1] - first[k]))
            sets.append(whole[0])
        else:
            sets.append(np.zeros(0, np.uint64))
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), starts


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The minima of each set that is not empty, one row each."""
    rows = len(starts) - 1
    out = np.full((rows, MINIMA), np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK, "right")) - 1)
        for lo in range(starts[at], starts[end], max(CHUNK, 1)) if end == at + 1 else [starts[at]]:
            hi = min(lo + CHUNK, starts[end]) if end == at + 1 else starts[end]
            part = values[lo:hi]
            cuts = np.array([0]) if end == at + 1 else starts[at:end] - lo
            buffer = np.empty_like(part)
            for k, factor in enumerate(FACTORS):
                np.multiply(part, factor, out=buffer)
                np.minimum(out[at:end, k], np.minimum.reduceat(buffer, cuts), out=out[at:end, k])
        at = end
    return out


def signatures(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and packed low bits of rows of minima."""
    n = len(found)
    bands = found.reshape(n, BANDS, ROWS)
    keys = np.zeros((n, BANDS), np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(ODD) + bands[:, :, k])
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
    low = np.zeros((n, LONGS * PER_LONG), np.uint64)
    low[:, :MINIMA] = found & np.uint64((1 << BITS) - 1)
    shifts = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    packed = np.bitwise_or.reduce(low.reshape(n, LONGS, PER_LONG) << shifts, axis=2)
    return keys, packed


def set_digests(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    import xxhash

    return [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])]


def lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    flat = pa.array(np.ascontiguousarray(values).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), flat)


def features(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``n_shingles``, the class of its set (64 bits of its digest; null if empty), bands and signature."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values, starts = shingle_sets(batch.column("text"), size)
        sizes = np.diff(starts)
        full = np.flatnonzero(sizes)
        found = minima(values, np.append(starts[full], starts[-1]))
        for empty, rows in ((False, full), (True, np.flatnonzero(sizes == 0))):
            if len(rows):
                keys, packed = signatures(found) if not empty else (None, None)
                digests = set_digests(values, starts)
                cids = [None if empty else int.from_bytes(digests[r][:8], "little", signed=True) for r in rows]
                nothing = pa.nulls(len(rows), pa.list_(pa.int64()))
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(rows)), pa.array(sizes[rows], pa.int64()), pa.array(cids, pa.int64()),
                     nothing if empty else lists(keys), nothing if empty else lists(packed)],
                    ["doc_id", "n_shingles", "cid", "bands", "sig"],
                )

    schema = "doc_id bigint, n_shingles bigint, cid bigint, bands array<bigint>, sig array<bigint>"
    return mapped(docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text")),
                  {"doc_id": "doc_id", "text": "text"}, schema, work)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the low bits that agree, without the share that agrees by chance."""
    ones = F.lit(int("1" * PER_LONG, 16)).cast("bigint")

    def differ(x, y):
        z = x.bitwiseXOR(y)
        any_ = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3))
        return F.bit_count(any_.bitwiseAND(ones)).cast("int")

    other = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda acc, x: acc + x)
    chance = 2.0**-BITS
    return ((MINIMA - other) / F.lit(float(MINIMA)) - chance) / (1 - chance)


def packed_sets(docs: DataFrame, size: int, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The full set of one row of each wanted class (``cid``, ``rep``), five bytes a shingle hash, sorted."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(class_filter(wanted))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values, starts = shingle_sets(batch.column("text"), size)
        digests = set_digests(values, starts)
        cids = np.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], np.int64)
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(maybe(shared.value, class_key(cids, ids)) & (np.diff(starts) > 0))
        short = values >> np.uint64(24)
        sets = [np.sort(short[starts[r] : starts[r + 1]]).view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for r in rows]
        if len(rows):
            yield pa.record_batch([pa.array(cids[rows]), pa.array(ids[rows], pa.int64()), pa.array(sets, pa.binary())],
                                  ["cid", "rep", "set"])

    named = docs.where(docs[doc_id].isNotNull()).select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    found = mapped(named, {"doc_id": "doc_id", "text": "text"}, "cid bigint, rep bigint, set binary", work)
    return found.join(wanted.select("cid", "rep"), ["cid", "rep"], "left_semi").select("cid", "set")


def class_key(cids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(cids.astype(np.int64).view(np.uint64) ^ mix(ids.astype(np.int64).view(np.uint64)))


def class_filter(wanted: DataFrame) -> np.ndarray:
    keys = lambda batch: class_key(batch.column("cid").to_numpy(), batch.column("rep").to_numpy())
    return key_filter(wanted.select("cid", "rep"), keys)


MEMBERS_PER_TASK = 512


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Forests of the pairs (a, b) with 100 * intersection >= percent * union of their full sets.

    Partners of ``a`` stream past its set; partners of a frequent ``a`` are dealt to several tasks.
    """
    counts = pairs.groupBy("a").agg((F.floor(F.count("*") / MEMBERS_PER_TASK) + 1).alias("shares"))
    dealt = pairs.join(counts, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share")
    roles = dealt.select(F.col("b").alias("cid"), F.col("a").alias("hub"), "share", F.lit(1).alias("role")).unionByName(
        counts.select(F.col("a").alias("cid"), F.col("a").alias("hub"), every, F.lit(0).alias("role"))
    )
    rows = roles.join(sets, "cid").repartition("hub", "share").sortWithinPartitions("hub", "share", "role")

    def run(batches):
        hub, mine = None, None
        for batch in batches:
            out = []
            for cid, own, role, raw in zip(*[batch.column(k).to_pylist() for k in ("cid", "hub", "role", "set")]):
                values = unpack(raw)
                if role == 0:
                    hub, mine = own, values
                    continue
                if hub != own:
                    raise ValueError("a pair without the set of its hub")
                places = np.searchsorted(mine, values)
                both = int((mine[np.minimum(places, len(mine) - 1)] == values).sum())
                if 100 * both >= percent * (len(mine) + len(values) - both):
                    out.append((own, cid))
            yield pa.record_batch([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.select("cid", "hub", "role", "set").mapInArrow(lambda b: forests(run(b)), LABELS)


LABELS = "cid bigint, comp bigint"
FOREST = 1 << 18  # nodes that a union of links holds before it is emitted
FEW = 1 << 17  # nodes of forests that one task joins: 2 MB


class Joined:
    """Components of what was joined so far, by their least member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def add(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def forests(batches) -> Iterator[pa.RecordBatch]:
    """The nodes (cid) of a task's links with their least one (comp); after ``FOREST`` nodes a new forest begins."""

    def emitted(joined):
        nodes = list(joined.parent)
        return pa.record_batch([pa.array(nodes, pa.int64()), pa.array([joined.root(x) for x in nodes], pa.int64())], ["cid", "comp"])

    joined = Joined()
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            joined.parent.setdefault(x, x)
            joined.parent.setdefault(y, y)
            joined.add(x, y)
        if len(joined.parent) >= FOREST:
            yield emitted(joined)
            joined = Joined()
    if joined.parent:
        yield emitted(joined)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(cid, comp) of all nodes of ``edges`` (a, b). Tasks shrink their links to forests."""
    return of_forests(edges.mapInArrow(forests, LABELS), name)


def of_forests(shrunk: DataFrame, name: str) -> DataFrame:
    """``components`` of forests: few of these are joined by one task, more of them in rounds.

    What makes links shrinks them itself: two Python steps in a row would be two workers a task.
    """
    forest = keep(shrunk, f"{name}-forest")
    if forest.count() > FEW:
        return spread_components(forest.toDF("a", "b"), name)
    return keep(forest.coalesce(1).mapInArrow(forests, LABELS), f"{name}-labels")


def spread_components(edges: DataFrame, name: str) -> DataFrame:
    """``components`` in rounds: least label of the neighbours, then the label's own label."""
    both = keep(edges.select(F.col("a").alias("cid"), F.col("b").alias("to")).unionByName(
        edges.select(F.col("b").alias("cid"), F.col("a").alias("to"))).distinct(), f"{name}-edges")
    labels = keep(both.groupBy("cid").agg(F.least(F.col("cid"), F.min("to")).alias("comp")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("cid").alias("to"), "comp"), "to").groupBy("cid").agg(F.min("comp").alias("near"))
        lower = labels.join(near, "cid").select("cid", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("cid").alias("low"), F.col("comp").alias("next"))
        step = keep(lower.join(jump, "low").select("cid", F.least("low", "next").alias("comp"),
                                                   (F.least("low", "next") < F.col("comp")).alias("moved")), f"{name}-labels")
        labels = step.select("cid", "comp")
        if step.where("moved").isEmpty():
            return labels


HUB_ROUNDS = 2
SLACK = 0.15  # below the threshold by almost five standard deviations of the estimate
HELD, STREAMED = 512, 20_000
LINKS = "a bigint, b bigint"
PLACES = "array<struct<block:bigint,stream:bigint,role:int>>"


def in_blocks(rows: DataFrame, payloads: DataFrame, payload: str) -> DataFrame:
    """Rows (key, cid, comp) of keys with several components, dealt into blocks with their payloads (cid, payload).

    In a block stand rows of the smaller components (role 0) and then rows of all (role 1); every row of a
    smaller component meets every other row in some block.
    """
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    keys = per.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("major"), F.count("*").alias("comps")).where("comps > 1")
    plan = keys.select(
        "key", F.col("major.comp").alias("major"), F.ceil((F.col("n") - F.col("major.n")) / HELD).alias("blocks"),
        F.ceil(F.col("n") / STREAMED).alias("streams"),
    )
    met = rows.join(plan, "key").join(payloads.select("cid", payload), "cid")
    upto = lambda c: F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1)
    block, stream = F.pmod(F.xxhash64("cid"), F.col("blocks")), F.pmod(F.xxhash64("cid", F.lit(1)), F.col("streams"))
    place = lambda b, s, role: F.struct(b.alias("block"), s.alias("stream"), F.lit(role).alias("role"))
    held = F.when(F.col("comp") != F.col("major"), F.transform(upto("streams"), lambda s: place(block, s, 0)))
    streamed = F.transform(upto("blocks"), lambda b: place(b, stream, 1))
    places = F.explode(F.concat(F.coalesce(held, F.array().cast(PLACES)), streamed)).alias("at")
    order = ["key", "block", "stream"]
    dealt = met.select("key", places, "cid", "comp", payload).select("key", "at.*", "cid", "comp", payload)
    return dealt.repartition(*order).sortWithinPartitions(*order, "role")


def links_of(batches, payload: str, load, compare):
    """Components (a, b) that links join. ``load`` makes an index of the held payloads of a block, ``compare``
    says which of them each streamed payload matches."""
    now, held, index, joined = None, [], None, Joined()
    for batch in batches:
        marks = list(zip(*[batch.column(k).to_pylist() for k in ("key", "block", "stream", "role")]))
        comps, values = batch.column("comp"), batch.column(payload)
        out, at = [], 0
        while at < len(marks):
            end = at + 1
            while end < len(marks) and marks[end] == marks[at]:
                end += 1
            group, role = marks[at][:3], marks[at][3]
            if group != now:
                now, held, index, joined = group, [], None, Joined()
            part = (comps.slice(at, end - at).to_numpy(), values.slice(at, end - at))
            if role == 0:
                held.append(part)
            elif held:
                if index is None:
                    index = (np.concatenate([h[0] for h in held]), load(pa.concat_arrays([h[1] for h in held])))
                comp, data = index
                for row, matches in compare(data, part[1]):
                    own = int(part[0][row])
                    out += [(own, m) for m in comp[matches].tolist() if m != own and joined.add(m, own)]
            at = end
        yield pa.record_batch([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def signature_matrix(sigs: pa.Array) -> np.ndarray:
    return sigs.flatten().to_numpy().view(np.uint64).reshape(len(sigs), LONGS)


def alike(least: float):
    """Comparison of signatures: those whose estimate is at least ``least``."""
    chance = 2.0**-BITS
    most = MINIMA * (1 - (least * (1 - chance) + chance))
    ones = np.uint64(int("1" * PER_LONG, 16))

    def compare(held: np.ndarray, streamed: pa.Array):
        for row, sig in enumerate(signature_matrix(streamed)):
            z = held ^ sig
            z = (z | z >> np.uint64(1) | z >> np.uint64(2) | z >> np.uint64(3)) & ones
            yield row, np.flatnonzero(np.bitwise_count(z).sum(axis=1) <= most)

    return compare


def unpack(raw) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def inverted(sets: pa.Array) -> tuple[np.ndarray, ...]:
    """Shingles of a block's sets in order, whose they are, and how many each has."""
    lists_ = [unpack(s.as_buffer()) for s in sets]
    sizes = np.array([len(x) for x in lists_])
    values = np.concatenate(lists_)
    order = np.argsort(values, kind="stable")
    return values[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes


def overlapping(percent: int):
    """Comparison of full sets by the index of a block."""

    def compare(held, streamed: pa.Array):
        values, owner, sizes = held
        for row, raw in enumerate(streamed):
            own = unpack(raw.as_buffer())
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            n = hi - lo
            hits = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[hits], minlength=len(sizes))
            yield row, np.flatnonzero(100 * both >= percent * (sizes + len(own) - both))

    return compare


def labelled(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their class, by the links found so far: its own where none was."""
    if found is None:
        return rows.withColumn("comp", F.col("cid"))
    return rows.join(found, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``n_shingles``, ``component_id`` (least id that links reach) and ``kept`` (it is that one).

    What the result does not read is deleted.
    """
    with passing(docs.sparkSession):
        rows, every = linked(docs, size, percent, doc_id, text)
    out = rows.join(every, "cid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def linked(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their classes, and the ``component_id`` of every class."""
    with passing(docs.sparkSession):  # minima are the widest rows: they go before the sets are written
        wide = keep(features(docs, size, doc_id, text), "minhash-features")
        own = wide.where(F.col("cid").isNotNull() & F.col("doc_id").isNotNull())
        picked = F.min_by(F.struct("bands", "sig"), F.col("doc_id"))
        full = keep(own.groupBy("cid").agg(F.min("doc_id").alias("rep"), picked.alias("x")).select("cid", "rep", "x.*"), "minhash-minima")
        rows = keep(wide.select("doc_id", "n_shingles", "cid"), "minhash-rows", 2)
        classes = keep(full.select("cid", "rep"), "minhash-classes", 1)
        bands = full.select("cid", F.explode("bands").alias("key"))
        shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        members = keep(bands.join(shared, "key"), "minhash-members", 1)
        near = members.select("cid").distinct()
        sigs = keep(full.join(near, "cid", "left_semi").select("cid", "rep", "sig"), "minhash-signatures", 1)
    sets = keep(packed_sets(docs, size, sigs, doc_id, text), "minhash-sets")
    least = percent / 100 - SLACK

    found = None  # components of the classes that have links
    joined = lambda new: of_forests(new if found is None else new.unionByName(found), "minhash")
    for number in range(HUB_ROUNDS):
        where = labelled(members, found)
        hubs = where.groupBy("key").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"), F.min_by(F.struct("cid", "comp"), F.xxhash64("cid", F.lit(number))).alias("hub")
        ).where("low < high")
        met = where.join(hubs, "key").where(F.col("comp") != F.col("hub.comp"))
        left, right = (sigs.select(F.col("cid").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
        pairs = met.select(F.col("hub.cid").alias("a"), F.col("cid").alias("b")).repartition("b").distinct()  # a class has up to 36 hubs
        pairs = pairs.join(right, "b").join(left, "a").where(estimate(F.col("sig_a"), F.col("sig_b")) >= least).select("a", "b")
        found = joined(confirm(keep(pairs, "minhash-pairs"), sets, percent))

    # smaller components of a bucket against all its members: first what could link, then what does
    near = in_blocks(labelled(members, found), sigs, "sig").mapInArrow(lambda b: forests(links_of(b, "sig", signature_matrix, alike(least))), LABELS)
    family = of_forests(near, "minhash-near").select(F.col("cid").alias("comp"), F.col("comp").alias("key"))
    full = keep(labelled(sigs.select("cid"), found).join(family, "comp").select("key", "cid", "comp"), "minhash-families")
    found = joined(in_blocks(full, sets, "set").mapInArrow(lambda b: forests(links_of(b, "set", inverted, overlapping(percent))), LABELS))
    ids = labelled(classes.select("cid", "rep"), found)
    least_id = ids.groupBy("comp").agg(F.min("rep").alias("component_id"))
    every = keep(ids.join(least_id, "comp").select("cid", "component_id"), "minhash-components", 1)
    return rows, every
