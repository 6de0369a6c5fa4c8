"""Helpers the operators share: Arrow batches in slices, and word hashes of whole buffers."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.session import shared_path

SLICE_BYTES = 1 << 19
BATCH_ROWS = 1000  # texts are long rows: the default of 10000 takes ten times the memory on both sides
SPACES = b" \t\n\v\f\r"
UPPER = bytes(range(65, 91))
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ship(spark: SparkSession) -> None:
    """Give this package's code to the Python workers, once per Spark context; keep Arrow batches of texts small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    context = spark.sparkContext
    if any(f.endswith("veil-code.zip") for f in getattr(context, "_python_includes", [])):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "veil-code.zip")
    with zipfile.ZipFile(path, "w") as code:
        for folder, _, names in os.walk(os.path.join(top, "veil")):
            for name in names:
                if name.endswith(".py"):
                    code.write(full := os.path.join(folder, name), os.path.relpath(full, top))
    context.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PASSING: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("passing", default=())


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Files that ``keep`` writes inside are deleted at the end; ``stays`` is the number of scopes that they outlive."""
    paths: list[str] = []
    token = PASSING.set((*PASSING.get(), paths))
    try:
        yield
    finally:
        PASSING.reset(token)
        for name in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, name: str, stays: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start from files whose size is known."""
    path = shared_path(df.sparkSession, name)
    scopes = PASSING.get()
    scopes = scopes[: max(len(scopes) - stays, 0)]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``limit`` bytes; a longer text is a range of its own."""
    sizes = np.zeros(batch.num_rows + 1, np.int64)
    np.cumsum(byte_lengths(batch.column(text)), out=sizes[1:])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
        yield at, end
        at = end


def byte_lengths(texts: pa.Array) -> np.ndarray:
    lengths = pc.binary_length(texts)
    return np.asarray(lengths.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each text starts in it; null counts as empty."""
    values = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(values.type)
    offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give free memory back at the end of a task: workers are kept, and those of an executor share its limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def mapped(
    df: DataFrame, columns: dict[str, str], schema: str, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``work`` over slices of the columns, renamed by ``columns`` (own name to the table's); nothing else is read."""
    text = "text"

    def run(batches):
        try:
            for batch in batches:
                for at, end in slices(batch, text, limit):
                    yield from work(batch.slice(at, end - at))
        finally:
            release()

    picked = df.select(*[df[theirs].cast("string" if own == text else df.schema[theirs].dataType).alias(own)
                         for own, theirs in columns.items()])
    return picked.mapInArrow(run, schema)


# filters over keys -------------------------------------------------------------------------------

FILTER_BITS = 26


def filter_places(keys: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(3):
        yield (mix(keys + np.uint64(k)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def key_filter(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Bloom filter over 64-bit keys: built where the rows are, merged by ``bit_or``, 8 MB at most."""

    def places(batches):
        for batch in batches:
            at = np.concatenate(list(filter_places(keys(batch))))
            words, bits = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            yield pa.record_batch([pa.array(words), pa.array(bits.view(np.int64))], ["word", "bits"])

    merged = rows.mapInArrow(places, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table = merged.toArrow()
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def maybe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter; those that are in it always are."""
    hit = np.ones(len(keys), bool)
    for at in filter_places(keys):
        hit &= (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return hit


def suspects(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test of rows by hash: false only where ``xxhash64`` of no value in ``keys`` is the tested hash.

    Few rows of a wide table pass a test by few keys, so those alone need a join, and the texts of the others no shuffle.
    """
    hashes = keys.select(F.xxhash64(key).alias("hash"))
    shared = keys.sparkSession.sparkContext.broadcast(key_filter(hashes, lambda b: b.column("hash").to_numpy().view(np.uint64)))

    @F.arrow_udf("boolean")
    def may(hash_: pa.Array) -> pa.Array:
        return pa.array(maybe(shared.value, hash_.to_numpy().view(np.uint64)))

    return may


def without_rows(df: DataFrame, gone: DataFrame, key: str, gone_key: str) -> DataFrame:
    """``df`` without the rows whose ``key`` is in ``gone``; null is a value like any other."""
    suspect = suspects(gone, gone_key)(F.xxhash64(df[key]))
    left = df.where(suspect).join(gone, df[key].eqNullSafe(gone[gone_key]), "left_anti")
    return df.where(~suspect).union(left)


# word hashes -----------------------------------------------------------------------------------

ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
LOWER_VALUES = BYTE_VALUES[np.frombuffer(LOWER_TABLE, np.uint8)]


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            k = len(self.values)
            step = np.uint64(pow(self.base, k, 1 << 64))
            self.values = np.concatenate([self.values, self.values * step])
        return self.values[:n]


UP, DOWN = Powers(ODD), Powers(INVERSE)


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range of ``values``: a polynomial from prefix sums, so long ranges cost as much as short ones."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * UP.upto(len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * DOWN.upto(len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def hash_words(
    data: np.ndarray, bounds: np.ndarray, lower: bool = False, gaps: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, ...]:
    """Hash, first byte and end of each word, and for each text the number of its first word.

    Words are runs without ``gaps`` (a flag per byte; ASCII white space unless given); they never cross the ``bounds`` of texts. Long texts are
    hashed in pieces cut at white space, so that memory does not grow with them.
    """
    n = len(data)
    gap = gaps[data] if n else np.zeros(0, bool)
    inner = bounds[(bounds > 0) & (bounds < n)]
    begins, stops = ~gap, ~gap
    if n:
        begins = begins.copy()
        begins[1:] &= gap[:-1]
        begins[inner] |= ~gap[inner]
        stops = stops.copy()
        stops[:-1] &= gap[1:]
        stops[inner - 1] |= ~gap[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    values = LOWER_VALUES if lower else BYTE_VALUES
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        lo, hi = starts[at], ends[end - 1]
        hashes[at:end] = rolling(values[data[lo:hi]], starts[at:end] - lo, ends[at:end] - lo)
        at = end
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside one text, its first word, and its text."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    before = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
    starts = np.arange(len(text)) - before[text] + first[:-1][text]
    return rolling(hashes, starts, starts + size), starts, text
