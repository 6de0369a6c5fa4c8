"""Rows of conversations in order, dealt so that no task needs to hold a whole conversation.

Rows are dealt by ranges of (conversation, turn, text digest) and sorted inside a partition, so a conversation
with a third of all rows lies in many partitions. ``gathered`` hands a task's rows out by conversations; one
that may go on in another partition, or reaches ``PART_BYTES`` or ``PART_ROWS``, comes in parts that are not ``whole``.

Rows of one turn go by the MD5 of role, newline and text: equal rows are neighbours. Null turns come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import slices

PART_BYTES, PART_ROWS = 1 << 20, 1 << 10
NEVER = object()


@dataclass(frozen=True)
class Part:
    """Rows that follow each other: ``edges`` cut them into conversations."""

    rows: pa.RecordBatch
    edges: np.ndarray
    whole: list[bool]
    first: int  # number of the first conversation here; in order over all partitions


def ordered(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, missing: str = "") -> DataFrame:
    """``conv_id, turn, role, text`` in order; ``missing`` stands for null roles and texts."""
    named = rows.select(
        rows[conv_id].alias("conv_id"),
        rows[turn].alias("turn"),
        *[F.coalesce(rows[theirs].cast("string"), F.lit(missing)).alias(own) for own, theirs in (("role", role), ("text", text))],
    )
    order = ["conv_id", "turn", "tie"]
    dealt = named.withColumn("tie", F.md5(F.concat("role", F.lit("\n"), "text"))).repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).drop("tie")


def run_edges(ids: pa.Array) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])


def gathered(batches: Iterator[pa.RecordBatch], limit: int = PART_BYTES) -> Iterator[Part]:
    """A partition's rows by conversations; only those that neither touch its ends nor exceed ``limit`` are whole."""
    held, count, opening, cut = None, TaskContext.get().partitionId() << 33, NEVER, NEVER

    def part(rows: pa.RecordBatch, edges: np.ndarray, loose: bool) -> Part:
        ids = [rows.column("conv_id")[int(k)].as_py() for k in edges[:-1]]
        whole = [i != opening and i != cut and not loose for i in ids]
        return Part(rows, edges, whole, count)

    for batch in batches:
        for at, end in slices(batch, "text"):
            piece = batch.slice(at, end - at)
            held = piece if held is None else pa.Table.from_batches([held, piece]).combine_chunks().to_batches()[0]
            if opening is NEVER:
                opening = held.column("conv_id")[0].as_py()
            edges = run_edges(held.column("conv_id"))
            if len(edges) > 2:
                yield part(held.slice(0, edges[-2]), edges[:-1], False)
                count += len(edges) - 2
                held, cut = held.slice(edges[-2]), NEVER if held.column("conv_id")[int(edges[-2])].as_py() != cut else cut
            if held.num_rows >= PART_ROWS or (pc.sum(pc.binary_length(held.column("text"))).as_py() or 0) >= limit:
                yield part(held, np.array([0, held.num_rows]), True)
                count, cut, held = count + 1, held.column("conv_id")[0].as_py(), None
    if held is not None and held.num_rows:
        yield part(held, run_edges(held.column("conv_id")), True)
