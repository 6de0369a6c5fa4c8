"""Conversations as chat-formatted training texts with loss masks, assembled as columns of bytes.

A turn becomes ``begin role newline text end newline``. Control strings inside texts get one backslash after
their first character, as do those that have backslashes there already, so the escape is reversible and a
formatted text holds control strings only where the template put them. In roles, backslash, newline and the
characters that begin a control string are written as two characters.

A task takes the rows of its conversations together: lengths of headers, texts and escapes are added up to
offsets, one buffer is allocated, and source bytes, headers, ends and backslashes are scattered into it. The
buffer, with the offsets of conversations, is the Arrow column. The loss mask is a list of byte ranges.

``formatted`` gives ``conv_id, part, whole, n_turns, formatted, loss_starts, loss_ends``: a conversation in
one row, or, if it is longer than a megabyte or touches the edge of a partition, in parts to be read by
ascending ``part``. ``digests`` parses that output alone and gives back counts and digests; only loose parts
are sent on as bytes, and streamed through a hash, so no task holds a whole long conversation.

Defined cases: null texts and roles are empty; null conversation ids are one conversation; null turns come
first, and rows of one turn go by the MD5 of role and text; repeated rows are turns of their own; an empty
table gives no rows; conversations without an assistant have an empty mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veil.llm.common import text_bytes
from veil.llm.turns import NEVER, PART_BYTES, gathered, ordered

SCATTER_BYTES = 1 << 20


@dataclass(frozen=True)
class Template:
    """Marks of a turn and control strings, all beginning with one of ``openers`` and holding none after that."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if any(o in c[1:] or "\\" in c or len(c) < 2 for c in self.controls for o in self.openers):
            raise ValueError("control strings hold an opening character only as their first, and no backslash")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.end, *self.others)

    @property
    def openers(self) -> str:
        return "".join(sorted({c[0] for c in self.controls}))

    def pattern(self, least: str) -> str:
        """Control strings with ``least`` (a quantifier) backslashes after the first character."""
        return "|".join(f"{re.escape(c[0])}\\\\{least}{re.escape(c[1:])}" for c in self.controls)

    def header(self, role: str) -> str:
        codes = {"\\": "\\\\", "\n": "\\n"} | {o: f"\\{k}" for k, o in enumerate(self.openers)}
        return self.begin + "".join(codes.get(c, c) for c in role) + "\n"

    def role(self, header: str) -> str:
        codes = {"\\": "\\", "n": "\n"} | {str(k): o for k, o in enumerate(self.openers)}
        return re.sub(r"\\(.)", lambda m: codes[m[1]], header)


class Assembler:
    """Formats rows of conversations into one buffer."""

    def __init__(self, template: Template):
        self.template = template
        self.found = re.compile(template.pattern("*").encode())
        self.end = np.frombuffer(f"{template.end}\n".encode(), np.uint8)

    def escapes(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where a backslash goes in: behind the first byte of each control string that lies in one text."""
        spans = np.array([m.span() for m in self.found.finditer(memoryview(data))], np.int64).reshape(-1, 2)
        text = np.searchsorted(bounds, spans[:, 0], "right") - 1
        return spans[spans[:, 1] <= bounds[text + 1], 0] + 1

    def rows(self, roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all turns, where each begins, and where its text begins and ends."""
        data, bounds = text_bytes(texts)
        named = roles.dictionary_encode()
        headers = [np.frombuffer(self.template.header(r).encode(), np.uint8) for r in named.dictionary.to_pylist()]
        role = named.indices.to_numpy(zero_copy_only=False)
        head = np.array([len(h) for h in headers], np.int64)[role]
        extra = self.escapes(data, bounds)
        before = np.searchsorted(extra, bounds)  # backslashes in the texts before
        size = head + np.diff(bounds) + np.diff(before) + len(self.end)
        starts = np.concatenate([[0], np.cumsum(size)])
        begin = starts[:-1] + head
        stop = starts[1:] - len(self.end)
        out = np.empty(starts[-1], np.uint8)
        # pieces of texts between escapes keep their distance to the place they go to
        pieces = np.sort(np.concatenate([bounds[:-1], extra]), kind="stable")
        owner = np.minimum(np.searchsorted(bounds, pieces, "right") - 1, len(size) - 1)
        inside = np.searchsorted(extra, pieces, "right") - before[owner]
        shift = (begin - bounds[:-1])[owner] + inside
        for at in range(0, len(data), SCATTER_BYTES):
            last = min(at + SCATTER_BYTES, len(data))
            a, b = np.searchsorted(pieces, at, "right") - 1, np.searchsorted(pieces, last)
            lengths = np.diff(np.concatenate([[at], pieces[a + 1 : b], [last]]))
            out[np.arange(at, last) + np.repeat(shift[a:b], lengths)] = data[at:last]
        text = np.searchsorted(bounds, extra, "right") - 1
        out[extra + (begin - bounds[:-1])[text] + np.arange(len(extra)) - before[text]] = ord("\\")
        for k, h in enumerate(headers):
            out[starts[:-1][role == k][:, None] + np.arange(len(h))] = h
        out[stop[:, None] + np.arange(len(self.end))] = self.end
        return out, starts, begin, stop


def lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))


def formatted(
    rows: DataFrame, template: Template | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Formatted conversations with their loss masks; see above."""
    own = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assembler = Assembler(own)
        for part in gathered(batches):
            out, starts, begin, stop = assembler.rows(part.rows.column("role"), part.rows.column("text"))
            edges, n = part.edges, len(part.edges) - 1
            offsets = starts[edges]
            learned = np.isin(part.rows.column("role").to_numpy(zero_copy_only=False).astype(str), own.learned)
            chosen = np.flatnonzero(learned)
            base = offsets[np.searchsorted(edges, chosen, "right") - 1]
            cuts = np.searchsorted(chosen, edges)
            values = pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))
            yield pa.record_batch(
                [part.rows.column("conv_id").take(pa.array(edges[:-1])), pa.array(part.first + np.arange(n), pa.int64()),
                 pa.array(part.whole, pa.bool_()), pa.array(np.diff(edges), pa.int64()), values,
                 lists(begin[chosen] - base, cuts), lists(stop[chosen] - base, cuts)],
                ["conv_id", "part", "whole", "n_turns", "formatted", "loss_starts", "loss_ends"],
            )

    kind = rows.schema[conv_id].dataType.simpleString()
    dealt = ordered(rows, conv_id, turn, role, text)
    return dealt.mapInArrow(
        run, f"conv_id {kind}, part bigint, whole boolean, n_turns bigint, formatted string, loss_starts array<int>, loss_ends array<int>"
    )


class Reader:
    """Parses formatted text back, by the template's marks alone."""

    def __init__(self, template: Template):
        self.template = template
        self.begin, self.end = template.begin.encode(), f"{template.end}\n".encode()
        self.escaped = re.compile(template.pattern("+").encode())
        self.roles: dict[bytes, bytes] = {}

    def plain(self, text: bytes) -> bytes:
        return self.escaped.sub(lambda m: m[0][:1] + m[0][2:], text)

    def turns(self, value: bytes) -> Iterator[tuple[bytes, bytes]]:
        *turns, rest = value.split(self.end)
        if rest or not all(t.startswith(self.begin) for t in turns):
            raise ValueError("not a formatted conversation")
        for t in turns:
            header, _, text = t[len(self.begin) :].partition(b"\n")
            if header not in self.roles:
                if len(self.roles) > 10_000:
                    self.roles.clear()
                self.roles[header] = self.template.role(header.decode()).encode()
            yield self.roles[header], self.plain(text)


def code_points(value: bytes) -> int:
    return len(value) - np.count_nonzero(np.frombuffer(value, np.uint8) & 0xC0 == 0x80)


READ = "conv_id {}, part bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, turns binary, loss binary"


def digests(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """Read back from ``formatted``: per conversation its turns, and the text under the loss mask, as counts and digests."""
    own = template or Template()
    kind = parts.schema["conv_id"].dataType.simpleString()
    names = [c.split(" ")[0] for c in READ.split(", ")]

    def batch_of(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        kinds = [ids, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds[: len(rows[0])])], names[: len(rows[0])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(own)
        for batch in batches:
            rows, held, ids = [], 0, batch.schema.field("conv_id").type
            for k in range(batch.num_rows):
                conv, part, whole, n, value, starts, ends = (batch.column(c)[k] for c in ("conv_id", "part", "whole", "n_turns", "formatted", "loss_starts", "loss_ends"))
                data = value.as_buffer().to_pybytes()
                turns = [r + b"\n" + t + b"\n" for r, t in reader.turns(data)]
                loss = b"".join(reader.plain(data[a:b]) for a, b in zip(starts.as_py(), ends.as_py()))
                row, text = (conv.as_py(), part.as_py(), len(turns)), b"".join(turns)
                sizes = code_points(loss), code_points(data)
                if whole.as_py():
                    rows.append((*row, hashlib.sha256(text).hexdigest(), sizes[0], hashlib.sha256(loss).hexdigest(), sizes[1], None, None))
                else:
                    rows.append((*row, None, sizes[0], None, sizes[1], text, loss))
                    held += len(text)
                if held > PART_BYTES:
                    yield batch_of(rows, ids)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows, ids)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, totals, hashes, kind_of = NEVER, [0, 0, 0], [], None

        def done() -> tuple:
            return (conv, None, totals[0], hashes[0].hexdigest(), totals[1], hashes[1].hexdigest(), totals[2])

        for batch in batches:
            rows, kind_of = [], batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if conv is not NEVER and r["conv_id"] != conv:
                    rows.append(done())
                    conv = NEVER
                if r["turns"] is None:
                    rows.append(tuple(r[c] for c in names[:7]))
                    continue
                if conv is NEVER:
                    conv, totals, hashes = r["conv_id"], [0, 0, 0], [hashlib.sha256(), hashlib.sha256()]
                totals = [a + r[c] for a, c in zip(totals, ("n_turns", "loss_chars", "formatted_chars"))]
                hashes[0].update(r["turns"])
                hashes[1].update(r["loss"])
            if rows:
                yield batch_of(rows, kind_of)
        if conv is not NEVER:
            yield batch_of([done()], kind_of)

    parsed = parts.mapInArrow(read, READ.format(kind))
    dealt = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(joined, ", ".join(READ.format(kind).split(", ")[:7])).drop("part")
