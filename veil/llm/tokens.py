"""Exact token counts of a piece vocabulary at every prefix of a text.

The vocabulary merges pieces by score. A sequence of pieces is what the merges give exactly if every two
neighbours, merged on their own, stay as they are. So the last piece of each prefix follows from those of
shorter prefixes, and so does its count: one pass, however long the text or a word in it is. Pieces never
hold a blank after another character (``Vocabulary`` makes sure of it), so a text falls into units that
begin with blanks and are counted each on its own.

Defined cases: null and empty texts have no tokens and no prefixes; special strings inside a text are plain
text; repeated ids give one row each.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm.common import mapped

BLANK = "▁"
UNIT = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
CACHED_UNITS = 200_000
CACHED_CHARS = 64


class Vocabulary(dict):
    """Counts at every prefix of units seen so far, and the pieces they come from."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in own}
        if any(BLANK in p.lstrip(BLANK) for p in self.scores):
            raise ValueError("pieces with inner blanks: texts can't be cut at blanks")
        self.longest = max(map(len, self.scores))
        self.pieces = list(self.scores)
        # the number of each piece; -1 for what only begins a piece
        self.numbers = {p[:k]: -1 for p in self.pieces for k in range(1, len(p))} | {p: n for n, p in enumerate(self.pieces)}
        self.neighbours: list[dict[int, bool]] = [{} for _ in self.pieces]
        self.n_pairs = 0
        self.totals = Totals(self)

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text, best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-s, i) for i in range(len(parts) - 1) if (s := self.scores.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stay(self, left: int, right: int) -> bool:
        """Whether two pieces next to each other stay as they are."""
        if self.n_pairs >= 8 * CACHED_UNITS:
            for known in self.neighbours:
                known.clear()
            self.n_pairs = 0
        a, b = self.pieces[left], self.pieces[right]
        found = self.neighbours[left][right] = self.merged(a + b) == [a, b]
        self.n_pairs += 1
        return found

    def counts(self, unit: str) -> list[int]:
        """Number of tokens of ``unit[:1]``, ``unit[:2]`` and so on.

        Every prefix has one last piece. A prefix that is known offers each piece that begins after it to the
        prefix where that piece ends; the piece that stays next to the known last piece is the one.
        """
        n, number, longest = len(unit), self.numbers.get, self.longest
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        for begin in range(n):
            count = counts[begin] + 1
            before = last[begin]
            known = self.neighbours[before] if before >= 0 else None
            for end in range(begin + 1, min(n, begin + longest) + 1):
                piece = number(unit[begin:end])
                if piece is None:
                    break
                if piece >= 0 and not counts[end]:
                    fits = True if known is None else known.get(piece)
                    if fits is None:
                        fits = self.stay(before, piece)
                    if fits:
                        counts[end], last[end] = count, piece
            if not counts[begin + 1]:  # an unknown character: its bytes, and nothing merges across it
                counts[begin + 1] = counts[begin] + len(unit[begin].encode("utf-8", "surrogatepass"))
        del counts[0]
        return counts

    def prefixes(self, unit: str) -> np.ndarray:
        return np.asarray(self.counts(unit), np.int32)

    def __missing__(self, unit: str) -> np.ndarray:
        found = self.prefixes(unit)
        if len(unit) <= CACHED_CHARS:
            if len(self) >= CACHED_UNITS:
                self.clear()
            self[unit] = found
        return found


class Totals(dict):
    """The count at the end of each unit seen so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, unit: str) -> int:
        total = self.vocabulary.counts(unit)[-1]
        if len(unit) <= CACHED_CHARS:
            if len(self) >= 5 * CACHED_UNITS:
                self.clear()
            self[unit] = total
        return total


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def units(text: str) -> list[str]:
    return UNIT.findall(BLANK + text.replace(" ", BLANK)) if text else []


def text_prefixes(vocab: Vocabulary, text: str) -> np.ndarray:
    """Number of tokens of every prefix of ``text``, the whole text last."""
    total, parts = 0, []
    for unit in units(text):
        counts = vocab[unit]
        parts.append(counts + total)
        total += int(counts[-1])
    return np.concatenate(parts)[1:] if parts else np.zeros(0, np.int32)  # the first blank is not of the text


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every text."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        totals = vocabulary(path).totals
        texts = [t or "" for t in batch.column("text").to_pylist()]
        counts = [sum(map(totals.__getitem__, units(t))) for t in texts]
        sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
        yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                              ["doc_id", "n_bytes", "n_tokens"])

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    return mapped(docs, {"doc_id": doc_id, "text": text}, schema, work)


def prefix_table(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``prefix_tokens``: the exact number of tokens of the first 1, 2, ... code points.

    Four bytes a character: kept for texts whose cuts are asked for again and again.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        arrays = [text_prefixes(vocab, t or "") for t in batch.column("text").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
        values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
        yield pa.record_batch([batch.column("doc_id"), lists], ["doc_id", "prefix_tokens"])

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, prefix_tokens array<int>"
    return mapped(docs, {"doc_id": doc_id, "text": text}, schema, work)


def longest_prefix(prefix_tokens: Column, budget: int) -> Column:
    """How many code points the longest prefix within ``budget`` tokens has.

    Counts may fall by one when a character completes a longer piece, so the last fitting prefix counts, not
    the first that does not fit.
    """
    fits = F.filter(F.sequence(F.lit(1), F.size(prefix_tokens)), lambda n: F.element_at(prefix_tokens, n) <= budget)
    return F.when(F.size(prefix_tokens) > 0, F.coalesce(F.array_max(fits), F.lit(0))).otherwise(0)


def tokens_between(prefix_tokens: Column, chars: Column) -> Column:
    """Exact number of tokens of the first ``chars`` code points."""
    return F.when(chars <= 0, 0).otherwise(F.try_element_at(prefix_tokens, F.least(chars, F.size(prefix_tokens))))
