"""Chunks of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions.spans import append, let
from veil.functions.text import SPACE


def word_chunks(text: str, limit: int = 4000) -> str:
    """Array of chunks: a short text as it is, a long one packed word by word up to the limit.

    Only cut positions are folded; each chunk is then joined once from its slice of words.
    """
    words = f"filter(split({text}, r'{SPACE}+'), w -> w <> '')"
    cuts = f"""aggregate(words, struct(0 AS i, 0 AS n, array(0) AS cuts),
        (a, w) -> IF(a.n + length(w) > {limit} AND a.i > element_at(a.cuts, -1),
            struct(a.i + 1 AS i, length(w) AS n, concat(a.cuts, array(a.i)) AS cuts),
            struct(a.i + 1 AS i, a.n + length(w) + 1 AS n, a.cuts AS cuts)),
        a -> concat(a.cuts, array(a.i)))"""
    slices = """transform(slice(cuts, 1, size(cuts) - 1), (c, i) ->
        array_join(slice(words, c + 1, get(cuts, i + 1) - c), ' '))"""
    # a text of blanks only has no words and no chunks
    long = let(words, "words", f"IF(size(words) = 0, cast(array() AS array<string>), {let(cuts, 'cuts', slices)})")
    return f"IF(length({text}) <= {limit}, array({text}), {long})"


def with_offsets(chunks: str) -> str:
    """Chunks with running offsets, one character between neighbours: array<struct<chunk, chunk_offset>>."""
    entry = "struct<chunk:string,chunk_offset:bigint>"
    step = append("a.pages", "a.page", "struct(c AS chunk, a.at AS chunk_offset)")
    return f"""aggregate({chunks},
        struct(0L AS at, cast(array() AS array<array<{entry}>>) AS pages, cast(array() AS array<{entry}>) AS page),
        (a, c) -> struct(a.at + length(c) + 1 AS at, {step}),
        a -> flatten(concat(a.pages, array(a.page))))"""


def chunk_words(pages: DataFrame, limit: int = 4000) -> DataFrame:
    """(doc_id, page_num, chunk_idx, chunk, chunk_offset), row-local."""
    return (
        pages.select(
            "doc_id",
            "page_num",
            F.posexplode_outer(F.expr(with_offsets(word_chunks("text", limit)))).alias("chunk_idx", "c"),
        )
        .where(F.col("c").isNotNull())
        .select("doc_id", "page_num", "chunk_idx", "c.chunk", "c.chunk_offset")
    )


def stride_chunks(text: str, size: int = 2000, overlap: int = 150) -> str:
    """Array of overlapping windows of fixed stride that cover the whole text."""
    stride = size - overlap
    return f"""transform(sequence(0, greatest(length({text}) - {overlap} - 1, 0), {stride}),
        at -> substr({text}, at + 1, {size}))"""


def chunk_overlap(pages: DataFrame, size: int = 2000, overlap: int = 150) -> DataFrame:
    return pages.select(
        "doc_id", "page_num", F.posexplode(F.expr(stride_chunks("text", size, overlap))).alias("chunk_idx", "chunk")
    )


# --- fixed values: where a chunk may end, best first ---
SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " "]


def quoted(text: str) -> str:
    return "'" + text.replace("\n", "\\n") + "'"


def separator_cuts(size: int, overlap: int) -> str:
    """Begin and end of every window over ``blocks`` (a text in pieces of ``size``) and its length ``n``.

    The fold holds positions only. What it searches is cut from two neighbouring blocks, so a step costs a window
    and not the text before it. A separator is found from behind in the reversed second half of the window.
    """
    head = size // 2
    half = f"reverse(substr(concat(get(blocks, CAST((a.at + {head}) div {size} AS INT)), coalesce(get(blocks, CAST((a.at + {head}) div {size} AS INT) + 1), '')), (a.at + {head}) % {size} + 1, {size - head}))"
    found = ", ".join(f"nullif(locate({quoted(sep[::-1])}, w), 0)" for sep in SEPARATORS)
    end = let(half, "w", f"a.at + {size} + 1 - coalesce({found}, 1)")
    page = append("a.pages", "a.page", "struct(a.at AS at, e AS e)")
    entry = "struct<at:int,e:int>"
    state = f"struct<at:int,pages:array<array<{entry}>>,page:array<{entry}>>"
    step = let(end, "e", f"CAST(struct(e - {overlap} AS at, {page}) AS {state})")
    last = "array(struct(a.at AS at, n AS e))"
    return f"""aggregate(sequence(0, n div {head + 1 - overlap}),
        CAST(struct(0 AS at, array() AS pages, array() AS page) AS {state}),
        (a, i) -> IF(n - a.at > {size}, {step}, a),
        a -> concat(flatten(concat(a.pages, array(a.page))), {last}))"""


def separator_chunks(text: str, size: int = 2000, overlap: int = 150) -> str:
    """Array of windows, each ending behind the best separator of its second half.

    Each window starts ``overlap`` before the end of the last; together they cover the whole text. A short text,
    an empty one too, is one chunk; null has none. Work is linear in the text.
    """
    if overlap > size // 2:
        raise ValueError("overlap must not be longer than half a chunk")
    block = f"c.at div {size}"
    piece = f"""substr(concat(get(blocks, CAST({block} AS INT)), coalesce(get(blocks, CAST({block} AS INT) + 1), '')),
        c.at % {size} + 1, c.e - c.at)"""
    taken = f"transform(cuts, c -> {piece})"
    blocks = f"regexp_extract_all({text}, r'(?s).{{1,{size}}}', 0)"
    long = let(blocks, "blocks", let(f"length({text})", "n", let(separator_cuts(size, overlap), "cuts", taken)))
    return f"IF(length({text}) <= {size}, array({text}), {long})"


def chunk_at_separators(pages: DataFrame, size: int = 2000, overlap: int = 150) -> DataFrame:
    """Separator-aware chunks, row-local and without Python."""
    return pages.where(F.col("text").isNotNull()).select(
        "doc_id", "page_num", F.posexplode(F.expr(separator_chunks("text", size, overlap))).alias("chunk_idx", "chunk")
    )
