"""Spans of pattern matches inside one text, and overlap resolution, as array expressions.

All of this is row-local: no shuffle, no Python worker. A span is
``struct(rank, kind, start, end, text, confidence, source)`` with code-point offsets. The
expressions are SQL text over a named column, which keeps plan building cheap for long registries.
"""

from __future__ import annotations

import re

from veil.functions.patterns import Pattern, java_regex

SPAN = "struct<rank:int,kind:string,start:int,end:int,text:string,confidence:double,source:string>"
NO_SPANS = f"cast(array() AS array<{SPAN}>)"


def literal(text: str) -> str:
    """A raw SQL string literal; patterns never hold both kinds of quote."""
    quote = '"' if "'" in text else "'"
    if quote in text:
        raise ValueError(f"cannot quote {text!r}")
    return f"r{quote}{text}{quote}"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``; a bound variable is never inlined."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


# Two code points that Unicode reserves for internal use mark matches inside a scanned text.
MARK, INNER, SPARE = "\ufdd0", "\ufdd1", "\ufffd"
HIT = "struct<rank:int,kind:string,confidence:double,source:string,pieces:array<string>>"
PAGE = 128  # entries a growing array holds before it is set aside


def append(pages: str, page: str, entry: str) -> str:
    """Fields ``pages`` and ``page`` of a fold that grows a list by one entry.

    Appending copies the array, so a list grows in pages. Long lists should hold numbers: what they
    point to is then taken by one ``transform``.
    """
    full = f"size({page}) >= {PAGE}"
    return f"IF({full}, concat({pages}, array({page})), {pages}) AS pages, IF({full}, array({entry}), concat({page}, array({entry}))) AS page"


NO_PAGES = "cast(array() AS array<array<int>>) AS pages, cast(array() AS array<int>) AS page"


def starts(lengths: str) -> str:
    """Where each of consecutive pieces begins, from their lengths."""
    return f"""aggregate({lengths}, struct(0 AS at, {NO_PAGES}),
        (a, n) -> struct(a.at + n AS at, {append('a.pages', 'a.page', 'a.at')}),
        a -> flatten(concat(a.pages, array(a.page))))"""


def split_group(regex: str) -> tuple[str, str, str]:
    """A Java regex as what stands before, inside and after its first capturing group."""
    depth, open_at, end_at, k, in_class = 0, None, None, 0, False
    while k < len(regex):
        c = regex[k]
        if c == "\\":
            k += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            if open_at is None and regex[k + 1 : k + 2] != "?":
                if depth:
                    raise ValueError(f"the group of {regex!r} stands inside another one")
                open_at = k
            depth += 1
        elif c == ")":
            depth -= 1
            if open_at is not None and end_at is None and depth == 0:
                end_at = k
        elif c == "|" and depth == 0:
            raise ValueError(f"alternatives of {regex!r} need a group (?:...) of their own")
        k += 1
    return regex[:open_at], regex[open_at + 1 : end_at], regex[end_at + 1 :]


def quoted(text: str) -> str:
    """A SQL string literal of any text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def marked_pieces(text: str, pattern: Pattern, rank: int, inner: bool = True) -> str:
    """One regex pass: marks are set around the matches, then gap, match, gap, ... are split apart.

    A match is marked as what stands before the value, the value, and what stands after it; without
    ``inner`` marks it is the value.
    """
    regex = java_regex(pattern.regex, pattern.any_digit)
    marked = f"{MARK}{INNER}$0{INNER}{MARK}" if inner else f"{MARK}$0{MARK}"
    if pattern.group:
        before, value, after = split_group(regex)
        more = len(re.findall(r"(?<!\\)\((?!\?)", value))
        regex, marked = f"({before})({value})({after})", f"{MARK}$1{INNER}$2{INNER}${3 + more}{MARK}"
    hit = f"""struct({rank} AS rank, {quoted(pattern.kind)} AS kind, {pattern.confidence}D AS confidence, {quoted(pattern.source)} AS source,
        split(regexp_replace({text}, {literal(regex)}, '{marked}'), '{MARK}', -1) AS pieces)"""
    if pattern.hints:
        hinted = " OR ".join(f"contains({text}, {literal(h)})" for h in pattern.hints)
        hit = f"IF({hinted}, {hit}, NULL)"
    return hit


FEW = 48  # pieces whose places are taken from the pieces before them; longer lists are folded


def hit_spans(hit: str, inner: bool = True) -> str:
    """Spans of one pattern's pieces, of which every second is a match."""
    if not inner:
        span = f"""struct({hit}.rank AS rank, {hit}.kind AS kind, b AS start, b + length(p) AS end,
            p AS text, {hit}.confidence AS confidence, {hit}.source AS source)"""
        every = f"transform(sequence(1, size({hit}.pieces) - 1, 2), i -> {{}})"
        one = let(f"length(array_join(slice({hit}.pieces, 1, i), ''))", "b", let(f"get({hit}.pieces, i)", "p", span))
        many = let(f"get({hit}.pieces, i)", "p", let("get(at, i)", "b", span))
        at = starts(f"transform({hit}.pieces, p -> length(p))")
        return f"IF(size({hit}.pieces) <= {FEW}, {every.format(one)}, {let(at, 'at', every.format(many))})"
    lengths = f"transform({hit}.pieces, (p, i) -> IF(i % 2 = 1, length(p) - 2, length(p)))"
    value = f"substring_index(substring_index(p, '{INNER}', 2), '{INNER}', -1)"
    span = f"""struct({hit}.rank AS rank, {hit}.kind AS kind, b AS start, b + length(v) AS end,
        v AS text, {hit}.confidence AS confidence, {hit}.source AS source)"""
    begin = f"get(at, i) + length(substring_index(p, '{INNER}', 1))"
    one = let(f"get({hit}.pieces, i)", "p", let(value, "v", let(begin, "b", span)))
    every = f"transform(sequence(1, size({hit}.pieces) - 1, 2), i -> {one})"
    return let(starts(lengths), "at", every)


def all_spans(text: str, patterns: list[Pattern]) -> str:
    """Spans of every pattern in (registry, position) order: one array per row, one read of the text.

    Patterns that need digits share one cheap test, so texts without digits skip them all. A text
    that holds a mark itself is scanned with a neutral stand-in of the same length.
    """
    inner = any(p.group for p in patterns)
    tests = list(dict.fromkeys(java_regex(p.needs, p.any_digit) for p in patterns if p.needs))

    def pieces(rank: int, p: Pattern) -> str:
        hit = marked_pieces("t", p, rank, inner)
        return f"IF(get(needed, {tests.index(java_regex(p.needs, p.any_digit))}), {hit}, NULL)" if p.needs else hit

    plain = [pieces(i, p) for i, p in enumerate(patterns) if not p.digits]
    digit = [pieces(i, p) for i, p in enumerate(patterns) if p.digits]
    none = f"cast(array() AS array<{HIT}>)"
    groups = []
    if plain:
        groups.append(f"array({', '.join(plain)})")
    if digit:
        groups.append(f"IF(rlike(t, '[0-9][0-9]'), array({', '.join(digit)}), {none})")
    hits = f"array_sort(filter(concat({', '.join(groups)}), h -> size(h.pieces) > 1))"
    found = f"flatten(transform({hits}, h -> {hit_spans('h', inner)}))"
    if tests:
        found = let(f"array({', '.join(f'rlike(t, {literal(x)})' for x in tests)})", "needed", found)
    dirty = f"contains({text}, '{MARK}') OR contains({text}, '{INNER}')"
    clean = f"IF({dirty}, translate({text}, '{MARK}{INNER}', '{SPARE}{SPARE}'), {text})"
    restored = f"""transform(spans, s -> IF(contains(s.text, '{SPARE}'),
        struct(s.rank AS rank, s.kind AS kind, s.start AS start, s.end AS end,
            substr({text}, s.start + 1, s.end - s.start) AS text, s.confidence AS confidence, s.source AS source), s))"""
    return let(let(clean, "t", found), "spans", f"IF({dirty}, {restored}, spans)")


def keep_disjoint(spans: str) -> str:
    """Greedy overlap resolution in array order: keep a span unless it overlaps one already kept."""
    return f"""aggregate({spans}, {NO_SPANS}, (kept, s) ->
        CASE WHEN exists(kept, k -> k.start < s.end AND k.end > s.start) THEN kept
             ELSE concat(kept, array(s)) END)"""


SHORT = 24  # spans that are compared pairwise; longer lists are cut into clusters first


def resolve_overlaps(spans: str) -> str:
    """``keep_disjoint`` for long lists: spans that touch form clusters, each resolved by itself.

    Spans of different clusters never overlap, so the result is that of the whole list, in
    (rank, position) order.
    """
    cuts = f"""aggregate(o, struct(-1 AS reach, 0 AS i, {NO_PAGES}),
        (a, s) -> IF(s.start < a.reach,
            struct(greatest(a.reach, s.end) AS reach, a.i + 1 AS i, a.pages AS pages, a.page AS page),
            struct(s.end AS reach, a.i + 1 AS i, {append('a.pages', 'a.page', 'a.i')})),
        a -> concat(flatten(concat(a.pages, array(a.page))), array(a.i)))"""
    cluster = "slice(o, c + 1, get(cuts, i + 1) - c)"
    kept = f"""flatten(transform(slice(cuts, 1, size(cuts) - 1), (c, i) -> IF(get(cuts, i + 1) - c < 2, {cluster},
        {let(cluster, 'k', keep_disjoint('array_sort(k)'))})))"""
    clustered = let(by_position("all"), "o", f"array_sort({let(cuts, 'cuts', kept)})")
    short = f"IF(size(all) < 2, all, IF(size(all) <= {SHORT}, {keep_disjoint('array_sort(all)')}, {clustered}))"
    return let(spans, "all", short)


def keep_leftmost(spans: str) -> str:
    """``keep_disjoint`` of spans in reading order: only the last kept span can reach into the next one."""
    kept = f"""aggregate(o, struct(-1 AS reach, 0 AS i, {NO_PAGES}),
        (a, s) -> IF(s.start < a.reach,
            struct(a.reach AS reach, a.i + 1 AS i, a.pages AS pages, a.page AS page),
            struct(s.end AS reach, a.i + 1 AS i, {append('a.pages', 'a.page', 'a.i')})),
        a -> flatten(concat(a.pages, array(a.page))))"""
    return let(by_position(spans), "o", f"transform({kept}, k -> get(o, k))")


def by_position(spans: str) -> str:
    """Spans in reading order; the sort is stable, so equal starts keep their order."""
    return f"array_sort({spans}, (a, b) -> CASE WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1 ELSE 0 END)"


BLOCK = 2048


def between(blocks: str, start: str, end: str) -> str:
    """Characters from ``start`` to ``end`` of a text cut into blocks: only the blocks that hold them are read."""
    return f"""IF({end} <= {start}, '', substr(array_join(slice({blocks}, {start} div {BLOCK} + 1,
        ({end} - 1) div {BLOCK} - {start} div {BLOCK} + 1), ''), {start} % {BLOCK} + 1, {end} - {start}))"""


def splice(text: str, spans: str, replacement: str) -> str:
    """Replace exactly the given disjoint spans; ``replacement`` is an expression over span ``s``."""
    last = "coalesce(get(o, i - 1).end, 0)"
    pieces = f"transform(o, (s, i) -> concat({between('blocks', last, 's.start')}, {replacement}))"
    tail = between("blocks", "coalesce(get(o, size(o) - 1).end, 0)", f"length({text})")
    body = let(f"regexp_extract_all({text}, r'(?s).{{1,{BLOCK}}}', 0)", "blocks", f"concat(array_join({pieces}, ''), {tail})")
    return let(by_position(spans), "o", f"IF(size(o) = 0, {text}, {body})")
