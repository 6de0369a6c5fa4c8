"""Conversation structure repair: the cheapest edits after which roles read ``(s?(ua)+)?``, found by branch and bound.

A row is blank (no character but white space), else duplicate (its role and text came earlier), else truncated
(its last character but white space is none of ``.!?``), else sound. Rows may be kept (0), reroled to user or
assistant (1) or deleted (2, and blank and duplicate rows must be); an empty user or assistant row may be
inserted anywhere (5); a truncated row that stays adds 5. Of equally cheap repairs the one wins whose edits,
written as D, I, K and R in order, are least.

``cheapest`` searches depth first with an explicit stack. A node is a row number and what the roles so far
allow next. The suffix bound of a node is what the rows from there on cost at least from its state, whatever
the edits are; a node is cut if its cost and bound exceed the incumbent (cost, edits), or if its edits are
greater at equal cost, or if an earlier prefix reached the same row and state no dearer and with no greater
edits. The search ends when the stack is empty: the incumbent is proved best.

Conversations mostly lie whole in one task. Those at the edges of partitions, or longer than a part, are
solved in parts: first occurrences of equal rows are found by an aggregation, each part is solved for every
pair of states at its ends, the parts are chained by least (cost, edits), and the chosen edits are applied
part by part; only edits and states of one conversation meet in one task, texts do not.

Defined cases: null roles and texts are one space; null conversation ids are one conversation; rows go by
turn, null turns first, then by the MD5 of role, newline and text; a role that is empty or begins with another letter than s, u or a
can't be kept; an empty table gives no rows. Turns are integers.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import keep
from veil.llm.turns import NEVER, gathered, ordered

KEEP, REROLE, DELETE, INSERT, STAYS_TRUNCATED = 0, 1, 2, 5, 5
WHITE = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (START, ASSISTANT)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEEDED = (USER, USER, ASSISTANT, USER)  # what a reroled or inserted row becomes
LEGAL = {"su", "ua", "au"}
CACHED = 50_000
UNREACHED = 1 << 60


def faults(roles: list[str], texts: list[str], repeated) -> list[str]:
    """First fault of each row, or ``""``; ``repeated(k)`` says whether row k came earlier."""
    out = []
    for k, text in enumerate(texts):
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if repeated(k) else "" if bare[-1] in ".!?" else "truncated")
    return out


def symbols(roles: list[str], found: list[str]) -> str:
    """A letter per row: x must go; s, u, a by role, o another role; upper case if truncated."""
    out = []
    for role, fault in zip(roles, found):
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        out.append("x" if fault in ("blank", "duplicate") else letter.upper() if fault == "truncated" else letter)
    return "".join(out)


def moves_of(row: str, state: int) -> list[tuple[int, str, int]]:
    """What may be done with a row in a state: price, edit and the state after it."""
    moves = [(DELETE, "D", state)]
    if row != "x":
        more = STAYS_TRUNCATED if row.isupper() else 0
        kept = AFTER.get((state, row.lower()))
        if kept is not None:
            moves.append((KEEP + more, "K", kept))
        moves.append((REROLE + more, "R", NEEDED[state]))
    return moves


MOVES = {(row, state): moves_of(row, state) for row in "xsuaoSUAO" for state in STATES}


def with_insertions(cost: list[int]) -> list[int]:
    """Costs to go from each state, if rows may be inserted first; after two insertions states come again."""
    for _ in range(2):
        cost = [min(cost[s], INSERT + cost[NEEDED[s]]) for s in STATES]
    return cost


def suffix_bounds(rows: str, ends: tuple[int, ...]) -> list[list[int]]:
    """For each row and state a cost that no repair of the rows from there on can fall below; edits are ignored."""
    bounds = [with_insertions([0 if s in ends else UNREACHED for s in STATES])]
    for row in reversed(rows):
        after = bounds[-1]
        bounds.append(with_insertions([min(price + after[then] for price, _, then in MOVES[row, s]) for s in STATES]))
    return bounds[::-1]


def cheapest(rows: str, start: int = START, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Least (cost, edits) that lead from ``start`` over all rows to one of ``ends``; None where nothing does."""
    n, bound = len(rows), suffix_bounds(rows, ends)
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        at, state, cost, edits = stack.pop()
        least = cost + bound[at][state]
        if least >= UNREACHED or (best is not None and (least > best[0] or (least == best[0] and edits > best[1]))):
            continue
        known = reached.get((at, state))
        if known is not None and known <= (cost, edits):
            continue
        reached[at, state] = (cost, edits)
        if at == n and state in ends:
            best = (cost, edits)  # what is worse was cut above
            continue
        moves = [(INSERT, "I", NEEDED[state], at)]
        if at < n:
            moves += [(price, edit, then, at + 1) for price, edit, then in MOVES[rows[at], state]]
        # the most promising is searched first: it lies on top of the stack
        moves.sort(key=lambda m: (m[0] + bound[m[3]][m[2]], m[1]), reverse=True)
        for price, edit, then, to in moves:
            if best is None or cost + price + bound[to][then] <= best[0]:
                stack.append((to, then, cost + price, edits + edit))
    return best


class Solver:
    """``cheapest`` with a bounded memory for short conversations: the same few shapes come again and again."""

    def __init__(self):
        self.known: dict[tuple, tuple[int, str] | None] = {}

    def __call__(self, rows: str, start: int = START, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
        if len(rows) > 64:
            return cheapest(rows, start, ends)
        key = (rows, start, ends)
        if key not in self.known:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[key] = cheapest(rows, start, ends)
        return self.known[key]


def applied(edits: str, roles: list[str], texts: list[str], state: int = START) -> tuple[list[str], list[str]]:
    """Rows after the edits."""
    names = {USER: "user", ASSISTANT: "assistant"}
    out_roles, out_texts, at = [], [], 0
    for edit in edits:
        if edit == "K":
            state = AFTER[state, roles[at][:1]]
            out_roles.append(roles[at])
        elif edit != "D":
            state = NEEDED[state]
            out_roles.append(names[state])
        if edit != "D":
            out_texts.append("" if edit == "I" else texts[at])
        at += edit != "I"
    return out_roles, out_texts


def broken_pairs(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))


def gaps_of(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else most - least + 1 - distinct


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PART = "conv_id {}, part bigint, whole boolean, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, turns array<bigint>, roles array<string>, texts array<string>"
TABLE = [pa.int64(), pa.bool_(), *[pa.int64()] * len(COUNTS), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]


def names_of(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def batch_of(schema: str, kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in kinds]
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds)], names_of(schema))


def first_pass(rows: DataFrame, kind: str) -> DataFrame:
    """Whole conversations repaired; of the others, the rows of each part as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = Solver()
        for part in gathered(batches):
            ids = part.rows.schema.field("conv_id").type
            turns, roles, texts = (part.rows.column(c).to_pylist() for c in ("turn", "role", "text"))
            out = []
            for k, (a, b) in enumerate(zip(part.edges[:-1].tolist(), part.edges[1:].tolist())):
                key = (part.rows.column("conv_id")[a].as_py(), part.first + k, part.whole[k])
                mine, said = roles[a:b], texts[a:b]
                if not part.whole[k]:
                    out.append((*key, *[None] * len(COUNTS), None, turns[a:b], mine, said))
                    continue
                seen: set = set()
                found = faults(mine, said, lambda j: (mine[j], said[j]) in seen or seen.add((mine[j], said[j])) is not None)
                # blank rows come earlier, too, but an equal row is blank itself
                cost, edits = solve(symbols(mine, found))
                when = [t for t in turns[a:b] if t is not None]
                counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
                gaps = gaps_of(min(when), max(when), len(set(when))) if when else 0
                out.append((*key, gaps, *counts, broken_pairs(mine), cost, edits, None, *applied(edits, mine, said)))
            yield batch_of(PART, [ids, *TABLE], out)

    return rows.mapInArrow(run, PART.format(kind))


PIECE = (
    "conv_id {}, part bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
    "least bigint, most bigint, distinct bigint, costs array<bigint>, audits array<string>, roles array<string>, texts array<string>"
)
PIECES = [*[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string())]


def solved_parts(loose: DataFrame, kind: str) -> DataFrame:
    """Each part of a split conversation with its faults, and its cheapest edits for each pair of states at its ends."""
    digest = F.md5(F.concat("r.roles", F.lit("\n"), "r.texts"))
    places = loose.select("conv_id", "part", F.posexplode(F.arrays_zip("roles", "texts")).alias("k", "r")).select("conv_id", "part", "k", digest.alias("digest"))
    firsts = places.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "k")).alias("first"))
    again = places.join(firsts, places.conv_id.eqNullSafe(firsts.conv_id) & (places.digest == firsts.digest)).where(F.struct("part", "k") != F.col("first"))
    again = again.groupBy("part").agg(F.collect_set("k").alias("again"))  # a part has a bounded number of rows
    rows = loose.select("conv_id", "part", "turns", "roles", "texts").join(again, "part", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = Solver()
        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                roles, texts, again = r["roles"], r["texts"], set(r["again"] or ())
                found = faults(roles, texts, again.__contains__)
                rows = symbols(roles, found)
                table = [solve(rows, a, (b,)) for a in STATES for b in STATES]
                when = [t for t in r["turns"] if t is not None]
                counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
                yield batch_of(PIECE, [ids, *PIECES], [(
                    r["conv_id"], r["part"], *counts, broken_pairs(roles), roles[0][:1], roles[-1][:1],
                    min(when, default=None), max(when, default=None), len(set(when)),
                    [None if t is None else t[0] for t in table], [None if t is None else t[1] for t in table], roles, texts,
                )])

    return rows.select("conv_id", "part", "turns", "roles", "texts", "again").mapInArrow(run, PIECE.format(kind))


class Chain:
    """The parts of one conversation, chained by least (cost, edits); edits that all ways share are not kept."""

    def __init__(self, conv):
        self.conv, self.parts, self.back = conv, [], []
        self.ways: dict[int, tuple[int, str]] = {START: (0, "")}
        self.counts, self.last, self.turns, self.distinct = [0, 0, 0, 0], None, [None, None], 0

    def add(self, r: dict) -> None:
        ways, back = {}, {}
        for a, (cost, edits) in self.ways.items():
            for b in STATES:
                price, more = r["costs"][4 * a + b], r["audits"][4 * a + b]
                if price is not None and (b not in ways or (cost + price, edits + more) < ways[b]):
                    ways[b], back[b] = (cost + price, edits + more), a
        shared = len(os.path.commonprefix([e for _, e in ways.values()]))
        self.ways = {b: (c, e[shared:]) for b, (c, e) in ways.items()}
        self.parts.append(r["part"])
        self.back.append(back)
        for k, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[k] += r[c]
        self.counts[3] += self.last is not None and self.last + r["first"] not in LEGAL
        self.last = r["last"]
        if r["least"] is not None:
            self.distinct += r["distinct"] - (self.turns[1] == r["least"])
            self.turns = [r["least"] if self.turns[0] is None else self.turns[0], r["most"]]

    def rows(self) -> Iterator[tuple]:
        """Per part its states at both ends; what is counted per conversation stands at the first part."""
        cost, _, state = min((*self.ways[s], s) for s in ENDS if s in self.ways)
        ends = []
        for back in reversed(self.back):
            ends.append((back[state], state))
            state = back[state]
        for k, (part, (a, b)) in enumerate(zip(self.parts, reversed(ends))):
            counts = (gaps_of(*self.turns, self.distinct), *self.counts, cost) if k == 0 else (0,) * len(COUNTS)
            yield (part, *counts, a, b)


CHOSEN = "chosen bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", a int, b int"


def chained(pieces: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, chain = [*[pa.int64()] * (1 + len(COUNTS)), pa.int32(), pa.int32()], None
        for batch in batches:
            for r in batch.to_pylist():
                if chain is not None and r["conv_id"] != chain.conv:
                    yield batch_of(CHOSEN, kinds, list(chain.rows()))
                    chain = None
                chain = chain or Chain(r["conv_id"])
                chain.add(r)
        if chain is not None:
            yield batch_of(CHOSEN, kinds, list(chain.rows()))

    rows = pieces.drop("roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(run, CHOSEN)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with one in twenty each dropped, emptied, stripped of sentence ends, repeated, or given to the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    fated = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return fated.where("fate <> 0").select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


REPAIRED = PART.replace(", turns array<bigint>", "")


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation its repaired ``roles`` and ``texts`` with the edits (``audit``), their cost and the faults found.

    A conversation that is not ``whole`` comes in several rows, to be read by ascending ``part``; its counts stand
    in the first of them, and 0 in the others.
    """
    kind = rows.schema[conv_id].dataType.simpleString()
    parts = keep(first_pass(ordered(rows, conv_id, turn, role, text, " "), kind), "repair-parts")
    pieces = keep(solved_parts(parts.where("NOT whole"), kind), "repair-pieces")
    chosen = chained(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                edits = r["audits"][4 * r["a"] + r["b"]]
                row = (r["conv_id"], r["part"], False, *[r[f"c_{c}"] for c in COUNTS], edits, *applied(edits, r["roles"], r["texts"], r["a"]))
                yield batch_of(REPAIRED, [ids, *[t for k, t in enumerate(TABLE) if k != len(TABLE) - 3]], [row])

    named = chosen.select("chosen", *[F.col(c).alias(f"c_{c}") for c in COUNTS], "a", "b")
    joined = pieces.join(named, pieces.part == named.chosen).select("conv_id", "part", "audits", "roles", "texts", *[f"c_{c}" for c in COUNTS], "a", "b")
    whole = parts.where("whole").drop("turns")
    return whole.unionByName(joined.mapInArrow(run, REPAIRED.format(kind)))


DIGEST = "conv_id {}, part bigint, n bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string, body string"


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, audit and the SHA-256 of its repaired ``role:text`` lines."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    body = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    rows = parts.select(
        "conv_id", "part", F.size("roles").cast("bigint").alias("n"), *COUNTS, "audit",
        F.when(F.col("whole"), F.sha2(body, 256)).alias("repaired_sha256"), F.when(~F.col("whole"), body).alias("body"),
    )
    names = names_of(DIGEST)
    final = DIGEST.rsplit(", ", 1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, totals, audit, digest = NEVER, [], [], None

        def done() -> tuple:
            return (conv, None, *totals, "".join(audit), digest.hexdigest())

        for batch in batches:
            out = []
            kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * (2 + len(COUNTS)), pa.string(), pa.string()]
            for r in batch.to_pylist():
                if conv is not NEVER and r["conv_id"] != conv:
                    out.append(done())
                    conv = NEVER
                if r["body"] is None:
                    out.append(tuple(r[c] for c in names[:-1]))
                    continue
                if conv is NEVER:
                    conv, totals, audit, digest = r["conv_id"], [0] * (1 + len(COUNTS)), [], hashlib.sha256()
                if r["n"]:
                    digest.update((("\n" if totals[0] else "") + r["body"]).encode())
                totals = [a + r[c] for a, c in zip(totals, ("n", *COUNTS))]
                audit.append(r["audit"])
            if out:
                yield batch_of(final, kinds, out)
        if conv is not NEVER:
            yield batch_of(final, kinds, [done()])

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(run, final.format(kind)).drop("part", "n")
