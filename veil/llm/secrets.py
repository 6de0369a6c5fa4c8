"""Secret scans: typed spans in texts, and what the whole corpus says about who owns each candidate.

A candidate that more than ``FEW_OWNERS`` owners or more than ``FEW_REPOSITORIES`` repositories hold is a widely
copied example, so one spread over many documents of a single large owner is, too; one that stays with few of
both is taken for a live credential. Only hashes of candidates and texts are counted and joined.

Defined cases: null and empty texts have no spans; a null owner or repository counts as one of its own;
repeated rows are scanned each on its own but count once towards owners and repositories; repositories that
hold a candidate in equal texts only are copies of one another and count as one; spans of different kinds may
overlap, those of one kind never do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm.common import keep


@dataclass(frozen=True)
class Kind:
    """A span is a match of ``pattern``; its candidate is group ``value``, of ``least`` characters or more."""

    name: str
    pattern: str
    value: int = 0
    least: int = 0


BASE = [
    Kind(
        "assign",
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        "|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Kind("access", "AKIA[A-Z0-9]{16,}"),  # a shorter match holds no longer one
    Kind("hex", "[0-9a-f]{24,}"),
]
MORE = [
    Kind("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Kind("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Kind("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    # up to the end line, whose absence leaves the first line alone; single dashes may stand in the header fields
    Kind("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,9}-----END [A-Z ]*PRIVATE KEY-----)?"),
]
KINDS = [*BASE, *MORE]
FEW_OWNERS, FEW_REPOSITORIES = 2, 10
BLOCK = 64
SPAN = "array<struct<start:int,kind:int,end:int,candidate:string>>"


def placed(items: Column) -> Column:
    """(gap, size, kept, candidate) pieces as (start, end, kept, candidate), by a fold over blocks of a fold.

    A plain fold copies all it has at every step; with blocks it copies once a block.
    """
    empty = F.array().cast("array<struct<start:int,end:int,kept:boolean,candidate:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, item):
        begin = acc.at + item.gap
        span = F.struct(begin.alias("start"), (begin + item["size"]).alias("end"), item.kept.alias("kept"), item.candidate.alias("candidate"))
        return F.struct((begin + item["size"]).alias("at"), F.concat(acc.out, F.array(span)).alias("out"))

    def block(acc, part):
        inner = F.aggregate(part, F.struct(acc.at.alias("at"), empty.alias("out")), step)
        joined = F.transform(F.array(inner), lambda x: F.struct(x.at.alias("at"), F.concat(acc.out, x.out).alias("out")))
        return joined[0]

    cuts = F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))
    blocks = F.transform(cuts, lambda k: F.slice(items, k, F.lit(BLOCK)))
    return F.when(F.size(items) > 0, F.aggregate(blocks, start, block, lambda acc: acc.out)).otherwise(empty)


def kind_spans(text: Column, kind: Kind, number: int) -> Column:
    """Leftmost spans of one kind that do not overlap; matches with too short a candidate take their place, too."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.value)) if kind.value else matches
    gaps = F.split(text, kind.pattern, -1)
    items = F.zip_with(
        F.arrays_zip(matches.alias("m"), values.alias("v")), F.slice(gaps, F.lit(1), F.size(matches)),
        lambda x, g: F.struct(
            F.length(g).alias("gap"), F.length(x.m).alias("size"), (F.length(x.v) >= kind.least).alias("kept"),
            F.sha2(x.v, 256).alias("candidate"),
        ),
    )
    found = F.filter(placed(items), lambda s: s.kept)
    spans = F.transform(
        found, lambda s: F.struct(s.start.alias("start"), F.lit(number).alias("kind"), s.end.alias("end"), s.candidate.alias("candidate"))
    )
    return F.when(text.rlike(kind.pattern), spans).otherwise(F.array().cast(SPAN))


def spans(text: Column, kinds: list[Kind] = KINDS) -> Column:
    """All spans of a text, by start, then by kind in the order listed."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_sort(F.concat(*[kind_spans(text, k, n) for n, k in enumerate(kinds)]))


def named(found: Column, kinds: list[Kind] = KINDS) -> Column:
    names = F.array(*[F.lit(k.name) for k in kinds])
    parts = F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string")))
    return F.array_join(parts, ",")


def ownership(hits: DataFrame, few: int = FEW_OWNERS, few_repositories: int = FEW_REPOSITORIES) -> DataFrame:
    """Per candidate: how many repositories and owners hold it, and whether it is an example or live.

    A text that several repositories hold counts for the first of them.
    """
    blank = F.lit("\x00")
    owner, repository = (F.coalesce(F.col(c).cast("string"), blank).alias("name") for c in ("owner", "repository"))
    owners = hits.select("candidate", F.lit(True).alias("owns"), owner).distinct()
    texts = hits.groupBy("candidate", "text").agg(F.min(repository).alias("name"))
    repositories = texts.select("candidate", F.lit(False).alias("owns"), "name").distinct()
    counted = owners.unionByName(repositories).groupBy("candidate").agg(
        F.count_if(~F.col("owns")).alias("n_repositories"), F.count_if("owns").alias("n_owners")
    )
    return counted.withColumn("live", (F.col("n_owners") <= few) & (F.col("n_repositories") <= few_repositories))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id",
         few: int = FEW_OWNERS, few_repositories: int = FEW_REPOSITORIES) -> DataFrame:
    """Per row: its spans, how many of them are live credentials or copied examples by the whole corpus, and in
    ``judged`` each candidate with its repositories and owners."""
    rows = keep(
        docs.select(
            docs[doc_id].alias("doc_id"), docs[owner].alias("owner"), docs[repository].alias("repository"),
            F.xxhash64(docs[text]).alias("text"), spans(docs[text]).alias("spans"), F.monotonically_increasing_id().alias("row"),
        ), "secret-spans",
    )
    hits = rows.where(F.size("spans") > 0).select("row", "owner", "repository", "text", F.explode("spans.candidate").alias("candidate"))
    known = F.struct("candidate", "n_repositories", "n_owners", "live")
    judged = hits.join(ownership(hits, few, few_repositories), "candidate", "left").groupBy("row").agg(
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"), F.array_sort(F.collect_set(known)).alias("judged")
    )
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_live", "n_example")]
    return rows.join(judged, "row", "left").select("doc_id", "spans", *counts, F.coalesce("judged", F.array()).alias("judged"))


def redacted(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", mark: str = "[SECRET]",
             few: int = FEW_OWNERS, few_repositories: int = FEW_REPOSITORIES) -> DataFrame:
    """``docs`` with live credentials replaced by ``mark``; copied examples stay. Columns are those of ``docs``."""
    key = F.xxhash64(docs[text], docs[repository], docs[owner])
    found = docs.select(
        key.alias("row"), docs[owner].alias("owner"), docs[repository].alias("repository"), F.xxhash64(docs[text]).alias("text"),
        spans(docs[text]).alias("spans"),
    ).where(F.size("spans") > 0)
    hits = keep(found.select("row", "owner", "repository", "text", F.explode("spans").alias("span")), "secret-hits")
    candidates = hits.select("owner", "repository", "text", F.col("span.candidate").alias("candidate"))
    live = hits.join(ownership(candidates, few, few_repositories).where("live"), F.col("span.candidate") == F.col("candidate"), "left_semi")
    marked = live.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("span.start", "span.end"))).alias("marked"))
    rows = docs.select(key.alias("row"), F.struct("*").alias("doc")).join(marked, "row", "left")
    new = F.when(F.col("marked").isNull(), F.col(f"doc.{text}")).otherwise(without(F.col(f"doc.{text}"), F.col("marked"), mark))
    return rows.select(*[(new if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])


def without(text: Column, marked: Column, mark: str) -> Column:
    """``text`` with the places in ``marked`` (sorted) replaced; overlapping places become one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, place):
        gap = F.substring(text, acc.at + 1, place.start - acc.at)
        fresh = F.struct(place.end.alias("at"), F.concat(acc.out, gap, F.lit(mark)).alias("out"))
        more = F.struct(F.greatest(acc.at, place.end).alias("at"), acc.out.alias("out"))
        return F.when(place.start >= acc.at, fresh).otherwise(more)

    return F.aggregate(marked, start, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))
