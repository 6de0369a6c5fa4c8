"""URL filters: rules looked up by hashes of every host suffix and path prefix of a url.

Defined cases: a null url, or one without ``://``, has an empty host and an empty path and fits no rule;
urls that occur often are judged once; rules with the same host and path: block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX_HEX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(tail, "^[^?#]*", 0)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their full digest and its short prefix."""
    named = rules.select(
        F.translate(F.col("host"), UPPER, UPPER.lower()).alias("rule_host"), F.col("path").alias("rule_path"), "verdict"
    )
    once = named.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # block after allow
    full = expression("rule_host", "rule_path")
    return once.withColumn("rule_digest", full).withColumn("key", F.substring(full, 1, PREFIX_HEX))


def expression(host: Column | str, path: Column | str) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def host_suffixes(host: Column) -> Column:
    labels = F.split(host, "\\.")
    cuts = F.sequence(F.lit(1), F.size(labels))
    return F.transform(cuts, lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Host, path, the longest fitting rule and its verdict for each page.

    A rule's path may end anywhere, so a path is cut at every length that some rule has: at most as many
    prefixes as there are different rule lengths; these few numbers are all that the driver sees of the rules.
    The largest of the fitting rules is the longest; among equals that with the longer host, then block.
    """
    host, path = host_and_path(pages[url].cast("string"))
    named = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"))
    places = named.where("host != ''").select("host", "path").distinct()
    table = rule_table(rules)
    lengths = [r[0] for r in table.select(F.length("rule_path")).distinct().collect()]
    cuts = F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")
    cut = F.transform(
        F.filter(cuts, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    parts = places.select(
        "host", "path", F.explode(host_suffixes(F.col("host"))).alias("suffix"), cut.alias("prefixes")
    )
    parts = parts.select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    parts = parts.withColumn("digest", expression("suffix", "prefix")).withColumn("key", F.substring("digest", 1, PREFIX_HEX))
    found = parts.join(table, "key").where(
        (F.col("digest") == F.col("rule_digest")) & F.col("suffix").eqNullSafe(F.col("rule_host"))
        & (F.col("prefix") == F.col("rule_path"))
    )
    rule = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        "verdict", F.concat("rule_host", "rule_path").alias("rule"),
    )
    best = found.groupBy("host", "path").agg(F.max(rule).alias("best"))
    return named.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
