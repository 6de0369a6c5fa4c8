"""Names: every part of a name keeps one stand-in, and stand-ins do not repeat before the pool ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions import hashing as H
from veil.functions.text import collapse_space
from veil.operators.running import block_rank


def name_parts(names: DataFrame) -> DataFrame:
    """(doc_id, ord, text) exploded into (…, pos, part, role); the last of two parts is a last name."""
    split = names.withColumn("parts", F.split(collapse_space(F.col("text")), " "))
    return split.select(
        "doc_id", "ord", "text", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("pos", "part")
    ).withColumn("role", F.when((F.col("n_parts") == 2) & (F.col("pos") == 1), "last").otherwise("first"))


def first_role(parts: DataFrame) -> DataFrame:
    """The role a part has where it first occurs, longest name first: (doc_id, part, role)."""
    return (
        parts.groupBy("doc_id", "part")
        .agg(F.min(F.struct((-F.length("text")).alias("n"), "ord", "pos", "role")).alias("f"))
        .select("doc_id", "part", F.col("f.role").alias("role"))
    )


def pseudo_person(names: DataFrame, salt: str = "") -> DataFrame:
    """Stand-in per (doc_id, ord, text). Parts are ranked by hash, so the pick is injective up to pool size.

    The rank is taken in blocks of the hash, so a document with most of all names is no single task.
    """
    parts = name_parts(names)
    roles = first_role(parts)
    ranked = block_rank(
        roles.withColumn("h", F.expr(H.digest("part", salt))), ["doc_id", "role"], F.col("h"), F.substring("h", 1, 2), "rank"
    )
    name = f"IF(role = 'last', {H.choose(H.LAST_NAMES, 'rank')}, {H.choose(H.FIRST_NAMES, 'rank')})"
    stand_in = ranked.select("doc_id", "part", F.expr(name).alias("new_part"))
    return (
        parts.join(stand_in, ["doc_id", "part"])
        .groupBy("doc_id", "ord", "text")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "new_part"))).alias("p"))
        .select("doc_id", "ord", "text", F.array_join(F.col("p.new_part"), " ").alias("pseudonym"))
    )
