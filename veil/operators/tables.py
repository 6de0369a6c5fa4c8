"""Anonymizing a set of tables so that their joins still hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from veil.functions.pseudo import synth_by_subtype
from veil.session import cut_lineage


def cells(name: str, df: DataFrame) -> DataFrame:
    """A table as (column_id, value): every non-null cell as text."""
    stack = ", ".join(f"'{name}.{c}', CAST(`{c}` AS STRING)" for c in df.columns)
    return df.select(F.expr(f"stack({len(df.columns)}, {stack}) AS (column_id, value)")).where(
        F.col("value").isNotNull()
    )


BITS = 62  # columns per bit mask


def column_signatures(tables: dict[str, DataFrame]) -> DataFrame:
    """Which set of columns shares how many distinct values: (columns array, n_values).

    A set of columns is a few bit masks, OR-ed per value with map-side combine, so a value that fills
    a third of a table costs one entry per map task and no group is ever collected. What follows
    works on column sets, whose number does not grow with rows.
    """
    ids = [f"{t}.{c}" for t, d in tables.items() for c in d.columns]
    masks = [f"m{i}" for i in range((len(ids) + BITS - 1) // BITS)]
    place = {c: (masks[i // BITS], 1 << (i % BITS)) for i, c in enumerate(ids)}

    def marked(name: str, df: DataFrame) -> DataFrame:
        rows = ", ".join(
            f"CAST(`{c}` AS STRING), " + ", ".join(f"{place[f'{name}.{c}'][1] if place[f'{name}.{c}'][0] == m else 0}L" for m in masks)
            for c in df.columns
        )
        return df.select(F.expr(f"stack({len(df.columns)}, {rows}) AS (value, {', '.join(masks)})"))

    every = reduce(DataFrame.unionByName, [marked(n, d) for n, d in tables.items()])
    sets = (
        every.where(F.col("value").isNotNull())
        .groupBy("value").agg(*[F.bit_or(m).alias(m) for m in masks])
        .groupBy(*masks).agg(F.count("*").alias("n_values"))
    )
    named = ", ".join(f"IF({place[c][0]} & {place[c][1]}L <> 0, '{c}', NULL)" for c in sorted(ids))
    return sets.select(F.expr(f"array_compact(array({named}))").alias("columns"), "n_values")


def column_pairs(tables: dict[str, DataFrame], min_overlap: float = 0.2, min_distinct: int = 1) -> DataFrame:
    """Columns of different tables and names whose distinct values overlap enough.

    overlap = shared / smaller distinct count.
    """
    signatures = column_signatures(tables)
    sizes = (
        signatures.select(F.explode("columns").alias("column_id"), "n_values")
        .groupBy("column_id").agg(F.sum("n_values").alias("n_distinct"))
    )
    shared = (
        signatures.select(
            F.explode(
                F.expr(
                    """flatten(transform(columns, (a, i) -> transform(
                        slice(columns, i + 2, size(columns)), b -> struct(a AS a, b AS b))))"""
                )
            ).alias("pair"),
            "n_values",
        )
        .groupBy("pair.a", "pair.b").agg(F.sum("n_values").alias("n_shared"))
        .where(
            (F.split_part("a", F.lit("."), F.lit(1)) != F.split_part("b", F.lit("."), F.lit(1)))
            & (F.split_part("a", F.lit("."), F.lit(2)) != F.split_part("b", F.lit("."), F.lit(2)))
        )
    )
    a, b = sizes.toDF("a", "n_a"), sizes.toDF("b", "n_b")
    smaller = F.least("n_a", "n_b")
    return (
        shared.join(a, "a").join(b, "b")
        .where((F.col("n_shared") / smaller >= min_overlap) & (smaller >= min_distinct))
        .select("a", "b", "n_shared", smaller.alias("n_smaller"))
    )


def column_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, column_id) of every column: schema size."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, f"{t}.{c}") for t, d in tables.items() for c in d.columns]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_id string")


def same_name_links(catalog: DataFrame) -> DataFrame:
    """Columns whose name occurs in more than one table."""
    return (
        catalog.groupBy("column_name")
        .agg(F.count("*").alias("n_tables"), F.array_join(F.sort_array(F.collect_list("table_name")), ",").alias("tables"))
        .where("n_tables > 1")
    )


def link_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components of (node) under (a, b) edges: (node, component), the least node names it.

    A label takes the least label next to it and then the label that this one has itself, so chains
    halve and rounds grow with the logarithm of the longest. Each round starts from files.
    """
    both = cut_lineage(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = cut_lineage(nodes.select("node", F.col("node").alias("component")))
    while True:
        offered = (
            both.join(labels, both["a"] == labels["node"])
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("component").alias("offer"))
        )
        lower = labels.join(offered, "node", "left").select(
            "node", "component", F.least("component", F.coalesce("offer", "component")).alias("low")
        )
        own = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        moved = cut_lineage(
            lower.join(own, "low").select(
                "node",
                F.least("low", "next").alias("component"),
                (F.least("low", "next") < F.col("component")).alias("changed"),
            )
        )
        labels = moved.select("node", "component")
        if moved.where("changed").isEmpty():
            return labels


def group_keys(labels: DataFrame) -> DataFrame:
    """Mapping key per column: ``group_{i}`` for linked columns, ``col::{name}`` for single ones."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    # ranks components, of which there are at most as many as columns
    ranked = sizes.where("n > 1").withColumn(
        "i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("component")) - 1
    )
    return labels.join(ranked, "component", "left").select(
        "node",
        F.coalesce(
            F.concat(F.lit("group_"), F.col("i").cast("string")),
            F.concat(F.lit("col::"), F.substring_index("node", ".", -1)),
        ).alias("group_key"),
    )


# --- rules that stand in for the model: pattern over values, pattern over names ---
VALUE_RULES = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "phone": r"^[+]?[0-9(][0-9() .-]{8,17}[0-9]$",
    "date_of_birth": r"^(19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]$",
    "medical_record_number": r"^MRN[- ]?[0-9]{4,}$",
    "name": r"^[A-Z][a-z]+( [A-Z][a-z]+){1,2}$",
}
NAME_RULES = {
    "email": "e?mail",
    "phone": "phone|mobile|fax",
    "ssn": "ssn|social_sec",
    "national_id": "passport|national_id|aadhaar",
    "date_of_birth": "birth|dob",
    "medical_record_number": "mrn|record_n",
    "medical_condition": "diagnos|condition",
    "account_number": "acct|account",
    "address": "addr|street",
    "generic_id": "custkey|suppkey|user_id|_id$",
    "name": "name",
}
SUBTYPE_ORDER = [
    "email", "ssn", "phone", "date_of_birth", "medical_record_number", "name", "national_id",
    "medical_condition", "account_number", "address", "generic_id",
]
NAME_CONFIDENCE = 0.7


def column_values(tables: dict[str, DataFrame]) -> DataFrame:
    """Every non-null cell of a table set as (column_name, value)."""
    every = reduce(DataFrame.unionByName, [cells(n, d) for n, d in tables.items()])
    return every.select(F.substring_index("column_id", ".", -1).alias("column_name"), "value")


EXAMPLES = 5


def column_classify(samples: DataFrame) -> DataFrame:
    """Label and subtype per distinct column name from all its cells (column_name, value).

    Cells are counted per value first; examples are the least values, ranked with a limit before the
    shuffle. Score of a subtype = share of cells that fit its value pattern, or a fixed confidence
    where the column's name fits; best score wins, then the listed order.
    """
    counted = samples.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    fits = lambda s: F.sum(F.when(F.col("value").rlike(VALUE_RULES[s]), F.col("n")).otherwise(0)) / F.sum("n")
    shares = counted.groupBy("column_name").agg(
        *[(F.round(fits(s), 6) if s in VALUE_RULES else F.max(F.lit(0.0))).alias(f"v_{s}") for s in SUBTYPE_ORDER]
    )
    ranked = counted.withColumn("i", F.row_number().over(Window.partitionBy("column_name").orderBy("value"))).where(F.col("i") <= EXAMPLES)
    examples = ranked.groupBy("column_name").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("examples"))
    stats = shares.join(examples, "column_name")
    lower = F.lower("column_name")
    scored = F.array(
        *[
            F.struct(
                (-F.greatest(F.col(f"v_{s}"), F.when(lower.rlike(NAME_RULES[s]), F.lit(NAME_CONFIDENCE)).otherwise(F.lit(0.0)) if s in NAME_RULES else F.lit(0.0))).alias("score"),
                F.lit(i).alias("i"),
                F.lit(s).alias("subtype"),
            )
            for i, s in enumerate(SUBTYPE_ORDER)
        ]
    )
    best = stats.withColumn("b", F.array_min(scored))
    sure = F.col("b.score") <= -0.5
    return best.select(
        "column_name",
        F.when(sure & F.col("b.subtype").startswith("medical"), "PHI").when(sure, "PII").otherwise("NONE").alias("label"),
        F.when(sure, F.col("b.subtype")).otherwise("other").alias("subtype"),
        F.when(sure, -F.col("b.score")).otherwise(0.0).alias("confidence"),
        "examples",
    )


def synth_cell(column: str, subtype: str, null_policy: str = "keep", unique: bool = False, salt: str = "") -> Column:
    """Stand-in for one cell; nulls stay, or are drawn like the text ``__NULL__``."""
    value = f"CAST(`{column}` AS STRING)"
    if null_policy == "synthesize":
        value = f"coalesce({value}, '__NULL__')"
    return F.expr(synth_by_subtype(f"'{subtype}'", value, unique, salt))


def anonymize_table(df: DataFrame, subtypes: dict[str, str], null_policy: str = "keep", unique: bool = True, salt: str = "") -> DataFrame:
    """Replace the given columns by stand-ins. A pure projection: equal values stay equal everywhere."""
    return df.select(
        *[
            synth_cell(c, subtypes[c], null_policy, unique, salt).alias(c) if c in subtypes else F.col(c)
            for c in df.columns
        ]
    )


def linked_subtypes(info: DataFrame, keys: DataFrame) -> DataFrame:
    """Subtype per column: sensitive columns, and every column linked to one takes the surest member's."""
    joined = keys.withColumn("column_name", F.substring_index("node", ".", -1)).join(info, "column_name", "left")
    member = F.when(
        F.col("label").isin("PII", "PHI"), F.struct("confidence", "subtype")
    )
    best = joined.groupBy("group_key").agg(F.max(member).alias("best"))
    return joined.join(best, "group_key").where("best IS NOT NULL").select(
        "node", "group_key", F.col("best.subtype").alias("subtype")
    )


def apply_mapping(df: DataFrame, column: str, mapping: DataFrame, group_key: str) -> DataFrame:
    """Replace a column through a persisted mapping (group_key, original, synthetic); unknown values stay.

    The mapping grows with the data, so no broadcast is asked for; values that hold much of the table
    are split by the adaptive join.
    """
    m = mapping.where(F.col("group_key") == group_key).select(
        F.col("original").alias("_o"), F.col("synthetic").alias("_s")
    )
    joined = df.withColumn("_o", F.col(column).cast("string")).join(m, "_o", "left")
    return joined.select(*[F.coalesce("_s", "_o").alias(c) if c == column else F.col(c) for c in df.columns])


def extend_mapping(mapping: DataFrame, values: DataFrame, subtype: str, unique: bool = True, salt: str = "") -> DataFrame:
    """Mapping rows for values (group_key, original) that the stored mapping does not know yet."""
    unseen = values.distinct().join(mapping, ["group_key", "original"], "left_anti")
    return unseen.select(
        "group_key", "original", F.expr(synth_by_subtype(f"'{subtype}'", "original", unique, salt)).alias("synthetic")
    )


def key_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of both sides per key (k, l, r): one shuffle of counts.

    A key that holds a third of the rows is one count per map task.
    """
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = left.select(F.col(left_key).alias("k"), one.alias("l"), zero.alias("r")).unionByName(
        right.select(F.col(right_key).alias("k"), zero.alias("l"), one.alias("r"))
    )
    return both.groupBy("k").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def joined_rows(per_key: DataFrame) -> DataFrame:
    """Row count of the inner join whose ``key_counts`` are given: no join."""
    matched = F.when(F.col("k").isNotNull(), F.col("l") * F.col("r"))
    return per_key.agg(F.coalesce(F.sum(matched), F.lit(0)).alias("n_rows"))


def anonymized_keys(per_key: DataFrame, subtype: str, salt: str = "") -> DataFrame:
    """``key_counts`` after both sides are anonymized: each key is mapped once, keys that meet add up."""
    named = per_key.select(F.expr(synth_by_subtype(f"'{subtype}'", "CAST(k AS STRING)", True, salt)).alias("k"), "l", "r")
    return named.groupBy("k").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
