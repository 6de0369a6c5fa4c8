"""Format-preserving permutations: bijections on whole domains, formats kept."""

import re

import pytest
from pyspark.sql import functions as F

from veil.functions import permute


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_digit_strings_are_permuted(spark, n):
    df = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("v"))
    rows = df.select("v", F.expr(permute.permute_digits("v", "k")).alias("p"), F.expr(permute.permute_digits("v", "other")).alias("o")).collect()
    assert sorted(r.p for r in rows) == sorted(r.v for r in rows) == sorted(r.o for r in rows)
    if n > 2:  # another key, another permutation, few fixed points; one digit can only be shifted, by ten keys
        assert sum(r.p == r.o for r in rows) < 10 and sum(r.p == r.v for r in rows) < 10


def test_formats_stay(spark):
    texts = ["123-45-6789", "+1 (202) 555-0101", "no digits", "", None, "٣ is no 3", "7", "0" * 36, "9" * 37, "1" * 200 + "x" + "2" * 50, "a\n1\U0001F6002"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = [r.p for r in df.select("i", F.expr(permute.permute_digits("v", "it's")).alias("p")).orderBy("i").collect()]
    shape = lambda t: None if t is None else re.sub("[0-9]", "#", t)
    assert [shape(t) for t in got] == [shape(t) for t in texts]
    assert got[2:5] == texts[2:5] and got[0] != texts[0] and got[9] != texts[9]


def test_long_digit_strings_stay_distinct(spark):
    df = spark.range(20000).selectExpr("concat('9', lpad(CAST(id AS STRING), 35, '0')) AS v", "lpad(CAST(id AS STRING), 50, '0') AS w")
    both = df.select(F.expr(permute.permute_digits("v")).alias("v"), F.expr(permute.permute_digits("w")).alias("w"))
    row = both.selectExpr("count(DISTINCT v) v", "count(DISTINCT w) w", "min(length(v)) a", "min(length(w)) b").first()
    assert tuple(row) == (20000, 20000, 36, 50)


def test_names_do_not_repeat(spark):
    df = spark.range(32 * 32 * 4).withColumn("n", F.expr(permute.permute_person("id", "k", 4)))
    row = df.selectExpr("count(DISTINCT n) d", "count(n) c").first()
    assert row.d == row.c == 4096
    out = spark.createDataFrame([(-1,), (4096,), (None,)], "id long").select(F.expr(permute.permute_person("id", "k", 4)).alias("n"))
    assert [r.n for r in out.collect()] == [None] * 3
