"""What the physical plans must and must not hold, whatever the data size."""

import re

import pytest
from pyspark.sql import functions as F

import checks.catalog  # noqa: F401 - registers the queries
from checks import base
from tests.conftest import SMALL
from veil.functions.patterns import REGISTRY
from veil.operators import chunk, detect, mask, resolve, synth, tables
from veil.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return readers.documents(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_row_local_work_has_no_shuffle(docs):
    for df in (
        mask.protect(docs, REGISTRY),
        mask.protect_spans(docs, REGISTRY),
        detect.detect_patterns(docs),
        chunk.chunk_words(docs),
        synth.synthesize(docs.withColumn("file_type", F.lit(".txt")), 2),
    ):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_a_scan_runs_each_pattern_once(docs):
    text = plan(detect.detect_patterns(docs, [p for p in REGISTRY if p.kind == "MAC_ADDRESS"]))
    assert len(re.findall(r"regexp_replace\(", text)) == 1
    text = plan(mask.protect(docs, [p for p in REGISTRY if p.kind == "MAC_ADDRESS"]))
    assert text.count("(?:[0-9A-Fa-f]{2}:){5}") == 1


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    from veil.sources.registry import registry_list

    rows = orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("upload_date"))
    text = plan(registry_list(rows, status="F"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text


def test_repeats_collapse_before_the_shuffle(spark):
    from checks.base import derived

    import checks.catalog  # noqa: F401

    text = plan(resolve.dedup_best_type(derived(spark, SMALL, "entities")))
    shuffle = text.index("Exchange hashpartitioning")
    assert "partial_max" in text[shuffle:]


def test_links_need_no_join_of_values(spark):
    t = {n: spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("customer", "orders")}
    text = plan(tables.column_signatures(t))
    assert "Join" not in text and "partial_bit_or" in text and "collect" not in text


@pytest.mark.parametrize("key", ["paginate", "recent_masked", "recent_jobs"])
def test_pages_and_top_rows_are_top_k(spark, key):
    text = plan(base.QUERIES[key](spark, SMALL))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


SKIP = {"src_text", "src_csv_dir", "sink_csv", "registry_append", "stream_mask", "stream_progress", "stream_window", "qa_loop", "link_groups", "replica", "mapping_io", "fk_preserved"}


@pytest.mark.parametrize("key", [k for k in base.QUERIES if k not in SKIP])
def test_no_cross_joins(spark, key):
    text = plan(base.QUERIES[key](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
