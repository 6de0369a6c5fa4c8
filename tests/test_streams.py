"""Streams over several files, with repeats, late rows and restarts."""

import datetime as dt
import os
import shutil

import duckdb
import pytest

import checks.catalog  # noqa: F401 - registers the queries
from checks import base
from checks.compare import compare
from tests.conftest import SMALL
from veil.functions.patterns import REGISTRY
from veil.streaming import streams

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def deliver(spark, rows, schema, folder, name):
    """One file, put into the watched folder when it is whole."""
    made = folder.parent / f"made-{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(made))
    part = next(f for f in os.listdir(made) if f.endswith(".parquet"))
    folder.mkdir(exist_ok=True)
    shutil.copy(made / part, folder / f"{name}.parquet")


def run(spark, folder, tmp_path):
    stream = streams.once(streams.arrivals(spark, str(folder), streams.DOCUMENT_SCHEMA))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    streams.run_available(streams.mask_stream(stream, REGISTRY), out, mark).awaitTermination()
    return sorted((r.doc_id is None, r.doc_id or 0, r.masked_text or "") for r in spark.read.parquet(out).collect())


def test_a_file_delivered_twice_is_masked_once(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [(1, "mail a@example.com", "en", "s", 18), (2, None, None, None, None), (None, "x", "en", "s", 1)]
    deliver(spark, rows, DOCS, folder, "one")
    deliver(spark, rows, DOCS, folder, "again")
    first = run(spark, folder, tmp_path)
    assert len(first) == 3 and not any("example.com" in t for _, _, t in first)
    deliver(spark, rows, DOCS, folder, "restarted")  # the query stopped and starts from its checkpoint
    assert run(spark, folder, tmp_path) == first
    deliver(spark, [(1, "another text", "en", "s", 12)], DOCS, folder, "changed")
    assert len(run(spark, folder, tmp_path)) == 4


@pytest.mark.parametrize("late, counted", [("2 hours", False), ("10 hours", True)])
def test_windows_over_several_files_with_a_late_row(spark, tmp_path, late, counted):
    folder, day = tmp_path / "in", dt.datetime(2024, 1, 1)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    files = [[(1, day.replace(hour=1), 1, "a", 1.0, "")], [(2, day.replace(hour=8), 1, "a", 2.0, "")], [(3, day.replace(hour=9), 1, "a", 2.0, "")], [(4, day.replace(hour=1, minute=30), 1, "a", 4.0, "")]]
    for i, rows in enumerate(files):
        deliver(spark, rows, schema, folder, f"f{i}")
        stream = streams.window_stream(streams.read_folder(spark, str(folder), streams.EVENT_SCHEMA), late)
        streams.run_updates(stream, out, mark).awaitTermination()
    got = {r.window_start.hour: (r.n, r.cents) for r in streams.latest(spark, out, ["window_start", "event_type"]).collect()}
    assert got == {1: (2, 500) if counted else (1, 100), 8: (1, 200), 9: (1, 200)}


@pytest.mark.parametrize("key", ["stream_mask", "stream_progress", "stream_window"])
def test_tables_of_one_file_and_of_many_give_the_same(spark, tmp_path, key):
    for name in ("documents", "conversations", "events"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    query = base.QUERIES[key]
    one, many = query(spark, SMALL), query(spark, str(tmp_path))
    assert one.count() > 0
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_masked_stream_of_null_and_blank_texts_equals_its_sql(spark, tmp_path):
    texts = ["mail a@example.com", "plain", "[REDACTED]", None, "", " \n\t", "\x0b\x1c\x85", "\u00a0\u2028\u3000", " \u200b "]
    for i in range(3):  # a file of blank texts only, too
        deliver(spark, [(k, t, "en", "s", None) for k, t in enumerate(texts) if k // 3 == i], DOCS, tmp_path / "documents.parquet", f"part-{i}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    message, same = compare(spark, con, str(tmp_path), "stream_mask", base.QUERIES["stream_mask"], base.SQL["stream_mask"])
    assert same, message
    assert sorted(r.doc_id for r in base.QUERIES["stream_mask"](spark, str(tmp_path)).collect()) == [0, 1, 2, 8]
