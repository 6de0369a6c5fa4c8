"""Archives and URL filters."""

import base64
import gzip
import hashlib
import re
from collections import Counter

from veil.llm import urls, warc

PAGES = "page_id bigint, url string, html string, record_id string, salt int, host string, verdict string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "h", "v") for r in rows], PAGES).repartition(2)


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (1, "http://a.org/x y\tz", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b.org/", None), (4, "http://b.org/2", ""),
    (5, "u", "one\r\n\r\nWARC/1.1\r\n\r\nHTTP/1.1 200"), (6, "u", "日本" * 200_000), (7, "v", "single"), (7, "v", "single"),
    (None, "n", "<p>é</p>"), (None, None, None), (8, "w", "filedesc://x 0 0 text/plain 5\n1 0 org\n"),
]


def test_records_come_back_from_archives(spark):
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_archives(pages(spark, ROWS)).collect())
    top = {}
    for page, _, html in ROWS:
        top[html or ""] = max(top.get(html or "", -1), page if page is not None else -1)
    expected = Counter()
    for page, _, html in ROWS:
        again = (page if page is not None else -1) != top[html or ""]
        expected[page, len((html or "").encode()), sha(html), "revisit" if again else "response", top[html or ""] if again else None] += 1
    assert got == expected


def test_no_pages(spark):
    assert warc.warc_archives(pages(spark, [])).count() == 0


def test_both_versions_by_their_declared_lengths():
    for version in (1, 2):
        name = "a.arc"
        block = b"HTTP/1.0 404 Not\r\nA: b\r\n\r\nbody\nhttp://x 1 2 text/html 3\n"
        extra = b"" if version == 1 else b" 404 - - 77 a.arc"
        line = b"http://h/p 1.2.3.4 20010203040506 text/html" + extra + b" %d\n" % len(block)
        raw = warc.version_block(version, name, "20010101000000") + line + block + b"\nbroken line\n" + line + block[:10]
        for content in (raw, gzip.compress(raw)):
            first, second = warc.arc_rows(name, content)
            assert (first["version"], first["url"], first["date"], first["status"]) == (version, "http://h/p", "2001-02-03T04:05:06Z", "404")
            assert first["payload"] == block.split(b"\r\n\r\n", 1)[1] and not first["truncated"]
            assert second["truncated"]


def test_malformed_archives_lose_only_what_is_broken(spark):
    good = b"http://h/p 1.2.3.4 20010203040506 text/html 2\nhi\n"
    starts = [b"filedesc://x\n", b"filedesc://x 0 0 text/plain 3\nx y\n", b"filedesc://x 0 0 text/plain 2\n3 \n", b"filedesc://x 0 0 t \xb2\n", b"\n\n",
              b"http://h/q 1.2.3.4 2001 text/html \xb2\n", b"filedesc://x 0 0 text/plain 999999999999999999999\n"]
    for start in starts:
        assert [r["payload"] for r in warc.arc_rows("a", start + good)] == [b"hi"], start
    short = b"http://h/p 1.2.3.4 20010203040506 text/html 12\nHTTP/1.1\r\n\r\n\n"
    assert [r["status"] for r in warc.arc_rows("a", short + good)] == [None, None]
    packed = gzip.compress(good)
    assert len(list(warc.arc_rows("a", packed + packed[:10] + b"\xff" * 20))) == 1 and list(warc.arc_rows("a", b"")) == []
    whole = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: x\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    lacking = [whole.replace(line, b"") for line in (b"WARC-Type: resource\r\n", b"WARC-Record-ID: <urn:uuid:1>\r\n", b"Content-Length: 2\r\n", b"WARC-Date: x\r\n")]
    odd = whole.replace(b"WARC-Date", b"X-Page-Id: y\r\nWARC-Date")
    for content in (b"".join([*lacking, odd]), gzip.compress(b"".join([*lacking, odd]))):
        (row,) = warc.warc_rows(content, True)
        assert (row["payload"], row["page_id"]) == (b"hi", None)
    assert len(list(warc.warc_rows(gzip.compress(whole) + gzip.compress(whole)[:30], True))) == 1
    bad = spark.createDataFrame([("a", bytearray(s + good)) for s in starts], warc.ARCHIVES)
    assert warc.parse_arc(bad).count() == len(starts)


def test_short_and_broken_dates():
    assert warc.w3c("199901") == "1999-01-01T00:00:00Z" and warc.w3c("x") == "1970-01-01T00:00:00Z"


def test_files_are_gzip_members_of_records(spark):
    from veil.session import shared_path

    path = shared_path(spark, "warc-test")
    records = warc.parse_arc(warc.arc_archives(pages(spark, ROWS)))
    warc.write_warc(warc.to_warc(records, warc.originals(records)), path)
    raw = [gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(path).collect()]
    assert sum(len(re.findall(rb"WARC-Record-ID: <urn:uuid:[0-9a-f-]{36}>", x)) for x in raw) == len(ROWS)
    back = warc.read_warc(spark, path)
    assert all(r.payload_digest == r.declared_digest for r in back.collect())


URLS = [
    (1, "HTTP://WWW.Example.COM/en/1?q#f"), (2, "https://example.com/en"), (3, "http://m.example.com/en/"), (4, "http://x.net/es/9"), (5, None),
    (6, "no scheme"), (7, "http://"), (8, "http://com"), (9, "http://com/"), (10, "http://é.NET/fr/\nx"), (11, "http://notexample.com/en/"),
    (11, "http://notexample.com/en/"), (None, "http://example.com:80/en/"), (12, "http://h.org?a://b.net/es/"), (13, "a://b..net/es/#"),
]
RULES = [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/es/", "allow"), ("net", "/fr/", "block"), ("net", "", "allow")]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v, h.lower() + p) for h, p, v in RULES
            if host and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def test_rules_by_hash_prefixes(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    table = pages(spark, [(k, u, None) for k, u in URLS])
    got = Counter(map(tuple, urls.judge(table, rules).collect()))
    assert got == Counter((k, *plain_verdict(u)) for k, u in URLS)
    none = spark.createDataFrame([], rules.schema)
    assert {r.verdict for r in urls.judge(table, none).collect()} == {"allow"}
    assert urls.judge(pages(spark, []), rules).count() == 0


def test_filters_stay_native(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = urls.judge(pages(spark, [(1, "x", None)]), rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
