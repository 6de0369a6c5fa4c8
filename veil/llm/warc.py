"""Legacy ARC archives to WARC archives, and WARC archives back to rows.

``parse_arc`` reads archives of version 1 (five header fields) and version 2 (ten) by the field list of
their own version block and by the lengths their records declare. ``to_warc`` gives each record what ARC
does not know: an identifier, a timestamp in W3C form, a record type and digests. ``write_warc`` lets Spark
commit the files, so a lost executor leaves no half archive behind.

Defined cases: a null payload is empty; a null url becomes ``urn:page:<id>``; white space inside a url is
percent-encoded; a null id stays null and ranks below all others; rows repeated with the same id and payload
are all ``response``; a record shorter than declared is kept and marked ``truncated``; a line that is no
header is skipped up to the next line, and so is a version block without a length; one that names no known
version leaves the version as it was; a WARC record without length, type, identifier or date is skipped;
numbers that can't be read are null; of a damaged gzip file, what comes before the damage (in ARC, before the
damaged member) is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.common import keep
from veil.session import shared_path

ARCHIVE_BYTES = 1 << 20
RECORDS_PER_FILE = 20_000
SALTS = 16

V1_FIELDS = ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"]
V2_FIELDS = [*V1_FIELDS[:4], "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]
FIELDS = {1: V1_FIELDS, 2: V2_FIELDS}

REQUIRED = {"warc-type", "warc-record-id", "warc-date"}
SIGNED = r"-?[0-9]{1,18}"

ARCHIVES = "path string, content binary"
ARC_RECORDS = pa.schema([
    ("archive", pa.string()), ("version", pa.int32()), ("offset", pa.int64()), ("url", pa.string()),
    ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("status", pa.string()),
    ("truncated", pa.bool_()), ("page_id", pa.int64()), ("record_id", pa.string()),
    ("http_head", pa.binary()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
WARC_RECORDS = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()),
    ("page_id", pa.int64()), ("refers_to", pa.int64()), ("declared_digest", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])


def ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ARC -------------------------------------------------------------------------------------------


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 veil\n{' '.join(FIELDS[version])}\n\n".encode()
    extra = [] if version == 1 else ["200", "-", "-", "0", name]
    head = " ".join([f"filedesc://{name}", "0.0.0.0", date, "text/plain", *extra, str(len(body))])
    return head.encode() + b"\n" + body


def arc_record(version: int, name: str, offset: int, page_id: int | None, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode()
    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n"
    ).encode() + payload
    place = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else f"urn:page:{page_id}"
    extra = [] if version == 1 else ["200", "-", "-", str(offset), name]
    fields = [place, "192.0.2.1", "20200101000000", "text/html", *extra, str(len(block))]
    return " ".join(fields).encode() + b"\n" + block + b"\n"


def arc_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """ARC archives of pages (``path``, ``content``), of about ``ARCHIVE_BYTES``, versions 1 and 2 in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = 0, [], 0

        def closed():
            return pa.record_batch([pa.array([f"part-{number}.arc"]), pa.array([b"".join(parts)])], ["path", "content"])

        for batch in batches:
            for row in range(batch.num_rows):
                version, name = 1 + number % 2, f"part-{number}.arc"
                if not parts:
                    parts = [version_block(version, name, "20200101000000")]
                    size = len(parts[0])
                cells = (batch.column(k)[row].as_py() for k in range(3))
                parts.append(arc_record(version, name, size, *cells))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield closed()

    picked = pages.select(pages[page_id].cast("bigint"), pages[url].cast("string"), pages[html].cast("string"))
    return picked.mapInArrow(run, ARCHIVES)


def http_parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """HTTP head, payload and header fields of a block; a block that is no HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    head, _, payload = block.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return head + b"\r\n\r\n", payload, {k.strip().lower(): v.strip() for k, _, v in pairs}


def number_of(text: str | bytes | None, pattern: str = r"[0-9]{1,18}") -> int | None:
    text = text.decode("latin-1") if isinstance(text, bytes) else text
    return int(text) if text is not None and re.fullmatch(pattern, text) else None


def unpacked(content: bytes) -> bytes:
    """The bytes of all gzip members, up to the first one that is damaged; other content as it is."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            parts.append(member.decompress(content))
        except zlib.error:
            break
        content = member.unused_data
    return b"".join(parts)


def arc_rows(archive: str, content: bytes) -> Iterator[dict]:
    """Records of one archive; the version block at its start says how many fields a header line has."""
    data = unpacked(content)
    version, at = 1, 0
    while at < len(data):
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        line, begin = data[at:stop], stop + 1
        if line.startswith(b"filedesc://"):
            length = number_of(line.rstrip(b"\r").rsplit(b" ", 1)[-1])
            if length is not None:
                named = number_of(data[begin : begin + length].split(b" ", 1)[0])
                version = named if named in FIELDS else version
            at = begin + (length or 0)
            continue
        cells = line.decode("utf-8", "replace").rsplit(" ", len(FIELDS[version]) - 1)
        length = number_of(cells[-1])
        if len(cells) != len(FIELDS[version]) or length is None:
            at = begin
            continue
        field = dict(zip(FIELDS[version], cells))
        block = data[begin : begin + length]
        head, payload, http = http_parts(block)
        own = digest(payload)
        number, status = http.get("x-page-id", ""), head.split(b"\r\n", 1)[0].split(b" ")[1:2]
        yield {
            "archive": archive, "version": version, "offset": at, "url": field["URL"], "ip": field["IP-address"],
            "date": w3c(field["Archive-date"]), "mime": field["Content-type"],
            "status": field.get("Result-code") or (status[0].decode("utf-8", "replace") if status else None),
            "truncated": len(block) < length, "page_id": number_of(number, SIGNED),
            "record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{field['URL']} {field['Archive-date']} {number} {own}")),
            "http_head": head, "payload_digest": own, "payload_bytes": len(payload), "payload": payload,
        }
        at = begin + length


def w3c(date: str) -> str:
    """``YYYYMMDDhhmmss``, or a beginning of it, as a W3C timestamp; anything else as the epoch."""
    whole = date + "00000101000000"[len(date) :]
    if not re.fullmatch(r"[0-9]{14}", whole) or len(date) < 4:
        return "1970-01-01T00:00:00Z"
    return f"{whole[:4]}-{whole[4:6]}-{whole[6:8]}T{whole[8:10]}:{whole[10:12]}:{whole[12:]}Z"


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: str = "payload_bytes", limit: int = 4 << 20):
    """Rows as Arrow batches of about ``limit`` payload bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += 200 + (row[size] if row.get("payload") else 0)
        if total >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def parse_arc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of ARC archives given as ``path`` and ``content``, as Spark's binaryFile source reads them."""

    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                for row in arc_rows(batch.column(0)[k].as_py(), batch.column(1)[k].as_py()):
                    yield row if payloads else row | {"payload": None, "http_head": None}

    return archives.select("path", "content").mapInArrow(lambda b: in_batches(rows(b), ARC_RECORDS), ddl(ARC_RECORDS))


# WARC ------------------------------------------------------------------------------------------


def originals(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """For payloads that occur more than once: the record with the largest page_id, which the others revisit."""
    best = F.max(F.struct("page_id", "record_id", "date"))
    groups = records.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
    found = groups.agg(best.alias("best"), F.count("*").alias("n")).where("n > 1")
    return found.select("payload_digest", "payload_bytes", F.col("best.page_id").alias("refers_to"),
                        F.col("best.record_id").alias("refers_id"), F.col("best.date").alias("refers_date"))


def field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")


def to_warc(records: DataFrame, firsts: DataFrame) -> DataFrame:
    """One WARC record (``record``, bytes) per ARC record.

    Only payloads that occur more than once are in ``firsts``; it is spread over salts, so a payload that
    fills a third of the archives does not meet in one task.
    """
    salted = records.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)))
    spread = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    joined = salted.join(spread, ["payload_digest", "payload_bytes", "salt"], "left")
    again = F.col("refers_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    http = F.length("http_head") > 0
    kind = F.when(again, "revisit").when(http, "response").otherwise("resource")
    block = F.when(again, F.col("http_head")).otherwise(F.concat("http_head", "payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", kind),
        field("WARC-Record-ID", F.format_string("<urn:uuid:%s>", "record_id")),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-IP-Address", F.col("ip")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        field("WARC-Truncated", F.when(F.col("truncated"), "length")),
        field("X-Page-Id", F.col("page_id")),
        F.when(
            again,
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                field("WARC-Refers-To", F.format_string("<urn:uuid:%s>", "refers_id")),
                field("WARC-Refers-To-Date", F.col("refers_date")),
                field("X-Refers-To-Page-Id", F.col("refers_to")),
            ),
        ).otherwise(""),
        field("Content-Type", F.when(http, "application/http; msgtype=response").otherwise(F.col("mime"))),
        field("Content-Length", F.length(block)),
        F.lit("\r\n"),
    )
    return joined.select(F.concat(head.cast("binary"), block).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files: each record is one value of Spark's text sink, the two line ends after it the separator.

    Spark's strings hold any bytes, so the cast changes none. Files are gzip members of at most
    ``RECORDS_PER_FILE`` records.
    """
    sink = records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n")
    sink.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def warc_rows(content: bytes, payloads: bool) -> Iterator[dict]:
    packed = content[:2] == b"\x1f\x8b"
    source = gzip.GzipFile(fileobj=io.BytesIO(content)) if packed else io.BytesIO(content)
    try:
        yield from records_of(source, payloads)
    except (EOFError, gzip.BadGzipFile, zlib.error):
        return  # what comes before the damage is read


def records_of(source: io.BufferedIOBase, payloads: bool) -> Iterator[dict]:
    while line := source.readline():
        if not line.startswith(b"WARC/"):
            continue
        named = {}
        while (line := source.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            named[name.lower()] = value.strip()
        length = number_of(named.get("content-length"))
        if length is None:
            continue
        _, payload, http = http_parts(source.read(length))
        if not REQUIRED <= named.keys():
            continue
        number = {k: number_of(named.get(k), SIGNED) for k in ("x-page-id", "x-refers-to-page-id")}
        declared = named.get("warc-payload-digest", "").removeprefix("sha1:")
        again, size = named["warc-type"] == "revisit", number_of(http.get("content-length"))
        yield {
            "record_id": named["warc-record-id"][10:-1], "record_type": named["warc-type"],
            "url": named.get("warc-target-uri"), "date": named["warc-date"], "page_id": number["x-page-id"],
            "refers_to": number["x-refers-to-page-id"], "declared_digest": declared,
            "payload_digest": declared if again else digest(payload),
            "payload_bytes": len(payload) if not again or size is None else size,
            "payload": payload if payloads else None,
        }


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the WARC files under ``path``; digests are those of the payloads read, not those declared."""

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                yield from warc_rows(content.as_py(), payloads)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda b: in_batches(rows(b), WARC_RECORDS), ddl(WARC_RECORDS))


def warc_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages through ARC archives into WARC archives, and the records read back from these."""
    spark = pages.sparkSession
    archives = arc_archives(pages)
    firsts = keep(originals(parse_arc(archives, payloads=False), least_bytes), "warc-firsts")
    path = shared_path(spark, "warc")
    write_warc(to_warc(parse_arc(archives), firsts), path)
    return read_warc(spark, path, payloads=False)
