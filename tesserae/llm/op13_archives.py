"""Web archives: ARC files of both versions, their conversion to WARC, and WARC files read back.

ARC: each record is a header line, as many bytes as that line's last field declares, and a line feed. A file begins with
a `filedesc://` record whose text names the version: header lines of version 1 have 5 fields (URL, address, date, type,
length), those of version 2 have 10 (code, checksum, location, offset and file name in front of the length). Fields are
taken from the right, so an unescaped blank in a URL does no harm. Lines that are no header are passed over; a record that ends
early is kept and marked.

WARC: types follow from the block (an HTTP response: response; other blocks: resource; filedesc: warcinfo), identifiers
from archive and offset (so a repeated task gives the same ones), dates from the 14 digits, digests (SHA-256) from payload
and block. Of responses with equal payloads of at least LEAST bytes the first one, by page id, then archive and offset,
stays; others become revisits that name it and keep only their HTTP headers.

Files are written by Spark's text writer with the format's own record ends as line ends, gzipped, RECORDS to a file, and
read by its binary-file source, so they live wherever Spark can write. A task reads records of a file one after the other
and holds the compressed file and one Arrow batch. Payloads are not shuffled while the table of repeated digests is small
enough to broadcast; beyond that one join on digests is, which adaptive execution can split.

A null or empty html is an empty payload, a null url is `unknown:`, a null page id is no header and comes last among
equals; repeated rows are records of their own. Other columns are not read. An empty table gives archives without records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_dir
from .common import drop_folder, materialize, sized, small_batches, table

#: Shortest payload that a revisit may stand for.
LEAST = 100
#: Records in a file, and bytes of records in an Arrow batch.
RECORDS, BATCH = 2000, 4 << 20
KEY = "X-Page-Id"
#: Fixed values of the formats.
ARC_FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tesserae:archives")


def _escape(url: str | None) -> bytes:
    """Without blanks and control characters, which header lines can't hold."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "unknown:").encode()


def http_block(key: int | None, payload: bytes) -> bytes:
    """The response that a crawler stores for a page."""
    name = f"{KEY}: {key}\r\n" if key is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{name}\r\n".encode() + payload


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with the blank line, payload)."""
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])


def header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?mi)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)[ \t]*\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,19}", text) else None


def arc_header(version: int, url: bytes, ip: bytes, date: bytes, kind: bytes, block: bytes, code: int = 200, offset: int = 0, name: bytes = b"-") -> bytes:
    """A record's header line; version 2 also has the result code, a checksum of the block, and where the record stands."""
    more = [b"%d" % code, hashlib.md5(block).hexdigest().encode(), b"-", b"%d" % offset, name] if version == 2 else []
    return b" ".join([url, ip, date, kind, *more, b"%d" % len(block)])


def arc_description(version: int, name: bytes, date: bytes) -> bytes:
    """The record that begins a file."""
    block = b"%d 0 tesserae\n%s\n" % (version, ARC_FIELDS[version])
    return arc_header(version, b"filedesc://" + name, b"0.0.0.0", date, b"text/plain", block, name=name) + b"\n" + block


def arc_records(data: io.BufferedIOBase) -> Iterator[dict]:
    """Records of an ARC file from a stream, the file's description among them."""
    version, at = 1, 0
    while line := data.readline():
        offset, at = at, at + len(line)
        start = line.rstrip(b"\r\n")
        told = start.startswith(b"filedesc://")
        fields = start.rsplit(b" ", 9 if told and len(start.split(b" ")) >= 10 or version == 2 and not told else 4)
        if len(fields) < 5 or not fields[-1].isdigit() or not re.fullmatch(rb"\d{8,14}", fields[2]):
            continue
        block = data.read(int(fields[-1]))
        at += len(block)
        if told:
            first = block.split(b"\n", 1)[0].split(b" ")[0]
            version = int(first) if first.isdigit() else 1
        yield {
            "offset": offset, "version": version, "url": fields[0], "ip": fields[1], "date": fields[2].ljust(14, b"0"), "kind": fields[3],
            "code": _number(fields[4].decode("latin-1")) if len(fields) == 10 else None, "block": block, "truncated": len(block) < int(fields[-1]),
        }


def warc_records(data: io.BufferedIOBase) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of the records of a WARC file from a stream."""
    while line := data.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = [line]
        while (line := data.readline()).strip():
            head.append(line)
        lines = b"".join(head)
        yield lines, data.read(_number(header(lines, "Content-Length")) or 0)


def record_id(archive: str, offset: int) -> str:
    return str(uuid.uuid5(_NAMES, f"{archive}#{offset}"))


def iso_date(digits: bytes) -> str:
    d = digits.decode()
    month, day = max(d[4:6], "01"), max(d[6:8], "01")
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _stream(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if content[:2] == b"\x1f\x8b" else raw


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def _grouped(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each up to BATCH bytes."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += size(row)
        if held >= BATCH:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some, held = [], 0
    if some:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _text(batch_rows: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Records as values of Spark's text writer, which takes the bytes of strings as they are."""
    for b in _grouped(((r,) for r in batch_rows), pa.schema([("value", pa.binary())]), lambda r: len(r[0])):
        yield pa.record_batch([b.column(0).view(pa.string())], ["value"])


def write_arc(pages: DataFrame, folder: str, version: int | None = None, ip: Column | None = None, date: Column | None = None) -> None:
    """Writes page_id, url and html as ARC files of one version, or of both in turn; ip and date (14 digits) default to unknown ones."""
    small_batches(pages.sparkSession)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        part, n, offset = TaskContext.get().partitionId(), count(), 0
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (0, 1, 3, 4)]
            for key, url, at, day, payload in zip(*cols, batch.column(2).view(pa.binary()).to_pylist(), strict=True):
                k = next(n)
                v, name, day = version or 1 + (part + k // (RECORDS - 1)) % 2, b"%d-%d.arc" % (part, k // (RECORDS - 1)), (day or "19700101000000").encode()
                if k % (RECORDS - 1) == 0:  # a file's first record
                    first = arc_description(v, name, day)
                    offset = len(first) + 1
                    yield first
                block = http_block(key, payload or b"")
                record = arc_header(v, _escape(url), (at or "0.0.0.0").encode(), day, b"text/html", block, offset=offset, name=name) + b"\n" + block
                offset += len(record) + 1
                yield record

    cols = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), ip if ip is not None else F.lit(None).cast("string"), date if date is not None else F.lit(None).cast("string")]
    out = pages.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(lambda b: _text(records(b)), "value string")
    out.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)


_ARC = [("archive", "string"), ("offset", "long"), ("key", "long"), ("record_id", "string"), ("type", "string"), ("date", "string"), ("uri", "string"), ("ip", "string"), ("content_type", "string"), ("truncated", "boolean"), ("payload_bytes", "long"), ("payload_digest", "string"), ("head", "binary"), ("payload", "binary")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(fields: list[tuple[str, str]]) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in fields])


def _ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in fields)


def _converted(archive: str, r: dict) -> tuple:
    """What a WARC record says of an ARC record; head is what stays of a revisit's block."""
    told, web = r["url"].startswith(b"filedesc://"), r["block"].startswith(b"HTTP/")
    head, payload = http_parts(r["block"]) if web and not told else (b"", r["block"])
    kind, content = ("warcinfo", "application/warc-fields") if told else ("response", "application/http; msgtype=response") if web else ("resource", r["kind"].decode("latin-1"))
    if told:
        payload = b"software: tesserae\r\nformat: WARC File Format 1.1\r\nsource: %s\r\n" % r["url"]
    return (
        archive, r["offset"], _number(header(head, KEY)), record_id(archive, r["offset"]), kind, iso_date(r["date"]), r["url"].decode("utf-8", "replace"), r["ip"].decode("latin-1"),
        content, r["truncated"], len(payload), hashlib.sha256(payload).hexdigest(), head, payload,
    )


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of ARC files, gzipped or not, with the WARC fields that follow from them; payloads: also head and payload."""
    small_batches(spark)
    fields = _ARC if payloads else _ARC[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (_converted(a.as_py(), r)[: len(fields)] for b in batches for a, c in zip(b.column(0), b.column(1), strict=True) for r in arc_records(_stream(c.as_py())))
        yield from _grouped(rows, _arrow(fields), lambda r: 300 + len(r[-1]) if payloads else 300)

    return _files(spark, path).mapInArrow(run, _ddl(fields))


def warc_record(r: dict) -> bytes:
    """A record without the two line ends that close it; first: the record that a revisit refers to."""
    first, content = r["first"], r["content_type"]
    block = r["head"] if first else r["head"] + r["payload"]
    kind = "revisit" if first else r["type"]
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{r['record_id']}>"), ("WARC-Date", r["date"])]
    if kind != "warcinfo":
        lines += [("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}")]
    if first:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{first['record_id']}>"), ("WARC-Refers-To-Target-URI", first["uri"]), ("WARC-Refers-To-Date", first["date"])]
        lines += [(f"Refers-To-{KEY}", str(first["key"]))] if first["key"] is not None else []
    if r["truncated"]:
        lines.append(("WARC-Truncated", "unspecified"))
    lines += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", content), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block


def arc_to_warc(spark: SparkSession, arc: str, warc: str, least: int = LEAST) -> None:
    """Converts the ARC files of a folder to WARC files in another."""
    place = F.struct(F.col("key").isNull().alias("unnamed"), "key", "archive", "offset", "record_id", "uri", "date").alias("place")
    brief = read_arc(spark, arc, payloads=False).where((F.col("type") == "response") & (F.col("payload_bytes") >= least))
    firsts = brief.select("payload_digest", place).groupBy("payload_digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = read_arc(spark, arc).join(sized(materialize(firsts)), "payload_digest", "left")
    itself = (F.col("archive") == F.col("first.archive")) & (F.col("offset") == F.col("first.offset")) | (F.col("type") != "response")
    rows = joined.withColumn("first", F.when(~itself, F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _text(warc_record(r) for b in batches for r in b.to_pylist())

    rows.mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(warc)


_WARC = [("record_id", "string"), ("type", "string"), ("date", "string"), ("uri", "string"), ("key", "long"), ("payload_bytes", "long"), ("payload_digest", "string"), ("digest_holds", "boolean"), ("refers_to_id", "string"), ("refers_to_key", "long"), ("payload", "binary")]


def _read_back(head: bytes, block: bytes) -> tuple:
    """A record's fields. A response's payload is measured; of a revisit the HTTP headers give its length, the record its digest."""
    kind = header(head, "WARC-Type")
    web = block.startswith(b"HTTP/")
    http, payload = http_parts(block) if web else (b"", block)
    said = (header(head, "WARC-Payload-Digest") or "").removeprefix("sha256:") or None
    size, digest, holds = len(payload), hashlib.sha256(payload).hexdigest(), None
    if kind == "revisit":
        size, digest = _number(header(http, "Content-Length")), said
    else:
        holds = said is None or said == digest
    named = lambda x: x.removeprefix("<urn:uuid:").removesuffix(">") if x else None
    return (
        named(header(head, "WARC-Record-ID")), kind, header(head, "WARC-Date"), header(head, "WARC-Target-URI"), _number(header(http, KEY)), size, digest, holds,
        named(header(head, "WARC-Refers-To")), _number(header(head, f"Refers-To-{KEY}")), payload,
    )


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of WARC files, gzipped or not; digest_holds: the payload has the digest that its record gives."""
    small_batches(spark)
    fields = _WARC if payloads else _WARC[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (_read_back(h, block)[: len(fields)] for b in batches for c in b.column(1) for h, block in warc_records(_stream(c.as_py())))
        yield from _grouped(rows, _arrow(fields), lambda r: 300 + len(r[-1]) if payloads else 300)

    return _files(spark, path).mapInArrow(run, _ddl(fields))


def op13_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC files of both versions, converted to WARC files, and what those say."""
    folder = f"{shared_dir(spark)}/tesserae/{uuid.uuid4().hex}"
    write_arc(table(spark, sf_dir, "pages"), f"{folder}-arc")
    arc_to_warc(spark, f"{folder}-arc", f"{folder}-warc")
    drop_folder(spark, f"{folder}-arc")
    found = read_warc(spark, f"{folder}-warc", payloads=False).where("type <> 'warcinfo'")
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_key").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM r
"""
