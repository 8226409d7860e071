"""Legacy archives: ARC records in versions 1 and 2 become WARC 1.1 records, with equal payloads written once.

An ARC file begins with a version block whose own header line (``filedesc://``) is followed by its version and the
names of the fields of every later header line; these names, not a fixed order, say where URL, date, type and length
stand. A record is a header line, as many bytes as it declares, and a line end.

Files are made of gzip members, one for each record (records of over ``MEMBER_BYTES`` take several), and begin with a
``warcinfo`` record, so a reader can begin at any record. Spark's text writer puts the bytes out as they are and ends
each file with its line separator, a zero byte: the last byte of a member whose size is under 2 ** 24.

WARC has what ARC lacks: identifiers (a UUID of version 8 that carries the page's number and a digest of URL and date,
so the same record always gets the same one), ISO timestamps, record types and payload digests. Pages with equal
payloads of at least ``MIN_REVISIT`` bytes are one response and revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import cycle

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.llm.common import arrow_batches

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 1000
#: Records in a file at most, compressed bytes after which one is ended, and payload bytes in an ARC block before the
#: next is begun.
FILE_RECORDS, FILE_BYTES = 2000, 8 << 20
BLOCK_BYTES = 1 << 20
#: Bytes of a gzip member before it is compressed; the last byte of its size is 0.
MEMBER_BYTES = (1 << 24) - 1
#: Bytes that a reader inflates at a time.
READ_BYTES = 1 << 20

#: The field names of both versions of ARC header lines.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"
#: Date of a page in its ARC header line, as pages have none of their own.
PAGE_DATE = "20200101000000"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes


def arc_url(url: str) -> str:
    """A URL as header lines have it: white space percent-encoded, ``-`` for an empty one."""
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"


def write_arc(records: list[tuple[str, str, str, bytes]], version: int = 1) -> bytes:
    """An ARC file of ``(url, date, content type, block)``; header lines have URLs as :func:`arc_url` gives them."""
    names = ARC_FIELDS[version]
    about = f"{version} 0 quillmart\n{names}\n\n".encode()
    head = {"URL": "filedesc://pages.arc", "IP-address": "0.0.0.0", "Archive-date": "19960101000000", "Content-type": "text/plain"}
    out = [_arc_line(head, names, len(about)), about, b"\n"]
    for url, date, kind, block in records:
        head = {"URL": arc_url(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": "200"}
        out += [_arc_line(head, names, len(block)), block, b"\n"]
    return b"".join(out)


def _arc_line(values: dict[str, str], names: str, length: int) -> bytes:
    values = values | {"Archive-length": str(length)}
    return (" ".join(values.get(n, "-") for n in names.split(" ")) + "\n").encode()


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block. Lengths are the declared ones, so blocks may hold anything, header lines too."""
    names: list[str] = []
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a header line without end")
        line = data[at:end].decode("utf-8").rstrip("\r")
        if not line:
            at = end + 1
            continue
        values = line.split(" ")
        length = int(values[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"a record declares {length} bytes and has {len(block)}")
        at = end + 1 + length
        if not names:
            if not line.startswith("filedesc://"):
                raise ValueError("no version block")
            about = block.decode("utf-8").split("\n")
            version, names = int(about[0].split(" ")[0]), about[1].rstrip("\r").split(" ")
            if version not in ARC_FIELDS or names[-1] != "Archive-length" or "URL" not in names:
                raise ValueError(f"unknown ARC version {about[0]!r}")
            continue
        if len(values) != len(names):
            raise ValueError(f"{len(values)} fields in a header line of {len(names)}")
        yield ArcRecord(dict(zip(names, values)), block)


def record_id(page_id: int | None, url: str, date: str) -> str:
    """A UUID of version 8 that holds the page's number: 48 bits of it, 12 of the digest, 16 of it, 46 of the digest."""
    digest = int.from_bytes(hashlib.sha256(f"{url} {date}".encode()).digest()[:8], "big")
    n = (page_id or 0) & (1 << 64) - 1
    low = (n & 0xFFFF) << 46 | (digest & (1 << 45) - 1) << 1 | (page_id is None)
    x = (n >> 16) << 80 | 8 << 76 | (digest >> 52) << 64 | 2 << 62 | low
    h = f"{x:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(identifier: str) -> int | None:
    """The page's number in a :func:`record_id`."""
    x = int(identifier[10:-1].replace("-", ""), 16)
    n = (x >> 80) << 16 | x >> 46 & 0xFFFF
    return None if x & 1 else n - (1 << 64) if n >> 63 else n


def _stamp(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(arc: ArcRecord, refers_to: int | None = None, refers_to_url: str = "", refers_to_date: str = "", is_revisit: bool = False) -> bytes:
    """The WARC record that says what an ARC record does; a revisit has the HTTP headers alone.

    Number, URL and date of the record that a revisit refers to are as its own ARC record has them, so both give one id.
    """
    url, date = arc.fields["URL"], arc.fields["Archive-date"]
    http, _, payload = arc.block.partition(b"\r\n\r\n")
    found = re.search(rb"(?mi)^" + PAGE_HEADER.encode() + rb": (-?\d+)\r?$", http)
    page = int(found[1]) if found else None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = http + b"\r\n\r\n" + (b"" if is_revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page, url, date)}",
        f"WARC-Date: {_stamp(date)}",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {arc.fields.get('IP-address', '0.0.0.0')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if is_revisit:
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(refers_to, refers_to_url, refers_to_date)}",
            f"WARC-Refers-To-Target-URI: {refers_to_url}",
            f"WARC-Refers-To-Date: {_stamp(refers_to_date)}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(about: str, date: str) -> bytes:
    """The first record of a file; ``about`` tells it from those of other files."""
    block = b"software: quillmart\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {about}")
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {_stamp(date)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_members(record: bytes) -> bytes:
    """A record as gzip members, each of MEMBER_BYTES at most."""
    out = []
    for i in range(0, len(record), MEMBER_BYTES):
        member = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [member.compress(record[i : i + MEMBER_BYTES]), member.flush()]
    return b"".join(out)


def _inflated(data: bytes) -> Iterator[bytes]:
    """A file's bytes by pieces; gzip members follow one another, other files are as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            out = member.decompress(data, READ_BYTES)
            data = member.unconsumed_tail
            if out:
                yield out
            elif not data and not member.eof:
                raise ValueError("a gzip member is cut off")
        data = member.unused_data


def read_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of each record of a file that comes in pieces; holds one record and one piece at a time."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and need(len(held) + 1):
            pass
        if end < 0:
            if held.strip():
                raise ValueError("a record's headers are cut off")
            return
        lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        n = int(headers["content-length"])
        if not need(end + 4 + n + 4):
            raise ValueError("a record's block is cut off")
        yield headers, bytes(held[end + 4 : end + 4 + n])
        del held[: end + 4 + n + 4]


def pages_to_arc(pages: DataFrame, versions: tuple[int, ...] = (1,)) -> DataFrame:
    """``(arc binary, marks array<struct<refers_to, refers_to_url, refers_to_date, is_revisit>>)``: ARC blocks of some pages each.

    ``pages`` has ``page_id, url, html, is_revisit, refers_to, refers_to_url``. Null texts count as empty. The blocks of a
    task take the ``versions`` in turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = pa.struct([("refers_to", pa.int64()), ("refers_to_url", pa.string()), ("refers_to_date", pa.string()), ("is_revisit", pa.bool_())])
        turn = cycle(versions)
        for b in batches:
            records: list[tuple[str, str, str, bytes]] = []
            marks: list[dict] = []
            size = 0

            def block() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([write_arc(records, next(turn))], pa.binary()), pa.array([marks], pa.list_(mark))], ["arc", "marks"])

            for row in b.to_pylist():
                payload = row["html"].encode()
                page = "" if row["page_id"] is None else f"{PAGE_HEADER}: {row['page_id']}\r\n"
                http = f"HTTP/1.1 200 OK\r\n{page}Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                records.append((row["url"], PAGE_DATE, "text/html", http.encode() + payload))
                other = {"refers_to_url": arc_url(row["refers_to_url"]), "refers_to_date": PAGE_DATE} if row["is_revisit"] else {}
                marks.append({"refers_to": row["refers_to"], "is_revisit": row["is_revisit"]} | other)
                size += len(payload)
                if size >= BLOCK_BYTES:
                    yield block()
                    records, marks, size = [], [], 0
            if records:
                yield block()

    columns = ["page_id", "url", "html", "is_revisit", "refers_to", "refers_to_url"]
    mark = "struct<refers_to:long,refers_to_url:string,refers_to_date:string,is_revisit:boolean>"
    return pages.select(*columns).mapInArrow(run, f"arc binary, marks array<{mark}>")


def arc_to_warc(arcs: DataFrame, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``file binary``: whole WARC files. ``arcs`` as :func:`pages_to_arc` gives.

    A task holds one ARC block and one file of ``file_bytes`` and a record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["file"])

        for b in batches:
            for arc, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r, m in zip(read_arc(arc), marks, strict=True):
                    record = warc_record(r, m["refers_to"], m["refers_to_url"] or "", m["refers_to_date"] or "", m["is_revisit"])
                    if not held:
                        held.append(gzip_members(warcinfo(hashlib.sha256(record).hexdigest(), r.fields["Archive-date"])))
                    held.append(gzip_members(record))
                    size += len(held[-1])
                    if len(held) > file_records or size >= file_bytes:
                        yield file()
                        held, size = [], 0
        if held:
            yield file()

    return arcs.mapInArrow(run, "file binary")


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, html, is_revisit, refers_to, refers_to_url`` of every page.

    Of pages with equal payloads of at least ``min_bytes`` bytes, that with the largest page_id is the response. Only such
    pages are dealt by digest, with the digests that occur more than once, and the copies of a frequent payload can be
    divided (:func:`_anew`); shorter pages stay where they are. A null html counts as empty, a null url as the empty
    one; pages with a null page_id are never the response of others and, like repeated rows of the response's page_id,
    are revisits only of another page_id.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    short = slim.where(F.octet_length("html") < min_bytes).select("page_id", "url", "html", F.lit(False).alias("is_revisit"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_to_url"))
    keyed = slim.where(F.octet_length("html") >= min_bytes).withColumn("digest", F.unhex(F.sha1("html")))
    latest = F.max(F.struct("page_id", "url")).alias("last")
    repeated = keyed.where(F.col("page_id").isNotNull()).groupBy("digest").agg(latest, F.count(F.lit(1)).alias("n"))
    repeated = repeated.where(F.col("n") > 1).select(_anew(F.col("digest")).alias("digest"), F.col("last.page_id").alias("first"), F.col("last.url").alias("first_url"))
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.lit(False))
    long = keyed.join(repeated, "digest", "left").select(
        "page_id", "url", "html", revisit.alias("is_revisit"), F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_to_url")
    )
    return short.unionByName(long)


def _anew(digest: Column) -> Column:
    """The same digest, computed again: what was gathered by it is dealt anew by a join, which AQE can then split."""
    return F.unhex(F.hex(digest))


def write_archives(pages: DataFrame, path: str, versions: tuple[int, ...] = (1,), file_records: int = FILE_RECORDS) -> None:
    """Pages as ARC, converted record by record, written as WARC files of at most ``file_records`` records below ``path``."""
    files = arc_to_warc(pages_to_arc(mark_revisits(pages), versions), file_records)
    # The writer's separator gives the last byte of each file, and a file has one row.
    files.selectExpr("CAST(substring(file, 1, length(file) - 1) AS string) AS file").write.option("compression", "none").option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each WARC record below ``path``: ``page_id, payload_bytes, payload_digest, record_type, refers_to, refers_to_id, record_id, url, date``.

    Of a revisit, bytes and digest of the full payload come from its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = []
                for head, block in read_warc(_inflated(content)):
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    declared = int(re.search(rb"(?mi)^Content-Length: (\d+)\r?$", http)[1])
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind, refers = head["warc-type"], head.get("warc-refers-to")
                    if kind == "response" and (declared != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"the payload of {head['warc-record-id']} is not what its headers say")
                    rows.append({
                        "page_id": page_of(head["warc-record-id"]),
                        "payload_bytes": declared,
                        "payload_digest": digest,
                        "record_type": kind,
                        "refers_to": page_of(refers) if refers else None,
                        "refers_to_id": refers,
                        "record_id": head["warc-record-id"],
                        "url": head["warc-target-uri"],
                        "date": head["warc-date"],
                    })
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "refers_to_id": pa.string(), "record_id": pa.string(), "url": pa.string(), "date": pa.string()}
    schema = pa.schema(list(kinds.items()))
    # The compressed bytes of a batch of files, and one record, are what a task holds.
    arrow_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_to_id string, record_id string, url string, date string")


#: op5 in DuckDB.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, url, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, url,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND last <> page_id THEN last END AS refers_to
FROM m
"""
