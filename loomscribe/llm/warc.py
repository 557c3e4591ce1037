"""Legacy ARC archives converted to WARC.

``read_arc`` walks concatenated ARC data: a ``filedesc:`` version block names the version
(1: five header fields, 2: ten), each further header line declares the length of its block.
``to_warc`` synthesises what ARC lacks: record ids, ISO timestamps, response or revisit
types and SHA-1 payload digests.  ``read_warc`` parses the archives again.

Archives are written by Spark's text writer, whose record separator is the format's own
(a line break after an ARC block, two CRLFs after a WARC record), in files of at most
``RECORDS_PER_FILE`` records, and read whole file by whole file, so a file's size is bounded by
that many of its longest record; both parsers go by the declared lengths, so payloads may hold
anything.  HTTP heads are carried over as they stand, with CRLF or bare LF line ends; blocks
without one (``dns:`` records and the like) become ``resource`` records.  Revisits are found by one grouped maximum
per digest (combined before the shuffle) joined back by digest.

Broken archives do not end a job: what can't be read, from its place to the archive's end (a
declared length or head says where the next record is) or the one record whose payload fails its
digest, is a row of ``rejected_arc`` or ``rejected_warc``; all records before it are read.

Defined results: a null payload is empty; of equal payloads of ``REVISIT_BYTES`` or more the
largest page id is the response (all rows that carry it), null ids never win unless all are
null; repeated rows are records of their own, as ids are made of a record's place; blanks in URLs are percent-encoded, a null URL is ``unknown:``; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscribe.llm.common import arrow_rows
from loomscribe.sources.scratch import shared_folder

REVISIT_BYTES = 1000
RECORDS_PER_FILE = 500
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER, KEEPER_HEADER = "X-Page-Id", "X-Refers-To-Page-Id"
RECORDS = "page_id long, record_id string, url string, date string, mime string, head binary, payload binary, payload_bytes long, digest string"
_RECORDS = pa.schema(
    [("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("mime", pa.string())]
    + [("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string())]
)


def _http(page_id: Column, n_bytes: Column) -> Column:
    """The HTTP head in front of a payload."""
    return F.concat(
        F.lit(f"HTTP/1.1 200 OK\r\n{PAGE_HEADER}: "),
        F.coalesce(page_id.cast("string"), F.lit("-")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        n_bytes.cast("string"),
        F.lit("\r\n\r\n"),
    )


def arc_rows(pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """One ARC segment per page: version block (1 or 2 by the id), header line, block."""
    html = F.coalesce(F.col("html"), F.lit(""))
    block = F.concat(_http(F.col("page_id"), F.octet_length(html)), html)
    url = F.coalesce(F.regexp_replace("url", r"\s", "%20"), F.lit("unknown:"))

    def segment(version: int) -> Column:
        fields = f"{version} 0 Reserved\n{ARC_FIELDS[version]}\n\n"
        head = f"filedesc://pages.arc 0.0.0.0 {date} text/plain {'200 - - 0 pages.arc ' * (version == 2)}{len(fields)}\n{fields}"
        middle = f" 0.0.0.0 {date} text/html " + "200 - - 0 pages.arc " * (version == 2)
        return F.concat(F.lit(head), url, F.lit(middle), F.octet_length(block).cast("string"), F.lit("\n"), block)

    second = F.coalesce(F.col("page_id") % 2 != 0, F.lit(False))
    return pages.select(F.when(second, segment(2)).otherwise(segment(1)).alias("value"))


def write_archive(rows: DataFrame, separator: str, name: str) -> str:
    """Write ready-made records as gzip archives; returns their folder."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("lineSep", separator).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)
    return path


def archives(spark: SparkSession, path: str) -> DataFrame:
    """Whole archive files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").cast("binary").alias("content"))


_BLANK_LINE = re.compile(rb"\r?\n\r?\n")


def _head(data: bytes, at: int) -> tuple[dict[bytes, bytes], int]:
    """Header lines from ``at`` up to the blank line (or all that is left), and where the body begins."""
    blank = _BLANK_LINE.search(data, at)
    end, body = blank.span() if blank else (len(data), len(data))
    lines = (line.partition(b":") for line in data[at:end].splitlines())
    return {k.strip().lower(): v.strip() for k, _, v in lines}, body


def _page_id(headers: dict[bytes, bytes], name: str) -> int | None:
    value = headers.get(name.lower().encode(), b"-")
    number = int(value) if re.fullmatch(rb"-?\d{1,19}", value) else None
    return number if number is not None and -(2**63) <= number < 2**63 else None


class Broken(Exception):
    """Where in an archive a record can't be read, and why."""

    def __init__(self, place: int, reason: str):
        super().__init__(place, reason)
        self.place, self.reason = place, reason


def _int(value: str | bytes | None, place: int, what: str) -> int:
    digits = value.decode("ascii", "replace") if isinstance(value, bytes) else value or ""
    if not (digits.isascii() and digits.isdigit()):
        raise Broken(place, f"{what} is no number: {digits[:40]!r}")
    return int(digits)


def _block(data: bytes, at: int, length: int, place: int) -> bytes:
    block = data[at : at + length]
    if len(block) < length:
        raise Broken(place, f"a block of {length} bytes was declared, {len(block)} are left")
    return block


def parse_arc(data: bytes, name: str = "") -> Iterator[dict | Broken]:
    """The records of concatenated ARC data; ``name`` tells archives apart in record ids.

    A header that can't be read or a block that is cut ends the archive with a ``Broken``."""
    at, names = 0, ARC_FIELDS[1].split()
    try:
        while at < len(data):
            if data[at : at + 1] in b"\r\n":
                at += 1
                continue
            record, at, names = _arc_record(data, at, names, name)
            if record is not None:
                yield record
    except Broken as broken:
        yield broken


def _arc_record(data: bytes, begin: int, names: list[str], name: str) -> tuple[dict | None, int, list[str]]:
    """The record at ``begin`` (none for a version block), where it ends, and the fields from there on."""
    end = data.find(b"\n", begin)
    if end < 0:
        raise Broken(begin, "a header line does not end")
    line = data[begin:end].decode("utf-8", "replace").rstrip("\r")
    version = line.startswith("filedesc:")
    fields = line.split(" ") if version else line.rsplit(" ", len(names) - 1)
    if not version and len(fields) != len(names):
        raise Broken(begin, f"a header line has {len(fields)} fields of {len(names)}")
    length = _int(fields[-1], begin, "the length")
    block = _block(data, end + 1, length, begin)
    at = end + 1 + length
    if version:
        number = _int(block[:1], begin, "the version")
        if number not in ARC_FIELDS:
            raise Broken(begin, f"version {number} is not known")
        return None, at, ARC_FIELDS[number].split()
    header = dict(zip(names, fields, strict=True))
    http, body = _head(block, 0) if block.startswith(b"HTTP/") else ({}, 0)
    payload = block[body:]
    record = {
        "page_id": _page_id(http, PAGE_HEADER),
        "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{begin} {header['URL']}')}>",
        "url": header["URL"],
        "date": header["Archive-date"],
        "mime": header["Content-type"],
        "head": block[:body],
        "payload": payload,
        "payload_bytes": len(payload),
        "digest": hashlib.sha1(payload).hexdigest(),
    }
    return record, at, names


REJECTS = "name string, place long, reason string"
_REJECTS = pa.schema([("name", pa.string()), ("place", pa.int64()), ("reason", pa.string())])


def _parsed(archive: DataFrame, parse, schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"], strict=True):
                rows = [r for r in parse(content.as_buffer().to_pybytes(), name) if not isinstance(r, Broken)]
                yield arrow_rows(schema, {f.name: [r[f.name] for r in rows] for f in schema})

    return archive.mapInArrow(run, ddl)


def _rejected(archive: DataFrame, parse) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"], strict=True):
                found = [r for r in parse(content.as_buffer().to_pybytes(), name) if isinstance(r, Broken)]
                yield arrow_rows(_REJECTS, {"name": [name] * len(found), "place": [r.place for r in found], "reason": [r.reason for r in found]})

    return archive.mapInArrow(run, REJECTS)


def read_arc(archive: DataFrame) -> DataFrame:
    return _parsed(archive, parse_arc, _RECORDS, RECORDS)


def rejected_arc(archive: DataFrame) -> DataFrame:
    """``REJECTS``: where ARC archives could not be read, and why."""
    return _rejected(archive, parse_arc)


def revisits(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Records with ``keeper`` and ``keeper_record``, set where another record has the payload."""
    long = records.filter(F.col("payload_bytes") >= least)
    keepers = long.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "record_id")).alias("k")).filter("n > 1")
    keepers = keepers.select(F.col("digest").alias("d"), F.col("k.page_id").alias("keeper"), F.col("k.record_id").alias("keeper_record"))
    joined = records.join(keepers, (F.col("digest") == F.col("d")) & (F.col("payload_bytes") >= least), "left")
    other = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.withColumns({c: F.when(other, F.col(c)) for c in ("keeper", "keeper_record")}).drop("d")


def warc_rows(records: DataFrame) -> DataFrame:
    """One WARC record per row of ``revisits``."""
    revisit, http = F.col("keeper").isNotNull(), F.length("head") > 0
    kind = F.when(revisit, F.lit("revisit")).when(http, F.lit("response")).otherwise(F.lit("resource"))
    refers = F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), F.col("keeper_record"), F.lit(f"\r\n{KEEPER_HEADER}: "), F.col("keeper").cast("string"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        kind,
        F.lit("\r\nWARC-Record-ID: "),
        F.col("record_id"),
        F.lit("\r\nWARC-Date: "),
        F.regexp_replace("date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z"),
        F.lit("\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.upper("digest"),
        F.lit("\r\nX-Payload-Length: "),
        F.col("payload_bytes").cast("string"),
        F.when(revisit, refers).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: "),
        F.when(http, F.lit("application/http;msgtype=response")).otherwise(F.col("mime")),
        F.lit("\r\nContent-Length: "),
    )
    payload = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    block = F.concat(F.col("head").cast("string"), payload)
    return records.select(F.concat(head, F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block).alias("value"))


WARC = "page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_WARC = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64())]
    + [("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def parse_warc(data: bytes, name: str = "") -> Iterator[dict | Broken]:
    """The records of an uncompressed WARC file, stored payloads with their digest checked.

    A payload that fails its digest is one ``Broken``; a head that can't be read or a cut block ends
    the archive with one."""
    at = 0
    try:
        while at < len(data):
            if data[at : at + 1] in b"\r\n":
                at += 1
                continue
            record, at = _warc_record(data, at)
            yield record
    except Broken as broken:
        yield broken


def _warc_record(data: bytes, begin: int) -> tuple[dict | Broken, int]:
    """The record at ``begin``, and where it ends."""
    head, at = _head(data, begin)
    block = _block(data, at, _int(head.get(b"content-length"), begin, "the length"), begin)
    at += len(block)
    missing = [h.decode() for h in (b"warc-type", b"warc-payload-digest", b"warc-target-uri", b"warc-date", b"x-payload-length") if h not in head]
    if missing:
        return Broken(begin, f"no header {', '.join(missing)}"), at
    kind = head[b"warc-type"].decode("utf-8", "replace")
    http, body = _head(block, 0) if block.startswith(b"HTTP/") else ({}, 0)
    declared = head[b"warc-payload-digest"].partition(b":")[2].lower().decode("utf-8", "replace")
    if kind != "revisit" and hashlib.sha1(block[body:]).hexdigest() != declared:
        return Broken(begin, "the payload does not match its digest"), at
    if not head[b"x-payload-length"].isdigit():
        return Broken(begin, "the payload's length is no number"), at
    return {
        "page_id": _page_id(http, PAGE_HEADER),
        "url": head[b"warc-target-uri"].decode("utf-8", "replace"),
        "date": head[b"warc-date"].decode("utf-8", "replace"),
        "payload_bytes": int(head[b"x-payload-length"]),
        "payload_digest": declared,
        "record_type": kind,
        "refers_to": _page_id(head, KEEPER_HEADER),
    }, at


def read_warc(archive: DataFrame) -> DataFrame:
    return _parsed(archive, parse_warc, _WARC, WARC)


def rejected_warc(archive: DataFrame) -> DataFrame:
    """``REJECTS``: where WARC archives could not be read, and why."""
    return _rejected(archive, parse_warc)


def convert(arc: DataFrame) -> DataFrame:
    """ARC archives (``content``) to WARC records, ready for ``write_archive``."""
    return warc_rows(revisits(read_arc(arc)))


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages to ARC files, converted to WARC files, read back: one row per page."""
    spark = pages.sparkSession
    arc = write_archive(arc_rows(pages), "\n", "arc")
    warc = write_archive(convert(archives(spark, arc)), "\r\n\r\n", "warc")
    return read_warc(archives(spark, warc))
