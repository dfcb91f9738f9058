"""WARC archives: records of pages with revisits, and a reader that salvages what it can from damaged archives.

Writing: the first page of every payload (smallest key) is a ``response`` record, equal payloads become ``revisit`` records that
refer to it. Each task joins its records, one gzip member each, to archives of bounded size, which Spark's text writer puts into
the shared folder byte by byte, so that its committer decides which attempt of a task counts.

Reading: every member and record is checked (inflation and CRC, version line, header, length, closing lines, payload digest).
After a failed check the reader searches for the next member or version line that passes all checks, goes on from there, and
reports the bytes in between as a quarantined gap. Archives may be plain, gzipped by record, or a mixture.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import common

#: An archive is closed when it holds so many bytes; one larger record makes a larger archive.
ARCHIVE_BYTES = 32 << 20
#: An empty gzip member, which holds no record: Spark's text writer needs something to put behind every row.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300" + "00" * 8)
#: Record ids carry the key of the page.
RECORD_ID = "urn:x-row:"
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: What may start a record or a member, for the search after a failed check.
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: Header fields that a record has once; a second one belongs to another record whose start is lost.
ONCE = ("warc-type", "warc-record-id", "warc-date", "content-length")
RECORDS = ("archive string, offset long, size long, record_key string, target_key string, url string, record_type string, "
           "payload_bytes long, payload_digest string, payload binary, gap_reason string")


class Record(NamedTuple):
    key: str | None
    target: str | None
    url: str | None
    kind: str
    payload_bytes: int | None
    digest: str | None
    payload: bytes | None


class Found(NamedTuple):
    """A record at a byte span of the archive, or a gap with its reason."""
    offset: int
    size: int
    record: Record | None
    reason: str | None


class Damaged(Exception):
    """A failed check; its text is the reason of the gap."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(key: str) -> str:
    return f"<{RECORD_ID}{quote(key, safe='')}>"


def record_bytes(key: str | None, url: str | None, payload: bytes, target: str | None, date: str) -> bytes:
    """One record; ``target`` is the key of the response that a revisit refers to. A revisit keeps the response's header lines
    only, whose Content-Length tells the payload's size. Control characters of the address are percent-encoded."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if target is None else 'revisit'}",
            f"WARC-Record-ID: {_id(key) if key is not None else f'<{uuid.uuid4().urn}>'}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: quote(m[0]), url))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response"]
    if target is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {_id(target)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member_bytes(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    try:
        lines = head.decode().split("\r\n")
    except UnicodeDecodeError:
        raise Damaged("header is not UTF-8") from None
    out: dict[str, str] = {}
    for name, sep, value in (x.partition(":") for x in lines[1:]):
        name = name.strip().lower()
        if not sep or not name:
            raise Damaged("header line without a name")
        if name in out and name in ONCE:
            raise Damaged("header names a field twice")
        out[name] = value.strip()
    return out


def _length(fields: dict[str, str], name: str = "content-length") -> int:
    if not re.fullmatch(r"\d{1,18}", fields.get(name, "")):
        raise Damaged("no valid Content-Length")
    return int(fields[name])


def _key(identifier: str | None) -> str | None:
    inner = (identifier or "").strip("<>")
    return unquote(inner[len(RECORD_ID):]) if inner.startswith(RECORD_ID) else None


def parse_record(data: bytes, at: int) -> tuple[Record | None, int]:
    """(record, end of its bytes) of the version line at ``at``; None for records of other types than response and revisit.
    Raises Damaged when any check fails."""
    if not VERSION.match(data, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("header does not end")
    fields = _fields(data[at:stop])
    begin = stop + 4
    end = begin + _length(fields)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("truncated record" if end + 4 > len(data) else "record does not end where its length says")
    block = data[begin:end]
    if (want := fields.get("warc-block-digest", "")).startswith("sha1:") and want[5:].upper() != digest(block):
        raise Damaged("block digest differs")
    kind = fields.get("warc-type", "")
    if kind not in ("response", "revisit"):
        return None, end + 4
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/"):
        raise Damaged("block holds no HTTP message")
    told = _fields(http)
    claimed = fields.get("warc-payload-digest", "").removeprefix("sha1:").upper()
    if kind == "response":
        size, payload_digest = len(payload), digest(payload)
        if claimed and claimed != payload_digest and "transfer-encoding" not in told:
            raise Damaged("payload digest differs")
        claimed = claimed or payload_digest
    else:
        size, payload = _length(told) if "content-length" in told else None, None
    return Record(_key(fields.get("warc-record-id")), _key(fields.get("warc-refers-to")), fields.get("warc-target-uri"), kind,
                  size, claimed or None, payload), end + 4


def _inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """(content, end) of the gzip member at ``at``; zlib checks its CRC and length."""
    inflater, out, view, here = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not inflater.eof and here < len(data):
            out.append(inflater.decompress(view[here:here + step]))
            here += step
    except zlib.error:
        raise Damaged("gzip member fails its check") from None
    if not inflater.eof:
        raise Damaged("truncated gzip member")
    return b"".join(out), min(here, len(data)) - len(inflater.unused_data)


def _unit(data: bytes, at: int) -> tuple[list[Record], int, str | None]:
    """The plain record at ``at``, or all records of the member there that pass their checks; the end of its bytes; the first
    failed check inside a member that is sound itself."""
    if data[at:at + 3] != MEMBER:
        record, end = parse_record(data, at)
        return [record] if record else [], end, None
    content, end = _inflate(data, at)
    records, here, reason = [], 0, None
    while here < len(content):
        try:
            record, here = parse_record(content, here)
        except Damaged as e:
            reason = reason or str(e)
            following = VERSION.search(content, here + 1)
            here = following.start() if following else len(content)
            continue
        if record:
            records.append(record)
    return records, end, reason


def salvage(data: bytes) -> Iterator[Found]:
    """Records and quarantined gaps of one archive, in the order of their bytes. Members with other record types and empty members
    are neither. A sound member that holds a damaged record is reported as a gap beside its sound records."""
    at, gap, reason = 0, None, None
    while at < len(data):
        try:
            records, end, inside = _unit(data, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            following = START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield Found(gap, at - gap, None, reason)
            gap = None
        if inside:
            yield Found(at, end - at, None, inside)
        for record in records:
            yield Found(at, end - at, record, None)
        at = end
    if gap is not None:
        yield Found(gap, len(data) - gap, None, reason)


def targets(pages: DataFrame, key: str, payload: str, min_revisit_bytes: int) -> DataFrame:
    """(payload, key, url, target): ``target`` is the smallest key with an equal payload, where that is another one. Payloads
    are compared by SHA-256 and length; only the digests that occur under several keys are kept."""
    size, sha = F.octet_length(payload), F.sha2(F.col(payload), 256)
    several = pages.where(size >= min_revisit_bytes).groupBy(sha.alias("first_sha"), size.alias("first_size")).agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key")).where("first_key < last_key").drop("last_key")
    joined = pages.withColumns({"sha": sha, "size": size}).join(
        several, (F.col("sha") == F.col("first_sha")) & (F.col("size") == F.col("first_size")), "left")
    later = F.col(key) > F.col("first_key")
    return joined.withColumn("target", F.when(later, F.col("first_key")).when(F.col(key).isNull(), F.col("first_key")))


def write(df: DataFrame, key: str, url: str, html: str, path: str, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
          date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of ``df`` as gzipped archives into the folder ``path``.

    The payload is the text in UTF-8, a null one empty. Rows whose payload of at least ``min_revisit_bytes`` bytes occurs under a
    smaller key become revisits of the smallest; rows that share the smallest key are all responses, and so are payloads whose keys
    are all null. Rows with a null key revisit a key if there is one, and get a random record id. An empty table gives a
    folder without records. Other columns are not read.
    """
    pages = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"),
                      F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    plan = targets(pages, "key", "payload", min_revisit_bytes).select(
        F.col("key").cast("string").alias("key"), "url", "payload", F.col("target").cast("string").alias("target"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys, urls, payloads, firsts = batch.columns
            for i in range(batch.num_rows):
                held.append(member_bytes(record_bytes(keys[i].as_py(), urls[i].as_py(), payloads[i].as_py(), firsts[i].as_py(), date)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    (plan.mapInArrow(archives, "archive binary").select(F.col("archive").cast("string").alias("value"))  # the same bytes
     .write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
     .text(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives below ``path`` (columns of RECORDS). A gap has only archive, offset, size and gap_reason; a
    member that holds several records gives its span to each. An archive passes through one task, so its size bounds the
    memory; Spark reads it, from any store that Spark can read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("record_key", pa.string()),
                            ("target_key", pa.string()), ("url", pa.string()), ("record_type", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
                            ("gap_reason", pa.string())])
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                name, held, size = name.as_py(), [], 0
                for f in salvage(content.as_py() or b""):
                    r = f.record or Record(None, None, None, None, None, None, None)
                    held.append((name, f.offset, f.size, r.key, r.target, r.url, r.kind, r.payload_bytes, r.digest, r.payload, f.reason))
                    size += len(r.payload or b"")
                    if size > 4 << 20 or len(held) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, RECORDS)


def through_archives(df: DataFrame, key: str, url: str, html: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``df`` as archives into the shared folder and read them back: key, url, payload_bytes, payload_digest, record_type
    and refers_to of every record, from the archives alone."""
    spark = df.sparkSession
    path = common.shared_path(spark, "warc")
    write(df, key, url, html, path, min_revisit_bytes)
    common.delete_at_end(spark, path)
    kind = df.schema[key].dataType
    return read(spark, path).where("gap_reason IS NULL").select(
        F.col("record_key").cast(kind).alias(key), F.col("url"), "payload_bytes", "payload_digest", "record_type",
        F.col("target_key").cast(kind).alias("refers_to"))
