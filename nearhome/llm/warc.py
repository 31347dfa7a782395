"""WARC archives: a writer and a reader that salvages what a damaged archive still holds.

Writing: one gzip member per record, by Spark's text writer, so that the archives are committed like any other table.
The writer puts a separator after every row. It is the last byte of an empty gzip member with which every row ends, so
the file is a plain sequence of members and any WARC tool reads it. A row holds all members of an archive, which ends
before it would pass ``FILE_BYTES`` or ``RECORDS_PER_FILE``; only a single record that is larger makes a larger archive.

Reading: records are taken one after another, each checked (gzip sum, version line, mandatory headers, length, end of
record, payload digest). After a check fails, the reader looks for the next place where a whole valid member, or a record behind a
version line in an archive without compression, begins, goes on there and logs the bytes between as a quarantined gap.

Of records with equal payloads of at least ``MIN_SHARED`` bytes the one with the smallest page_id is a response and the
others are revisits of it; rows that repeat that page_id and payload are responses too. A null page_id is never the
smallest unless all are null; then all are responses. Null html is an empty payload. Archives that cannot be read at
all give one gap; empty ones give nothing.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhome.session import scratch_path, written

MIN_SHARED = 100  # bytes; smaller payloads are always stored
RECORDS_PER_FILE = 10_000
FILE_BYTES = 32 << 20  # compressed; an archive is written and read as one row
SLICE = 8 << 20  # bytes of payload in a batch that goes back to Spark
CHUNK = 1 << 16
DATE = "2000-01-01T00:00:00Z"  # the pages carry no time; a fixed one keeps reruns equal
_EMPTY = gzip.compress(b"", mtime=0)
_VERSION = b"WARC/1."
_MAGIC = b"\x1f\x8b\x08"

RECORD = "file string, start long, length long, gap string, headers map<string,string>, payload binary"


# --- writing ---

def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is set for revisits, whose payload is null."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = (
        rows.filter(F.octet_length("payload") >= MIN_SHARED)
        .groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    )
    joined = rows.join(written(shared.select("digest", "first_id"), "warc-shared"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(record_id: str, url: str | None, payload: bytes | None, digest: str, refers_to: str | None) -> bytes:
    body = payload or b""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Writes the records of ``page_records`` as archives of bounded size below ``path``."""

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for at in range(batch.num_rows):
                page, url, payload, digest, refers = (c[at].as_py() for c in columns)
                record = record_bytes("" if page is None else str(page), url, payload, digest, None if refers is None else str(refers))
                member = gzip.compress(record, 6, mtime=0) + _EMPTY
                if held and (size + len(member) > file_bytes or len(held) >= records_per_file):
                    yield row(held)
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield row(held)

    def row(members: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["archive"])  # the writer adds the last byte

    packed = records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(archives, "archive binary")
    writer = packed.select(F.col("archive").cast("string").alias("value")).write
    writer.option("lineSep", "\u0000").option("maxRecordsPerFile", 1).text(path)


# --- reading ---

def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def parse_record(data: bytes, at: int) -> tuple[int, dict[str, str], bytes] | str:
    """(end, headers, payload) of the record that begins at ``at``, or the check that failed."""
    if not data.startswith(_VERSION, at):
        return "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return "headers without an end"
    headers = _headers(data[at:stop])
    if not headers.get("warc-type") or not headers.get("warc-date") or not re.fullmatch(r"<[^<>\s]+>", headers.get("warc-record-id", "")):
        return "a mandatory header is missing"
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", ""), re.ASCII):
        return "no content length"
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "no end of record where the length says"
    payload = data[begin:end]
    kind, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if headers.get("warc-type") != "revisit" and kind.lower() == "sha256" and hashlib.sha256(payload).hexdigest() != digest.lower():
        return "payload digest differs"
    return end + 4, headers, payload


def _member(data: bytes, at: int) -> tuple[int, bytes] | None:
    """(end, content) of the gzip member that begins at ``at``, or None when it is broken."""
    stream, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not stream.eof:
            if at >= len(data):
                return None
            out.append(stream.decompress(view[at : at + CHUNK]))
            at = min(at + CHUNK, len(data))
            if len(out) == 1 and out[0] and not out[0].startswith(_VERSION[: len(out[0])]):
                return None
    except zlib.error:
        return None
    return at - len(stream.unused_data), b"".join(out)


def _plain_units(data: bytes) -> Iterator[tuple[int, int, str | None, dict, bytes]]:
    at = 0
    while at < len(data):
        found = parse_record(data, at)
        if not isinstance(found, str):
            yield at, found[0], None, found[1], found[2]
            at = found[0]
            continue
        begin, why, at = at, found, data.find(_VERSION, at + 1)
        while at >= 0 and isinstance(parse_record(data, at), str):
            at = data.find(_VERSION, at + 1)
        at = len(data) if at < 0 else at
        yield begin, at, why, {}, b""


def _gzip_units(data: bytes) -> Iterator[tuple[int, int, str | None, dict, bytes]]:
    at = 0
    while at < len(data):
        found = _member(data, at) if data.startswith(_MAGIC, at) else None
        if found is None:
            begin, at = at, data.find(_MAGIC, at + 1)
            while at >= 0 and (found := _member(data, at)) is None:
                at = data.find(_MAGIC, at + 1)
            at = len(data) if at < 0 else at
            yield begin, at, "no valid member", {}, b""
            if found is None:
                continue
        end, content = found
        for _, _, why, headers, payload in _plain_units(content):  # a member may hold several records
            yield at, end, why, headers, payload
        at = end


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict, bytes]]:
    """(start, end, reason of a gap or None, headers, payload) over the bytes of an archive, in order.

    Inside a compressed archive, start and end are those of the member.
    """
    compressed = data.startswith(_MAGIC[:2]) or not data.startswith(_VERSION) and -1 < data.find(_MAGIC) < (data.find(_VERSION) % (len(data) + 1))
    yield from (_gzip_units if compressed else _plain_units)(data)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, length, gap, headers, payload): the records (gap is null) and the quarantined gaps of all archives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("gap", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for batch in batches:
            for at in range(batch.num_rows):
                file, data = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                rows, size = [], 0
                for start, end, gap, headers, payload in salvage(data):
                    rows.append({"file": file, "start": start, "length": end - start, "gap": gap, "headers": list(headers.items()), "payload": payload if gap is None else None})
                    size += len(payload) + 200
                    if size > SLICE:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, RECORD)


def _id(header: str) -> F.Column:
    return F.regexp_extract(F.col("headers")[header], r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def page_index(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the page records; revisits by what they refer to."""
    rows = written(records.filter("gap IS NULL").select(
        _id("warc-record-id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("found"), F.substring_index(F.col("headers")["warc-payload-digest"], ":", -1).alias("digest"),
        F.col("headers")["warc-type"].alias("record_type"), _id("warc-refers-to").alias("refers_to"),
    ), "warc-index")
    responses, revisits = rows.filter("record_type = 'response'"), rows.filter("record_type = 'revisit'")
    sources = responses.select(
        F.col("page_id").alias("refers_to"), F.col("found").alias("digest"), F.col("payload_bytes").alias("bytes"),
    ).join(revisits.select("refers_to").distinct(), "refers_to", "left_semi").distinct()
    resolved = revisits.join(sources, ["refers_to", "digest"], "left")
    return responses.select(
        "page_id", "payload_bytes", F.col("found").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(resolved.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes all pages as archives in the shared folder and answers from what reading them gives."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(page_records(pages), path)
    return page_index(read_archives(spark, path))
