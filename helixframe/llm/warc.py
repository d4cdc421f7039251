"""WARC archives without repeated payloads.

Headers (id, payload digest, length) are shuffled by digest to find the first record of each payload. Its record is a
response; the others become revisit records that name it and hold no payload. Every record is a gzip member of its own,
as readers that seek expect; whole files of a bounded size go through Spark's own text sink as raw bytes, so they appear
only when their task has committed. Reading inflates a stretch at a time, parses every record by its Content-Length and
joins revisits to their originals.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import BROADCAST_IDS
from helixframe.session import stored, stored_path

CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as 32 upper-case base32 characters: ten hex digits at a time make eight of them."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def _record_id(page_id: Column, digest: Column) -> Column:
    """The same urn:uuid for the same page and payload, whenever it is asked for."""
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null: empty), digest, n_bytes, first (the smallest page_id with that payload, if another).

    Only headers are shuffled; if revisits are few, which is counted, whole pages stay where they are."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumns(
        {"digest": base32_sha1(F.col("html").cast("binary")), "n_bytes": F.octet_length("html").cast("long")}
    )
    headers = stored(rows.select("page_id", "digest", "n_bytes"), "warc-headers")
    firsts = headers.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    firsts = stored(firsts.where("first < last").select(F.col("digest").alias("of"), "first"), "warc-firsts")  # a table, so that a hot digest can be split
    later = headers.join(firsts, F.col("digest") == F.col("of")).where(F.col("page_id") > F.col("first"))
    later = stored(later.select(F.col("page_id").alias("later_id"), F.col("digest").alias("later_digest"), "first").distinct(), "warc-later")
    found = F.broadcast(later) if later.count() <= BROADCAST_IDS else later.hint("merge")
    return rows.join(found, (F.col("page_id") == F.col("later_id")) & (F.col("digest") == F.col("later_digest")), "left").select("page_id", "url", "html", "digest", "n_bytes", "first")


#: What ends a file: the text sink writes a separator after each row, and this one is a gzip member of nothing.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = 16_000_000, date: str | None = None) -> None:
    """Write one record for each row of pages (page_id, url, html) to files under path, which grow to file_bytes, or by
    one record beyond it.

    Payloads of at least min_bytes that equal one of a smaller page_id become revisit records; a null html is an empty
    payload; line breaks and blanks in a url are percent-encoded; null ids get responses; rows that repeat the smallest
    id are responses too. An empty table writes no records.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    resolved = resolve_revisits(pages, min_bytes)
    revisit = F.col("first").isNotNull()
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A"), " ", "%20")
    http = F.concat(F.lit(HTTP), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first"), F.col("digest")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        F.lit(""),
        F.lit(""),
    ]
    record = F.concat(F.concat_ws(CRLF, *lines), block, F.lit(CRLF * 2))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                members.append(gzip.compress(value.as_buffer(), 6, mtime=0))
                size += len(members[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["file"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["file"])

    (
        resolved.select(record.alias("value"))
        .mapInArrow(files, "file binary")
        .select(F.col("file").cast("string"))  # the same bytes
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
STEP = 65_536


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of all gzip members, a stretch at a time."""
    at, view = 0, memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):
            some = view[at : at + STEP]
            at += len(some)
            yield member.decompress(some)
        at -= len(member.unused_data)


def parse_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive that comes in stretches, by Content-Length alone."""
    chunks, held = iter(chunks), bytearray()

    def more() -> bool:
        for chunk in chunks:
            held.extend(chunk)
            return True
        return False

    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("an archive ends within a record's headers")
                return
        headers = {k.decode().lower(): v.decode() for k, v in HEADER.findall(held, 0, end + 2)}
        first, last = end + 4, end + 4 + int(headers["content-length"])
        while len(held) < last + 4:
            if not more():
                raise ValueError("an archive ends within a record")
        yield headers, bytes(memoryview(held)[first:last])
        del held[: last + 4]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, payload_bytes, payload_digest, refers_to of every record in the archives under path.

    Lengths and digests of responses are taken from their payloads; a revisit has those of the response it names.
    """
    names = ["page_id", "record_type", "record_id", "refers", "n_bytes", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, whole in parse_records(inflated(content.as_py())):
                    page = int(h["x-page-id"]) if h.get("x-page-id") else None
                    if h["warc-type"] == "revisit":
                        rows.append((page, "revisit", h["warc-record-id"], h["warc-refers-to"], None, h["warc-payload-digest"][5:]))
                        continue
                    payload = whole[whole.index(b"\r\n\r\n") + 4 :]
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((page, "response", h["warc-record-id"], None, len(payload), digest))
                columns = [[r[i] for r in rows] for i in range(6)]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parsed = files.mapInArrow(run, "page_id long, record_type string, record_id string, refers string, n_bytes long, digest string")
    found = stored(parsed, "warc-records")
    originals = stored(  # a table, so that the join can split an original that very many records refer to
        found.where(F.col("record_type") == "response")
        .groupBy("record_id")
        .agg(F.first("page_id").alias("original"), F.first("n_bytes").alias("original_bytes"), F.first("digest").alias("original_digest"))
        .withColumnRenamed("record_id", "original_id"),
        "warc-originals",
    )
    revisits = found.where(F.col("record_type") == "revisit").join(originals, F.col("refers") == F.col("original_id"), "left")
    return revisits.select(
        "page_id",
        "record_type",
        F.col("original_bytes").alias("payload_bytes"),
        F.coalesce("original_digest", "digest").alias("payload_digest"),
        F.col("original").alias("refers_to"),
    ).unionByName(
        found.where(F.col("record_type") == "response").select(
            "page_id", "record_type", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to")
        )
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives of pages to the shared folder and read them back."""
    path = stored_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)
