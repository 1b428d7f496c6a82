"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as three records: the request, the response (or a revisit,
if an equal payload was captured before) and metadata. Request and metadata name
the response's record in WARC-Concurrent-To; reading joins the three through that
and gives one nested row per capture.

Records are rows of text until Spark's own writer makes the files, so the commit
protocol, not this module, deals with lost executors; the line separator of the
writer is the blank line that ends a WARC record. Reading goes by Content-Length:
Spark's reader unpacks gzipped files and hands them on piece by piece, cut at blank
lines wherever they are, and the pieces of a file are one stream of bytes again. So
a worker holds a record at a time, however large the archive.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stored, text_source

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures in one file, at most.
FILE_CAPTURES = 1000

RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, payload_digest string, http_length long, payload_bytes long, page_id long, payload binary"


def record_id(kind: str, page: Column) -> Column:
    """The record id of a page's capture: the same whenever it is written again."""
    named = F.coalesce(page.cast("string"), F.concat(F.lit("url:"), F.col("url")), F.lit("none"))
    digest = F.md5(F.concat(F.lit(f"{kind}:"), named, F.lit("/"), F.col("payload_digest")))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def header_safe(value: Column) -> Column:
    """The value without what would end or hide a header line."""
    return F.regexp_replace(value, r"[\x00-\x20\x7f]", "%20")


def captures(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to) of pages (page_id, url, html).

    Of pages with equal payloads of at least ``least_bytes`` bytes, the one with
    the smallest page_id is the response and the others refer to it; smaller
    payloads never refer. A null html is an empty payload. Rows that repeat a
    page_id and payload are captures of their own under one record id, all
    responses or all revisits. A page without an id is told by its url; it refers to
    the page of equal payload with the smallest id, if there is one, and is a response
    otherwise. An empty table gives an empty one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    # sums and minima are combined before the shuffle; only repeated digests are kept
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("first is not null and n > 1").select("payload_digest", "first")
    # the pages of one payload move to the page that is its response through a join that splits large keys
    joined = rows.join(stored(first, "repeated"), "payload_digest", "left")
    later = F.col("page_id").isNull() | (F.col("first") < F.col("page_id"))
    refers = F.when(later & (F.col("payload_bytes") >= least_bytes), F.col("first"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def records(found: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The WARC records of captures, a row of text each, without their closing blank line."""
    named = found.withColumn("id", record_id("response", F.col("page_id")))
    uri = F.coalesce(header_safe(F.col("url")), F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")), F.lit("urn:none"))
    named = named.withColumn("uri", F.when(uri == "", F.lit("urn:empty")).otherwise(uri))

    def record(kind: str, own: Column, extra: list[Column], content: str, block: Column) -> Column:
        lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), own), F.concat(F.lit("WARC-Target-URI: "), F.col("uri")), F.lit(f"WARC-Date: {date}"), *extra, F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
        return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"))
    near = F.concat(F.lit("WARC-Concurrent-To: "), F.col("id"))
    asked = record("request", record_id("request", F.col("page_id")), [near], "application/http; msgtype=request", F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1" + END)))
    full = record("response", F.col("id"), [digest], "application/http; msgtype=response", F.concat(http, F.col("html")))
    back = [digest, F.concat(F.lit("WARC-Refers-To: "), record_id("response", F.col("refers_to"))), F.lit(f"WARC-Profile: {PROFILE}")]
    again = record("revisit", F.col("id"), back, "application/http; msgtype=response", http)
    about = record("metadata", record_id("metadata", F.col("page_id")), [near], "application/warc-fields", F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")))
    answer = F.when(F.col("refers_to").isNull(), full).otherwise(again)
    return named.select(F.explode(F.array(asked, answer, about)).alias("value"))


def write(found: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write captures as gzipped WARC files below ``path``."""
    records(found, date).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * FILE_CAPTURES).text(path)


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream, one in memory at a time."""
    while line := stream.readline():
        if line == b"\r\n":  # between records
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block


def opened(data: bytes) -> BinaryIO:
    """A stream over a file's bytes; gzip with any number of members is unpacked as it is read."""
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


class Pieces(io.RawIOBase):
    """The bytes of a file, from what stands between its blank lines."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.left:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.left = memoryview(piece + END.encode())
        n = min(len(buffer), len(self.left))
        buffer[:n], self.left = self.left[:n], self.left[n:]
        return n


SCHEMA = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("http_length", pa.int64()), ("payload_bytes", pa.int64()), ("page_id", pa.int64()), ("payload", pa.binary())])


def parsed(stream: BinaryIO, payloads: bool) -> Iterator[pa.RecordBatch]:
    """The rows (RECORD) of an uncompressed WARC stream, about 8 MB of payloads at a time."""
    rows, held = [], 0
    for headers, block in parse(stream):
        kind = headers.get("warc-type", "")
        row = {"record_id": headers.get("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"), "uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "payload_digest": headers.get("warc-payload-digest", "").partition(":")[2] or None}
        if kind in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            length = re.search(rb"(?i)\ncontent-length: *(\d+)", head)
            row["http_length"] = int(length[1]) if length else None
            row["payload_bytes"] = row["http_length"]
            if kind == "response":
                digest = hashlib.sha256(body).hexdigest()
                if row["payload_digest"] not in (None, digest):
                    raise ValueError(f"{row['record_id']}: the payload does not have its digest")
                row |= {"payload_digest": digest, "payload_bytes": len(body), "payload": body if payloads else None}
                held += len(body) * payloads
        elif kind == "metadata" and (page := re.search(rb"(?m)^page-id: *(-?\d+)", block)):
            row["page_id"] = int(page[1])
        rows.append(row)
        if len(rows) >= 3000 or held > 8 << 20:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, SCHEMA)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all WARC files below ``path`` (columns: RECORD).

    Gzipped files (``*.gz``, of any number of members) are read as streams; others
    (``*.warc``, ``*.txt``) whole. ``payload_bytes`` and ``payload_digest`` of a response
    come from the payload as read, those of a revisit from its headers. Without
    ``payloads`` the payloads themselves stay behind. A record that is cut short, or is
    none, is an error; no files give no rows.
    """

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((file.as_py(), piece.as_py()) for batch in batches for file, piece in zip(batch.column("file"), batch.column("content")))
        for _, of_file in itertools.groupby(pieces, lambda p: p[0]):
            yield from parsed(io.BufferedReader(Pieces(piece for _, piece in of_file)), payloads)

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from parsed(opened(content.as_py()), payloads)

    below = spark.read.option("recursiveFileLookup", "true")
    # gzipped files are never split, and a task reads one after the other
    packed = below.option("pathGlobFilter", "*.gz").option("lineSep", END).text(path)
    packed = text_source(packed, F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("content"))
    plain = below.format("binaryFile").option("pathGlobFilter", "*.{warc,txt}").load(path).select("content")
    return packed.mapInArrow(streams, RECORD).unionByName(plain.mapInArrow(wholes, RECORD))


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: (capture_id, page_id, copies, response, request, metadata), the last three nested.

    Records meet at the response's or revisit's record id: their own, or the one in
    their concurrent-to. A capture may lack its request or metadata (null then);
    records that name a response that is not there are left out. ``copies`` counts
    the times that the archive holds it.
    """
    keyed = found.withColumn("capture_id", F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))).where("capture_id is not null")
    answer = F.struct("record_id", "type", "uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload")
    other = F.struct("record_id", "uri", "date")
    pick = lambda kinds, what: F.max_by(F.when(F.col("type").isin(*kinds), what), F.when(F.col("type").isin(*kinds), F.col("record_id")))
    whole = keyed.groupBy("capture_id").agg(pick(("response", "revisit"), answer).alias("response"), pick(("request",), other).alias("request"), pick(("metadata",), other).alias("metadata"), F.max("page_id").alias("page_id"), F.count_if(F.col("type").isin("response", "revisit")).alias("copies"))
    return whole.where("response is not null").select("capture_id", "page_id", "copies", "response", "request", "metadata")


def round_trip(pages: DataFrame, payloads: bool = False, path: str | None = None) -> DataFrame:
    """Archive the pages, read the archive back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(captures(pages), path)
    whole = assemble(read(spark, path, payloads)).select("capture_id", "page_id", "copies", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"))
    whole = stored(whole, "captures")
    # whom revisits refer to; a large group of copies splits, as both sides are dealt by this join
    targets = whole.where("record_type = 'response'").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"))
    revisits = whole.where("record_type = 'revisit'").join(targets, "to")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    every = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")
    answers = whole.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return answers.select(*columns, every).unionByName(revisits.select(*columns, every)).drop("__copy")
