"""WARC archives: writing captures as request, response or revisit, and metadata records; joining them again.

Files are ``.warc.gz`` with one gzip member a record, as the WARC 1.1 format asks.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.shared import Scratch, new_folder, removed, written

_EOL = b"\r\n"
#: Archives have no clock of their own: what a run writes is the same whenever it runs.
WARC_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f6b1f5e-9a57-5d0b-8a44-0f5f0c6b7a10")
_READ_BYTES = 1 << 20
_PIECE_BYTES = 16 << 10
#: Bytes of payload in one batch that a reader hands on.
_BATCH_BYTES = 8 << 20

RECORD = (
    "record_id string, warc_type string, target_uri string, concurrent_to string, refers_to string, payload_digest string, "
    "content_type string, http_length long, fields map<string, string>, payload binary"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {page_id} {digest}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + _EOL * 2 + block + _EOL * 2) + pack.flush()


def capture_records(page_id: int | None, url: str, payload: bytes, response_id: int | None) -> list[bytes]:
    """The request, response or revisit, and metadata of a capture; response_id is null for what is stored in full."""
    digest, uri = payload_digest(payload), url.replace("\r", "").replace("\n", "").strip() or "urn:no-uri"
    own = record_id("answer", page_id, digest)
    base = [("WARC-Date", WARC_DATE), ("WARC-Target-URI", uri)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    answer = [("WARC-Record-ID", own), *base, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if response_id is None:
        first = record([("WARC-Type", "response"), *answer], http + payload)
    else:
        revisit = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id("answer", response_id, digest))]
        first = record([("WARC-Type", "revisit"), *answer, *revisit], http)
    host = uri.partition("://")[2].partition("/")[0]
    asked = f"GET {uri} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    request = [("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page_id, digest)), *base, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")]
    known = "" if page_id is None else f"page-id: {page_id}\r\n"
    meta = [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page_id, digest)), *base, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")]
    return [first, record(request, asked), record(meta, f"{known}payload-length: {len(payload)}\r\n".encode())]


class _Unzipped:
    """Bytes of a file of gzip members or of plain records, read as they are needed."""

    def __init__(self, source):
        self.source, self.held, self.at = source, bytearray(), 0
        self.raw, self.raw_at = source.read(2), 0
        self.unpack = zlib.decompressobj(31) if self.raw == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.raw_at == len(self.raw):
            self.raw, self.raw_at = self.source.read(_READ_BYTES), 0
            if not self.raw:
                return False
        if self.at > _READ_BYTES:
            del self.held[: self.at]
            self.at = 0
        # zlib copies what is behind the end of a member, so it gets little at a time.
        piece = self.raw[self.raw_at : self.raw_at + _PIECE_BYTES]
        self.raw_at += len(piece)
        if self.unpack is None:
            self.held += piece
            return True
        self.held += self.unpack.decompress(piece)
        if self.unpack.eof:
            self.raw_at -= len(self.unpack.unused_data)
            self.unpack = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes:
        """What stands before the next mark; empty at the end of the file."""
        seen = 0
        while (found := self.held.find(mark, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self._more():
                if self.held[self.at :].strip():
                    raise ValueError("a record ends inside its header")
                return b""
        out, self.at = bytes(self.held[self.at : found]), found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self._more():
                raise ValueError("a record is shorter than it says")
        out, self.at = bytes(self.held[self.at : self.at + n]), self.at + n
        return out


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode(errors="replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse_records(source) -> Iterator[dict]:
    """The records of one archive, as rows of RECORD, in the order of the file."""
    data = _Unzipped(source)
    while head := data.until(_EOL * 2).lstrip(_EOL):
        version, warc = _fields(head)
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        block = data.take(int(warc["content-length"]))
        data.take(4)
        http, payload, content = {}, block, warc.get("content-type", "")
        if content.startswith("application/http"):
            top, _, payload = block.partition(_EOL * 2)
            http = _fields(top)[1]
        digest = (warc.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        if warc.get("warc-type") == "response" and digest not in (None, payload_digest(payload)):
            raise ValueError("a payload does not have the digest that its record says")
        fields = _fields(_EOL + block)[1] if content.startswith("application/warc-fields") else {}
        length = http.get("content-length", "")
        yield {
            "record_id": warc.get("warc-record-id"),
            "warc_type": warc.get("warc-type"),
            "target_uri": warc.get("warc-target-uri"),
            "concurrent_to": warc.get("warc-concurrent-to"),
            "refers_to": warc.get("warc-refers-to"),
            "payload_digest": digest,
            "content_type": content or None,
            "http_length": int(length) if length.isdigit() else None,
            "fields": {k: v for k, v in fields.items() if k},
            "payload": payload,
        }


def with_responses(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as (page_id, url, payload, response_id): null where the page is stored in full.

    Of pages with byte-equal payloads (SHA-256 and length), the one with the largest page_id is stored in full, and
    the others name it. Grouping is a map-side maximum; the join back is one that Spark splits where a payload is hot.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.unhex(F.sha2("payload", 256)).alias("same"), F.length("payload").alias("length"))
    largest = written(pages.sparkSession, rows.groupBy("same", "length").agg(F.max("page_id").alias("largest")), "warc-largest")
    named = rows.join(largest, ["same", "length"])
    # Without any page_id in a group there is nothing to name: all its rows are stored in full.
    revisits = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return named.select("page_id", "url", "payload", F.when(revisits, F.col("largest")).alias("response_id"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages(page_id, url, html) as archives, three records a capture; one row a file: path, n_records.

    Each task writes a file of its own. A task that runs again writes another file, and only those of the tasks that
    count are in the result, which is a table: reading it again doesn't write again. Null html is an empty payload.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        path, sink, n = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for page_id, url, payload, response_id in zip(*(c for c in batch.columns), strict=True):
                if sink is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(path, compression=None)
                    sink.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", WARC_DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                for data in capture_records(page_id.as_py(), url.as_py(), payload.as_py(), response_id.as_py()):
                    sink.write(data)
                    n += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n}])

    return written(spark, with_responses(pages).mapInArrow(write, "path string, n_records long"), "warc-files")


def read_archives(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """The records (RECORD) of the archives that files(path) names, in the store of folder's URI; a task reads files as streams."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        text, held, size = pa.string(), [], 0
        schema = pa.schema(
            [(k, text) for k in ("record_id", "warc_type", "target_uri", "concurrent_to", "refers_to", "payload_digest", "content_type")]
            + [("http_length", pa.int64()), ("fields", pa.map_(text, text)), ("payload", pa.binary())]
        )
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as source:
                    for row in parse_records(source):
                        held.append(row | {"fields": list(row["fields"].items())})
                        size += len(row["payload"])
                        if size > _BATCH_BYTES or len(held) > 5000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(read, RECORD)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, answer, request, metadata, each a record with the columns of records.

    Responses, revisits and resources are captures. A request or metadata record belongs to the capture that its
    concurrent-to names, or that names it. Of several requests or metadata records of one capture, the one with the
    smallest record id is taken. Captures that repeat a record id are rows of their own. Records that belong to no
    capture are left out; a capture without a request or metadata has null there.
    """
    rows = records.select("record_id", "concurrent_to", "warc_type", F.struct(*records.columns).alias("row"))
    answers = rows.filter(F.col("warc_type").isin("response", "revisit", "resource"))
    naming = answers.filter("concurrent_to is not null").select(F.col("record_id").alias("capture_id"), F.col("concurrent_to").alias("record_id"))
    own = rows.filter(F.col("warc_type").isin("request", "metadata"))
    linked = own.filter("concurrent_to is not null").select(F.col("concurrent_to").alias("capture_id"), "record_id", "warc_type", "row")
    linked = linked.unionByName(own.join(naming, "record_id").select("capture_id", "record_id", "warc_type", "row"))
    kinds = [F.min_by("row", F.when(F.col("warc_type") == kind, F.col("record_id"))).alias(kind) for kind in ("request", "metadata")]
    return answers.select(F.col("record_id").alias("capture_id"), F.col("row").alias("answer")).join(linked.groupBy("capture_id").agg(*kinds), "capture_id", "left")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes pages as archives, reads them back, joins the records, and returns a digest row for each page.

    page_id, payload_bytes, payload_digest (bare base32 SHA-1), record_type, refers_to: the page_id of the response
    that a revisit names. Of pages with equal payloads the one with the largest page_id is the response. The payloads
    themselves are checked against their digests where they are read and don't go into the joins.

    Null html counts as empty; a null url is written as one without a place. Rows that agree in page_id and payload
    are captures of one record id, each with its row. Rows with a null page_id revisit the response of their payload,
    or are responses where no page_id is there. Other columns of pages are ignored. An empty table gives an empty
    result.
    """
    spark = pages.sparkSession
    folder, scratch = new_folder(spark, "warc"), Scratch(spark, "warc")
    records = read_archives(spark, write_archives(pages, folder), folder)
    # As a table the records are parsed once, and joins go by their true size.
    records = scratch.written(records.withColumn("payload_length", F.length("payload").cast("long")).drop("payload"), "records")
    removed(spark, folder)
    small = assemble_captures(records).select(
        F.element_at("metadata.fields", "page-id").cast("long").alias("page_id"),
        F.coalesce("answer.http_length", "answer.payload_length").alias("payload_bytes"),
        F.col("answer.payload_digest").alias("payload_digest"),
        F.col("answer.warc_type").alias("record_type"),
        F.col("answer.record_id").alias("record_id"),
        F.col("answer.refers_to").alias("refers_record"),
    )
    small = scratch.written(small, "captures")
    revisits, responses = small.filter("record_type = 'revisit'"), small.filter("record_type <> 'revisit'")
    named = scratch.written(responses.groupBy(F.col("record_id").alias("refers_record")).agg(F.max("page_id").alias("refers_to")), "responses")
    scratch.keep("captures", "responses")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).union(revisits.join(named, "refers_record", "left").select(columns))
