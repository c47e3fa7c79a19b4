"""Web archives as a table of chunks.

A record is written as rows (archive, record, chunk): the bytes of an archive are those of its rows
in that order. A chunk holds a bounded number of bytes, so neither writing nor reading allocates a
whole record. Each chunk carries the running checksum and length of its record up to its end;
readers check every chunk against them, and digest payloads chunk by chunk.

The archive of a row is the writing task and the record its place there; Spark's commit of a written
table admits one attempt of every task. Records of one chunk are read where they lie, the others are
brought together by record and read in the order of chunks.

Defined results:
- A missing payload is empty, a missing url is left out of the header, a missing page_id is kept.
- Of equal payloads of at least `least` bytes, the rows with the largest page_id are responses (all
  of them, where a page is repeated) and the others revisit it; a missing page_id is smaller than
  all others. If every page_id of a payload is missing, all its rows are responses.
- Payloads are equal if SHA-1 and length are. An empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import rows_in, utf8
from cadenza.session import cut, new_path, send_with_tasks

CHUNK = 1 << 20
BATCH_BYTES = 1 << 22
# Names and forms of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"

CHUNKS = pa.schema(
    [("archive", pa.int32()), ("record", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()),
     ("record_bytes", pa.int64()), ("running_crc32", pa.int64()), ("data", pa.binary())]
)
CHUNK_FIELDS = "archive int, record long, chunk int, last boolean, record_bytes long, running_crc32 long, data binary"
RECORDS = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
)
RECORD_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def plan_records(pages: DataFrame, least: int, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """page_id, url, payload, n_bytes, digest, refers_to (missing for responses)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), utf8(payload_col).alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    long = rows.filter(F.col("n_bytes") >= least).groupBy("digest", "n_bytes")
    kept = long.agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop("n")
    # Written, so that the join can split a payload that very many pages share.
    kept = cut(kept)
    refers = F.when(~F.col("kept").eqNullSafe(F.col("page_id")), F.col("kept"))
    return rows.join(kept, ["digest", "n_bytes"], "left").select("page_id", "url", "payload", "n_bytes", "digest", refers.alias("refers_to"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record_head(page_id: int | None, url: str | None, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """The WARC and HTTP headers of a record; the payload of a response follows them."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        # Line ends would end the field.
        ("WARC-Target-URI", None if url is None else " ".join(url.splitlines())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Page-ID", page_id),
        ("WARC-Profile", None if refers_to is None else REVISIT),
        ("WARC-Refers-To", None if refers_to is None else _record_id(refers_to, digest)),
        ("WARC-Refers-To-Page-ID", refers_to),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(http) + (n_bytes if refers_to is None else 0)),
    ]
    head = "\r\n".join([VERSION, *(f"{name}: {value}" for name, value in fields if value is not None)])
    return head.encode() + END + http


def _spans(parts: list[bytes], size: int) -> Iterator[bytes]:
    """The bytes of the parts in spans of `size`, without joining the parts first."""
    held = bytearray()
    for part in parts:
        view, at = memoryview(part), 0
        while at < len(view):
            taken = view[at : at + size - len(held)]
            held += taken
            at += len(taken)
            if len(held) == size:
                yield bytes(held)
                held.clear()
    if held:
        yield bytes(held)


def chunk_rows(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunks of the records planned by `plan_records`."""

    def run(batches):
        archive, held, size = TaskContext.get().partitionId(), [], 0
        for record, (page_id, url, payload, n_bytes, digest, refers_to) in enumerate(rows_in(batches)):
            head = record_head(page_id, url, n_bytes, digest, refers_to)
            parts = [head, payload, END] if refers_to is None else [head, END]
            left, crc, done = sum(map(len, parts)), 0, 0
            for number, data in enumerate(_spans(parts, chunk)):
                crc, done = crc32(data, crc), done + len(data)
                held.append((archive, record, number, done == left, done, crc, data))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield _as_batch(held, CHUNKS)
                    held, size = [], 0
        if held:
            yield _as_batch(held, CHUNKS)

    return pages.mapInArrow(run, CHUNK_FIELDS)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def write_archives(pages: DataFrame, path: str, least: int = 1000, chunk: int = CHUNK) -> None:
    """Write a record for every page (page_id, url, html) to archives at a path."""
    chunk_rows(plan_records(pages, least), chunk).write.parquet(path)


class _Reader:
    """One record, fed chunk by chunk."""

    def __init__(self):
        self.head, self.fields, self.http = bytearray(), None, None
        self.sha, self.payload, self.crc, self.done, self.tail = hashlib.sha1(), 0, 0, 0, b""

    def feed(self, number: int, expected: int, record_bytes: int, running: int, data: bytes) -> None:
        self.crc, self.done = crc32(data, self.crc), self.done + len(data)
        if number != expected or self.crc != running or self.done != record_bytes:
            raise ValueError("a chunk is missing, repeated or damaged")
        if self.http is None:
            self.head += data
            data = self._headers()
        if data:
            self._body(data)

    def _headers(self) -> bytes:
        if self.fields is None:
            end = self.head.find(END)
            if end < 0:
                return b""
            lines = self.head[:end].decode().split("\r\n")
            if lines[0] != VERSION:
                raise ValueError("not a WARC record")
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            del self.head[: end + len(END)]
        end = self.head.find(END)
        if end < 0:
            return b""
        self.http = dict(line.split(": ", 1) for line in self.head[:end].decode().split("\r\n")[1:])
        self.left = int(self.fields["Content-Length"]) - end - len(END)
        rest = bytes(self.head[end + len(END) :])
        self.head.clear()
        return rest

    def _body(self, data: bytes) -> None:
        own = data[: self.left]
        self.sha.update(own)
        self.payload += len(own)
        self.left -= len(own)
        self.tail += data[len(own) :]

    def row(self) -> tuple:
        if self.http is None or self.left or self.tail != END:
            raise ValueError("a record is cut off")
        number = lambda name: int(self.fields[name]) if name in self.fields else None
        written, kind = self.fields["WARC-Payload-Digest"].removeprefix("sha1:"), self.fields["WARC-Type"]
        n_bytes = int(self.http["Content-Length"])
        if kind == "response" and (self.sha.hexdigest() != written or self.payload != n_bytes):
            raise ValueError("a payload does not match its digest")
        return number("WARC-Page-ID"), n_bytes, written, kind, number("WARC-Refers-To-Page-ID"), self.fields.get("WARC-Target-URI")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the records whose chunks come one after the other."""
    held, reader, at, expected = [], None, None, 0
    for batch in batches:
        for archive, record, number, last, record_bytes, running, data in zip(*(c.to_pylist() for c in batch.columns)):
            if reader is None:
                reader, at, expected = _Reader(), (archive, record), 0
            elif at != (archive, record):
                raise ValueError("a record is cut off")
            reader.feed(number, expected, record_bytes, running, data)
            expected += 1
            if last:
                held.append(reader.row())
                reader = None
        if held:
            yield _as_batch(held, RECORDS)
            held = []
    if reader is not None:
        raise ValueError("a record is cut off")


def read_chunks(chunks: DataFrame) -> DataFrame:
    """The records of archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    columns = [f.name for f in CHUNKS]
    whole = F.col("last") & (F.col("chunk") == 0)
    single = chunks.filter(whole).select(*columns).mapInArrow(_records, RECORD_FIELDS)
    split = chunks.filter(~whole).select(*columns).repartition("archive", "record")
    return single.unionByName(
        split.sortWithinPartitions("archive", "record", "chunk").mapInArrow(_records, RECORD_FIELDS)
    )


def read_archives(spark, path: str) -> DataFrame:
    return read_chunks(spark.read.parquet(path))


def round_trip(pages: DataFrame, least: int = 1000, chunk: int = CHUNK) -> DataFrame:
    """Write archives of the pages to the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least, chunk)
    return read_archives(pages.sparkSession, path)


send_with_tasks(__name__)
