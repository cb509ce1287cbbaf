"""WARC records as a chunked record table (operator 7).

:func:`write` turns payloads into WARC/1.1 records and keeps them as rows of a
record number, a chunk number and at most `chunk_bytes` bytes, with the SHA-1 of
the payload so far.  A record of at most `chunk_bytes` is one row, marked `whole`; those are read
where they lie, and only the chunks of longer ones are exchanged to read them.  The chunks of a partition in their order, one after the
other, are a valid archive (:func:`archive_bytes`).  :func:`read` streams the
chunks of each record in order: it holds a header and one chunk, and takes the
digest as it goes.  :func:`parse_stream` makes such rows from any WARC byte
stream, block by block.

Of records with equal payloads of at least `min_bytes`, the one with the largest
identifier is a response and the others are revisits without a payload block.

A null payload is empty; a very long one only adds chunks.  A null identifier is less than any other.  Rows that
repeat the largest identifier and the payload are all responses; their records share a WARC-Record-ID, as they are the same record.  An empty table
gives an empty archive.  Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

CHUNK_BYTES = 1 << 20
#: Bytes of chunks in a batch that is handed on.
FLUSH_BYTES = 4 << 20
#: A header of more bytes is an error, so that reading stays bounded.
MAX_HEADER_BYTES = 64 << 10
SCHEMA = "record bigint, chunk_no int, data binary, sha1_so_far string, whole boolean"
READ = "record bigint, record_id string, record_type string, target_uri string, payload_bytes bigint, payload_digest string, page_id bigint, refers_to bigint, verified boolean"


def digest_text(sha1: bytes) -> str:
    """Upper-case base32, as archives write digests."""
    return base64.b32encode(sha1).decode()


def header(record_type: str, record_id: str, uri: str | None, digest: str, size: int, body: int, page_id: int | None, refers_to: int | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri:
        lines.append("WARC-Target-URI: " + quote(uri, safe="!#$%&'()*+,/:;=?@[]~-._"))
    lines += ["Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if record_type == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>")
        lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    lines.append(f"Content-Length: {body}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _serialise(chunk_bytes: int):
    """Chunk rows, one after the other: of a payload no copy is made but of the chunks of a batch of rows."""

    def chunks(page_id, uri, newest, size, sha, payload):
        digest = digest_text(sha)
        kind = "response" if newest is None or newest == page_id else "revisit"
        body, running = size if kind == "response" else 0, hashlib.sha1()
        head, tail = header(kind, f"urn:page:{page_id}:{digest}", uri, digest, size, body, page_id, newest), b"\r\n\r\n"
        if len(head) + body + len(tail) <= chunk_bytes:
            running.update(payload[:body])
            yield b"".join((head, payload[:body], tail)), running.hexdigest(), True
            return
        yield head, running.hexdigest(), False
        for a in range(0, body, chunk_bytes):
            part = payload[a : a + chunk_bytes]
            running.update(part)
            yield bytes(part), running.hexdigest(), False
        yield tail, running.hexdigest(), False

    def run(batches):
        record = TaskContext.get().partitionId() << 32
        out: list[list] = [[], [], [], [], []]
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.bool_()))], names=["record", "chunk_no", "data", "sha1_so_far", "whole"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, uri, newest, size, sha = (batch.column(c)[i].as_py() for c in range(5))
                payload = memoryview(batch.column(5)[i].as_buffer())
                for n, (part, so_far, whole) in enumerate(chunks(page_id, uri, newest, size, sha, payload)):
                    for column, x in zip(out, (record, n, part, so_far, whole)):
                        column.append(x)
                    held += len(part)
                    if held >= FLUSH_BYTES:
                        yield flush()
                        out, held = [[], [], [], [], []], 0
                record += 1
        if out[0]:
            yield flush()

    return run


def write(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A written archive of the pages: record, chunk_no, data, sha1_so_far, whole.

    Payloads are exchanged once, by digest; a very common one's rows are split by Spark's skew join."""
    ship(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    own = own.withColumns({"size": F.octet_length("payload").cast("bigint"), "sha": F.unhex(F.sha1("payload"))})
    newest = own.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("newest"))
    both = own.join(newest, ["sha", "size"], "left")
    return written(both.select("page_id", "uri", "newest", "size", "sha", "payload").mapInArrow(_serialise(chunk_bytes), SCHEMA), "warc")


class Reader:
    """Takes the bytes of one record after the other, in blocks of any size; holds a header at most."""

    def __init__(self):
        self.head, self.fields, self.left, self.size, self.sha = b"", None, 0, 0, hashlib.sha1()

    def feed(self, block: bytes) -> Iterator[dict]:
        """Records that end with this block: their fields, with size and digest of the payload that was read."""
        while block:
            if self.fields is None:
                self.head = (self.head + block).lstrip(b"\r\n") if not self.head else self.head + block
                end = self.head.find(b"\r\n\r\n")
                if end < 0:
                    if len(self.head) > MAX_HEADER_BYTES:
                        raise ValueError("a record's header is too long")
                    return
                block, lines = self.head[end + 4 :], self.head[:end].decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("not a WARC record")
                self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                self.head, self.left, self.size, self.sha = b"", int(self.fields["content-length"]), 0, hashlib.sha1()
            part, block = block[: self.left], block[self.left :]
            self.sha.update(part)
            self.size += len(part)
            self.left -= len(part)
            if not self.left:
                yield {"fields": self.fields, "size": self.size, "sha1": self.sha.digest()}
                self.fields = None

    def end(self) -> None:
        if self.fields is not None or self.head.strip(b"\r\n"):
            raise ValueError("the archive ends within a record")


def parse_stream(blocks: Iterable[bytes]) -> Iterator[dict]:
    """Records of a WARC byte stream; see Reader.feed."""
    reader = Reader()
    for block in blocks:
        yield from reader.feed(block)
    reader.end()


def _read(batches):
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    reader, now, so_far = Reader(), None, None
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        out = []
        for record, n, data, claimed in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if record != now:
                reader.end()
                reader, now = Reader(), record
            for x in reader.feed(data):
                f = x["fields"]
                claim = f.get("warc-payload-digest", "").removeprefix("sha1:")
                revisit = f["warc-type"] == "revisit"
                full = number(f.get("x-payload-length", x["size"])) if revisit else x["size"]
                digest = claim if revisit else digest_text(x["sha1"])
                good = revisit or digest == claim
                out.append((record, f["warc-record-id"].strip("<>"), f["warc-type"], f.get("warc-target-uri"), full, digest, number(f.get("x-page-id")), number(f.get("x-refers-to-page-id")), good))
            if reader.fields is not None and reader.sha.hexdigest() != claimed:
                raise ValueError(f"record {record}: chunk {n} is damaged or missing")
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)
    reader.end()


def read(archive: DataFrame) -> DataFrame:
    """A row per record: record, record_id, record_type, target_uri, payload_bytes, payload_digest, page_id, refers_to, verified.

    A revisit's size and digest are those of the payload it refers to."""
    ship(archive.sparkSession)
    chunks = archive.where("NOT whole").repartition("record").sortWithinPartitions("record", "chunk_no")
    return archive.where("whole").mapInArrow(_read, READ).unionByName(chunks.mapInArrow(_read, READ))


def archive_bytes(archive: DataFrame) -> Iterator[bytes]:
    """The archive as a byte stream, chunk by chunk; brings one partition at a time to the driver."""
    for row in archive.orderBy("record", "chunk_no").select("data").toLocalIterator():
        yield bytes(row[0])


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write the pages, read the archive back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read(write(pages, **columns)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
