"""WARC archives written and read as rows of chunks.

A payload is never one value after it has been cut: it travels as rows of a record id and a chunk
number, each with the SHA-1 of the payload up to its end, which the next chunk's digest goes on from.
The archive stores a payload with HTTP's chunked transfer coding, so every chunk row of the table is a
framed piece of the file and both directions run with one chunk in memory.

Archives are gzipped text files written and read by Spark's own text source with CRLF as the line
end, so they lie in any store Spark reaches and a failed task leaves no half-written file. A gzip file
is read by one task from its start, which is what keeps a record's lines in order; many files are the
unit of parallelism.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import as_bytes, columns, cut, slices
from tracehold.session import scratch

CHUNK, LEAST = 1 << 16, 1000
_TIME = "2024-01-01T00:00:00Z"
_CHUNKS = "page_id long, chunk int, size int, upto long, sha1 string, last boolean"
_FIELDS = [("page_id", pa.int64()), ("chunk", pa.int32()), ("size", pa.int32()), ("upto", pa.int64()), ("sha1", pa.string()), ("last", pa.bool_()),
           ("record_type", pa.string()), ("refers_to", pa.int64())]
_NONE = "none"


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip([c for c, _ in fields], map(list, zip(*rows)))), pa.schema(fields))


def chunked(payload: bytes, size: int = CHUNK) -> Iterator[tuple[memoryview, str, bool]]:
    """Pieces of at most ``size`` bytes, none cut inside a UTF-8 character, each with the digest so far
    and whether it is the last. An empty payload is one empty piece."""
    digest, view, at = hashlib.sha1(usedforsecurity=False), memoryview(payload), 0
    while True:
        end = min(at + size, len(view))
        while end < len(view) and view[end] & 0xC0 == 0x80:
            end -= 1
        digest.update(view[at:end])
        yield view[at:end], digest.copy().hexdigest(), end == len(view)
        if end == len(view):
            return
        at = end


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 16):
        rows = []
        for i, html in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist()):
            upto = 0
            for n, (piece, sha1, last) in enumerate(chunked(as_bytes(html))):
                upto += len(piece)
                rows.append((i, n, len(piece), upto, sha1, last))
        yield _batch(rows, _FIELDS[:6])


def chunk_table(pages: DataFrame) -> DataFrame:
    """page_id, chunk, size, upto (bytes up to this chunk's end), sha1 (of them) and last."""
    return pages.select("page_id", "html").mapInArrow(_digest_rows, _CHUNKS)


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def _clean(url: str | None) -> str:
    return "".join((url or "about:blank").split())


def record_lines(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None) -> Iterator[str]:
    """A record as lines of the archive; each is followed by CRLF. ``refers_to`` makes it a revisit,
    which has no payload."""
    key = _NONE if page_id is None else str(page_id)
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is None:
        length = len(http) + sum(len(f"{len(p):x}") + 4 + len(p) for p, _, _ in chunked(payload) if len(p)) + len("0\r\n\r\n")
        kind = "response"
    else:
        length, kind = len(http), "revisit"
    yield "WARC/1.1"
    yield f"WARC-Type: {kind}"
    yield f"WARC-Record-ID: {record_id(key)}"
    yield f"WARC-Date: {_TIME}"
    yield f"WARC-Target-URI: {_clean(url)}"
    yield f"WARC-Payload-Digest: sha1:{sha1}"
    yield f"X-Page-ID: {key}"
    yield f"X-Payload-Length: {size}"
    if refers_to is not None:
        yield "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield f"WARC-Refers-To: {record_id(refers_to)}"
        yield f"X-Refers-To-Page-ID: {refers_to}"
    yield "Content-Type: application/http;msgtype=response"
    yield f"Content-Length: {length}"
    yield ""
    yield from http.removesuffix("\r\n").split("\r\n")
    if refers_to is None:
        for piece, _, _ in chunked(payload):
            if len(piece):
                yield f"{len(piece):x}"
                yield str(piece, "utf-8", "surrogatepass")
        yield "0"
        yield ""
    yield ""
    yield ""


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for b in slices(batches, 16):
        for r in b.to_pylist():
            for line in record_lines(r["page_id"], r["url"], as_bytes(r["html"]), r["payload_bytes"], r["payload_digest"], r["refers_to"]):
                held.append(line)
                weight += len(line)
                if weight > 1 << 20:
                    yield pa.record_batch([pa.array(held, pa.string())], ["value"])
                    held, weight = [], 0
    if held:
        yield pa.record_batch([pa.array(held, pa.string())], ["value"])


class _Reader:
    """The lines of archives to rows of ``_CHUNKS`` and the record's headers, one line at a time."""

    def __init__(self):
        self.state, self.rows = "start", []

    def line(self, line: bytes) -> None:
        getattr(self, f"_{self.state}")(line)

    def _start(self, line: bytes) -> None:
        if line == b"WARC/1.1":
            self.head, self.state = {}, "headers"
        elif line:
            raise ValueError(f"not a record: {line[:80]!r}")

    def _headers(self, line: bytes) -> None:
        if line:
            name, _, value = line.decode().partition(": ")
            self.head[name] = value
        else:
            self.state = "http"

    def _http(self, line: bytes) -> None:
        if line:
            return
        self.digest, self.number, self.size = hashlib.sha1(usedforsecurity=False), 0, 0
        if self.head["WARC-Type"] == "revisit":
            self.size = int(self.head["X-Payload-Length"])
            self._end(self.head["WARC-Payload-Digest"].removeprefix("sha1:"))
        else:
            self.state = "size"

    def _size(self, line: bytes) -> None:
        self.left = int(line, 16)
        self.piece = self.left
        self.state, self.first = ("chunk", True) if self.left else ("last", True)
        if not self.left:
            self._end(self.digest.hexdigest())

    def _chunk(self, line: bytes) -> None:
        """A chunk may hold CRLF itself: its lines are joined again until its size is reached."""
        if not self.first:
            self.digest.update(b"\r\n")
            self.left -= 2
        self.digest.update(line)
        self.left -= len(line)
        self.first = False
        if self.left < 0:
            raise ValueError("a chunk is longer than it says")
        if not self.left:
            self.size += self.piece
            self.rows.append(self._row(self.number, self.piece, self.digest.hexdigest(), False))
            self.number, self.state = self.number + 1, "size"

    def _row(self, number: int, size: int, sha1: str, last: bool) -> tuple:
        page, refers = self.head["X-Page-ID"], self.head.get("X-Refers-To-Page-ID")
        return (None if page == _NONE else int(page), number, size, self.size, sha1, last, self.head["WARC-Type"], int(refers) if refers else None)

    def _end(self, sha1: str) -> None:
        if sha1 != self.head["WARC-Payload-Digest"].removeprefix("sha1:") or self.size != int(self.head["X-Payload-Length"]):
            raise ValueError(f"record {self.head['WARC-Record-ID']} is damaged")
        self.rows.append(self._row(self.number, 0, sha1, True))
        self.state = "start"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    for b in batches:
        for v in b.column(0):
            reader.line(v.as_py())
        if reader.rows:
            yield _batch(reader.rows, _FIELDS)
            reader.rows = []
    if reader.state != "start":
        raise ValueError("the archive ends inside a record")


def read_chunks(archives: DataFrame) -> DataFrame:
    """The chunk table of archives read as text with CRLF line ends, and record_type and refers_to. A
    record ends with a row of size 0, whose upto is the payload's length (a revisit's: of the payload
    it stands for)."""
    return archives.select(F.col("value").cast("binary").alias("value")).mapInArrow(_read, _CHUNKS + ", record_type string, refers_to long")


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest and refers_to (null for a response), once for each page_id
    and payload. Payloads count as equal by their length and SHA-1."""
    whole = cut(chunk_table(pages).filter("last").select("page_id", F.col("upto").alias("payload_bytes"), F.col("sha1").alias("payload_digest")).distinct(), "warc-digests")
    first = whole.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("response"))
    return whole.join(first, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "payload_bytes", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """A record for each row of ``pages`` (page_id, url, html) in gzipped WARC files under ``path``."""
    plan = plan_records(pages, least)
    same = pages["page_id"].eqNullSafe(plan["page_id"]) & (F.sha1(F.coalesce(pages["html"], F.lit("")).cast("binary")) == plan["payload_digest"])
    rows = pages.join(plan, same).select(pages["page_id"], "url", "html", "payload_bytes", "payload_digest", "refers_to")
    rows.mapInArrow(_write, "value string").write.option("compression", "gzip").option("lineSep", "\r\n").text(path)


def read_archives(spark, path: str) -> DataFrame:
    return read_chunks(spark.read.option("lineSep", "\r\n").schema("value string").text(path))


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Write the pages as archives and read them back: page_id, payload_bytes, payload_digest (hex
    SHA-1), record_type, refers_to. Of records with equal payloads of at least ``least`` bytes the one
    with the largest page_id is the response, the others revisit it.

    Null payloads are empty and null addresses ``about:blank``. Every row gives a record and a row, also
    one that repeats another (both are then the response, or both revisit it). A row with a null page_id
    is a revisit wherever a page with an id has its payload, else a response. An empty table gives an
    empty archive and no rows."""
    df = columns(pages, page_id=page_id, url=url, html=html)
    path = scratch(df.sparkSession, "warc")
    write_archives(df, path, least)
    return (read_archives(df.sparkSession, path).filter("last")
            .select("page_id", F.col("upto").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to"))
