"""WARC archives: a writer with one gzip member per record and a sequential reader.

The reader pulls a bounded piece of the file at a time through an incremental zlib
decompressor, frames each block by its Content-Length and hashes it as it passes, so a
record is never held whole unless its payload is asked for. Block and payload digests are
verified; anything that breaks the framing raises WarcError.

Pages with equal payloads of at least min_revisit bytes are stored once: the record of
the smallest page_id is the response, the others are revisits (identical-payload-digest)
that keep only the HTTP header, whose Content-Length is that of the whole payload.

Archives go to a folder that driver and executors share, by Arrow's file systems, under
names of the task attempt; the manifest, written by Spark, lists those of the attempts
that counted, so a repeated task does no harm. Pages of a payload that many share, and
those too small to be shared, are dealt to many tasks.

Defined cases: null html is an empty payload; a null url leaves its header out; rows with
one page_id and equal payloads are alike (all response if that id is the smallest); a
null page_id is larger than any other and comes back as null; if all equal payloads have
null ids, all are responses; empty tables give no archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _frame

PIECE = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"


class WarcError(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """A gzip member with one record; a revisit if refers_to is given."""
    head = _http(len(payload))
    block = hashlib.sha256(head)
    if refers_to is None:
        block.update(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{block.hexdigest()}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + (len(payload) if refers_to is None else 0)}", "", ""]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    parts = [z.compress("\r\n".join(lines).encode()), z.compress(head)]
    if refers_to is None:
        parts.append(z.compress(payload))
    return b"".join([*parts, z.compress(b"\r\n\r\n"), z.flush()])


class _Members:
    """The decompressed bytes of the gzip member that comes next in a stream, piece by piece."""

    def __init__(self, stream):
        self.stream, self.rest, self.z, self.held = stream, b"", None, b""

    def begin(self) -> bool:
        """Go to the next member; false at the end of the stream."""
        self.rest = self.rest or self.stream.read(PIECE)
        self.z, self.held = zlib.decompressobj(31), b""
        return bool(self.rest)

    def more(self) -> bytes:
        """At least one more byte of the member, or nothing at its end."""
        if self.held:
            out, self.held = self.held, b""
            return out
        while not self.z.eof:
            if not self.rest and not self.z.unconsumed_tail:
                self.rest = self.stream.read(PIECE)
                if not self.rest:
                    raise WarcError("the stream ends inside a record")
            try:
                out = self.z.decompress(self.z.unconsumed_tail or self.rest, PIECE)
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            self.rest = b""
            if self.z.eof:
                self.rest = self.z.unused_data
            if out:
                return out
        return b""

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        data = b""
        while mark not in data:
            new = self.more()
            if not new or len(data) > most:
                raise WarcError("a header has no end")
            data += new
        out, _, self.held = data.partition(mark)
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            new = self.more()
            if not new:
                raise WarcError("a block is shorter than its Content-Length")
            if len(new) > n:
                new, self.held = new[:n], new[n:]
            n -= len(new)
            yield new


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for x in lines:
        name, colon, value = x.partition(b":")
        if not colon:
            raise WarcError(f"not a header: {x[:60]!r}")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _length(headers: dict[str, str]) -> int:
    if not headers.get("content-length", "").isdigit():
        raise WarcError("no Content-Length")
    return int(headers["content-length"])


def read_records(stream, payloads: bool = False) -> Iterator[Record]:
    """The records of an archive, in order; stream has read(n)."""
    m = _Members(stream)
    while m.begin():
        first, *lines = m.until(b"\r\n\r\n").split(b"\r\n")
        if not first.startswith(b"WARC/1."):
            raise WarcError(f"not a WARC record: {first[:60]!r}")
        h = _headers(lines)
        block, payload, kept = hashlib.sha256(), hashlib.sha256(), []
        head, inside, n, told = b"", False, 0, None
        for piece in m.take(_length(h)):
            block.update(piece)
            if not inside:
                head += piece
                top, end, piece = head.partition(b"\r\n\r\n")
                if not end:
                    continue
                inside, told = True, _length(_headers(top.split(b"\r\n")[1:]))
            payload.update(piece)
            n += len(piece)
            if payloads:
                kept.append(piece)
        if b"".join(m.take(4)) != b"\r\n\r\n" or m.more():
            raise WarcError("a record does not end where its Content-Length says")
        if told is None:
            raise WarcError("a block has no HTTP header")
        digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
        if h.get("warc-block-digest", "").removeprefix("sha256:") != block.hexdigest():
            raise WarcError(f"block digest of {h.get('warc-record-id')}")
        if h.get("warc-type") != "revisit" and (payload.hexdigest() != digest or n != told):
            raise WarcError(f"payload digest of {h.get('warc-record-id')}")
        yield Record(h, told, digest, b"".join(kept) if payloads else None)


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path that Hadoop names s3a://, abfss:// or the like."""
    scheme, mark, rest = uri.partition("://")
    known = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
    return fs.FileSystem.from_uri(f"{known.get(scheme, scheme)}://{rest}" if mark else uri)


def _writer(folder: str, archive_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        task = TaskContext.get()
        out, name, size, count, done = None, "", 0, 0, 0
        for b in batches:
            for page_id, url, html, digest, refers in zip(*(b.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    name = f"{task.partitionId():06d}-{done:04d}-{task.taskAttemptId()}.warc.gz"
                    out, size, count = files.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                data = record(page_id.as_py(), url.as_py(), html.as_py(), digest.as_py(), refers.as_py(), level)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    out, done = None, done + 1
                    yield pa.record_batch({"archive": [f"{folder}/{name}"], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})
        if out is not None:
            out.close()
            yield pa.record_batch({"archive": [f"{folder}/{name}"], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return run


def write(pages: DataFrame, folder: str, min_revisit: int = 100, archive_bytes: int = 64 << 20, level: int = 6) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html); returns the manifest (archive, records, bytes)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(_frame.as_binary("html"), F.lit(b"")).alias("html")).withColumn("digest", F.sha2("html", 256))
    rows = rows.withColumn("shared", F.when(F.octet_length("html") >= min_revisit, F.col("digest")))  # small payloads look up nothing
    counts = _frame.stored(rows.groupBy("shared").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    first = counts.where("shared is not null and first is not null").select("shared", "first")
    other = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    rows = _frame.look_up(rows, first, "shared", _frame.hot_keys(counts, "shared", "n", total))
    rows = rows.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))
    return _frame.stored(rows.mapInArrow(_writer(folder, archive_bytes, level), "archive string, records long, bytes long"))


def _number(value: str | None) -> int | None:
    text = (value or "").strip("<>").removeprefix(ID)
    return int(text) if text else None


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    for b in batches:
        for archive in b.column("archive").to_pylist():
            files, path = _files(archive)
            rows: list[tuple] = []
            with files.open_input_stream(path, compression=None) as stream:
                for r in read_records(stream):
                    rows.append((_number(r.headers.get("warc-record-id")), r.payload_bytes, r.payload_digest, r.headers["warc-type"], _number(r.headers.get("warc-refers-to"))))
                    if len(rows) == 5000:
                        yield pa.record_batch({n: pa.array(v, t) for (n, t), v in zip(kinds.items(), zip(*rows, strict=True), strict=True)})
                        rows = []
            if rows:
                yield pa.record_batch({n: pa.array(v, t) for (n, t), v in zip(kinds.items(), zip(*rows, strict=True), strict=True)})


def read(manifest: DataFrame) -> DataFrame:
    """The records of the archives of a manifest: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spread = manifest.select("archive").repartition(max(1, manifest.count()))
    return spread.mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(spark: SparkSession, pages: DataFrame, **kwargs) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    return read(write(pages, _frame.temporary_folder(spark, "warc"), **kwargs))
