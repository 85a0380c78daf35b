"""WARC archives: a writer, and a sequential reader of one gzip member per record.

The writer makes one `response` record for each distinct payload (the row with the greatest page_id) and `revisit`
records for its other rows. A block holds an HTTP header with the payload's length; revisits hold that header alone.
Archives are written by the tasks to a folder that all executors share, under a name of the task attempt, and listed in
a manifest that only successful attempts reach; a lost or repeated attempt leaves a file that nothing reads.

The reader takes a file in pieces of bounded size, inflates one gzip member at a time, frames each record by its
Content-Length and checks the digests of its block and payload. A damaged record raises WarcError.

Archives are read by a task each, as long as there are no more than READERS of them. Files are opened by pyarrow: local
ones, S3 (`s3://`, and Hadoop's `s3a://` and `s3n://`), Google's and Azure's stores, and HDFS where libhdfs is installed.

A null html is an empty payload. Rows that share the greatest page_id of a payload are all responses, and a null
page_id counts as less than any other. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, encoded, prepare

#: Bytes that the reader takes at a time, and a closed archive's size.
PIECE, ARCHIVE = 1 << 16, 256 << 20
#: Partitions that a manifest's archives are dealt to at most.
READERS = 20_000
#: Hadoop's names of schemes that pyarrow has under other names.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:loom-page:%s>"


class WarcError(ValueError):
    pass


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, record_id: str, payload: bytes, payload_digest: str, length: int, target: str | None = None, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member. `payload` is empty for a revisit; `length` is that of the full payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + payload
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response")]
    if target:
        headers.append(("WARC-Target-URI", urllib.parse.quote(target, safe=":/?#[]@!$&'()*+,;=%~")))
    headers += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE)] + [("WARC-Refers-To", refers_to)] * bool(refers_to)
    headers.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The contents of a file's gzip members, one after the other."""
    rest, unpacker, parts = b"", None, []
    while True:
        data = rest or stream.read(PIECE)
        rest = b""
        if not data:
            if unpacker is not None:
                raise WarcError("the file ends inside a gzip member")
            return
        if unpacker is None:
            unpacker, parts = zlib.decompressobj(31), []
        try:
            parts.append(unpacker.decompress(data))
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        if unpacker.eof:
            rest, unpacker = unpacker.unused_data, None
            yield b"".join(parts)


def parse(member: bytes) -> Record:
    """The record of a member, framed by its Content-Length, its digests verified."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    headers = {k.strip().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines[1:])}
    try:
        length = int(headers["Content-Length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not frame the member")
    if (want := headers.get("WARC-Block-Digest")) and want != f"sha1:{digest(block)}":
        raise WarcError("block digest differs")
    record = Record(headers, block)
    if headers.get("WARC-Type") == "response" and (want := headers.get("WARC-Payload-Digest")) and want != f"sha1:{digest(payload(record)[1])}":
        raise WarcError("payload digest differs")
    return record


def payload(record: Record) -> tuple[int, bytes]:
    """The full payload's length, and the payload (empty for revisits)."""
    head, _, body = record.block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value), body
    return len(body), body


def read_records(stream: BinaryIO) -> Iterator[Record]:
    for member in members(stream):
        yield parse(member)


def arrow_uri(uri: str) -> str:
    """A path or a URI of Hadoop's as one of pyarrow's."""
    scheme, mark, rest = uri.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}{mark}{rest}" if mark else "file://" + os.path.abspath(uri.removeprefix("file:"))


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(arrow_uri(uri))


def _page(uri: str | None) -> int | None:
    number = (uri or "").rpartition(":")[2].rstrip(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, files, full = None, [], []
        rows = 0
        for batch in batches:
            for page, url, html, kind, refers in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "kind", "refers"))):
                if out is None:
                    files.append(f"{path}/{name}-{len(files):04d}.warc.gz")
                    out = fs.open_output_stream(files[-1])
                    rows = 0
                data = encoded([html])[0] or b""
                out.write(record_bytes(kind, RECORD_ID % page, b"" if kind == "revisit" else data, digest(data), len(data), url, RECORD_ID % refers if kind == "revisit" else None))
                rows += 1
                if out.tell() >= ARCHIVE:
                    out.close()
                    out = None
                    full.append(rows)
        if out is not None:
            out.close()
            full.append(rows)
        scheme = folder.partition("://")[0]
        yield pa.RecordBatch.from_arrays([pa.array([f"{scheme}://{f}" if scheme == "file" else f"{folder}/{f.rpartition('/')[2]}" for f in files], pa.string()), pa.array(full, pa.int64())], ["file", "records"])

    return write


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])


def _reader(with_text: bool):
    schema = _ROW if with_text else pa.schema(list(_ROW)[:-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, expected in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                fs, path = _open(file)
                rows, size, seen = [], 0, 0
                with fs.open_input_stream(path) as stream:
                    for record in read_records(stream):
                        length, body = payload(record)
                        h = record.headers
                        row = (_page(h["WARC-Record-ID"]), length, h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], _page(h.get("WARC-Refers-To")))
                        rows.append(row + (body.decode("utf-8", "replace"),) * with_text)
                        size += len(body) * with_text
                        seen += 1
                        if len(rows) >= 4096 or size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, size = [], 0
                if seen != expected:
                    raise WarcError(f"{file} has {seen} records of {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return read


def with_record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """[page, url, html, kind, refers]: which rows are responses; payloads below least_bytes all are."""
    rows = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.sha1(F.col("html").cast("binary"))
    long_enough = F.octet_length("html") >= least_bytes
    keyed = rows.select("*", key.alias("key"))
    # Only payloads that several rows hold are joined back; a payload that a third of the rows hold is summed up in
    # each task first, and the join's large side can be split.
    several = rows.where(long_enough).select("page", key.alias("key")).groupBy("key").agg(F.max("page").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = keyed.join(several, "key", "left")
    again = F.col("top").isNotNull() & ~F.col("page").eqNullSafe(F.col("top"))
    return joined.select("page", "url", "html", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("top")).alias("refers"))


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in a shared folder; the manifest [file, records], lazily."""
    prepare(pages.sparkSession)
    return with_record_types(pages, least_bytes).mapInArrow(_writer(folder), "file string, records long")


def read_warc(manifest: DataFrame, with_text: bool = False, archives: int | None = None) -> DataFrame:
    """The records of the archives that a written manifest lists; it is counted unless the number of `archives` is given."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * with_text
    parts = min(max(1, manifest.count() if archives is None else archives), READERS)
    # By ranges of names, which are few and sampled whole: hashes would put several into a partition and none into others.
    return manifest.repartitionByRange(parts, "file").mapInArrow(_reader(with_text), schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """[page_id, payload_bytes, payload_digest, record_type, refers_to], as read back from archives just written."""
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = scratch.save(write_warc(pages, f"{scratch.path}/archives", least_bytes), "manifest")
    return read_warc(manifest)
