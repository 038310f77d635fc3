"""Saved web archives: files of gzip members, one record each, read by ranges.

`archived` reads the records that an index names, by offset and length. The data source "curavine_archive" reads whole
archives without an index, each file in ranges of bytes as Spark reads its own formats. Files are opened through
pyarrow's file systems: local and shared folders, and the object stores that pyarrow knows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Bytes of a file that one task reads, and bytes that are read at a time.
RANGE_BYTES, BLOCK_BYTES = 64_000_000, 1_000_000
_START = b"\x1f\x8b\x08"
_SCHEMA = "file string, offset bigint, length bigint, kind string, url string, date string, status int, mime string, body string"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    # Hadoop writes file:/x for what others call file:///x
    return fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path)) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def headers(block: bytes) -> dict[str, str]:
    """Names, in lower case, and values of header lines; the first line, which is none, has the name ""."""
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    return {"": first} | {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if _}


def parsed(raw: bytes) -> dict:
    """A record's kind, url, date, status, mime and body, which follows the second empty line; without one it is null."""
    own, _, rest = raw.partition(b"\r\n\r\n")
    answer, empty, body = rest.partition(b"\r\n\r\n")
    about, http = headers(own), headers(answer)
    status = re.match(r"HTTP/\S+ (\d{3})", http[""])
    return {
        "kind": about.get("warc-type"), "url": about.get("warc-target-uri"), "date": about.get("warc-date"), "status": int(status[1]) if status else None,
        "mime": http.get("content-type", "").partition(";")[0].strip() or None, "body": body.decode("utf-8", "replace") if empty else None,
    }


def _whole(raw: bytes, length: int) -> bytes | None:
    """The bytes of one member, or the record itself if it isn't compressed; null if it is cut off or broken."""
    if len(raw) < length or not raw:
        return None
    if raw[:2] != _START[:2]:
        return raw
    unpacked = zlib.decompressobj(31)
    try:
        out = unpacked.decompress(raw)
    except zlib.error:
        return None
    return out if unpacked.eof else None


def archived(index: DataFrame, folder: str, file: str = "filename", offset: str = "offset", length: str = "length", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The index's rows with the body of each one's record, read by offset and length from a file in the folder.

    Rows are dealt out by file and range of bytes and sorted, so that a task opens a file once and reads it forwards,
    and a large file is read by several tasks. Files that can't be opened, records that are cut off or can't be
    unpacked, and null or non-positive numbers give a null body; repeated rows are read again. Only a task's own
    records are held, one at a time. A column named body is replaced.
    """
    own = index.withColumns({"__file": F.col(file).cast("string"), "__offset": F.col(offset).try_cast("long"), "__length": F.col(length).try_cast("long")})
    dealt = own.repartition("__file", F.floor(F.coalesce("__offset", F.lit(0)) / range_bytes)).sortWithinPartitions("__file", "__offset")
    kept = [c for c in index.columns if c != "body"]

    def run(batches):
        source, name = None, None
        for batch in batches:
            bodies = []
            for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("__file", "__offset", "__length"))):
                raw = None
                if path and at is not None and at >= 0 and size is not None and size > 0:
                    if path != name:
                        if source is not None:
                            source.close()
                        source, name = _opened(f"{folder.rstrip('/')}/{path}"), path
                    if source is not None and at < source.size():
                        source.seek(at)
                        raw = _whole(source.read(size), size)
                bodies.append(parsed(raw)["body"] if raw is not None else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bodies, pa.string())], names=[*kept, "body"])
        if source is not None:
            source.close()

    return dealt.mapInArrow(run, StructType([*(index.schema[c] for c in kept), StructField("body", StringType())]))


def _opened(path: str) -> pa.NativeFile | None:
    system, own = file_system(path)
    try:
        return system.open_input_file(own)
    except OSError:
        return None


def members(source: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, int | None, bytes | None]]:
    """(offset, length, bytes) of the records that begin in a range of a file of gzip members.

    A record begins where a member unpacks to the first letters of one. What can't be unpacked is told with nulls, and
    the search goes on behind its first byte. The last record may reach beyond the range.
    """
    size = source.size()
    at = start
    while at < end:
        source.seek(at)
        block = source.read(min(BLOCK_BYTES, size - at))
        hit = block.find(_START)
        if hit < 0:
            at += max(1, len(block) - len(_START) + 1)
            continue
        at += hit
        if at >= end:
            return
        unpacked, out, read = zlib.decompressobj(31), [], 0
        source.seek(at)
        try:
            while not unpacked.eof and (block := source.read(BLOCK_BYTES)):
                out.append(unpacked.decompress(block))
                read += len(block)
                if not b"WARC/".startswith(out[0][:5]):
                    break
            whole = unpacked.eof
        except zlib.error:
            whole = False
        if not whole or not out[0].startswith(b"WARC/"):
            if out and out[0].startswith(b"WARC/"):
                yield at, None, None  # a record's start, but cut off or broken
            at += 1
            continue
        length = read - len(unpacked.unused_data)
        yield at, length, b"".join(out)
        at += length


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    """Plans a range of each file for each task; filters on file and offset leave out those without a row for them."""

    def __init__(self, options: dict):
        self.folder, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.files: set[str] | None = None
        self.least, self.most = 0, None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else None
            if column == ("file",) and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = named if self.files is None else self.files & named
            elif column == ("offset",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.least = max(self.least, f.value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.most = f.value if self.most is None else min(self.most, f.value)
            yield f  # Spark looks at the rows again

    def partitions(self) -> list[Range]:
        system, own = file_system(self.folder)
        found = []
        for info in system.get_file_info(fs.FileSelector(own, recursive=True)):
            name = info.path.removeprefix(own.rstrip("/") + "/")
            if info.is_file and not re.search(r"(^|/)[._]", name) and (self.files is None or name in self.files):
                starts = range(0, info.size, self.range_bytes)
                found += [Range(name, a, min(a + self.range_bytes, info.size)) for a in starts if a + self.range_bytes > self.least and (self.most is None or a <= self.most)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.end:
            return
        source = _opened(f"{self.folder.rstrip('/')}/{partition.file}")
        if source is None:
            raise OSError(f"can't open {partition.file}")  # it was listed
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *((c, pa.int32() if c == "status" else pa.string()) for c in ("kind", "url", "date", "status", "mime", "body"))])
        with source:
            for at, length, raw in members(source, partition.start, partition.end):
                row = {"file": partition.file, "offset": at, "length": length} | (parsed(raw) if raw is not None else {})
                yield pa.RecordBatch.from_pylist([row], schema=schema)


class ArchiveSource(DataSource):
    """spark.read.format("curavine_archive").load(folder): file, offset, length, kind, url, date, status, mime and body of each record.

    Each file, below the folder, is cut into ranges of the option rangeBytes; a record belongs to the range that it
    begins in. Records that can't be unpacked have a null length and body.
    """

    @classmethod
    def name(cls) -> str:
        return "curavine_archive"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the data source known to a session, and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def write_archive(pages: DataFrame, folder: str, url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages as records into archive files, one for each task, and returns their index, which is computed as it is read.

    (all columns of pages but html, filename, offset, length). A task that runs again writes another file, and only the
    file of the run that counts is in the index; so write the index before it is used twice.
    """
    kept = [c for c in pages.columns if c != html]

    def run(batches):
        system, own = file_system(folder)
        system.create_dir(own, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        at = 0
        with system.open_output_stream(f"{own.rstrip('/')}/{name}", compression=None) as out:
            for batch in batches:
                offsets, lengths = [], []
                for address, page in zip(batch.column(url).to_pylist(), batch.column(html).to_pylist()):
                    body = (page or "").encode("utf-8", "surrogatepass")
                    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                    about = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {address or ''}\r\nContent-Length: {len(answer)}\r\n\r\n".encode()
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(about + answer) + packer.flush()
                    out.write(member)
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([name] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=[*kept, "filename", "offset", "length"])

    added = [StructField("filename", StringType()), StructField("offset", LongType()), StructField("length", LongType())]
    return pages.mapInArrow(run, StructType([*(pages.schema[c] for c in kept), *added]))
