"""Record files as a Spark data source that streams them.

``spark.read.format("tfrecord")`` opens each file where it is read, through Arrow's file systems (local, S3, GCS, HDFS),
inflates it in pieces and walks its frames as they come: a task holds a few records, however large the file. With the
schema ``path string, record binary`` the records themselves are the rows; any other schema names the features to
decode, so what is not wanted is never decoded. Batches hold a few rows, as one row can be megabytes.

A gzipped file is one partition. A plain file can be cut: with the schema ``path string, file_bytes bigint, offset
bigint, record_bytes bigint`` the source lists where its records begin, reading nothing but their frames' heads, and
``ranges`` made of such a list become partitions of their own.

Options: ``path`` (a path, folder or glob), or ``files`` / ``ranges`` (JSON lists made by ``tfrecord.py``);
``compression`` (``GZIP`` or ``NONE``), ``size`` (side of a patch), ``check_data`` (test payload checksums too).
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .records import PIECE, decode, frames, inflated, masked_crc

#: Rows, and bytes of records, in an Arrow batch that leaves the reader.
BATCH_ROWS = 16
BATCH_BYTES = 1 << 23

RECORDS = T.StructType([T.StructField("path", T.StringType()), T.StructField("record", T.BinaryType())])
OFFSETS = T.StructType(
    [T.StructField("path", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("file_bytes", "offset", "record_bytes")]]
)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark prints it, and the path there. An unknown scheme is a ``ValueError``."""
    if path.startswith("/") or path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, _, rest = path.partition("://")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    if scheme not in ("s3", "gs", "hdfs"):
        raise ValueError(f"no streaming from {path!r}")
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")


def _visible(path: str) -> bool:
    return not posixpath.basename(path).startswith(("_", "."))


def found_files(pattern: str) -> list[str]:
    """Files of a path, folder or glob, in order; a folder stands for the files in it. None is an error."""
    system, path = file_system(pattern)
    fixed = path
    while any(c in fixed for c in "*?["):
        fixed = posixpath.dirname(fixed)
    top = system.get_file_info(fixed)
    out = []
    if top.type == fs.FileType.File:
        out = [fixed]
    elif top.type == fs.FileType.Directory:
        depth = len(path.rstrip("/").split("/"))
        for info in system.get_file_info(fs.FileSelector(fixed, recursive=True)):
            parts = info.path.split("/")
            inside = len(parts) - depth in (0, 1) and fnmatch.fnmatchcase("/".join(parts[:depth]), path.rstrip("/"))
            if inside and info.type == fs.FileType.File and all(map(_visible, parts[depth - 1 :])):
                out.append(info.path)
    if not out:
        raise FileNotFoundError(f"no record files at {pattern!r}")
    prefix = "file:" if isinstance(system, fs.LocalFileSystem) else pattern.partition("://")[0] + "://"
    return [prefix + p for p in sorted(out)]


@dataclass
class FileRange(InputPartition):
    """A whole file (``end`` is None), or the bytes of some of its records."""

    path: str
    start: int = 0
    end: int | None = None


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> T.StructType:
        return RECORDS

    def reader(self, schema: T.StructType) -> RecordReader:
        return RecordReader(schema, dict(self.options))


class RecordReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.wanted, self.options = schema, options
        self.compressed = options.get("compression", "GZIP").upper() == "GZIP"
        self.check_data = options.get("check_data", "false").lower() == "true"

    def partitions(self) -> list[FileRange]:
        if ranges := self.options.get("ranges"):
            return [FileRange(*r) for r in json.loads(ranges)]
        files = json.loads(self.options["files"]) if "files" in self.options else found_files(self.options["path"])
        return [FileRange(path) for path in files]

    def pieces(self, part: FileRange) -> Iterator[bytes]:
        system, path = file_system(part.path)
        if part.end is None:
            with system.open_input_stream(path, compression=None) as stream:
                while piece := stream.read(PIECE):
                    yield piece
        else:
            with system.open_input_file(path) as file:
                file.seek(part.start)
                for at in range(part.start, part.end, PIECE):
                    yield file.read(min(PIECE, part.end - at))

    def offsets(self, part: FileRange) -> Iterator[tuple[int, int, int]]:
        system, path = file_system(part.path)
        with system.open_input_file(path) as file:
            total, at = file.size(), 0
            while at < total:
                file.seek(at)
                head = file.read(12)
                if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
                    raise ValueError(f"corrupt or truncated record length in {part.path} at {at}")
                size = struct.unpack("<Q", head[:8])[0] + 16
                if at + size > total:
                    raise ValueError(f"truncated record in {part.path} at {at}")
                yield total, at, size
                at += size

    def rows(self, part: FileRange) -> Iterator[tuple[list, int]]:
        """(row, its bytes)."""
        if self.wanted == OFFSETS:
            yield from (([part.path, *row], 0) for row in self.offsets(part))
            return
        data = self.pieces(part)
        for record in frames(inflated(data) if self.compressed else data, self.check_data):
            if self.wanted == RECORDS:
                yield [part.path, record], len(record)
            else:
                own = T.StructType([f for f in self.wanted if f.name != "path"])
                values = dict(zip(own.fieldNames(), decode(record, own, int(self.options["size"])), strict=True)) | {"path": part.path}
                yield [values[n] for n in self.wanted.fieldNames()], len(record)

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        arrow, held, weight = to_arrow_schema(self.wanted), [], 0
        many = 10_000 if self.wanted == OFFSETS else BATCH_ROWS
        for row, size in self.rows(partition):
            held.append(row)
            weight += size
            if len(held) == many or weight >= BATCH_BYTES:
                yield batch_of(held, arrow)
                held, weight = [], 0
        if held:
            yield batch_of(held, arrow)


def batch_of(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
