"""Lands tables as record files, for the queries that read such files."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.records import masked_crc
from ..sources.stream import BATCH_ROWS


def _written_varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, body: bytes) -> bytes:
    return _written_varint(number << 3 | 2) + _written_varint(len(body)) + body


def encode(row: dict) -> bytes:
    """An example: strings and integers as they are, floats and lists of floats in single precision."""
    entries = []
    for name, value in row.items():
        if isinstance(value, str):
            feature = _field(1, _field(1, value.encode()))
        elif isinstance(value, int):
            feature = _field(3, _field(1, _written_varint(value)))
        else:
            feature = _field(2, _field(1, np.atleast_1d(np.asarray(value, dtype="<f4")).tobytes()))
        entries.append(_field(1, _field(1, name.encode()) + _field(2, feature)))
    return _field(1, b"".join(entries))


def framed(record: bytes) -> bytes:
    head = struct.pack("<Q", len(record))
    return head + struct.pack("<I", masked_crc(head)) + record + struct.pack("<I", masked_crc(record))


def write_tfrecords(rows: DataFrame, path: str) -> None:
    """Gzipped record files in the folder ``path``, whose name then stands for a file's: ``DIR/training-0.tfrecord.gz``.
    A null is an error, as no record may lack a feature."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                data = b"".join(framed(encode(r)) for r in batch.slice(at, BATCH_ROWS).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(data, mtime=0)], pa.binary())], names=["member"])

    checked = rows.where(F.assert_true(~F.array_contains(F.array(*[F.col(c).isNull() for c in rows.columns]), True), F.lit("a feature is null")).isNull())
    packed = checked.mapInArrow(members, "member binary")
    packed.select(F.col("member").cast("string")).write.mode("overwrite").option("lineSep", "\0").text(path)
