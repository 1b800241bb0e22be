"""Record files of serialized examples, gzipped or plain, as frames.

Spark lists the files, so an empty glob is its own error. Where Arrow knows the store, the ``tfrecord`` data source
(``stream.py``) streams each file in its task. Any other store that Spark knows is read with ``binaryFile``: then a
file is one value of at most 2 GB.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .records import PIECE, decode, frames, inflated
from .stream import BATCH_BYTES, BATCH_ROWS, OFFSETS, RECORDS, RecordSource, batch_of, file_system

SPLIT = r"(training|validation)-[^/]*(?:/part-[^/]*)?$"  # a folder that Spark wrote stands for a file
#: Bytes of a plain file that a task reads, where an index tells where its records begin.
SPLIT_BYTES = 128 << 20


def listed(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files, by path; contents are not read."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    return sorted((r["path"], r["length"]) for r in files.collect())


def _streams(paths: list[str]) -> bool:
    try:
        file_system(paths[0])
    except (ValueError, OSError):
        return False
    return True


def _source(spark: SparkSession, schema: T.StructType, **options):
    spark.dataSource.register(RecordSource)
    return spark.read.format("tfrecord").schema(schema).options(**options)


def index_tfrecords(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, file_bytes, offset, record_bytes) of each record of plain files: only the frames' heads are read. Write
    it somewhere; ``read_tfrecords`` takes it as ``index``."""
    return _source(spark, OFFSETS, files=json.dumps([path for path, _ in listed(spark, pattern)])).load()


def _ranges(index: DataFrame, files: list[tuple[str, int]], split_bytes: int) -> list[tuple[str, int, int]]:
    """Ranges of about ``split_bytes`` that begin with a record. An index that does not fit the files is an error.
    The driver gets a row per range."""
    parts = index.groupBy("path", F.floor(F.col("offset") / split_bytes).alias("part")).agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("record_bytes")).alias("end"), F.max("file_bytes").alias("bytes")
    )
    by_path: dict[str, list] = {path: [] for path, _ in files}
    for row in parts.collect():
        if row["path"] in by_path:
            by_path[row["path"]].append((row["start"], row["end"]))
    out = []
    for path, size in files:
        at = 0
        for start, end in sorted(by_path[path]):
            if start != at:
                break
            out.append((path, start, end))
            at = end
        if at != size:
            raise ValueError(f"the index does not cover {path}: {at} of {size} bytes")
    return out


def read_tfrecords(
    spark: SparkSession,
    pattern: str,
    schema: T.StructType,
    size: int = 128,
    columns: list[str] | None = None,
    compression: str | None = "GZIP",
    check_data: bool = False,
    partitions: int | None = None,
    index: DataFrame | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """One row per record with the wanted columns and ``split``, from the file name's prefix (null if it has none).
    ``partitions``: records are dealt to so many before they are decoded, for gzipped files that are few and large.
    ``index``: plain files are read in ranges of ``split_bytes``, one to a task."""
    wanted = T.StructType([f for f in schema if columns is None or f.name in columns])
    if compression not in ("GZIP", None):
        raise ValueError(f"unknown compression {compression!r}")
    if index is not None and compression:
        raise ValueError("a gzipped file cannot be cut")
    out = T.StructType([*wanted.fields, T.StructField("path", T.StringType())])
    files = listed(spark, pattern)
    arrow = to_arrow_schema(out)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                pairs = zip(part.column("path").to_pylist(), part.column("record").to_pylist(), strict=True)
                yield batch_of([[*decode(record, wanted, size), path] for path, record in pairs], arrow)

    if files and not _streams([path for path, _ in files]):
        records = spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(_whole_files(compression, check_data), RECORDS)
        rows = (records if partitions is None else records.repartition(partitions)).mapInArrow(decoded, out)
    else:
        options = {"compression": compression or "NONE", "check_data": str(check_data).lower(), "size": str(size)}
        parts = {"files": json.dumps([path for path, _ in files])} if index is None else {"ranges": json.dumps(_ranges(index, files, split_bytes))}
        if partitions is None:
            rows = _source(spark, out, **options, **parts).load()
        else:
            rows = _source(spark, RECORDS, **options, **parts).load().repartition(partitions).mapInArrow(decoded, out)
    return rows.withColumn("split", F.expr(f"nullif(regexp_extract(path, r'{SPLIT}', 1), '')")).drop("path")


def _whole_files(compression: str | None, check_data: bool):
    """Records of ``binaryFile`` rows."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                pieces = (bytes(data[at : at + PIECE]) for at in range(0, len(data), PIECE))
                held: list[bytes] = []
                for record in frames(inflated(pieces) if compression else pieces, check_data):
                    held.append(record)
                    if len(held) == BATCH_ROWS or sum(map(len, held)) >= BATCH_BYTES:
                        yield batch_of([[path, r] for r in held], to_arrow_schema(RECORDS))
                        held = []
                if held:
                    yield batch_of([[path, r] for r in held], to_arrow_schema(RECORDS))

    return records
