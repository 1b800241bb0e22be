"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python operator holds at once while it walks an Arrow batch.
SLICE_ROWS = 256

#: A task's caches (word -> ids, word -> scores) are emptied beyond this many entries of about 250 bytes, 40 MB.
#: They belong to the task and go with it; keys of more than ``LONG`` characters are not remembered.
CACHE_ENTRIES = 150_000
LONG = 64

#: ASCII white space that separates words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; make one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-ckpt-")
        sc.setCheckpointDir(folder)


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """What earlier tasks of this Python worker have freed goes back to the system; else it stays the worker's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression: Spark evaluates it one time for all uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def running(items: Column, size: Callable[[Column], Column], make: Callable[[Column, Column], Column], kind: str, block: int = 256) -> Column:
    """array<kind> of ``make(start, item)``, where start is the summed ``size`` of the items before. Items are walked
    in blocks, as a lambda copies its array for each item added: in time linear in their number."""

    def walked(x: Column) -> Column:
        part = lambda b: F.slice(x, b * block + 1, F.lit(block))
        blocks = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int"))
        none = lambda t: F.array().cast(f"array<{t}>")
        sums = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda acc, i: acc + size(i)))
        starts = F.aggregate(
            sums,
            F.struct(F.lit(0).alias("at"), none("int").alias("out")),
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )["out"]
        inside = lambda b, start: F.aggregate(
            part(b),
            F.struct(start.alias("at"), none(kind).alias("out")),
            lambda acc, i: F.struct((acc["at"] + size(i)).alias("at"), F.concat(acc["out"], F.array(make(acc["at"], i))).alias("out")),
        )["out"]
        return F.when(F.size(x) > 0, F.flatten(F.transform(starts, lambda start, b: inside(b, start)))).otherwise(none(kind))

    return let(items, walked)


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[dict], Iterable[tuple] | None]], schema: str, fields: list[pa.Field]
) -> DataFrame:
    """``mapInArrow`` over row dictionaries in bounded slices.

    ``make`` is called once per task and returns the row function, which yields output tuples.
    """
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = [x for row in batch.slice(at, SLICE_ROWS).to_pylist() for x in row_function(row)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)],
                        schema=arrow,
                    )

    return df.mapInArrow(run, schema)


def count_rows(df: DataFrame, items: Callable[[dict], Iterable[tuple[tuple, int]]], schema: str, fields: list[pa.Field]) -> DataFrame:
    """Partial counts: ``items`` gives (key, n) pairs of a row, and the last output column is the sum of n
    by key. Keys are summed in bounded tables before they leave the task; sum again after a shuffle."""
    arrow = pa.schema(fields)

    def out(counts: Counter) -> pa.RecordBatch:
        columns = [*zip(*counts, strict=True), list(counts.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for row in batch.slice(at, SLICE_ROWS).to_pylist():
                    for key, n in items(row):
                        counts[key] += n
                if len(counts) >= CACHE_ENTRIES:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    return df.mapInArrow(run, schema)
