"""From files to frames of inputs and labels."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bands import checked, mask
from ..operators.ordering import shuffled
from ..sources.schema import SCALARS, patch_struct, read_schema
from ..sources.tfrecord import read_tfrecords


def input_bands(names: list[str], outputs: list[str], scalars: tuple[str, ...] = SCALARS) -> list[str]:
    """All bands but the outputs, in schema order."""
    return [n for n in names if n not in scalars and n not in outputs and n != "split"]


def split_bands(
    patches: DataFrame, inputs: list[str], outputs: list[str], size: int, key: str = "id", also: tuple[str, ...] = ()
) -> DataFrame:
    """key, the columns of ``also``, inputs (a struct of bands) and label: one output becomes a mask, several stay
    as they are (a struct)."""
    label = mask(checked(F.col(outputs[0]), size)) if len(outputs) == 1 else F.struct(*outputs)
    keep = [c for c in (*also, "split") if c in patches.columns]
    return patches.select(key, *keep, F.struct(*[checked(F.col(b), size).alias(b) for b in inputs]).alias("inputs"), label.alias("label"))


def cached(df: DataFrame, cache: bool | str = False) -> DataFrame:
    """False: as it is. True: memory and disk. A path: written there as Parquet by split, then read back."""
    if cache is True:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if isinstance(cache, str):
        writer = df.write.mode("overwrite")
        (writer.partitionBy("split") if "split" in df.columns else writer).parquet(cache)
        return df.sparkSession.read.parquet(cache)
    return df


def fingerprint(spark: SparkSession, pattern: str, **options) -> str:
    """Of all that a cached frame depends on: the files' paths, lengths and times, and the options."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length", F.unix_micros("modificationTime").alias("t"))
    listed = sorted(tuple(r) for r in files.collect())
    return hashlib.sha256(json.dumps([listed, options], sort_keys=True, default=str).encode()).hexdigest()


def reused(spark: SparkSession, path: str, mark: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``path`` holds under this fingerprint, else ``make``'s, written there by split. Rows go to a folder of
    their own, and a manifest written after them makes them count: whoever stops halfway, or writes at the same time,
    leaves no half-written cache behind. Copies under other fingerprints stay until someone deletes them."""
    root = path.rstrip("/")
    manifest, held = f"{root}/manifest-{mark}", None
    try:
        held = spark.read.schema("data string").json(manifest).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    if held is None:
        data, df = f"data-{uuid.uuid4().hex}", make()
        (df.write.partitionBy("split") if "split" in df.columns else df.write).parquet(f"{root}/{data}")
        spark.createDataFrame([(data,)], "data string").coalesce(1).write.mode("overwrite").json(manifest)
        held = (data,)
    return spark.read.parquet(f"{root}/{held[0]}")


def load_patches(
    spark: SparkSession,
    directory: str,
    pattern: str = "*.tfrecord",
    outputs: tuple[str, ...] = ("BurnDate",),
    size: int = 128,
    compression: str | None = "GZIP",
    cache: bool | str = False,
    shuffle_seed: int | None = None,
    split: str | None = None,
    non_img_features: tuple[str, ...] = SCALARS,
    key: str = "id",
    keep: tuple[str, ...] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Schema sidecar, record files, inputs and label; cached before the optional shuffle. ``split`` picks
    the files whose name starts with it, so the others are never fetched. A cache path is used again as long as files and
    options are what they were. Float features are images but for
    ``non_img_features``; ``keep`` names scalars, such as the position, that stay beside the key."""
    schema = patch_struct(read_schema(spark, directory), non_img_features)
    images = [f.name for f in schema if isinstance(f.dataType, T.ArrayType)]  # other scalars are no input bands
    bands = input_bands(images, list(outputs), non_img_features)
    glob = f"{directory.rstrip('/')}/{split + '-' if split else ''}{pattern}"

    def read() -> DataFrame:
        patches = read_tfrecords(spark, glob, schema, size, [key, *keep, *bands, *outputs], compression, partitions=partitions)
        return split_bands(patches, bands, list(outputs), size, key, keep)

    if isinstance(cache, str):
        mark = fingerprint(spark, glob, schema=schema.jsonValue(), outputs=outputs, size=size, compression=compression, key=key, keep=keep)
        frame = reused(spark, cache, mark, read)
    else:
        frame = cached(read(), cache)
    return frame if shuffle_seed is None else shuffled(frame, shuffle_seed, key)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one only where all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"


def build_datasets(spark: SparkSession, directory: str, **options) -> tuple[DataFrame, DataFrame]:
    """(training shuffled, validation in file order)."""
    seed = options.pop("seed", 0)
    return (
        load_patches(spark, directory, split="training", shuffle_seed=seed, **options),
        load_patches(spark, directory, split="validation", **options),
    )
