"""Repeatable order, limits and splits."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places in the shuffled order: 15 hexadecimal digits.
PLACES = 1 << 60


def shuffled(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """Random order that depends on the seed and the key alone; a range-partitioned sort that spills."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.col(key))


def dealt(df: DataFrame, key: str = "id") -> DataFrame:
    """The rows in equal numbers to as many tasks as run at once, each task's by key. For what goes over them again and
    again, as a fit does: tasks of unlike size would let cores wait each time."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions(key)


def take_batches(df: DataFrame, n: int, batch_size: int, key: str = "id") -> DataFrame:
    """The first ``n`` batches by key: a top-k, not a full sort."""
    return df.orderBy(key).limit(n * batch_size)


def bounded_epoch(df: DataFrame, seed: int, steps: int, batch_size: int, key: str = "id") -> DataFrame:
    """``steps`` batches of the shuffled frame."""
    return shuffled(df, seed, key).limit(steps * batch_size)


def place(seed: int, key: str = "id") -> Column:
    """Where a key stands in the shuffled order of a seed, from 0 to ``PLACES``: the order of ``shuffled`` as a number."""
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(mixed, 1, 15), 16, 10).cast("bigint")


def land_by_place(df: DataFrame, path: str, seed: int, key: str = "id") -> DataFrame:
    """``df`` with ``place``, written in its order: a slice of places then reads the row groups that hold it."""
    df.withColumn("place", place(seed, key)).repartitionByRange("place").sortWithinPartitions("place").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def epoch_slice(at: int, share: Fraction) -> Column:
    """Which places belong to an epoch, from 0, where each takes this share of all rows: epochs go on where the last
    one ended, so none repeats a row until all have been taken, and then begin again. A filter on ``place``: nothing is
    sorted or counted, and an epoch has its number of rows up to the chance of hashes."""
    if share >= 1:
        return F.lit(True)
    begin, end = (int(share * n * PLACES) % PLACES for n in (at, at + 1))
    after, before = F.col("place") >= begin, F.col("place") < end
    return after & before if begin < end else after | before


def numbered(df: DataFrame, folder: str, key: str = "id", into: str = "ordinal") -> DataFrame:
    """``df`` with dense numbers from 1 by key. Rows are dealt by ranges of the key, sorted and written to ``folder``
    with their number inside their part; the driver adds up the parts' counts, a row for each part."""
    spark, low = df.sparkSession, (1 << 33) - 1
    dealt = df.repartitionByRange(key).sortWithinPartitions(key)
    dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(low).alias("_row")).write.mode("overwrite").parquet(folder)
    parts, before, starts = spark.read.parquet(folder), 0, []
    for part, n in sorted(tuple(r) for r in parts.groupBy("_part").count().collect()):
        starts.append((part, before))
        before += n
    begun = spark.createDataFrame(starts, "_part int, _start bigint")
    return parts.join(F.broadcast(begun), "_part").withColumn(into, F.col("_start") + F.col("_row") + 1).drop("_part", "_row", "_start")


def hashed_split(df: DataFrame, key: str = "id", every: int = 5) -> DataFrame:
    """Adds ``split``: every so many keys are for validation, the others for training."""
    return df.withColumn("split", F.when(F.pmod(F.col(key), F.lit(every)) == 0, "validation").otherwise("training"))
