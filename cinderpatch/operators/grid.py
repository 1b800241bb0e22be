"""Patches to pixels and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import checked


def to_pixels(patches: DataFrame, bands: list[str], size: int, key: str = "id") -> DataFrame:
    """(key, pos, r, c, bands...): one row per pixel. Only the named bands are zipped, so the scan reads no others."""
    zipped = F.arrays_zip(*[checked(F.col(b), size).alias(b) for b in bands])
    rows = patches.select(key, F.posexplode(zipped).alias("pos", "px"))
    return rows.select(
        key,
        "pos",
        F.floor(F.col("pos") / size).cast("int").alias("r"),
        (F.col("pos") % size).alias("c"),
        *[F.col("px").getField(b).alias(b) for b in bands],
    )


def to_patches(pixels: DataFrame, values: list[str], size: int, key: str = "id", complete_only: bool = True) -> DataFrame:
    """One array per value column and key, in order of ``pos``. A key's group has at most ``size * size``
    pixels. Patches that lack pixels are dropped, or kept short if ``complete_only`` is off."""
    grouped = pixels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *values))).alias("px"))
    if complete_only:
        grouped = grouped.where(F.size("px") == size * size)
    return grouped.select(key, *[F.col("px").getField(v).alias(v) for v in values])


def pool_pixels(pixels: DataFrame, values: list[str], k: int, how: str = "avg", key: str = "id") -> DataFrame:
    """Blocks of k x k pixels by group: for pixels that no longer stand together in a patch row."""
    fold = {"avg": F.avg, "max": F.max}[how]
    return pixels.groupBy(
        key, F.floor(F.col("r") / k).cast("int").alias("r"), F.floor(F.col("c") / k).cast("int").alias("c")
    ).agg(*[fold(v).alias(v) for v in values])
