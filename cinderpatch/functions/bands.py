"""Expressions on one patch's band arrays (row-major, ``size * size`` values)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once: without this, Spark evaluates it anew for each use in a lambda."""
    return F.transform(F.array(value), body)[0]


def checked(band: Column, size: int) -> Column:
    """The band, or an error if it has not exactly ``size * size`` values."""
    return F.when(F.assert_true(F.size(band) == size * size, F.lit("a band has a wrong number of values")).isNull(), band)


def above(value: Column, threshold: float) -> Column:
    """Strictly above, compared in single precision; NaN is not above anything."""
    return (value > F.lit(threshold).cast("float")) & ~F.isnan(value)


def burned(value: Column) -> Column:
    """A burn date above zero means burned; NaN does not."""
    return (value > 0) & ~F.isnan(value)


def mask(band: Column) -> Column:
    return F.transform(band, burned)


def rescale(value: Column, low: float = -0.3, high: float = 0.3) -> Column:
    """Linear to 0..1 in double precision, without clipping."""
    return (value.cast("double") - low) / (high - low)


def count_above(band: Column, threshold: float = 0.5) -> Column:
    return F.size(F.filter(band, lambda v: above(v, threshold))).cast("bigint")


def has_event(truth: Column, score: Column, threshold: float = 0.5) -> Column:
    """Any true pixel, or any score above the threshold."""
    return F.exists(truth, lambda m: m) | F.exists(score, lambda v: above(v, threshold))


def _blocks(band: Column, size: int, k: int, fold: Callable[[Column], Column]) -> Column:
    if size % k:
        raise ValueError(f"{size} is not divisible by {k}")
    side = size // k

    def one(b: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(side * side - 1)),
            lambda i: fold(
                F.array(
                    *[F.get(b, (F.floor(i / side) * k + y).cast("int") * size + (i % side) * k + x) for y in range(k) for x in range(k)]
                )
            ),
        )

    return let(band, one)


def average_pool(band: Column, size: int, k: int) -> Column:
    """Mean of each k x k block, in double precision."""
    return _blocks(band, size, k, lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / (k * k))


def max_pool(band: Column, size: int, k: int) -> Column:
    return _blocks(band, size, k, F.array_max)


def upsample(band: Column, size: int, k: int) -> Column:
    """Bilinear by a whole factor, centres at half pixels, edges repeated."""
    side = size * k

    def axis(at: Column) -> tuple[Column, Column, Column]:
        place = (at + 0.5) / k - 0.5
        low = F.floor(place)
        inside = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(size - 1)).cast("int")
        return inside(low), inside(low + 1), place - low

    def one(b: Column) -> Column:
        def cell(i: Column) -> Column:
            (y0, y1, dy), (x0, x1, dx) = axis(F.floor(i / side)), axis(i % side)
            value = lambda y, x: F.get(b, y * size + x).cast("double")
            upper = value(y0, x0) * (1 - dx) + value(y0, x1) * dx
            lower = value(y1, x0) * (1 - dx) + value(y1, x1) * dx
            return upper * (1 - dy) + lower * dy

        return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), cell)

    return let(band, one)


def layer_norm(features: Column, epsilon: float = 1e-3) -> Column:
    """Zero mean and unit variance over one pixel's features; no learned scale or shift."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)

    def centred(v: Column) -> Column:
        return let(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))

    def scaled(c: Column) -> Column:
        spread = F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x) / F.size(c) + epsilon)
        return let(spread, lambda s: F.transform(c, lambda x: x / s))

    return let(let(features, centred), scaled)


def multi_scale(band: Column, size: int, scales: tuple[int, ...] = (1, 2, 4)) -> Column:
    """The band at several scales, each brought back to full size: an array of arrays. Pooling and
    upsampling act on raw bands here, as a feature recipe for a classifier."""
    return F.array(
        *[F.transform(band, lambda v: v.cast("double")) if k == 1 else upsample(average_pool(band, size, k), size // k, k) for k in scales]
    )
