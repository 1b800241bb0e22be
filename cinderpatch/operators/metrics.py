"""Confusion counts and what follows from them, for pixel rows and for patch rows."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import above, count_above, let

COUNTS = ("tp", "fp", "fn", "tn")


def confusion(rows: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn over pixel rows; partial counts before the shuffle. Nulls count as false."""
    y, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    return rows.groupBy(*(by or [])).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")
    )


def _counts(truth: str, score: str, threshold: float) -> Column:
    """A patch's counts, as a struct."""
    hit = F.transform(score, lambda v: F.coalesce(above(v, threshold), F.lit(False)))
    pairs = F.zip_with(F.col(truth), hit, lambda y, p: F.coalesce(y.cast("int"), F.lit(0)) * 2 + F.coalesce(p.cast("int"), F.lit(0)))
    how_many = lambda cells, code: F.size(F.filter(cells, lambda v: v == code))
    return let(pairs, lambda c: F.struct(*[how_many(c, n).alias(k) for k, n in zip(COUNTS, (3, 1, 2, 0), strict=True)]))


def patch_confusion(patches: DataFrame, truth: str, score: str, threshold: float = 0.5) -> DataFrame:
    """The same counts from array columns: counted inside each row, so no pixel is ever shuffled."""
    counted = patches.select(_counts(truth, score, threshold).alias("n"))
    return counted.agg(*[F.coalesce(F.sum(f"n.{k}"), F.lit(0)).cast("bigint").alias(k) for k in COUNTS])


def _share(top: Column, bottom: Column) -> Column:
    """A ratio whose empty denominator gives 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def metrics(counts: DataFrame) -> DataFrame:
    """Adds f1, recall, precision and jaccard to confusion counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "f1": _share(2 * tp, 2 * tp + fp + fn),
            "recall": _share(tp, tp + fn),
            "precision": _share(tp, tp + fp),
            "jaccard": _share(tp, tp + fp + fn),
        }
    )


def threshold_report(rows: DataFrame, truth: Column, score: Column, thresholds: tuple[float, ...]) -> DataFrame:
    """Metrics at each of a few thresholds in one pass: one set of counters per threshold, no join and no copy of the rows."""
    y = F.coalesce(truth, F.lit(False))
    counters = []
    for i, t in enumerate(thresholds):
        p = F.coalesce(above(score, t), F.lit(False))
        for name, hit in zip(COUNTS, (y & p, ~y & p, y & ~p, ~y & ~p), strict=True):
            counters.append(F.count_if(hit).alias(f"{name}{i}"))
    wide = rows.agg(*counters)
    each = F.explode(
        F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in COUNTS]) for i, t in enumerate(thresholds)])
    )
    return metrics(wide.select(each.alias("x")).select("x.*"))


def score_histogram(rows: DataFrame, truth: Column, score: Column, thresholds: tuple[float, ...]) -> DataFrame:
    """(passed, positives, negatives): how many rows are above that many of the thresholds and no more, by label. Its
    rows can be summed with those of other tables. At most one row per threshold and task is shuffled."""
    cuts = sorted({np.float32(t) for t in thresholds})
    # strictly above a threshold in single precision: at or above the next number
    splits = [-np.inf, *[float(np.nextafter(t, np.float32(np.inf))) for t in cuts], np.inf]
    given = rows.select(F.coalesce(truth, F.lit(False)).alias("y"), F.coalesce(score.cast("float"), F.lit(float("nan"))).cast("double").alias("s"))
    cut = Bucketizer(splits=splits, inputCol="s", outputCol="passed", handleInvalid="keep").transform(given)
    passed = F.when(F.isnan("s"), 0).otherwise(F.col("passed").cast("int"))
    return cut.groupBy(passed.alias("passed")).agg(F.count_if("y").alias("positives"), F.count_if(~F.col("y")).alias("negatives"))


def threshold_curve(rows: DataFrame, truth: Column, score: Column, thresholds: tuple[float, ...]) -> DataFrame:
    """Metrics at any number of thresholds in one pass: all follow from one histogram of scores by label, of at most
    one row per threshold."""
    spark = rows.sparkSession
    cuts = sorted({np.float32(t) for t in thresholds})
    asked = spark.createDataFrame([(float(t), cuts.index(np.float32(t)) + 1) for t in dict.fromkeys(thresholds)], "threshold double, passed int")
    bins = score_histogram(rows, truth, score, thresholds)
    bins = bins.unionByName(asked.select("passed", F.lit(0).cast("bigint").alias("positives"), F.lit(0).cast("bigint").alias("negatives")))
    bins = bins.unionByName(spark.createDataFrame([(0, 0, 0)], "passed int, positives bigint, negatives bigint"))
    sums = bins.groupBy("passed").agg(F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"))
    upward = Window.partitionBy(F.lit(0)).orderBy(F.col("passed").desc())  # a row per threshold
    everything = Window.partitionBy(F.lit(0))
    counts = sums.select(
        "passed",
        F.sum("positives").over(upward).alias("tp"),
        F.sum("negatives").over(upward).alias("fp"),
        F.sum("positives").over(everything).alias("p"),
        F.sum("negatives").over(everything).alias("n"),
    )
    each = asked.join(counts, "passed").select("threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"))
    return metrics(each)


def patch_evaluation(patches: DataFrame, truth: str, cuts: list[tuple[str, float]]) -> DataFrame:
    """score, threshold and metrics for each of a few (score column, threshold) pairs, in one pass over the patches."""
    counted = patches.select(*[_counts(truth, score, t).alias(f"n{i}") for i, (score, t) in enumerate(cuts)])
    wide = counted.agg(
        *[F.coalesce(F.sum(f"n{i}.{k}"), F.lit(0)).cast("bigint").alias(f"{k}{i}") for i in range(len(cuts)) for k in COUNTS]
    )
    each = [
        F.struct(F.lit(score).alias("score"), F.lit(t).alias("threshold"), *[F.col(f"{k}{i}").alias(k) for k in COUNTS]) for i, (score, t) in enumerate(cuts)
    ]
    return metrics(wide.select(F.inline(F.array(*each))))


def positive_count(patches: DataFrame, score: str, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Pixels above the threshold over a whole split: counted in each row, then summed."""
    counted = patches.select(*(by or []), count_above(F.col(score), threshold).alias("n"))
    return counted.groupBy(*(by or [])).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_positive"))


def binary_iou(rows: DataFrame, truth: Column, score: Column, threshold: float = 0.5) -> DataFrame:
    """Jaccard of the positive class over all rows; a score at the threshold counts as positive."""
    hit = (score >= F.lit(threshold).cast("float")) & ~F.isnan(score)
    counts = confusion(rows, truth, hit)
    return counts.select(_share(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("iou"))


def soft_dice(rows: DataFrame, truth: Column, score: Column, epsilon: float = 1e-7) -> DataFrame:
    """Dice loss over all rows at once: 1 - 2 sum(y p) / (sum y + sum p + epsilon)."""
    y, p = truth.cast("double"), score.cast("double")
    sums = rows.agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(n) for n, v in (("yp", y * p), ("y", y), ("p", p))])
    return sums.select((1 - 2 * F.col("yp") / (F.col("y") + F.col("p") + epsilon)).alias("dice_loss"))
