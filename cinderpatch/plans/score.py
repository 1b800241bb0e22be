"""Apply a user's own image model to patches, and report."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bands import above, has_event
from ..operators.metrics import confusion, metrics, patch_evaluation


def score_patches(
    patches: DataFrame, make_predict: Callable, bands: list[str], size: int, batch_size: int = 8, into: str = "p", values: T.DataType | None = None
) -> DataFrame:
    """Adds the model's image. ``make_predict`` loads the model once per Python worker and returns a function
    of one array (batch, size, size) per band that gives (batch, size * size). Band names must differ."""
    if len(set(bands)) != len(bands):
        raise ValueError("bands must have distinct names")
    udf = predict_batch_udf(
        make_predict, return_type=T.ArrayType(values or T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[size, size]] * len(bands)
    )
    return patches.withColumn(into, udf(*bands))


def event_patches(patches: DataFrame, truth: str, score: str, examined: int | None = None, key: str = "id") -> DataFrame:
    """Patches with a true pixel or a score above one half; ``examined`` limits how many are looked at, by key."""
    looked_at = patches if examined is None else patches.orderBy(key).limit(examined)
    return looked_at.where(has_event(F.col(truth), F.col(score)))


def land_by_key(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table whose files hold a hash bucket of the key each, in its order. Tables that were landed with as many
    buckets are joined by this key where they lie, without a shuffle. The files are in ``path``; the
    session's catalogue only holds the name."""
    table = f"landed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)  # a file per bucket
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def keyed_report(labels: DataFrame, scores: DataFrame, keys: list[str], truth: str, score: str, threshold: float) -> DataFrame:
    """Metrics of labels and scores that come from different frames: joined by key, never by position."""
    both = labels.join(scores, keys, "inner")
    return metrics(confusion(both, F.col(truth), above(F.col(score), threshold)))


def persistence_report(rows: DataFrame, truth: str, last_year: str) -> DataFrame:
    """Last year's burned area as the prediction."""
    return metrics(confusion(rows, F.col(truth), above(F.col(last_year).cast("float"), 0.5)))


def evaluate(
    patches: DataFrame,
    truth: str = "label",
    score: str = "p",
    last_year: str | None = None,
    thresholds: tuple[float, ...] = (0.5, 0.9, 0.99),
    examined: int | None = None,
    key: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """The evaluation of scored patches: (metrics of the model at its thresholds and of last year's burned area at
    one half, patches worth a look). Only the metric rows are small; both stay in Spark."""
    cuts = [(score, t) for t in thresholds] + ([(last_year, 0.5)] if last_year else [])
    return patch_evaluation(patches, truth, cuts), event_patches(patches, truth, score, examined, key)
