"""Training and evaluation job: ``spark-submit cinderpatch/plans/job.py --model_type mlp --data_dir DIR --epochs 5``."""

from __future__ import annotations

import argparse
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderpatch.operators.forward import Net, image_scores
from cinderpatch.operators.metrics import threshold_report
from cinderpatch.operators.ordering import place, take_batches
from cinderpatch.plans.dataset import build_datasets
from cinderpatch.plans.score import evaluate
from cinderpatch.plans.train import MODELS, Fitted, fit_with_validation, multi_scale_pixels, pixel_features, predict
from cinderpatch.sources.schema import SCALARS


def options(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser()
    p.add_argument("--model_type", required=True, type=str.lower, choices=sorted(MODELS))
    p.add_argument("--data_dir", required=True)
    p.add_argument("--pattern", default="*.tfrecord.gz")
    p.add_argument("--compression", default="GZIP", choices=["GZIP", "NONE"])
    p.add_argument("--patch_size", type=int, default=128)
    p.add_argument("--output_band", default="BurnDate")
    p.add_argument("--last_year_band", help="burned area of the year before, for the baseline in the evaluation")
    p.add_argument("--non_img_features", nargs="*", default=list(SCALARS))
    p.add_argument("--partitions", type=int, help="deal the records of few large files to so many tasks before decoding")
    p.add_argument("--epochs", type=int, required=True)
    p.add_argument("--iterations", type=int, default=10, help="optimizer steps in an epoch")
    p.add_argument("--patience", type=int, default=5)
    p.add_argument("--batch_size", type=int, default=4, help="patches in a step")
    p.add_argument("--steps_per_epoch", type=int, help="an epoch learns from so many batches, the next ones in shuffled order; default: from all")
    p.add_argument("--rounds_path", help="folder for each epoch's model and history; a job started again goes on from there")
    p.add_argument("--cache_path", help="folder for decoded patches, used again as long as the files are the same")
    p.add_argument("--model_output_path")
    return p.parse_args(args)


def pixels(frame: DataFrame, model_type: str, size: int) -> DataFrame:
    """(id, pos, features, label) from patches with ``inputs`` and ``label``; a patch's ``place`` stays."""
    if "place" in frame.columns:
        kept = pixels(frame.withColumn("id", F.struct("place", "id")).drop("place"), model_type, size)
        return kept.select("id.id", "pos", "features", "label", "id.place")
    bands = frame.schema["inputs"].dataType.fieldNames()
    flat = frame.select("id", "inputs.*", F.transform("label", lambda v: v.cast("double")).alias("label"))
    if model_type == "multi_scale_mlp_head":
        return multi_scale_pixels(flat, bands, size, "label")
    opened = flat.select("id", F.posexplode(F.arrays_zip(*bands, "label")).alias("pos", "px")).select("id", "pos", "px.*")
    return opened.select("id", "pos", pixel_features(bands).alias("features"), "label")


def datasets(spark: SparkSession, o: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return build_datasets(
        spark,
        o.data_dir,
        pattern=o.pattern,
        outputs=(o.output_band,),
        size=o.patch_size,
        compression=None if o.compression == "NONE" else o.compression,
        non_img_features=tuple(o.non_img_features),
        partitions=o.partitions,
        cache=o.cache_path or False,
    )


def run(spark: SparkSession, o: argparse.Namespace) -> Fitted:
    train, validation = datasets(spark, o)
    share = None
    if o.steps_per_epoch:
        train = train.withColumn("place", place(0))
        share = Fraction(o.steps_per_epoch * o.batch_size, max(1, train.count()))
    # Spark evens out the pixels of few large files, in partitions of a size, not of a number.
    deal = lambda df: pixels(df, o.model_type, o.patch_size).hint("rebalance")
    fitted = fit_with_validation(deal(train), deal(validation), o.model_type, o.epochs, o.iterations, o.patience, folder=o.rounds_path, share=share)
    if o.model_output_path:
        fitted.model.write().overwrite().save(o.model_output_path)
    return fitted


def report(model, validation_pixels: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row of metrics per threshold."""
    return threshold_report(predict(model, validation_pixels), F.col("label") > 0, F.col("p").cast("float"), thresholds)


def scored_patches(model, frame: DataFrame, model_type: str, size: int) -> DataFrame:
    """Patches with the model's image ``p``, made in their own row: nothing is opened, shuffled or joined. ``model``
    is a fitted model or its ``Net``."""
    bands = [F.col("inputs")[b] for b in frame.schema["inputs"].dataType.fieldNames()]
    several = model_type.lower() == "multi_scale_mlp_head"
    return frame.withColumn("p", image_scores(bands, Net.of(model), size, (1, 2, 4) if several else (1,), several, T.FloatType()))


def evaluation(
    model,
    frame: DataFrame,
    model_type: str,
    size: int,
    last_year_band: str | None = None,
    thresholds: tuple[float, ...] = (0.5, 0.9, 0.99),
    examined: int | None = None,
    key: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """(metrics of the model and of last year's burned area, patches worth a look) on the validation split."""
    patches = scored_patches(model, frame, model_type, size)
    if last_year_band:
        patches = patches.withColumn("last_year", F.col("inputs")[last_year_band])
    return evaluate(patches, last_year="last_year" if last_year_band else None, thresholds=thresholds, examined=examined, key=key)


def peek(frame: DataFrame, n: int = 1) -> DataFrame:
    """Of the first patches by key: which inputs they have, and how many label values."""
    names = frame.schema["inputs"].dataType.fieldNames()
    return take_batches(frame, 1, n).select("id", F.lit(", ".join(names)).alias("inputs"), F.size("label").alias("label_values"))


if __name__ == "__main__":
    session, given = SparkSession.builder.appName("train").getOrCreate(), options()
    result = run(session, given)
    for row in result.history:
        print(*row)
    metric_rows, _ = evaluation(result.model, datasets(session, given)[1], given.model_type, given.patch_size, given.last_year_band)
    for row in metric_rows.collect():  # one per threshold
        print(*row)
