"""Pixel classifiers on Spark ML, fitted in rounds with validation, best round kept, early stop."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import layer_norm, let, multi_scale
from ..operators.metrics import soft_dice
from ..operators.ordering import epoch_slice


def pixel_features(bands: list[str]) -> Column:
    """One pixel's bands as a feature vector, in the given order."""
    return array_to_vector(F.array(*[F.col(b).cast("double") for b in bands]))


def multi_scale_pixels(patches: DataFrame, bands: list[str], size: int, label: str | None = None, key: str = "id") -> DataFrame:
    """(key, pos, features, label): each pixel's bands at scales 1, 2 and 4, normalised. Made in the patch
    row, then opened once; no shuffle."""
    scales = F.flatten(F.array(*[multi_scale(F.col(b), size) for b in bands]))  # an array of 3 * bands images
    truth = F.lit(None).cast("array<double>") if label is None else F.col(label)

    # Each pixel's values are gathered before the rows open, so no row carries an image. The images are bound to the
    # row: as a column of their own, Spark would put their expression into the lambda and make them for each pixel.
    def gather(row: Column) -> Column:
        values = lambda pos: layer_norm(F.transform(row["images"], lambda image: F.get(image, pos)))
        return F.transform(
            F.sequence(F.lit(0), F.lit(size * size - 1)), lambda pos: F.struct(values(pos).alias("values"), F.get(row["truth"], pos).alias("truth"))
        )

    gathered = patches.select(key, let(F.struct(scales.alias("images"), truth.alias("truth")), gather).alias("pixels"))
    # For a plain column Spark would add a filter on its size and make all of it twice.
    opened = gathered.select(key, F.posexplode(F.slice("pixels", 1, size * size)).alias("pos", "px"))
    return opened.select(key, "pos", array_to_vector("px.values").alias("features"), *([F.col("px.truth").alias("label")] if label else []))


#: Layers between the features and the two classes, by model name.
MODELS: dict[str, Callable[[int], list[int]]] = {
    "mlp": lambda n: [n, 128, 64, 2],
    "multi_scale_mlp_head": lambda n: [n, 128, 2],
}


def build_model(name: str, n_features: int, iterations: int = 20, seed: int = 0) -> MultilayerPerceptronClassifier:
    if name.lower() not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(MODELS))}")
    return MultilayerPerceptronClassifier(
        layers=MODELS[name.lower()](n_features), maxIter=iterations, seed=seed, featuresCol="features", labelCol="label"
    )


def predict(model, rows: DataFrame) -> DataFrame:
    """Adds ``p``, the probability of burned."""
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


Round = tuple[int, float, float, bool]


@dataclass
class Fitted:
    model: MultilayerPerceptronClassificationModel
    history: list[Round]  # round, train loss, validation loss, best so far

    def history_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.history, "round int, train_loss double, val_loss double, is_best boolean")


_ROUND = "round int, train_loss double, val_loss double, is_best boolean, settings string"


class SavedRounds:
    """Rounds of a fit in a shared folder: each round's model, then the line of its history that makes it count. What
    a stopped job was writing is written anew."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), json.dumps(settings, sort_keys=True)

    def history(self) -> list[Round]:
        """The rounds that are done; other settings are an error."""
        try:
            rows = self.spark.read.schema(_ROUND).json(f"{self.folder}/round-*").orderBy("round").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        if other := {r["settings"] for r in rows} - {self.settings}:
            raise ValueError(f"{self.folder} holds rounds of other settings: {', '.join(sorted(other))}, not {self.settings}")
        done = [tuple(r)[:4] for r in rows]
        return [r for n, r in enumerate(done, 1) if r[0] == n]

    def model(self, at: int) -> MultilayerPerceptronClassificationModel:
        return MultilayerPerceptronClassificationModel.load(f"{self.folder}/model-{at}")

    def add(self, done: Round, model: MultilayerPerceptronClassificationModel) -> None:
        model.write().overwrite().save(f"{self.folder}/model-{done[0]}")
        line = self.spark.createDataFrame([(*done, self.settings)], _ROUND).coalesce(1)
        line.write.mode("overwrite").json(f"{self.folder}/round-{done[0]}")


def fit_with_validation(
    train: DataFrame,
    validation: DataFrame,
    name: str = "mlp",
    rounds: int = 5,
    iterations: int = 10,
    patience: int = 5,
    seed: int = 0,
    folder: str | None = None,
    share: Fraction | None = None,
) -> Fitted:
    """Rounds of ``iterations`` steps, each going on from the weights of the last. Frames have ``features``
    and ``label`` (0 or 1). The driver holds the weights and one loss per round; the rows stay where they are.

    ``folder``: each round's model and history are saved there as it ends, and a fit that finds rounds there goes on
    after them, as if it had never stopped. ``share``: a round learns from this share of the rows only, the next slice of
    their ``place`` in a shuffled order."""
    train, validation = (df.persist(StorageLevel.MEMORY_AND_DISK) for df in (train, validation))
    try:
        first = train.select(vector_to_array("features").alias("f")).first()
        if first is None:
            raise ValueError("there is no row to learn from")
        n, history, model, best = len(first["f"]), [], None, None
        settings = {"name": name.lower(), "features": n, "iterations": iterations, "seed": seed, "share": str(share)}
        saved = SavedRounds(train.sparkSession, folder, settings) if folder else None
        if saved and (history := saved.history()[:rounds]):
            model = saved.model(len(history))
            if bests := [r[0] for r in history if r[3]]:
                best = saved.model(bests[-1])
        best_loss, waited = float("inf"), 0
        for _, _, loss, is_best in history:
            best_loss, waited = (loss, 0) if is_best else (best_loss, waited + 1)
        for at in range(len(history) + 1, rounds + 1):
            if waited >= patience:
                break
            trainer = build_model(name, n, iterations, seed)
            if model is not None:
                trainer = trainer.setInitialWeights(model.weights)
            model = trainer.fit(train if share is None else train.where(epoch_slice(at - 1, share)))
            losses = [soft_dice(predict(model, df), F.col("label"), F.col("p")).first()[0] for df in (train, validation)]
            is_best = losses[1] < best_loss
            history.append((at, *losses, is_best))
            if saved:
                saved.add(history[-1], model)
            best, best_loss, waited = (model, losses[1], 0) if is_best else (best, best_loss, waited + 1)
        return Fitted(best, history)
    finally:
        train.unpersist()
        validation.unpersist()
