"""Queries over the ``embeddings`` and ``labels`` tables and their SQL twins.

A row of ``embeddings`` has 64 values. It is read as a pixel of 64 bands (A00 to A63, its label the burn
date), as a patch of 8 x 8 pixels of one band, or, 64 rows together, as a patch of 64 bands.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bands as B
from ..operators import grid, history, metrics, ordering
from ..operators.forward import Net
from . import job, score, train
from ..sources.schema import patch_struct, read_schema, write_schema
from ..sources.tfrecord import read_tfrecords
from .dataset import build_datasets, cached, input_bands, load_patches, shared_folder
from .landing import write_tfrecords

BANDS = [f"A{i:02d}" for i in range(64)]
SIZE = 8


def _table(spark: SparkSession, sf_dir: str, name: str = "embeddings") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pixels(spark: SparkSession, sf_dir: str, bands: list[str]) -> DataFrame:
    return _table(spark, sf_dir).select("vec_id", *[F.get("embedding", F.lit(BANDS.index(b))).alias(b) for b in bands], F.col("label").alias("BurnDate"))


def _score() -> Column:
    """A score in about 0..1 from band A01, in single precision."""
    return B.rescale(F.col("A01")).cast("float")


def _truth() -> Column:
    return F.col("BurnDate") > 4


def band_projection(spark, sf_dir):
    return _pixels(spark, sf_dir, ["A01", "A16", "A09"]).drop("BurnDate")


def band_exclusion(spark, sf_dir):
    """All bands but the outputs, in their order."""
    rows = _pixels(spark, sf_dir, BANDS)
    return rows.select("vec_id", *input_bands(rows.columns, ["BurnDate", "A00"], ("vec_id",)))


def burn_label(spark, sf_dir):
    return _pixels(spark, sf_dir, []).select("vec_id", B.burned(F.col("BurnDate").cast("float")).alias("burned"))


def multi_output(spark, sf_dir):
    return _pixels(spark, sf_dir, ["A01"])


def pixel_explode(spark, sf_dir):
    return grid.to_pixels(_table(spark, sf_dir).withColumnRenamed("embedding", "v"), ["v"], SIZE, "vec_id")


def patch_reshape(spark, sf_dir):
    rows = _table(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 64).alias("patch"), (F.col("vec_id") % 64).cast("int").alias("pos"), F.get("embedding", F.lit(1)).alias("A01")
    )
    back = grid.to_patches(rows, ["A01"], SIZE, "patch")
    return back.select("patch", F.posexplode("A01").alias("pos", "A01"))


def _cells(spark, sf_dir, image):
    return _table(spark, sf_dir).select("vec_id", F.posexplode(image).alias("cell", "v"))


def block_avg_pool(spark, sf_dir):
    return _cells(spark, sf_dir, B.average_pool(F.col("embedding"), SIZE, 2)).withColumn("v", F.round("v", 6))


def block_max_pool(spark, sf_dir):
    return _cells(spark, sf_dir, B.max_pool(F.col("embedding"), SIZE, 2))


def pixel_pool(spark, sf_dir):
    pooled = grid.pool_pixels(pixel_explode(spark, sf_dir), ["v"], 4, "avg", "vec_id")
    return pooled.withColumn("v", F.round("v", 6))


def bilinear_upsample(spark, sf_dir):
    pooled = B.average_pool(F.col("embedding"), SIZE, 2)
    return _cells(spark, sf_dir, B.upsample(pooled, 4, 2)).withColumn("v", F.round("v", 6))


def multi_scale_features(spark, sf_dir):
    images = _table(spark, sf_dir).select("vec_id", B.multi_scale(F.col("embedding"), SIZE).alias("m"))
    pixels = images.select("vec_id", F.posexplode(F.arrays_zip(*[F.get("m", F.lit(i)).alias(f"s{i}") for i in range(3)])).alias("cell", "px"))
    normed = pixels.select("vec_id", "cell", B.layer_norm(F.array(*[F.col("px").getField(f"s{i}") for i in range(3)])).alias("f"))
    return normed.select("vec_id", "cell", *[F.round(F.get("f", F.lit(i)), 6).alias(f"f{i}") for i in range(3)])


def rgb_rescale(spark, sf_dir):
    rows = _pixels(spark, sf_dir, ["A01", "A16", "A09"])
    return rows.select("vec_id", *[F.round(B.rescale(F.col(b)), 6).alias(c) for b, c in zip(["A01", "A16", "A09"], ["red", "green", "blue"], strict=True)])


def confusion(spark, sf_dir):
    return metrics.confusion(_pixels(spark, sf_dir, ["A01"]), _truth(), B.above(_score(), 0.5))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def metrics_report(spark, sf_dir):
    return _rounded(metrics.metrics(confusion(spark, sf_dir)))


def patch_metrics(spark, sf_dir):
    truth = F.transform("embedding", lambda v: B.above(v, 0.0))
    patches = _table(spark, sf_dir).select(truth.alias("y"), F.transform("embedding", lambda v: B.rescale(v).cast("float")).alias("p"))
    return _rounded(metrics.metrics(metrics.patch_confusion(patches, "y", "p", 0.6)))


def threshold_sweep(spark, sf_dir):
    return _rounded(metrics.threshold_report(_pixels(spark, sf_dir, ["A01"]), _truth(), _score(), (0.5, 0.9, 0.99)))


THRESHOLDS = tuple(i / 1001 for i in range(1, 1001))


def threshold_curve(spark, sf_dir):
    """A thousand thresholds from one histogram."""
    return _rounded(metrics.threshold_curve(_pixels(spark, sf_dir, ["A01"]), _truth(), _score(), THRESHOLDS))


def persistence_baseline(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").select((F.col("quality") > 0).alias("y"), "toxic")
    return _rounded(score.persistence_report(rows, "y", "toxic"))


def binary_iou(spark, sf_dir):
    return _rounded(metrics.binary_iou(_pixels(spark, sf_dir, ["A01"]), _truth(), _score()))


def soft_dice(spark, sf_dir):
    return _rounded(metrics.soft_dice(_pixels(spark, sf_dir, ["A01"]), _truth(), _score()))


def positive_pixels(spark, sf_dir):
    return _table(spark, sf_dir).select("vec_id", B.count_above(F.col("embedding"), 0.1).alias("n_positive"))


def event_patches(spark, sf_dir):
    patches = _table(spark, sf_dir).select(
        "vec_id", F.transform("embedding", lambda v: B.above(v, 0.4)).alias("y"), F.transform("embedding", lambda v: (v + F.lit(0.1).cast("float"))).alias("p")
    )
    return score.event_patches(patches, "y", "p", key="vec_id").select("vec_id")


def inspected_patches(spark, sf_dir):
    patches = _table(spark, sf_dir).select(
        "vec_id", F.transform("embedding", lambda v: B.above(v, 0.3)).alias("y"), F.transform("embedding", lambda v: v).alias("p")
    )
    return score.event_patches(patches, "y", "p", examined=101, key="vec_id").select("vec_id")


def split_filter(spark, sf_dir):
    return ordering.hashed_split(_pixels(spark, sf_dir, ["A00"]), "vec_id").where("split = 'validation'")


def take_n(spark, sf_dir):
    return ordering.take_batches(_pixels(spark, sf_dir, ["A00"]), 5, 8, "vec_id")


def seeded_shuffle(spark, sf_dir):
    return ordering.shuffled(_pixels(spark, sf_dir, ["A00"]), 7, "vec_id")


def bounded_epoch(spark, sf_dir):
    return ordering.bounded_epoch(_pixels(spark, sf_dir, ["A00"]), 7, 10, 8, "vec_id")


def epoch_slices(spark, sf_dir):
    """Three epochs of 10 batches of 8, each a slice of the shuffled order, filtered from a table landed in it."""
    rows = _pixels(spark, sf_dir, ["A00"])
    share = Fraction(10 * 8, max(1, rows.count()))
    landed = ordering.land_by_place(rows, shared_folder(spark, "places"), 7, "vec_id")
    slices = [landed.where(ordering.epoch_slice(at, share)).select(F.lit(at).alias("epoch"), "vec_id", "A00", "BurnDate") for at in range(3)]
    return slices[0].unionByName(slices[1]).unionByName(slices[2])


def patch_ordinals(spark, sf_dir):
    """Dense numbers by key."""
    return ordering.numbered(_table(spark, sf_dir).select("vec_id", "label"), shared_folder(spark, "ordinals"), "vec_id")


def keyed_eval(spark, sf_dir):
    rows = _pixels(spark, sf_dir, ["A01"])
    labels = rows.select("vec_id", _truth().alias("y"))
    scores = rows.select("vec_id", _score().alias("p"))
    return _rounded(score.keyed_report(labels, scores, ["vec_id"], "y", "p", 0.5))


def bucketed_eval(spark, sf_dir):
    """The same from two tables landed by key, which are joined where they lie."""
    rows = _pixels(spark, sf_dir, ["A01"])
    landed = [score.land_by_key(df, shared_folder(spark, name), "vec_id", 8) for name, df in (("labels", rows.select("vec_id", _truth().alias("y"))), ("scores", rows.select("vec_id", _score().alias("p"))))]
    return _rounded(score.keyed_report(*landed, ["vec_id"], "y", "p", 0.5))


def _make_logistic():
    import numpy as np

    def predict(image):
        return 1.0 / (1.0 + np.exp(-image.reshape(len(image), -1).astype("float64")))

    return predict


def batch_score(spark, sf_dir):
    patches = _table(spark, sf_dir).select("vec_id", "embedding")
    scored = score.score_patches(patches, _make_logistic, ["embedding"], SIZE, batch_size=64, values=T.DoubleType())
    return scored.select("vec_id", F.posexplode("p").alias("pos", "p")).withColumn("p", F.round("p", 6))


def _fitted(spark, sf_dir):
    rows = ordering.hashed_split(_pixels(spark, sf_dir, BANDS), "vec_id")
    data = rows.select("vec_id", "split", train.pixel_features(BANDS).alias("features"), _truth().cast("double").alias("label"))
    frames = [ordering.dealt(data.where(F.col("split") == s), "vec_id") for s in ("training", "validation")]
    fitted = train.fit_with_validation(*frames, "mlp", rounds=3, iterations=8)
    return data, fitted


def mlp_fit_predict(spark, sf_dir):
    data, fitted = _fitted(spark, sf_dir)
    return train.predict(fitted.model, data.where("split = 'validation'")).select("vec_id", "label", F.round("p", 6).alias("p"))


def train_history(spark, sf_dir):
    _, fitted = _fitted(spark, sf_dir)
    return fitted.history_frame(spark)


def best_rounds(spark, sf_dir):
    """Ten fits' histories: which rounds run with a patience of five, and which of them is best."""
    losses = _table(spark, sf_dir).select(F.col("label").alias("fit"), F.col("vec_id").alias("round"), F.get("embedding", F.lit(0)).cast("double").alias("val_loss"))
    return history.best_rounds(losses, ["fit"], 5)


def round_choices(spark, sf_dir):
    """The same histories by round."""
    losses = _table(spark, sf_dir).select(F.col("label").alias("fit"), F.col("vec_id").alias("round"), F.get("embedding", F.lit(1)).cast("double").alias("val_loss"))
    return history.stopped_early(losses, ["fit"], 12).withColumn("waited", F.col("waited").cast("bigint"))


def pixel_vectors(spark, sf_dir):
    """Bands side by side as a feature vector, in their order, and back."""
    picked = ["A16", "A01", "A63", "A09"]
    vectors = _pixels(spark, sf_dir, picked).select("vec_id", train.pixel_features(picked).alias("features"))
    return vectors.select("vec_id", F.posexplode(vector_to_array("features")).alias("pos", "value"))


def peeked_patches(spark, sf_dir):
    """What the first patches of the validation files hold, by the record reader."""
    frame = load_patches(spark, _records(spark, sf_dir), "*.tfrecord.gz", size=SIZE, non_img_features=POINTS, split="validation")
    return job.peek(frame, 20)


def train_resume(spark, sf_dir):
    """A fit that was stopped after its first round and started again, beside one that ran through: by round, whether
    losses and choice are the same."""
    data, whole = _fitted(spark, sf_dir)
    frames = [ordering.dealt(data.where(F.col("split") == s), "vec_id") for s in ("training", "validation")]
    folder = shared_folder(spark, "rounds")
    for rounds in (1, 3):
        again = train.fit_with_validation(*frames, "mlp", rounds=rounds, iterations=8, folder=folder)
    both = whole.history_frame(spark).join(again.history_frame(spark).withColumnsRenamed({c: f"{c}_again" for c in ("train_loss", "val_loss", "is_best")}), "round")
    return both.select("round", *[(F.col(c) == F.col(f"{c}_again")).alias(f"same_{c}") for c in ("train_loss", "val_loss", "is_best")])


def multi_scale_fit(spark, sf_dir):
    patches = ordering.hashed_split(
        _table(spark, sf_dir).select("vec_id", "embedding", F.transform("embedding", lambda v: B.above(v, 0.0).cast("double")).alias("y")), "vec_id"
    )
    frames = [train.multi_scale_pixels(ordering.dealt(patches.where(F.col("split") == s), "vec_id"), ["embedding"], SIZE, "y", "vec_id") for s in ("training", "validation")]
    fitted = train.fit_with_validation(*frames, "multi_scale_mlp_head", rounds=2, iterations=5)
    return _rounded(metrics.threshold_report(train.predict(fitted.model, frames[1]), F.col("label") > 0, F.col("p").cast("float"), (0.5, 0.9)))


def split_positives(spark, sf_dir):
    rows = ordering.hashed_split(_table(spark, sf_dir), "vec_id")
    return metrics.positive_count(rows, "embedding", 0.1, ["split"])


def evaluation_report(spark, sf_dir):
    """Model scores at three thresholds and last year's burned area, in one pass over the patches."""
    patches = _table(spark, sf_dir).select(
        "vec_id",
        F.transform("embedding", lambda v: B.above(v, 0.2)).alias("label"),
        F.transform("embedding", lambda v: (B.rescale(v) + 0.2).cast("float")).alias("p"),
        F.transform("embedding", lambda v: v + F.lit(0.3).cast("float")).alias("last_year"),
    )
    return _rounded(score.evaluate(patches, last_year="last_year", key="vec_id")[0])


#: A small net by a rule: what is checked is the pass through it, for which any weights will do.
NET_LAYERS = [2, 4, 3, 2]
NET_WEIGHTS = [round(((i * 7 + 3) % 11 - 5) * 0.9, 1) for i in range(sum((n + 1) * m for n, m in zip(NET_LAYERS, NET_LAYERS[1:], strict=False)))]


def _image_frame(spark, sf_dir):
    """Patches of two bands, the second of which is last year's, and their mask."""
    last_year = F.transform(F.reverse("embedding"), lambda v: v + F.lit(0.3).cast("float"))
    return _table(spark, sf_dir).select("vec_id", F.struct(F.col("embedding").alias("A00"), last_year.alias("B23")).alias("inputs"), F.transform("embedding", lambda v: B.above(v, 0.1)).alias("label"))


def job_evaluation(spark, sf_dir):
    """The job's evaluation: a net scores whole patches in their row; last year's band beside it."""
    net = Net(NET_LAYERS, np.array(NET_WEIGHTS))
    return _rounded(job.evaluation(net, _image_frame(spark, sf_dir), "mlp", SIZE, "B23", (0.3, 0.5, 0.7), key="vec_id")[0])


def model_roundtrip(spark, sf_dir):
    """A fitted model, saved in the shared folder and loaded again, predicts the same."""
    data, fitted = _fitted(spark, sf_dir)
    path = shared_folder(spark, "model")
    fitted.model.write().overwrite().save(path)
    rows = data.where("split = 'validation'")
    again = train.predict(MultilayerPerceptronClassificationModel.load(path), rows).select("vec_id", F.col("p").alias("q"))
    both = train.predict(fitted.model, rows).join(again, "vec_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("q")).alias("same"))


FEATURES = [("id", "INT"), ("name", "BYTES"), ("lat", "FLOAT"), ("lon", "FLOAT"), ("elevation", "FLOAT"), ("A00", "FLOAT"), ("A01", "FLOAT"), ("burned_area_2023", "FLOAT"), ("BurnDate", "FLOAT")]
POINTS = ("lat", "lon", "id", "elevation")


def _records(spark, sf_dir) -> str:
    """Lands the table as record files of 8 x 8 patches, by split, with their schema; the folder is shared."""
    folder = shared_folder(spark, "records")
    number = lambda i: F.get("embedding", F.lit(i))
    times = lambda k: F.transform("embedding", lambda v: v * F.lit(k).cast("float"))
    rows = ordering.hashed_split(_table(spark, sf_dir), "vec_id").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("patch "), "vec_id").alias("name"),
        number(0).alias("lat"),
        number(1).alias("lon"),
        number(2).alias("elevation"),
        F.col("embedding").alias("A00"),
        times(2).alias("A01"),
        times(-1).alias("burned_area_2023"),
        times(100).alias("BurnDate"),
        "split",
    )
    for split in ("training", "validation"):
        write_tfrecords(rows.where(F.col("split") == split).drop("split"), f"{folder}/{split}-0.tfrecord.gz")
    write_schema(spark, folder, FEATURES)
    return folder


def record_scalars(spark, sf_dir):
    """Every kind of feature through the record reader, and the split of the file's prefix."""
    folder = _records(spark, sf_dir)
    rows = read_tfrecords(spark, f"{folder}/*.tfrecord.gz", patch_struct(read_schema(spark, folder), POINTS), SIZE)
    return rows.select("id", "name", "lat", "lon", "elevation", F.size("A00").alias("pixels"), "split")


def record_inputs(spark, sf_dir):
    """Inputs and mask of all splits, as pixels."""
    frame = load_patches(spark, _records(spark, sf_dir), "*.tfrecord.gz", size=SIZE, non_img_features=POINTS, keep=("lat",), partitions=8)
    cells = F.arrays_zip(*[F.col("inputs")[b].alias(b) for b in ("A00", "A01", "burned_area_2023")], F.col("label").alias("burned"))
    return frame.select("id", "lat", "split", F.posexplode(cells).alias("pos", "px")).select("id", "lat", "split", "pos", "px.*")


def record_outputs(spark, sf_dir):
    """Several outputs stay as they are."""
    frame = load_patches(spark, _records(spark, sf_dir), "*.tfrecord.gz", ("BurnDate", "burned_area_2023"), SIZE, non_img_features=POINTS, split="training")
    return frame.select("id", F.array_join(F.lit(frame.schema["inputs"].dataType.fieldNames()), " ").alias("inputs"), F.posexplode(F.arrays_zip("label.BurnDate", "label.burned_area_2023")).alias("pos", "px")).select("id", "inputs", "pos", "px.*")


def record_datasets(spark, sf_dir):
    """The two datasets of a job: one shuffled, one in file order, each with its patches and burned pixels."""
    both = build_datasets(spark, _records(spark, sf_dir), pattern="*.tfrecord.gz", size=SIZE, non_img_features=POINTS)
    burned = F.sum(F.size(F.filter("label", lambda v: v)))
    return both[0].unionByName(both[1]).groupBy("split").agg(F.count("*").alias("patches"), burned.alias("burned_pixels"))


def cache_reuse(spark, sf_dir):
    """Patches landed under a cache path, read again from it, and once more as other bands: which copy is read, and
    what of it is true of the table."""
    folder, cache = _records(spark, sf_dir), shared_folder(spark, "cache")
    load = lambda outputs: load_patches(spark, folder, "*.tfrecord.gz", outputs, SIZE, cache=cache, non_img_features=POINTS)
    told, known = [], []
    for outputs in (("BurnDate",), ("BurnDate",), ("BurnDate", "A01")):
        frame = load(outputs)
        copy = re.search("data-[0-9a-f]+", frame.inputFiles()[0])[0]
        known += [copy] * (copy not in known)
        told.append(frame.groupBy("split").agg(F.lit(known.index(copy)).alias("copy"), F.count("*").alias("patches")).withColumn("load", F.lit(len(told))))
    return told[0].unionByName(told[1]).unionByName(told[2])


def cache_roundtrip(spark, sf_dir):
    """Lands the pixels by split in the shared folder and reads them back."""
    landed = cached(ordering.hashed_split(_pixels(spark, sf_dir, ["A00", "A01"]), "vec_id"), shared_folder(spark, "pixels"))
    return landed.select("vec_id", "A00", "A01", "BurnDate", "split")


def _stopped_sql(value: int, patience: int) -> str:
    return f"""
      WITH h AS (SELECT label AS fit, vec_id AS round, CAST(embedding[{value}] AS DOUBLE) AS val_loss FROM embeddings),
      b AS (SELECT *, row_number() OVER w AS n, coalesce(val_loss < min(val_loss) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best
            FROM h WINDOW w AS (PARTITION BY fit ORDER BY round)),
      d AS (SELECT *, n - max(CASE WHEN is_best THEN n END) OVER (PARTITION BY fit ORDER BY round) AS waited FROM b)
      SELECT fit, round, val_loss, is_best, waited FROM d
      QUALIFY NOT coalesce(bool_or(waited >= {patience}) OVER (PARTITION BY fit ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)"""


_PX = "embeddings"
_P = "CAST((CAST(embedding[2] AS DOUBLE) + 0.3) / 0.6 AS FLOAT)"
_CELL = "SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding) AS v FROM embeddings"
_POOL = f"SELECT vec_id, (pos // 8) // 2 AS r, (pos % 8) // 2 AS c, avg(CAST(v AS DOUBLE)) AS v FROM ({_CELL}) GROUP BY ALL"


def _confusion_sql(truth: str, hit: str, source: str) -> str:
    def n(a: str, b: str) -> str:
        return f"CAST(count(*) FILTER ({a} AND {b}) AS BIGINT)"

    return (
        f"SELECT {n('y', 'h')} AS tp, {n('NOT y', 'h')} AS fp, {n('y', 'NOT h')} AS fn, {n('NOT y', 'NOT h')} AS tn "
        f"FROM (SELECT {truth} AS y, {hit} AS h FROM {source})"
    )


def _metrics_sql(counts: str, more: str = "") -> str:
    share = lambda a, b, name: f"round(coalesce({a} / nullif(CAST({b} AS DOUBLE), 0), 0), 6) AS {name}"
    return (
        f"SELECT {more}tp, fp, fn, tn, {share('2 * tp', '2 * tp + fp + fn', 'f1')}, {share('tp', 'tp + fn', 'recall')}, "
        f"{share('tp', 'tp + fp', 'precision')}, {share('tp', 'tp + fp + fn', 'jaccard')} FROM ({counts})"
    )


def _upsample_sql(pooled: str, side: int, k: int) -> str:
    n, last = side * k, side - 1
    return f"""
    SELECT o.vec_id, o.y * {n} + o.x AS cell,
      (a.v * (1 - dx) + b.v * dx) * (1 - dy) + (e.v * (1 - dx) + d.v * dx) * dy AS v
    FROM (SELECT vec_id, y, x, (y + 0.5) / {k} - 0.5 - floor((y + 0.5) / {k} - 0.5) AS dy, (x + 0.5) / {k} - 0.5 - floor((x + 0.5) / {k} - 0.5) AS dx,
            greatest(floor((y + 0.5) / {k} - 0.5), 0) AS y0, least(floor((y + 0.5) / {k} - 0.5) + 1, {last}) AS y1,
            greatest(floor((x + 0.5) / {k} - 0.5), 0) AS x0, least(floor((x + 0.5) / {k} - 0.5) + 1, {last}) AS x1
          FROM (SELECT DISTINCT vec_id FROM embeddings), range({n}) AS r(y), range({n}) AS s(x)) o
    JOIN ({pooled}) a ON a.vec_id = o.vec_id AND a.r = y0 AND a.c = x0
    JOIN ({pooled}) b ON b.vec_id = o.vec_id AND b.r = y0 AND b.c = x1
    JOIN ({pooled}) e ON e.vec_id = o.vec_id AND e.r = y1 AND e.c = x0
    JOIN ({pooled}) d ON d.vec_id = o.vec_id AND d.r = y1 AND d.c = x1"""


_POOL4 = f"SELECT vec_id, (pos // 8) // 4 AS r, (pos % 8) // 4 AS c, avg(CAST(v AS DOUBLE)) AS v FROM ({_CELL}) GROUP BY ALL"
_SPLIT = "CASE WHEN vec_id % 5 = 0 THEN 'validation' ELSE 'training' END"
_TRUTH, _HIT = "label > 4", f"{_P} > CAST(0.5 AS FLOAT)"
_CONFUSION = _confusion_sql(_TRUTH, _HIT, _PX)



def _net_sql(source: str) -> str:
    """``source`` has columns x0 and x1 and gets p, the net's probability."""
    at, width = 0, len(NET_LAYERS) - 1
    for layer, (n, m) in enumerate(zip(NET_LAYERS, NET_LAYERS[1:], strict=False)):
        name = "x" if layer == 0 else f"h{layer}_"
        sums = [" + ".join([*(f"({NET_WEIGHTS[at + o + j * m]}) * {name}{j}" for j in range(n)), f"({NET_WEIGHTS[at + n * m + o]})"]) for o in range(m)]
        outs = [f"1 / (1 + exp(-({x}))) AS h{layer + 1}_{o}" if layer < width - 1 else f"{x} AS z{o}" for o, x in enumerate(sums)]
        source, at = f"SELECT *, {', '.join(outs)} FROM ({source})", at + (n + 1) * m
    return f"SELECT *, 1 / (1 + exp(z0 - z1)) AS p FROM ({source})"


_IMAGES = """SELECT v > CAST(0.1 AS FLOAT) AS y, CAST(v AS DOUBLE) AS x0, CAST(u + CAST(0.3 AS FLOAT) AS DOUBLE) AS x1, u + CAST(0.3 AS FLOAT) AS last_year
  FROM (SELECT unnest(embedding) AS v, unnest(list_reverse(embedding)) AS u FROM embeddings)"""

ORACLE: dict[str, str] = {
    "band_projection": "SELECT vec_id, embedding[2] AS A01, embedding[17] AS A16, embedding[10] AS A09 FROM embeddings",
    "band_exclusion": f"SELECT vec_id, {', '.join(f'embedding[{i + 1}] AS A{i:02d}' for i in range(1, 64))} FROM embeddings",
    "burn_label": "SELECT vec_id, label > 0 AS burned FROM embeddings",
    "multi_output": "SELECT vec_id, embedding[2] AS A01, label AS BurnDate FROM embeddings",
    "pixel_explode": f"SELECT vec_id, CAST(pos AS INT) AS pos, CAST(pos // 8 AS INT) AS r, CAST(pos % 8 AS INT) AS c, v FROM ({_CELL})",
    "patch_reshape": """SELECT vec_id // 64 AS patch, CAST(vec_id % 64 AS INT) AS pos, embedding[2] AS A01 FROM embeddings
      WHERE vec_id // 64 IN (SELECT vec_id // 64 FROM embeddings GROUP BY 1 HAVING count(*) = 64)""",
    "block_avg_pool": f"SELECT vec_id, CAST(r * 4 + c AS INT) AS cell, round(v, 6) AS v FROM ({_POOL})",
    "block_max_pool": f"""SELECT vec_id, CAST(((pos // 8) // 2) * 4 + (pos % 8) // 2 AS INT) AS cell, max(v) AS v FROM ({_CELL}) GROUP BY ALL""",
    "pixel_pool": f"SELECT vec_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(v, 6) AS v FROM ({_POOL4})",
    "bilinear_upsample": f"SELECT vec_id, CAST(cell AS INT) AS cell, round(v, 6) AS v FROM ({_upsample_sql(_POOL, 4, 2)})",
    "multi_scale_features": f"""
      WITH p AS (SELECT x.vec_id, x.pos AS cell, CAST(x.v AS DOUBLE) AS a, y.v AS b, z.v AS c FROM ({_CELL}) x
                 JOIN ({_upsample_sql(_POOL, 4, 2)}) y ON x.vec_id = y.vec_id AND x.pos = y.cell
                 JOIN ({_upsample_sql(_POOL4, 2, 4)}) z ON x.vec_id = z.vec_id AND x.pos = z.cell),
      m AS (SELECT *, (a + b + c) / 3 AS mean FROM p),
      s AS (SELECT *, sqrt(((a - mean) ** 2 + (b - mean) ** 2 + (c - mean) ** 2) / 3 + 0.001) AS sd FROM m)
      SELECT vec_id, CAST(cell AS INT) AS cell, round((a - mean) / sd, 6) AS f0, round((b - mean) / sd, 6) AS f1, round((c - mean) / sd, 6) AS f2 FROM s""",
    "rgb_rescale": """SELECT vec_id, round((CAST(embedding[2] AS DOUBLE) + 0.3) / 0.6, 6) AS red,
      round((CAST(embedding[17] AS DOUBLE) + 0.3) / 0.6, 6) AS green, round((CAST(embedding[10] AS DOUBLE) + 0.3) / 0.6, 6) AS blue FROM embeddings""",
    "confusion": _CONFUSION,
    "metrics_report": _metrics_sql(_CONFUSION),
    "patch_metrics": _metrics_sql(_confusion_sql("v > 0 AND NOT isnan(v)", "CAST((CAST(v AS DOUBLE) + 0.3) / 0.6 AS FLOAT) > CAST(0.6 AS FLOAT)", f"({_CELL})")),
    "threshold_sweep": " UNION ALL ".join(
        _metrics_sql(_confusion_sql(_TRUTH, f"{_P} > CAST({t} AS FLOAT)", _PX), f"CAST({t} AS DOUBLE) AS threshold, ") for t in (0.5, 0.9, 0.99)
    ),
    "persistence_baseline": _metrics_sql(_confusion_sql("quality > 0", "toxic > 0.5", "labels")),
    "binary_iou": f"""SELECT round(coalesce(tp / nullif(CAST(tp + fp + fn AS DOUBLE), 0), 0), 6) AS iou
      FROM ({_confusion_sql(_TRUTH, f"{_P} >= CAST(0.5 AS FLOAT)", _PX)})""",
    "soft_dice": f"""SELECT round(1 - 2 * sum(y * p) / (sum(y) + sum(p) + 1e-7), 6) AS dice_loss
      FROM (SELECT CAST({_TRUTH} AS DOUBLE) AS y, CAST({_P} AS DOUBLE) AS p FROM embeddings)""",
    "positive_pixels": "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > CAST(0.1 AS FLOAT))) AS BIGINT) AS n_positive FROM embeddings",
    "event_patches": """SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > CAST(0.4 AS FLOAT))) > 0
      OR len(list_filter(embedding, lambda x: x + CAST(0.1 AS FLOAT) > CAST(0.5 AS FLOAT))) > 0""",
    "inspected_patches": """SELECT vec_id FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 101)
      WHERE len(list_filter(embedding, lambda x: x > CAST(0.3 AS FLOAT))) > 0 OR len(list_filter(embedding, lambda x: x > CAST(0.5 AS FLOAT))) > 0""",
    "split_filter": "SELECT vec_id, embedding[1] AS A00, label AS BurnDate, 'validation' AS split FROM embeddings WHERE vec_id % 5 = 0",
    "take_n": "SELECT vec_id, embedding[1] AS A00, label AS BurnDate FROM embeddings ORDER BY vec_id LIMIT 40",
    "bounded_epoch": """SELECT vec_id, embedding[1] AS A00, label AS BurnDate FROM embeddings
      ORDER BY md5(concat('7:', vec_id)), vec_id LIMIT 80""",
    "epoch_slices": " UNION ALL ".join(
        f"""SELECT {at} AS epoch, vec_id, embedding[1] AS A00, label AS BurnDate FROM embeddings, (SELECT count(*) AS n FROM embeddings)
        WHERE CAST(concat('0x', substr(md5(concat('7:', vec_id)), 1, 15)) AS BIGINT)
          BETWEEN CAST({at} * 80 * {1 << 60}::HUGEINT // n AS BIGINT) AND CAST({at + 1} * 80 * {1 << 60}::HUGEINT // n AS BIGINT) - 1"""
        for at in range(3)
    ),
    "patch_ordinals": "SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS ordinal FROM embeddings",
    "threshold_curve": _metrics_sql(
        f"""SELECT threshold, {', '.join(f"CAST(count(*) FILTER ({c}) AS BIGINT) AS {n}" for n, c in (("tp", "y AND h"), ("fp", "NOT y AND h"), ("fn", "y AND NOT h"), ("tn", "NOT y AND NOT h")))}
        FROM (SELECT round(t / 1001, 6) AS threshold, {_TRUTH} AS y, {_P} > CAST(t / 1001 AS FLOAT) AS h FROM embeddings, range(1, 1001) AS r(t)) GROUP BY threshold""",
        "threshold, ",
    ),
    "best_rounds": f"""SELECT fit, count(*) AS rounds, min_by(round, val_loss) AS best_round, min(val_loss) AS best_loss
      FROM ({_stopped_sql(1, 5)}) GROUP BY fit""",
    "round_choices": f"SELECT fit, round, val_loss, is_best, waited FROM ({_stopped_sql(2, 12)})",
    "pixel_vectors": """SELECT vec_id, CAST(i AS INT) AS pos, CAST([embedding[17], embedding[2], embedding[64], embedding[10]][i + 1] AS DOUBLE) AS value
      FROM embeddings, range(4) AS r(i)""",
    "peeked_patches": "SELECT vec_id AS id, 'A00, A01, burned_area_2023' AS inputs, CAST(64 AS INT) AS label_values FROM embeddings WHERE vec_id % 5 = 0 ORDER BY vec_id LIMIT 20",
    "train_resume": "SELECT CAST(r AS INT) AS round, true AS same_train_loss, true AS same_val_loss, true AS same_is_best FROM range(1, 4) AS x(r)",
    "cache_reuse": f"""SELECT split, CAST(copy AS INT) AS copy, patches, CAST(load AS INT) AS load
      FROM (SELECT {_SPLIT} AS split, count(*) AS patches FROM embeddings GROUP BY 1), (VALUES (0, 0), (1, 0), (2, 1)) AS c(load, copy)""",
    "split_positives": f"""SELECT {_SPLIT} AS split, CAST(sum(len(list_filter(embedding, lambda x: x > CAST(0.1 AS FLOAT)))) AS BIGINT) AS n_positive
      FROM embeddings GROUP BY 1""",
    "evaluation_report": " UNION ALL ".join(
        _metrics_sql(_confusion_sql("v > CAST(0.2 AS FLOAT)", f"{hit} > CAST({t} AS FLOAT)", f"({_CELL})"), f"'{name}' AS score, CAST({t} AS DOUBLE) AS threshold, ")
        for name, hit, t in (*(("p", "CAST((CAST(v AS DOUBLE) + 0.3) / 0.6 + 0.2 AS FLOAT)", t) for t in (0.5, 0.9, 0.99)), ("last_year", "v + CAST(0.3 AS FLOAT)", 0.5))
    ),
    "job_evaluation": " UNION ALL ".join(
        _metrics_sql(_confusion_sql("y", f"CAST({name} AS FLOAT) > CAST({t} AS FLOAT)", f"({_net_sql(_IMAGES)})"), f"'{name}' AS score, CAST({t} AS DOUBLE) AS threshold, ")
        for name, t in (("p", 0.3), ("p", 0.5), ("p", 0.7), ("last_year", 0.5))
    ),
    "model_roundtrip": "SELECT count(*) AS n, count(*) AS same FROM embeddings WHERE vec_id % 5 = 0",
    "record_scalars": f"""SELECT vec_id AS id, concat('patch ', vec_id) AS name, embedding[1] AS lat, embedding[2] AS lon, embedding[3] AS elevation,
      CAST(len(embedding) AS INT) AS pixels, {_SPLIT} AS split FROM embeddings""",
    "record_inputs": f"""SELECT vec_id AS id, embedding[1] AS lat, {_SPLIT} AS split, CAST(pos AS INT) AS pos, v AS A00, v * CAST(2 AS FLOAT) AS A01,
      v * CAST(-1 AS FLOAT) AS burned_area_2023, v > 0 AS burned FROM ({_CELL}) JOIN embeddings USING (vec_id)""",
    "record_outputs": f"""SELECT vec_id AS id, 'A00 A01' AS inputs, CAST(pos AS INT) AS pos, v * CAST(100 AS FLOAT) AS BurnDate,
      v * CAST(-1 AS FLOAT) AS burned_area_2023 FROM ({_CELL}) WHERE vec_id % 5 <> 0""",
    "record_datasets": f"""SELECT {_SPLIT} AS split, count(*) AS patches, CAST(sum(len(list_filter(embedding, lambda x: x > 0))) AS BIGINT) AS burned_pixels
      FROM embeddings GROUP BY 1""",
    "seeded_shuffle": "SELECT vec_id, embedding[1] AS A00, label AS BurnDate FROM embeddings",
    "keyed_eval": _metrics_sql(_CONFUSION),
    "bucketed_eval": _metrics_sql(_CONFUSION),
    "batch_score": f"SELECT vec_id, CAST(pos AS INT) AS pos, round(1 / (1 + exp(-CAST(v AS DOUBLE))), 6) AS p FROM ({_CELL})",
    "cache_roundtrip": """SELECT vec_id, embedding[1] AS A00, embedding[2] AS A01, label AS BurnDate,
      CASE WHEN vec_id % 5 = 0 THEN 'validation' ELSE 'training' END AS split FROM embeddings""",
}

_QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    band_projection,
    band_exclusion,
    burn_label,
    multi_output,
    pixel_explode,
    patch_reshape,
    block_avg_pool,
    block_max_pool,
    pixel_pool,
    bilinear_upsample,
    multi_scale_features,
    rgb_rescale,
    confusion,
    metrics_report,
    patch_metrics,
    threshold_sweep,
    threshold_curve,
    persistence_baseline,
    binary_iou,
    soft_dice,
    positive_pixels,
    event_patches,
    inspected_patches,
    split_filter,
    take_n,
    seeded_shuffle,
    bounded_epoch,
    epoch_slices,
    patch_ordinals,
    keyed_eval,
    bucketed_eval,
    batch_score,
    mlp_fit_predict,
    train_history,
    best_rounds,
    round_choices,
    pixel_vectors,
    peeked_patches,
    train_resume,
    multi_scale_fit,
    split_positives,
    evaluation_report,
    job_evaluation,
    model_roundtrip,
    record_scalars,
    record_inputs,
    record_outputs,
    record_datasets,
    cache_reuse,
    cache_roundtrip,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
