from fractions import Fraction

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.sql import functions as F

from cinderpatch.operators import forward, ordering
from cinderpatch.plans import job, queries, train

from . import records


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    path = tmp_path_factory.mktemp("patches")
    records.write_schema(path, [("id", "BYTES"), ("lat", "FLOAT"), ("lon", "FLOAT"), ("A00", "FLOAT"), ("A01", "FLOAT"), ("BurnDate", "FLOAT")])
    rng = np.random.default_rng(5)
    for split, n in (("training", 6), ("validation", 3)):
        rows = []
        for i in range(n):
            a, b = rng.normal(size=(2, 64)).astype("f4")
            rows.append({"id": f"{split}{i}", "lat": 0.0, "lon": 0.0, "A00": a, "A01": b, "BurnDate": np.where(a > 0.2, 200, 0)})
        records.write(path / f"{split}-0.tfrecord.gz", rows)
    return path


@pytest.mark.parametrize("model", ["mlp", "multi_scale_mlp_head"])
def test_job(spark, data, tmp_path, model):
    args = ["--model_type", model, "--data_dir", str(data), "--patch_size", "8", "--epochs", "3", "--iterations", "12", "--model_output_path", str(tmp_path / "m")]
    fitted = job.run(spark, job.options(args))
    losses = [h[2] for h in fitted.history]
    assert [h[3] for h in fitted.history] == [x == min(losses[: i + 1]) and x not in losses[:i] for i, x in enumerate(losses)]
    again = MultilayerPerceptronClassificationModel.load(str(tmp_path / "m"))
    assert again.weights == fitted.model.weights
    _, validation = job.build_datasets(spark, str(data), pattern="*.tfrecord.gz", size=8)
    rows = job.report(again, job.pixels(validation, model, 8), (0.5,)).first()
    assert rows["tp"] + rows["fp"] + rows["fn"] + rows["tn"] == 3 * 64
    assert rows["f1"] > 0.8
    assert fitted.history_frame(spark).count() == len(losses)


def test_evaluation(spark, data):
    train_frame, validation = job.build_datasets(spark, str(data), pattern="*.tfrecord.gz", size=8)
    fitted = train.fit_with_validation(job.pixels(train_frame, "MLP", 8), job.pixels(validation, "MLP", 8), "MLP", 2, 12)
    rows, events = job.evaluation(fitted.model, validation, "mlp", 8, "A00", (0.5, 0.9))
    found = [r.asDict() for r in rows.collect()]
    assert [(r["score"], r["threshold"]) for r in found] == [("p", 0.5), ("p", 0.9), ("last_year", 0.5)]
    assert all(r["tp"] + r["fp"] + r["fn"] + r["tn"] == 3 * 64 for r in found)
    same = job.report(fitted.model, job.pixels(validation, "mlp", 8), (0.5, 0.9)).collect()
    assert [(r["tp"], r["fn"]) for r in same] == [(r["tp"], r["fn"]) for r in found[:2]]
    assert found[2]["fp"] == 0 and events.count() == 3
    assert job.peek(validation, 2).collect()[0]["inputs"] == "A00, A01" and job.peek(validation, 2).count() == 2


@pytest.mark.parametrize("model", ["mlp", "multi_scale_mlp_head"])
def test_scores_in_the_patch_row_equal_those_by_pixel(spark, data, model):
    train_frame, validation = job.build_datasets(spark, str(data), pattern="*.tfrecord.gz", size=8)
    fitted = train.fit_with_validation(job.pixels(train_frame, model, 8), job.pixels(validation, model, 8), model, 1, 8)
    by_pixel = {(r["id"], r["pos"]): r["p"] for r in train.predict(fitted.model, job.pixels(validation, model, 8)).collect()}
    several = model != "mlp"
    images = forward.image_scores([F.col("inputs.A00"), F.col("inputs.A01")], forward.Net.of(fitted.model), 8, (1, 2, 4) if several else (1,), several)
    exact = validation.select("id", images.alias("p")).collect()
    assert len(exact) == 3 and len(by_pixel) == 3 * 64
    assert max(abs(v - by_pixel[r["id"], pos]) for r in exact for pos, v in enumerate(r["p"])) < 1e-9
    scored = job.scored_patches(fitted.model, validation, model, 8)
    assert scored.columns == [*validation.columns, "p"]
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and not [n for n in ("Generate", "Exchange", "Join") if n in plan], plan
    metric_plan = job.evaluation(fitted.model, validation, model, 8, "A00")[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in metric_plan and metric_plan.count("Exchange") == 1, metric_plan  # one row of sums per task


def test_bad_images_are_errors(spark):
    net = forward.Net([2, 1, 2], np.ones(7))
    for a, b in (([1.0] * 4, [1.0] * 3), ([1.0] * 4, None), ([], [])):
        frame = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
        with pytest.raises(Exception, match="has not 2 bands of 4 values"):
            frame.select(forward.image_scores([F.col("a"), F.col("b")], net, 2)).collect()
    empty = spark.createDataFrame([], "a array<float>, b array<float>")
    assert empty.select(forward.image_scores([F.col("a"), F.col("b")], net, 2)).count() == 0
    with pytest.raises(ValueError, match="2 inputs, not 1"):
        forward.image_scores([F.col("a")], net, 2)
    with pytest.raises(ValueError, match="not divisible"):
        forward.scaling(6, 4)


def test_no_image_crosses_the_opening_of_pixels(spark, data):
    _, validation = job.build_datasets(spark, str(data), pattern="*.tfrecord.gz", size=8)
    flat = validation.select("id", "inputs.*", F.transform("label", lambda v: v.cast("double")).alias("label"))
    plan = train.multi_scale_pixels(flat, ["A00", "A01"], 8, "label")._jdf.queryExecution().executedPlan().toString()
    (opened,) = [line for line in plan.split("\n") if "Generate" in line]
    kept = opened.split("], false")[0].split(", [")[-1]
    assert "id" in kept and "images" not in kept and "A00" not in kept and "label" not in kept, opened


def test_scales_are_made_once_for_a_patch_not_for_each_pixel(spark):
    patches = spark.range(3).select("id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda v: (v * 7 % 13).cast("float")).alias("v"))
    made = train.multi_scale_pixels(patches, ["v"], 8)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan, plan
    (line,) = [line for line in plan.split("\n") if " AS pixels" in line]
    scales, pixel = line.rsplit("struct(values", 1)
    assert "FLOOR(" in scales and "FLOOR(" not in pixel, pixel  # pooling and upsampling find their cells by FLOOR
    image = patches.select("id", train.multi_scale(F.col("v"), 8).alias("m")).first()["m"]
    by_pixel = made.where("id = 0").orderBy("pos").collect()
    expected = forward.normalized(np.array(image).T)
    assert np.abs(np.array([r["features"].toArray() for r in by_pixel]) - expected).max() < 1e-12 and made.count() == 3 * 64


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "a double, b double").select(train.pixel_features(["a", "b"]).alias("features"), F.lit(1.0).alias("label"))
    with pytest.raises(ValueError, match="no row"):
        train.fit_with_validation(empty, empty)


def test_early_stop(spark):
    rows = spark.range(60).select(train.array_to_vector(F.array(F.rand(1), F.rand(2))).alias("features"), (F.rand(3) > 0.5).cast("double").alias("label"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    flipped = rows.withColumn("label", 1 - F.col("label"))
    fitted = train.fit_with_validation(rows, flipped, "mlp", rounds=12, iterations=15, patience=2)
    assert len(fitted.history) < 12 and not fitted.history[-1][3] and not fitted.history[-2][3]


def test_unknown_model():
    with pytest.raises(ValueError, match="multi_scale_mlp_head"):
        train.build_model("tree", 3)
    with pytest.raises(SystemExit):
        job.options(["--model_type", "tree", "--data_dir", "x", "--epochs", "1"])


@pytest.fixture(scope="module")
def random_rows(spark):
    rows = spark.range(80).select("id", train.array_to_vector(F.array(F.rand(1), F.rand(2))).alias("features"), (F.rand(3) > 0.5).cast("double").alias("label"))
    return spark.createDataFrame(rows.collect(), rows.schema)


def test_a_stopped_fit_goes_on_as_if_it_had_not_stopped(spark, random_rows, tmp_path):
    frames, folder = (random_rows.where("id % 4 > 0"), random_rows.where("id % 4 = 0")), str(tmp_path / "rounds")
    whole = train.fit_with_validation(*frames, rounds=5, iterations=4)
    for rounds in (2, 4):
        train.fit_with_validation(*frames, rounds=rounds, iterations=4, folder=folder)
    (tmp_path / "rounds" / "round-5").mkdir()  # what a job left that was stopped while it wrote
    again = train.fit_with_validation(*frames, rounds=5, iterations=4, folder=folder)
    assert again.history == whole.history and again.model.weights == whole.model.weights
    # nothing is left to do: the saved rounds are the answer, also for fewer
    assert train.fit_with_validation(*frames, rounds=5, iterations=4, folder=folder).history == whole.history
    fewer = train.fit_with_validation(*frames, rounds=2, iterations=4, folder=folder)
    assert fewer.history == whole.history[:2]
    with pytest.raises(ValueError, match="other settings"):
        train.fit_with_validation(*frames, rounds=5, iterations=5, folder=folder)


def test_patience_counts_over_a_restart(spark, random_rows, tmp_path):
    flipped = random_rows.withColumn("label", 1 - F.col("label"))
    whole = train.fit_with_validation(random_rows, flipped, rounds=12, iterations=15, patience=3)
    stop = len(whole.history) - 1
    train.fit_with_validation(random_rows, flipped, rounds=stop, iterations=15, patience=3, folder=str(tmp_path / "r"))
    again = train.fit_with_validation(random_rows, flipped, rounds=12, iterations=15, patience=3, folder=str(tmp_path / "r"))
    assert again.history == whole.history and again.model.weights == whole.model.weights


def test_epochs_take_the_next_slice(spark, tmp_path):
    rows = spark.range(1000).withColumnRenamed("id", "key")
    landed = ordering.land_by_place(rows.repartition(4), str(tmp_path / "places"), 3, "key")
    share = Fraction(150, 1000)
    slices = [{r["key"] for r in landed.where(ordering.epoch_slice(at, share)).collect()} for at in range(14)]
    assert sum(map(len, slices[:6])) == len(set().union(*slices[:6])) and all(100 < len(s) < 200 for s in slices)
    assert set().union(*slices[:7]) == set(range(1000)) and slices[6] & slices[0]
    shuffled = [r["key"] for r in ordering.shuffled(rows, 3, "key").collect()]
    assert shuffled[: len(slices[0])] == [r["key"] for r in landed.where(ordering.epoch_slice(0, share)).orderBy("place").collect()]
    assert landed.where(ordering.epoch_slice(2, Fraction(3, 2))).count() == 1000
    plan = landed.where(ordering.epoch_slice(1, share))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(place" in plan.split("PushedFilters")[1] and not [n for n in ("Exchange", "Sort") if n in plan]


def test_job_with_bounded_epochs_and_restart(spark, data, tmp_path):
    args = ["--model_type", "mlp", "--data_dir", str(data), "--patch_size", "8", "--iterations", "3", "--batch_size", "1", "--steps_per_epoch", "3"]
    args += ["--rounds_path", str(tmp_path / "r"), "--cache_path", str(tmp_path / "c")]
    first = job.run(spark, job.options([*args, "--epochs", "1"]))
    both = job.run(spark, job.options([*args, "--epochs", "2"]))
    assert both.history[:1] == first.history and len(both.history) == 2
    train_frame, _ = job.datasets(spark, job.options([*args, "--epochs", "1"]))
    opened = job.pixels(train_frame.withColumn("place", ordering.place(0)), "mlp", 8)
    assert opened.columns == ["id", "pos", "features", "label", "place"] and opened.groupBy("id").agg(F.count_distinct("place")).count() == 6


def test_rows_of_a_fit_are_dealt_evenly(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spark.read.parquet(str(tmp_path / "one"))
    assert rows.rdd.getNumPartitions() == 1
    parts = ordering.dealt(rows).rdd.glom().map(lambda part: [r["id"] for r in part]).collect()
    assert len(parts) == 4 and max(map(len, parts)) - min(map(len, parts)) <= 1
    assert sorted(sum(parts, [])) == list(range(1000)) and all(p == sorted(p) for p in parts)


@pytest.mark.parametrize("name", ["train_resume", "multi_scale_fit"])
def test_fit_queries_deal_their_rows(spark, monkeypatch, name):
    seen = []

    def fit(*frames, **options):
        seen.extend(f.rdd.getNumPartitions() for f in frames[:2])
        raise StopIteration

    monkeypatch.setattr(train, "fit_with_validation", fit)
    with pytest.raises(StopIteration):
        queries.queries()[name](spark, "/root/testdata/sf0.001")  # a file of one part
    assert seen == [4, 4]
