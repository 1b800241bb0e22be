import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinderpatch.functions import bands as B
from cinderpatch.operators import grid, history, metrics, ordering
from cinderpatch.plans import score
from cinderpatch.plans.dataset import split_bands

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, **values):
    """The value of an expression over one row."""
    schema = ", ".join(f"{k} array<float>" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_nan_and_float_thresholds(spark):
    exact = float(np.float32(0.99))
    above = F.transform("b", lambda v: B.above(v, 0.99))
    assert one(spark, above, b=[exact, 1.0, math.nan, 0.5]) == [False, True, False, False]
    assert one(spark, B.mask(F.col("b")), b=[0.0, 1.0, math.nan, -1.0]) == [False, True, False, False]
    assert one(spark, B.count_above(F.col("b")), b=[0.5, 0.6, math.nan]) == 1


def test_constant_images_stay_constant(spark):
    flat = [2.5] * 64
    assert one(spark, B.average_pool(F.col("b"), 8, 4), b=flat) == [2.5] * 4
    assert one(spark, B.max_pool(F.col("b"), 8, 2), b=flat) == [2.5] * 16
    assert one(spark, B.upsample(F.col("b"), 8, 2), b=flat) == [2.5] * 256
    assert one(spark, B.multi_scale(F.col("b"), 8), b=flat) == [flat] * 3


def test_pool_size_must_divide():
    with pytest.raises(ValueError, match="not divisible"):
        B.average_pool(F.lit(None), 8, 3)


@few
@given(st.lists(st.floats(-4, 4, width=32), min_size=16, max_size=16))
def test_grid_functions_against_numpy(spark, values):
    image = np.array(values, dtype="f4").reshape(4, 4).astype(float)
    blocks = image.reshape(2, 2, 2, 2).swapaxes(1, 2).reshape(4, 4)
    assert np.allclose(one(spark, B.average_pool(F.col("b"), 4, 2), b=values), blocks.mean(axis=1))
    assert np.allclose(one(spark, B.max_pool(F.col("b"), 4, 2), b=values), blocks.max(axis=1))
    place = (np.arange(8) + 0.5) / 2 - 0.5
    low, share = np.floor(place).astype(int), place - np.floor(place)
    a, b = np.clip(low, 0, 3), np.clip(low + 1, 0, 3)
    wide = image[:, a] * (1 - share) + image[:, b] * share
    expected = wide[a] * (1 - share)[:, None] + wide[b] * share[:, None]
    assert np.allclose(one(spark, B.upsample(F.col("b"), 4, 2), b=values), expected.reshape(-1), atol=1e-9)
    normed = one(spark, B.layer_norm(F.transform("b", lambda v: v.cast("double"))), b=values)
    assert np.allclose(normed, (image.reshape(-1) - image.mean()) / np.sqrt(image.var() + 1e-3), atol=1e-9)


def test_pixels_and_back(spark):
    rows = [(i, [random.random() for _ in range(16)], [float(i)] * 16) for i in range(3)]
    patches = spark.createDataFrame(rows, "id int, a array<float>, b array<float>")
    pixels = grid.to_pixels(patches, ["a", "b"], 4)
    assert pixels.columns == ["id", "pos", "r", "c", "a", "b"] and pixels.count() == 48
    assert {(r["pos"], r["r"], r["c"]) for r in pixels.collect()} == {(p, p // 4, p % 4) for p in range(16)}
    back = grid.to_patches(pixels.repartition(3), ["a", "b"], 4)
    assert sorted(back.collect()) == sorted(patches.collect())
    holes = pixels.where("not (id = 1 and pos = 5)")
    assert {r["id"] for r in grid.to_patches(holes, ["a"], 4).collect()} == {0, 2}
    assert len(grid.to_patches(holes, ["a"], 4, complete_only=False).where("id = 1").first()["a"]) == 15
    pooled = {(r["id"], r["r"], r["c"]): r["b"] for r in grid.pool_pixels(pixels, ["b"], 2, "max").collect()}
    assert pooled == {(i, r, c): float(i) for i in range(3) for r in range(2) for c in range(2)}


def test_short_bands_are_errors(spark):
    short = spark.createDataFrame([(1, [1.0] * 3)], "id int, a array<float>")
    with pytest.raises(Exception, match="wrong number of values"):
        grid.to_pixels(short, ["a"], 4).collect()


def test_outputs(spark):
    patches = spark.createDataFrame([(1, [1.0] * 4, [0.0, 2.0, math.nan, 1.0])], "id int, a array<float>, y array<float>")
    assert split_bands(patches, ["a"], ["y"], 2).first()["label"] == [False, True, False, True]
    assert split_bands(patches, ["a"], ["a", "y"], 2).first()["label"]["a"] == [1.0] * 4


@few
@given(st.lists(st.tuples(st.booleans(), st.floats(0, 1, width=32)), min_size=1, max_size=40))
def test_metric_identities(spark, rows):
    df = spark.createDataFrame(rows, "y boolean, p float").repartition(3)
    m = metrics.metrics(metrics.confusion(df, F.col("y"), B.above(F.col("p"), 0.5))).first()
    assert m["tp"] + m["fp"] + m["fn"] + m["tn"] == len(rows)
    assert math.isclose(m["f1"], 2 * m["jaccard"] / (1 + m["jaccard"]), abs_tol=1e-12)
    patch = spark.createDataFrame([([y for y, _ in rows], [p for _, p in rows])], "y array<boolean>, p array<float>")
    assert metrics.metrics(metrics.patch_confusion(patch, "y", "p", 0.5)).first() == m
    swept = metrics.threshold_report(df, F.col("y"), F.col("p"), (0.5,)).drop("threshold").first()
    assert swept == m


def test_empty_denominators_and_tables(spark):
    none = spark.createDataFrame([], "y boolean, p float")
    m = metrics.metrics(metrics.confusion(none, F.col("y"), B.above(F.col("p"), 0.5))).first()
    assert tuple(m) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    assert metrics.soft_dice(none, F.col("y"), F.col("p")).first()["dice_loss"] == 1.0
    empty = spark.createDataFrame([], "y array<boolean>, p array<float>")
    assert tuple(metrics.patch_confusion(empty, "y", "p").first()) == (0, 0, 0, 0)
    assert metrics.binary_iou(none, F.col("y"), F.col("p")).first()["iou"] == 0.0


def test_iou_counts_the_threshold_itself(spark):
    df = spark.createDataFrame([(True, 0.5), (False, math.nan)], "y boolean, p float")
    assert metrics.binary_iou(df, F.col("y"), F.col("p")).first()["iou"] == 1.0
    assert score.persistence_report(df, "y", "p").first()["tp"] == 0


def test_orders_and_limits(spark):
    df = spark.range(100).withColumnRenamed("id", "id")
    a = [r["id"] for r in ordering.shuffled(df, 3).collect()]
    assert a == [r["id"] for r in ordering.shuffled(df.repartition(7), 3).collect()] and a != sorted(a)
    assert a != [r["id"] for r in ordering.shuffled(df, 4).collect()]
    assert [r["id"] for r in ordering.take_batches(df.repartition(5), 2, 3).collect()] == list(range(6))
    assert [r["id"] for r in ordering.bounded_epoch(df, 3, 2, 5).collect()] == a[:10]
    assert ordering.hashed_split(df).where("split = 'validation'").count() == 20


def test_events(spark):
    rows = [(1, [False] * 4, [0.5] * 4), (2, [True] + [False] * 3, [0.0] * 4), (3, [False] * 4, [0.0, 0.6, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, y array<boolean>, p array<float>")
    assert sorted(r["id"] for r in score.event_patches(df, "y", "p").collect()) == [2, 3]
    assert [r["id"] for r in score.event_patches(df, "y", "p", examined=2).collect()] == [2]


def test_band_names_must_differ():
    with pytest.raises(ValueError, match="distinct"):
        score.score_patches(None, None, ["a", "a"], 4)


def test_a_curve_of_thresholds_equals_the_report(spark):
    values = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0, float("nan"), None, -1.0, float("inf"), 0.1, 0.30000001]
    rows = spark.createDataFrame([(v, y) for v in values for y in (True, False, None)], "p float, y boolean")
    cuts = (0.99, 0.5, 0.1, 0.25, 0.3, 0.5000000001, 1.0, -5.0)
    want = metrics.threshold_report(rows, F.col("y"), F.col("p"), cuts)
    got = metrics.threshold_curve(rows.repartition(3), F.col("y"), F.col("p"), cuts)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
    nothing = metrics.threshold_curve(rows.limit(0), F.col("y"), F.col("p"), (0.5,)).first()
    assert tuple(nothing) == (0.5, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)


def test_histograms_can_be_summed(spark):
    rows = spark.range(1000).select((F.col("id") / 1000).cast("float").alias("p"), (F.col("id") % 3 == 0).alias("y"))
    cuts = tuple(i / 100 for i in range(100))
    part = lambda df: metrics.score_histogram(df, F.col("y"), F.col("p"), cuts)
    both = part(rows.where("p < 0.37")).unionByName(part(rows.where("p >= 0.37"))).groupBy("passed").agg(F.sum("positives"), F.sum("negatives"))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, part(rows).collect()))


def test_numbers_are_dense_without_one_task(spark, tmp_path):
    rows = spark.range(5_000).select((F.col("id") * 7919 % 5003).alias("id"), F.lit("x").alias("more")).repartition(6)
    got = ordering.numbered(rows, str(tmp_path / "n"))
    ids = sorted(r["id"] for r in rows.collect())
    assert got.columns == ["id", "more", "ordinal"] and {r["id"]: r["ordinal"] for r in got.collect()} == {v: n for n, v in enumerate(ids, 1)}
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert ordering.numbered(rows.limit(0), str(tmp_path / "none")).count() == 0


def test_tables_landed_by_key_are_joined_where_they_lie(spark, tmp_path):
    ids = spark.range(2_000).select((F.col("id") * 37 % 2_003).alias("id"))
    labels, scores = ids.select("id", (F.col("id") % 3 == 0).alias("y")), ids.select("id", (F.col("id") % 7 / 7).cast("float").alias("p")).repartition(5)
    want = score.keyed_report(labels, scores, ["id"], "y", "p", 0.5).first()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables too large for it
    try:
        landed = [score.land_by_key(df, str(tmp_path / name), "id", 6) for name, df in (("y", labels), ("p", scores))]
        plan = landed[0].join(landed[1], "id")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2, plan
        assert score.keyed_report(*landed, ["id"], "y", "p", 0.5).first() == want
        other = score.land_by_key(scores, str(tmp_path / "other"), "id", 5)  # fewer buckets: still right, by a shuffle
        assert score.keyed_report(landed[0], other, ["id"], "y", "p", 0.5).first() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("patience", [1, 2, 5])
def test_best_rounds_equal_a_plain_loop(spark, patience):
    rng = random.Random(patience)
    fits = {f: [rng.choice([rng.random(), float("nan"), 0.5, None]) for _ in range(rng.randint(1, 15))] for f in range(40)}
    frame = spark.createDataFrame([(f, n, v) for f, values in fits.items() for n, v in enumerate(values, 1)], "fit int, round int, val_loss double")
    want, kept = {}, {}
    for f, values in fits.items():
        best, best_at, waited, ran = math.inf, None, 0, []
        for n, v in enumerate(values, 1):
            better = v is not None and v < best
            best, best_at, waited = (v, n, 0) if better else (best, best_at, waited + 1)
            ran.append((n, better, waited))
            if waited >= patience:
                break
        want[f], kept[f] = (len(ran), best_at, None if best_at is None else best), ran
    assert {r["fit"]: tuple(r)[1:] for r in history.best_rounds(frame, ["fit"], patience).collect()} == want
    rows = history.stopped_early(frame.repartition(3), ["fit"], patience).orderBy("fit", "round").collect()
    assert {f: [(r["round"], r["is_best"], r["waited"]) for r in rows if r["fit"] == f] for f in fits} == kept
