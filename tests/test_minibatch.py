"""Mini-batch training in shared passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import minibatch as MB
from riskframe.operators import networks as N

from test_models import _xor_frame


def keyed(spark, n=1200):
    return _xor_frame(spark, n).withColumn("id", F.xxhash64("x1", "x2"))


FEATURES = ["x1", "x2"]


def test_learns_xor_and_repeats_whatever_the_layout(spark):
    data = keyed(spark)
    config = [{"hidden": [12], "activation": "relu"}]
    runs = [MB.train_shared(d, FEATURES, "y", config, "id", epochs=25, batch=32, lr=0.02,
                            block_rows=300)[0]
            for d in (data, data.repartition(5).orderBy("x2"))]
    assert runs[0].history[-1]["val_accuracy"] > 0.9
    assert len(runs[0].history) == 25 and not runs[0].stopped_early
    for a, b in zip(runs[0].history, runs[1].history):
        assert a["val_loss"] == pytest.approx(b["val_loss"], rel=1e-6)


def test_early_stopping_ends_the_run_and_gives_the_best_weights(spark):
    data = keyed(spark, 400)
    out, = MB.train_shared(data, FEATURES, "y", [{"hidden": [4]}], "id", epochs=60, batch=16,
                           lr=0.5, patience=3, min_delta=0.01)
    losses = [h["val_loss"] for h in out.history]
    assert out.stopped_early and len(losses) == out.best_epoch + 3 < 60
    assert out.passes == len(losses) + 1
    val = data.where("split = 'val'").toPandas()
    p = out.model.forward_numpy(val[FEATURES].to_numpy())
    assert N.log_loss(val["y"].to_numpy(float), p).mean() == pytest.approx(losses[out.best_epoch - 1])


def test_passes_do_not_grow_with_the_networks(spark):
    data = keyed(spark, 300)
    one = MB.train_shared(data, FEATURES, "y", [{"hidden": [3]}], "id", epochs=4)
    configs = [{"hidden": [3]}, {"hidden": [4, 4], "activation": "relu", "epochs": 2},
               {"hidden": [2], "lr": 0.1, "batch": 7}]
    many = MB.train_shared(data, FEATURES, "y", configs, "id", epochs=4)
    assert [t.passes for t in one + many] == [5] * 4
    assert [len(t.history) for t in many] == [4, 2, 4]
    assert [h["val_loss"] for h in many[0].history] == pytest.approx(
        [h["val_loss"] for h in one[0].history])
    rows = MB.sweep_rows(configs, many)
    assert [r["hidden"] for r in rows] == ["3", "4x4", "2"] and rows[1]["epochs"] == 2


def test_odd_rows_and_missing_splits(spark):
    data = keyed(spark, 100).select("id", "x1", "x2", "y", F.lit("train").alias("split"))
    odd = spark.createDataFrame([(1, None, 1.0, 1, "train"), (2, float("nan"), 1.0, 1, "train"),
                                 (3, 1.0, 1.0, None, "train"), (4, 1.0, 1.0, 1, None)],
                                "id long, x1 double, x2 double, y int, split string")
    a, = MB.train_shared(data.unionByName(odd), FEATURES, "y", [{"hidden": [3]}], "id", epochs=3)
    assert len(a.history) == 3 and a.history[0]["val_loss"] is None and a.test_accuracy is None
    none, = MB.train_shared(data.limit(0), FEATURES, "y", [{"hidden": [3]}], "id", epochs=3)
    assert none.history == [] and none.best_epoch == 0


def test_batch_steps_follow_adam():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 2)), (rng.random(20) > 0.5).astype(float)
    vec = N.flatten(N.init_layers([2, 3, 1], 1))
    run = MB._Run([2, 3, 1], "sigmoid", 0.1, 8, 1, vec, np.zeros_like(vec), np.zeros_like(vec))
    got, m, v, steps = MB._one_epoch(run, x, y, np.arange(20))
    assert steps == 3
    want, m1, v1 = vec, 0, 0
    for t, part in enumerate(([*range(8)], [*range(8, 16)], [*range(16, 20)]), 1):
        g = N.gradient(N.unflatten(want, run.sizes), "sigmoid", x[part], y[part])[0] / len(part)
        m1, v1 = 0.9 * m1 + 0.1 * g, 0.999 * v1 + 0.001 * g * g
        want = want - 0.1 * (m1 / (1 - 0.9 ** t)) / (np.sqrt(v1 / (1 - 0.999 ** t)) + 1e-8)
    assert np.allclose(got, want) and np.allclose(m, m1) and np.allclose(v, v1)


def test_blocks_trained_together_take_the_steps_they_would_take_alone():
    rng = np.random.default_rng(2)
    counts, width = np.array([21, 16, 9, 0]), 3
    x, y = rng.normal(size=(60, width)), (rng.random(60) > 0.4).astype(float)
    order = np.zeros((4, 21), np.int64)
    for row, n in zip(order, counts):
        row[:n] = rng.permutation(60)[:n]
    for activation in ("relu", "sigmoid"):
        sizes = [width, 5, 4, 1]
        vec = N.flatten(N.init_layers(sizes, 3, activation)) + 0.01
        run = MB._Run(sizes, activation, 0.05, 8, 1, vec, rng.normal(size=len(vec)) / 9,
                      rng.random(len(vec)) / 9, steps=5)
        *got, steps = MB._together(run, *MB.dealt(x, y, order, 8), counts)
        assert steps.tolist() == [3, 2, 2, 0]
        for b, n in enumerate(counts):
            want, m, v = run.vec, run.m, run.v
            for t, at in enumerate(range(0, n, 8), 6):
                rows = order[b, at:min(at + 8, n)]
                g = N.gradient(N.unflatten(want, sizes), activation, x[rows], y[rows])[0] / len(rows)
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                want = want - 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            for a, w in zip(got, (want, m, v)):
                assert np.allclose(a[b], w, rtol=1e-10, atol=1e-12)


def test_every_task_gets_as_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(MB, "TASK_BLOCKS", 2)
    blocks = MB.blocks_of(keyed(spark, 2000), FEATURES, "y", "id", "split", block_rows=40)
    held = [r["n"] for r in blocks.groupBy(F.spark_partition_id()).agg(
        F.count("*").alias("n")).collect()]
    assert sum(held) == 50 and len(held) > 1 and max(held) <= 2 and max(held) - min(held) <= 1
    one = blocks.selectExpr("size(y) = n[0] + n[1] + n[2] AND size(x) = 2 * size(y) AS whole")
    assert {r["whole"] for r in one.collect()} == {True}
    blocks.unpersist()
