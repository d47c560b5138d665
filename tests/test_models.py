"""Scoring, metrics, training, persistence and Sobol analysis."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import metrics as M
from riskframe.operators import scoring as SC
from riskframe.operators import sensitivity as Y
from riskframe.operators import training as TR
from riskframe.sources import io as IO


def _xor_frame(spark, n=1200, seed=0):
    rng = np.random.RandomState(seed)
    x = rng.uniform(-1, 1, (n, 2))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    split = np.where(np.arange(n) % 5 == 0, "val", "train")
    rows = [(float(a), float(b), int(c), str(s)) for (a, b), c, s in zip(x, y, split)]
    return spark.createDataFrame(rows, "x1 double, x2 double, y int, split string")


def test_compiled_mlpc_equals_transform(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from riskframe.operators.encoders import assemble
    df = assemble(_xor_frame(spark, 300), ["x1", "x2"]).withColumn("label", F.col("y").cast("double"))
    model = MultilayerPerceptronClassifier(layers=[2, 4, 2], maxIter=30, seed=1).fit(df)
    mlp = SC.mlp_from_spark(model)
    from pyspark.ml.functions import vector_to_array
    ours = SC.score(df, mlp, ["x1", "x2"], output="p_ours", prediction=None)
    spark_p = model.transform(ours).select(
        "p_ours", vector_to_array("probability")[1].alias("p_spark")).collect()
    assert max(abs(r.p_ours - r.p_spark) for r in spark_p) < 1e-9


def test_mlp_json_and_numpy_forward(spark):
    mlp = SC.rule_weights([3, 4, 1])
    assert SC.MLP.from_json(mlp.to_json()).layers == [(w, b) for w, b in mlp.layers]
    df = spark.createDataFrame([(0.1, -0.2, 0.3), (1.0, 2.0, -1.0)], "a double, b double, c double")
    got = [r.probability for r in SC.score(df, mlp, ["a", "b", "c"]).collect()]
    want = mlp.forward_numpy([[0.1, -0.2, 0.3], [1.0, 2.0, -1.0]])
    assert np.allclose(got, want, atol=1e-12)


def test_train_mlpc_learns_xor(spark):
    res = TR.train_mlpc(_xor_frame(spark), ["x1", "x2"], "y", [8], rounds=6, iters_per_round=25)
    m = TR.round_metrics(_xor_frame(spark), res.model, ["x1", "x2"], "y")
    assert m["val"][1] > 0.9
    losses = [h["val_loss"] for h in res.history]
    assert min(losses) == pytest.approx(TR.round_metrics(
        _xor_frame(spark), res.model, ["x1", "x2"], "y")["val"][0])


def test_train_dense_relu_beats_majority(spark):
    res = TR.train_dense(_xor_frame(spark), ["x1", "x2"], "y", [16, 16], "relu", steps=60,
                         lr=0.05, eval_every=20)
    m = TR.round_metrics(_xor_frame(spark), res.model, ["x1", "x2"], "y")
    assert m["val"][1] > 0.75


def test_confusion_report_and_accuracy(spark):
    rows = [(1, 1), (1, 0), (0, 0), (0, 0), (1, 1)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    cm = {(r.actual, r.predicted): r["count"] for r in M.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 2}
    rep = {r.label: r for r in M.classification_report(df).collect()}
    assert rep["1"].precision == 1.0 and rep["1"].recall == pytest.approx(2 / 3)
    assert rep["accuracy"].f1 == pytest.approx(0.8) == M.accuracy(df).collect()[0].accuracy
    norm = {(r.actual, r.predicted): r.fraction for r in M.confusion_normalized(df).collect()}
    assert norm[(1, 1)] == pytest.approx(2 / 3) and norm[(0, 1)] == 0.0


def test_confusion_sums_to_n(spark):
    rng = np.random.RandomState(2)
    rows = [(int(a), int(b)) for a, b in zip(rng.randint(0, 3, 500), rng.randint(0, 3, 500))]
    df = spark.createDataFrame(rows, "label int, prediction int")
    cm = M.confusion_matrix(df).collect()
    assert len(cm) == 9 and sum(r["count"] for r in cm) == 500
    rep = {r.label: r for r in M.classification_report(df).collect()}
    assert rep["accuracy"].f1 == pytest.approx(np.mean([a == b for a, b in rows]))


def test_report_class_never_predicted(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    rep = {r.label: r for r in M.classification_report(df, labels=[0, 1]).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].f1 == 0.0


def test_best_config_first_wins_ties(spark):
    res = spark.createDataFrame([(0, 0.8), (1, 0.9), (2, 0.9)], "config_idx int, accuracy double")
    assert M.best_configuration(res).collect()[0].config_idx == 1


def test_bce_clipped(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.5)], "label int, probability double")
    got = M.binary_cross_entropy(df).collect()[0].bce
    eps = 1e-7
    want = -(math.log(1 - eps) + math.log(1 - eps) + math.log(0.5)) / 3
    assert got == pytest.approx(want)


def test_evaluate_by_split_overall(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.9), ("b", 0, 1, 0.6), ("b", 0, 0, 0.1)],
                               "split string, label int, prediction int, probability double")
    got = {r.split: r for r in M.evaluate_by(df).collect()}
    assert got["all"].n == 3 and got["b"].n == 2 and got["all"].accuracy == pytest.approx(2 / 3)


def test_ishigami_indices(spark):
    base = spark.range(32768)
    prob = Y.Problem(["x1", "x2", "x3"], [(-math.pi, math.pi)] * 3)
    out = Y.evaluate_design(Y.saltelli_design(base, "id", 3), "id", prob, Y.ishigami())
    s = {r.feature: r for r in Y.sobol_indices(out, prob.names).collect()}
    for f, s1, st in (("x1", .3139, .5576), ("x2", .4424, .4424), ("x3", 0.0, .2437)):
        assert abs(s[f].s1 - s1) < 0.02 and abs(s[f].st - st) < 0.02
    pairs = {(r.feature_i, r.feature_j): r.s2 for r in Y.sobol_pairs(out, prob.names).collect()}
    assert abs(pairs[("x1", "x3")] - 0.2437) < 0.03
    ind, _ = Y.sobol_confidence(out, "id", prob.names, n_resamples=50, n_blocks=200)
    confs = [r.s1_conf for r in ind.collect()]
    assert all(0 < c < 0.05 for c in confs)


def test_linear_model_indices(spark):
    """f = sum a_i x_i on uniform inputs: S1 = ST = a_i^2 / sum a^2, S2 = 0."""
    a = [1.0, 2.0, 3.0]
    base = spark.range(20000)
    prob = Y.unit_problem(["p", "q", "r"])
    out = Y.evaluate_design(Y.saltelli_design(base, "id", 3), "id", prob,
                            lambda xs: sum((x * w for x, w in zip(xs, a)), F.lit(0.0)))
    s = {r.feature: r for r in Y.sobol_indices(out, prob.names).collect()}
    tot = sum(w * w for w in a)
    for f, w in zip(prob.names, a):
        assert abs(s[f].s1 - w * w / tot) < 0.03 and abs(s[f].st - w * w / tot) < 0.03
    assert all(abs(r.s2) < 0.03 for r in Y.sobol_pairs(out, prob.names).collect())


def test_mlp_rank_one_design_equals_direct(spark):
    mlp = SC.rule_weights([3, 4, 1])
    base = spark.range(50)
    prob = Y.unit_problem(["a", "b", "c"])
    design = Y.saltelli_design(base, "id", 3)
    fast = Y.evaluate_design(design, "id", prob, mlp).orderBy("id").collect()
    direct = Y.evaluate_design(design, "id", prob,
                               lambda xs: F.lit(0.0) + _direct(mlp, xs)).orderBy("id").collect()
    for r1, r2 in zip(fast, direct):
        for c in r1.asDict():
            assert r1[c] == pytest.approx(r2[c], abs=1e-12)


def _direct(mlp, xs):
    (w0, b0), (w1, b1) = mlp.layers
    hid = [1.0 / (1.0 + F.exp(-(F.lit(b0[o]) + sum((x * w0[o][i] for i, x in enumerate(xs)),
                                                   F.lit(0.0))))) for o in range(len(b0))]
    z = F.lit(b1[0]) + sum((h * w1[0][o] for o, h in enumerate(hid)), F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-z))


def test_model_save_load_round_trip(spark, tmp_path):
    mlp = SC.rule_weights([2, 3, 1])
    path = str(tmp_path / "model")
    IO.save_model(spark, path, {"mlp": mlp.to_json(), "meta": {"features": ["a", "b"]}})
    back = IO.load_model(spark, path)
    assert SC.MLP.from_json(back["mlp"]).layers == mlp.layers


def test_history_sink_and_absent_source(spark, tmp_path):
    path = str(tmp_path / "hist")
    assert IO.read_history(spark, path).count() == 0
    rows = [{"run_id": "r", "epoch": 1, "train_loss": 0.5, "val_loss": 0.6,
             "train_accuracy": 0.7, "val_accuracy": 0.65}]
    IO.write_history(TR.history_frame(spark, rows), path)
    IO.write_history(TR.history_frame(spark, rows), path)
    assert IO.read_history(spark, path).count() == 2


def test_csv_source_na_handling(spark, tmp_path):
    from pyspark.sql import types as T
    p = tmp_path / "x.csv"
    p.write_text("a,b\n1.5,x\nNA,NA\n,\nnan,y\n")
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType())])
    rows = IO.read_csv(spark, str(p), schema).collect()
    assert [r.a for r in rows] == [1.5, None, None, None]
    assert [r.b for r in rows] == ["x", None, None, "y"]


def test_missing_source_raises(spark):
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        IO.read_csv(spark, "/nonexistent/riskframe/file.csv")


def test_report_and_metrics_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (0, 1)], "label int, prediction int")
    rep = M.classification_report(df)
    IO.write_report(rep, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 5
    IO.append_metrics(M.accuracy(df), str(tmp_path / "metrics"))
    IO.append_metrics(M.accuracy(df), str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 2


def test_target_guard(spark):
    from riskframe.operators.filters import require_target
    df = spark.createDataFrame([(1,)], "a long")
    with pytest.raises(ValueError):
        require_target(df, "loan_status")
    require_target(df, "a")


def test_sweep_runs_configs_in_parallel(spark):
    rows, models = TR.sweep(_xor_frame(spark, 600), ["x1", "x2"], "y",
                            [{"hidden": [4]}, {"hidden": [8]}], test="val",
                            rounds=2, iters_per_round=15, parallelism=2)
    assert [r["config_idx"] for r in rows] == [0, 1]
    assert all(r["test_accuracy"] is not None for r in rows)


@pytest.mark.parametrize("activation", ["relu", "sigmoid"])
def test_partition_gradient_matches_finite_differences(activation):
    import pandas as pd

    rng = np.random.RandomState(0)
    sizes = [3, 4, 3, 1]
    x = rng.normal(size=(40, 3))
    y = (rng.uniform(size=40) > 0.5).astype(float)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    vec = TR._flatten(TR._init_layers(sizes, 1))
    vec = vec + rng.normal(scale=0.1, size=len(vec))

    class Box:
        def __init__(self, v):
            self.value = list(v)

    def loss_and_grad(v):
        out = next(TR._partition_gradients(sizes, activation, ["a", "b", "c"], "y",
                                           Box(v))(iter([pdf])))
        d = dict(zip(out["i"], out["v"]))
        return d[-1], np.array([d[i] for i in range(len(v))])

    _, grad = loss_and_grad(vec)
    eps = 1e-6
    for i in range(0, len(vec), 5):
        up, down = vec.copy(), vec.copy()
        up[i] += eps
        down[i] -= eps
        numeric = (loss_and_grad(up)[0] - loss_and_grad(down)[0]) / (2 * eps)
        assert grad[i] == pytest.approx(numeric, rel=1e-4, abs=1e-6)


def test_csv_source_failfast_rejects_bad_numbers(spark, tmp_path):
    from pyspark.sql import types as T
    p = tmp_path / "bad.csv"
    p.write_text("a\n1.5\nnot-a-number\n")
    schema = T.StructType([T.StructField("a", T.DoubleType())])
    assert [r.a for r in IO.read_csv(spark, str(p), schema).collect()] == [1.5, None]
    with pytest.raises(Exception):
        IO.read_csv(spark, str(p), schema, mode="FAILFAST").collect()


@pytest.mark.parametrize("kind,output", [("sigmoid", "sigmoid"), ("relu", "sigmoid"), ("sigmoid", "softmax2")])
def test_batched_scoring_equals_compiled(spark, kind, output):
    shallow, deep = SC.rule_weights([3, 5, 2 if output == "softmax2" else 1]), SC.rule_weights(
        [3, *[12] * 8, 2 if output == "softmax2" else 1], scale=1.6)
    rng = np.random.default_rng(2)
    rows = [(i, *[float(v) for v in rng.normal(0, 3, 3)], "k") for i in range(200)]
    rows += [(900, None, 1.0, 2.0, "k"), (901, float("nan"), 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, `b.c` double, d double, note string")
    for net in (shallow, deep):
        net.hidden_activation, net.output = kind, output
        compiled = SC.probability_columns(df, net, {"p": SC.feature_inputs(["a", "b.c", "d"])})
        batched = SC.batched_probabilities(df, {"p": net, "q": net}, ["a", "b.c", "d"])
        assert batched.columns == [*df.columns, "p", "q"]
        want = {r.id: r.p for r in compiled.collect()}
        for r in batched.collect():
            if r.id < 900:
                assert r.p == pytest.approx(want[r.id], abs=1e-12) and r.q == r.p
            else:
                assert r.p is None
    assert SC.n_weights(deep) > SC.COMPILED_WEIGHTS >= SC.n_weights(shallow)
    assert "MapInArrow" in SC.score(df, deep, ["a", "b.c", "d"])._jdf.queryExecution().toString()
