"""ML stages, evaluation cubes, row numbers and low-discrepancy designs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from riskframe.functions.ranking import row_numbers
from riskframe.operators import metrics as M
from riskframe.operators import scoring as SC
from riskframe.operators import sensitivity as Y
from riskframe.operators import stages as ST

from test_models import _xor_frame


def test_pipeline_is_fitted_saved_and_loaded(spark, tmp_path):
    data = _xor_frame(spark, 600).withColumn("id", F.xxhash64("x1", "x2")).withColumn(
        "c", F.when(F.col("x1") > 0, "up").otherwise("down"))
    cols = ["x1", "x2", "c"]
    chain = Pipeline(stages=[
        ST.LabelDictionaryEstimator(columns=["c"]), ST.StandardizationEstimator(columns=cols),
        ST.DenseNetworkEstimator(columns=cols, label="y", hidden=[8, 8],
                                 limits='{"epochs": 8, "batch": 32, "lr": 0.02}')])
    fitted = chain.fit(data)
    path = str(tmp_path / "chain")
    fitted.write().overwrite().save(path)
    back = PipelineModel.load(path)
    want = {r.id: (r.probability, r.prediction) for r in fitted.transform(data).collect()}
    assert {r.id: (r.probability, r.prediction) for r in back.transform(data).collect()} == want
    assert [s.uid for s in back.stages] == [s.uid for s in fitted.stages]
    right = sum(w[1] == r.y for r in data.collect() for w in [want[r.id]])
    assert right > 0.6 * len(want)
    Pipeline(stages=chain.getStages()).write().overwrite().save(str(tmp_path / "unfitted"))
    again = Pipeline.load(str(tmp_path / "unfitted")).getStages()
    assert again[0].getColumns() == ["c"] and again[2].getOrDefault(again[2].hidden) == [8, 8]


def test_stage_options_survive(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "c string")
    strict = ST.LabelDictionaryEstimator(columns=["c"], handleInvalid="error").fit(df)
    strict.write().overwrite().save(str(tmp_path / "d"))
    with pytest.raises(Exception, match="unseen"):
        ST.LabelDictionaryModel.load(str(tmp_path / "d")).transform(
            spark.createDataFrame([("z",)], "c string")).collect()
    net = ST.DenseNetworkModel(columns=["a"], network=SC.rule_weights([1, 2, 1]).to_json(), threshold=0.9)
    net.write().overwrite().save(str(tmp_path / "n"))
    out = ST.DenseNetworkModel.load(str(tmp_path / "n")).transform(
        spark.createDataFrame([(0.0,)], "a double")).first()
    assert out.prediction == int(out.probability >= 0.9)


def test_cube_gives_the_reports_of_each_population(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b"]), rng.choice([0, 1, 2, None]), rng.choice([0, 1, 1, 2, None]))
            for _ in range(400)]
    df = spark.createDataFrame(rows, "split string, label int, prediction int")
    cube = M.evaluation_cube(df)
    for pop in ("a", "b", "all"):
        own = df if pop == "all" else df.where(F.col("split") == pop)
        own = own.where("label IS NOT NULL")
        want = {r.label: r for r in M.classification_report(own, labels=[0, 1, 2]).collect()}
        got = {r.label: r for r in M.cube_report(cube).where(F.col("split") == pop).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert r.support == want[k].support and r.f1 == pytest.approx(want[k].f1)
            assert (r.precision, r.recall) == pytest.approx((want[k].precision, want[k].recall))
        cells = Counter({(r.actual, r.predicted): r["count"] for r in
                         M.confusion_matrix(own, labels=[0, 1, 2]).collect()})
        got = {(r.actual, r.predicted): r["count"] for r in
               M.cube_confusion(cube).where(F.col("split") == pop).collect()}
        assert got == cells
    assert M.cube_report(M.evaluation_cube(df.limit(0))).count() == 0
    sums = M.cube_confusion(cube).groupBy("split", "actual").agg(F.sum("fraction").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)


def test_row_numbers_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 3).alias("g"))
    got = row_numbers(df, ["k"], rows_per_task=100).collect()
    assert [r.number for r in sorted(got, key=lambda r: r.k)] == list(range(1000))
    by = row_numbers(df.withColumn("g", F.when(F.col("g") > 0, F.col("g"))), ["k"], ["g"], "n",
                     rows_per_task=70).collect()
    for g in (None, 1, 2):
        own = sorted((r for r in by if r.g == g), key=lambda r: r.k)
        assert [r.n for r in own] == list(range(len(own)))
    assert row_numbers(df.limit(0), ["k"]).count() == 0


def test_halton_points(spark):
    def mirrored(i, b):
        out, f = 0.0, 1.0 / b
        while i:
            out, i, f = out + f * (i % b), i // b, f / b
        return out
    rows = Y.halton_design(spark.range(300).withColumn("id", 5 * F.col("id")), "id", 3).collect()
    for n, r in enumerate(sorted(rows, key=lambda r: r.id), 1):
        want = [mirrored(n, p) for p in (2, 3, 5, 7, 11, 13)]
        assert [r.a_0, r.a_1, r.a_2, r.b_0, r.b_1, r.b_2] == pytest.approx(want, abs=1e-14)
    assert Y.halton_design(spark.range(0), "id", 2).count() == 0


def test_lattice_points(spark):
    rows = Y.lattice_design(spark.range(101), "id", 2).collect()
    for r in rows:
        for j, x in enumerate((r.a_0, r.a_1, r.b_0, r.b_1)):
            assert x == pytest.approx(((r.id + 0.5) * pow(76, j, 101) / 101) % 1, abs=1e-12)
    assert len({r.a_1 for r in rows}) == 101


def test_low_discrepancy_designs_are_closer_to_ishigami(spark):
    prob = Y.Problem(["x1", "x2", "x3"], [(-math.pi, math.pi)] * 3)
    want = np.array([.3139, .5576, .4424, .4424, 0.0, .2437])

    def error(design):
        out = Y.evaluate_design(design, "id", prob, Y.ishigami())
        got = {r.feature: (r.s1, r.st) for r in Y.sobol_indices(out, prob.names).collect()}
        return np.abs(np.array([v for f in prob.names for v in got[f]]) - want).mean()

    base = spark.range(4096)
    assert error(Y.halton_design(base, "id", 3)) < error(Y.saltelli_design(base, "id", 3))


def test_points_as_rows_equal_the_compiled_design(spark):
    net = SC.rule_weights([3, 4, 1])
    prob = Y.Problem(["a", "b.c", "d"], [(0.0, 2.0), (-1.0, 1.0), (5.0, 6.0)])
    design = Y.saltelli_design(spark.range(60), "id", 3)
    want = {r.id: r.asDict() for r in Y.evaluate_design(design, "id", prob, net).collect()}
    stage = ST.DenseNetworkModel(columns=prob.names, network=net.to_json())
    got = Y.evaluate_design_long(design, "id", prob, stage.transform).collect()
    assert len(got) == 60
    for r in got:
        assert r.asDict() == pytest.approx(want[r.id], abs=1e-12)


def test_one_hot_vectors(spark):
    from riskframe.operators import encoders as E
    rows = [("b", 10, "x"), ("a", 9, "x"), (None, None, "x"), ("b", 9, "x")]
    df = spark.createDataFrame(rows, "c string, `n.o` int, V string")
    out = E.one_hot_vector(df, ["c", "n.o"], "v")
    got = {(r["c"], r["n.o"]): (r.v.size, r.v.indices, r.v["values"]) for r in out.collect()}
    assert out.columns == ["c", "n.o", "v"]
    assert got == {("b", 10): (4, [1, 2], [1.0, 1.0]), ("a", 9): (4, [0, 3], [1.0, 1.0]),
                   (None, None): (4, [], []), ("b", 9): (4, [1, 3], [1.0, 1.0])}
    vectors = {r["c"]: r.v for r in E.as_ml_vector(out, "v").collect()}
    assert vectors["a"].toArray().tolist() == [1.0, 0.0, 0.0, 1.0]
    wide = spark.range(20_000)
    assert E.one_hot_vector(wide, ["id"]).select("one_hot.size").first()[0] == 20_000
