"""Missing values, column order and unlisted classes: cases that clean fixtures
never show."""

import math

import pytest
from pyspark.sql import types as T

from riskframe.operators import encoders as E
from riskframe.operators import metrics as M
from riskframe.operators import profile as PR
from riskframe.operators import sampling as S
from riskframe.plans import jobs
from riskframe.sources import io as IO
from riskframe.sources.tables import loans

from conftest import SF001

AB = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType())])


def test_csv_columns_by_name(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("b,more,a\nx,1,1.5\ny,2,2.5\n")
    df = IO.read_csv(spark, str(p), AB)
    assert df.columns == ["a", "b"] and df.count() == 2
    assert sorted(map(tuple, df.collect())) == [(1.5, "x"), (2.5, "y")]


def test_csv_absent_column_fails(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("b,c\nx,1\n")
    with pytest.raises(ValueError, match="lacks"):
        IO.read_csv(spark, str(p), AB)


def test_csv_files_with_unlike_headers_fail(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.csv").write_text("a,b\n1.5,x\n")
    (tmp_path / "d" / "2.csv").write_text("b,a\ny,2.5\n")
    with pytest.raises(Exception, match="(?i)header"):
        IO.read_csv(spark, str(tmp_path / "d"), AB).collect()


def test_csv_corrupt_records_show(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b\n1.5,x\nmany,y\n")
    rows = IO.read_csv(spark, str(p), AB, corrupt="raw").collect()
    assert [(r.a, r.b, r.raw) for r in rows] == [(1.5, "x", None), (None, "y", "many,y")]


NULLS = [(1, 1, 0.9), (0, 0, 0.2), (1, None, None), (0, None, None)]


def test_null_predictions_are_errors(spark):
    df = spark.createDataFrame(NULLS, "label int, prediction int, probability double")
    r = M.accuracy(df).collect()[0]
    assert (r.n, r.accuracy) == (4, 0.5)
    cm = {(x.actual, x.predicted): x["count"] for x in M.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 1, (0, None): 1, (1, None): 1}
    rep = {x.label: x for x in M.classification_report(df, labels=[0, 1]).collect()}
    assert rep["accuracy"].support == 4 and rep["accuracy"].f1 == 0.5
    assert rep["1"].support == 2 and rep["1"].recall == 0.5 and rep["1"].precision == 1.0
    b = M.binary_cross_entropy(df).collect()[0]
    assert b.n == 2 and b.bce == pytest.approx(-(math.log(0.9) + math.log(0.8)) / 2)
    ev = M.evaluate_by(df.selectExpr("*", "'t' AS split")).where("split = 'all'").collect()[0]
    assert (ev.n, ev.accuracy, ev.tp, ev.tn, ev.fp, ev.fn) == (4, 0.5, 1, 1, 0, 0)


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0, "x"), (-0.0, "x"), (1.5, None)], "a double, s string")
    got = {r.column: r.n_distinct for r in PR.distinct_counts(df).collect()}
    assert got == {"a": 2, "s": 1}
    assert PR.distinct_values(df).where("column = 'a'").count() == 2


def test_crosstab_finds_every_class(spark):
    df = spark.createDataFrame([("g", 0), ("g", 1), ("g", 2), ("g", 2), ("g", None)],
                               "g string, y int")
    r = PR.crosstab(df, "g", "y").collect()[0]
    assert (r.n_0, r.n_1, r.n_2) == (1, 1, 2)
    p = PR.crosstab_percent(df, ["g"], "y").collect()[0]
    assert (p.pct_0, p.pct_1, p.pct_2) == (25.0, 25.0, 50.0)
    some = PR.crosstab_percent(df, ["g"], "y", values=[0, 1]).collect()[0]
    assert (some.pct_0, some.pct_1) == (25.0, 25.0)


def test_crosstab_over_the_pivot_limit_fails(spark):
    before = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        with pytest.raises(ValueError, match="more than 3"):
            PR.crosstab(spark.range(10).selectExpr("'g' AS g", "id AS y"), "g", "y")
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", before)


def test_one_hot_of_numbers_in_number_order(spark):
    df = spark.range(12).selectExpr("id AS c")
    assert E.fit_one_hot(df, ["c"]).output_columns() == [f"c_{i}" for i in range(12)]


def test_null_key_fails(spark):
    df = spark.createDataFrame([(1, 0), (None, 0), (3, 1)], "id int, y int")
    with pytest.raises(Exception, match="no key"):
        S.balanced_undersample(df, "y", "id").collect()


@pytest.mark.parametrize("balance", [True, False])
def test_saved_bundle_with_the_key_as_feature(spark, tmp_path, balance):
    df = loans(spark, SF001)
    out = str(tmp_path / "raw")
    res = jobs.train_and_evaluate(df, out, preset="raw_with_id", balance=balance,
                                  configs=[{"hidden": [3]}], rounds=1, iters_per_round=10)
    ev = {r.split: r for r in jobs.evaluate_saved(df, f"{out}/model").collect()}
    assert ev["test"].accuracy == pytest.approx(res["results"].collect()[0].test_accuracy)
    if not balance:
        from riskframe import presets as P
        from riskframe.operators.filters import outlier_filter
        assert ev["all"].n == outlier_filter(df, P.OUTLIER_BOUNDS).count()
