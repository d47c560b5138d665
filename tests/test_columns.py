"""Edge-case literals for column functions, filters and encoders (FIXTURES F-7)."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskframe import presets as P
from riskframe.functions import columns as C
from riskframe.operators import encoders as E
from riskframe.operators import filters as FL


def test_right_closed_bins_edges(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.5,), (50.0,), (60.0,), (None,)], "x double")
    got = [r[0] for r in df.select(C.right_closed_bins("x", P.EMP_EDGES, P.EMP_LABELS)).collect()]
    assert got == [None, "<2", "2-5", ">20", None, None]


def test_label_code_order_with_null(spark):
    df = spark.createDataFrame([(v,) for v in ["<2", "2-5", "5-10", "10-20", ">20", None]],
                               "b string")
    enc = E.fit_label_encoder(df, ["b"])
    codes = dict(enc.transform(df.withColumn("orig", F.col("b"))).select("orig", "b").collect())
    assert codes == {"10-20": 0, "2-5": 1, "5-10": 2, "<2": 3, ">20": 4, None: 5}


def test_label_encoder_unseen(spark):
    fit_df = spark.createDataFrame([("a",), ("b",)], "c string")
    enc = E.fit_label_encoder(fit_df, ["c"])
    new = spark.createDataFrame([("b",), ("z",)], "c string")
    assert [r[0] for r in enc.transform(new).collect()] == [1, 2]
    strict = E.LabelEncoding(enc.classes, "error")
    with pytest.raises(Exception):
        strict.transform(new).collect()


def test_label_encoder_json_round_trip(spark):
    enc = E.LabelEncoding({"c": ["a", "b"]})
    assert E.LabelEncoding.from_json(enc.to_json()) == enc


def test_ratio_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a long, b long")
    assert [r[0] for r in df.select(C.ratio("a", "b")).collect()] == [None, 0.25]


def test_outlier_filter_drops_null_and_nan(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 10.0), (4, 61.0)],
                               "id long, person_emp_length double")
    kept = FL.outlier_filter(df, {"person_emp_length": 60})
    assert [r.id for r in kept.collect()] == [3]


def test_scale_constant_column_is_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    sc = E.fit_standard_scaler(df, ["x"])
    assert [r[0] for r in sc.transform(df).collect()] == [0.0, 0.0, 0.0]


def test_scale_uses_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    sc = E.fit_standard_scaler(df, ["x"])
    assert sc.std["x"] == pytest.approx(math.sqrt(1.25))
    assert E.Standardization.from_json(sc.to_json()) == sc


def test_threshold_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,)], "p double")
    assert [r[0] for r in df.select(C.threshold("p", 0.5)).collect()] == [1, 0]


def test_map_values_miss_is_null(spark):
    df = spark.createDataFrame([("A",), ("Z",)], "g string")
    got = [r[0] for r in df.select(C.map_values("g", P.GRADE_CODES)).collect()]
    assert got == [1, None]


def test_drop_strict_and_lenient(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    with pytest.raises(KeyError):
        FL.drop_columns(df, ["a", "zz"])
    assert FL.drop_columns(df, ["a", "zz", "a"], errors="ignore").columns == ["b"]


def test_select_dtypes(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True)], "a long, b double, c string, d boolean")
    assert FL.columns_of(df, ["numeric"]) == ["a", "b"]
    assert FL.columns_of(df, ["string", "bool"]) == ["c", "d"]


def test_one_hot_names_and_nulls(spark):
    df = spark.createDataFrame([("RENT",), ("OWN",), (None,)], "h string")
    oh = E.fit_one_hot(df, ["h"])
    out = oh.transform(df)
    assert out.columns == ["h_OWN", "h_RENT"]
    assert [tuple(r) for r in out.collect()] == [(0, 1), (1, 0), (0, 0)]


def test_missing_counts(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),)], "x double")
    r = FL.missing_counts(df, ["x"]).collect()[0]
    assert (r.n_missing, r.n_infinite) == (2, 1)


def test_spread_small_input_uses_all_cores(spark):
    from riskframe.session import input_bytes, spread
    df = spark.range(100).coalesce(1)
    assert input_bytes(df) is not None
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_cut_lineage_writes_to_checkpoint_folder(spark):
    from riskframe.session import checkpoint_dir, cut_lineage
    df = cut_lineage(spark.range(10).withColumnRenamed("id", "k"))
    assert df.count() == 10
    assert any(checkpoint_dir(spark).rstrip("/") in f or "riskframe-tables" in f
               for f in df.inputFiles())


def test_label_dictionary_equals_the_literal_map(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", None, "a", "d"]], "c string")
    fitted = E.fit_label_encoder(df, ["c"])
    inline = [r[0] for r in E.LabelEncoding(fitted.classes).transform(df).collect()]
    joined_df = fitted.transform(df.withColumn("k", F.lit(1)))
    assert joined_df.columns == ["c", "k"]
    assert sorted(r[0] for r in joined_df.collect()) == sorted(inline) == [0, 0, 1, 2, 3, 4]


def test_label_dictionary_over_several_ranges(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", "é", None, "_", "Z"]) and f"{rng.randint(0, 400)}", rng.choice("pqr"), None)
            for _ in range(2000)]
    df = spark.createDataFrame(rows, "a string, `b c` string, e string").repartition(3)
    fitted = E.fit_label_dictionary(df, ["a", "b c", "e"], "error", rows_per_task=60)
    want = [sorted({r[i] for r in rows if r[i] is not None}) for i in (0, 1)]
    assert fitted.classes == {"a": want[0], "b c": want[1], "e": []}
    fitted.save(str(tmp_path / "d"))
    for d in (fitted, E.LabelDictionary.load(spark, str(tmp_path / "d"))):
        got = Counter(map(tuple, d.transform(df).collect()))
        assert got == Counter((want[0].index(a) if a is not None else len(want[0]),
                               want[1].index(b), 0) for a, b, _ in rows)
    with pytest.raises(Exception, match="unseen"):
        fitted.transform(spark.createDataFrame([("none", "p", None)], df.schema)).collect()
    none = E.fit_label_dictionary(df.limit(0), ["a"])
    assert none.transform(df.select("a").limit(1)).first()[0] == 0


def test_label_dictionary_of_millions_of_values(spark):
    n = 3_000_000
    df = spark.range(n).select("id", F.lpad(F.col("id").cast("string"), 9, "0").alias("v"))
    fitted = E.fit_label_encoder(df, ["v"])
    assert fitted.sizes == {"v": n}
    r = fitted.transform(df).agg(F.count_if(F.col("id") == F.col("v")), F.count("*")).first()
    assert tuple(r) == (n, n)
