"""Evaluation metrics on a scored table (V1-V8).

Everything aggregates to (class x class) counts first - a partial aggregation
that leaves a handful of rows per task - and derives the metrics from those
counts, so evaluating a billion predictions costs one scan.

Missing values: a row without a truth label is not evaluated.  A NULL
prediction is an error of its row: it counts towards ``n`` and the support, is
never correct, and shows in the confusion matrix as ``predicted`` NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


MAX_CLASSES = 1_000


def _labels(df: DataFrame, label: str, prediction: str, labels: Sequence | None) -> list:
    """The class labels (given, or the distinct values of truth and
    prediction - a bounded list; the k x k grid is built from it)."""
    if labels is not None:
        return sorted(labels)
    vals = (df.select(F.col(label).alias("v")).union(df.select(F.col(prediction).alias("v")))
            .distinct().limit(MAX_CLASSES + 1).collect())
    if len(vals) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return sorted(r["v"] for r in vals if r["v"] is not None)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     labels: Sequence | None = None) -> DataFrame:
    """Long confusion matrix ``(actual, predicted, count)``, every label pair
    present (zeros filled); rows are truth, columns prediction (V1).  Rows
    without a prediction add a line with ``predicted`` NULL per truth label
    that has some."""
    labs = _labels(df, label, prediction, labels)
    counts = df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    dtype = df.schema[label].dataType
    grid = df.sparkSession.createDataFrame(
        [(a, p) for a in labs for p in [*labs, None]],
        T.StructType([T.StructField("a", dtype), T.StructField("p", dtype)]))
    # counts has at most (labels + 1)^2 rows: broadcast it
    on = (F.col("a") == F.col("actual")) & F.col("p").eqNullSafe(F.col("predicted"))
    return (grid.join(F.broadcast(counts), on, "left")
            .where(F.col("p").isNotNull() | F.col("n").isNotNull())
            .select(F.col("a").alias("actual"), F.col("p").alias("predicted"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("count")))


def confusion_normalized(df: DataFrame, label: str = "label", prediction: str = "prediction",
                         labels: Sequence | None = None) -> DataFrame:
    """Row-normalised confusion matrix: each truth row sums to 1; an empty row
    is all 0 (V2)."""
    cm = confusion_matrix(df, label, prediction, labels)
    row = cm.groupBy("actual").agg(F.sum("count").alias("row_total"))
    return cm.join(row, "actual").select(
        "actual", "predicted",
        F.coalesce(F.try_divide(F.col("count").cast("double"), F.col("row_total").cast("double")),
                   F.lit(0.0)).alias("fraction"))


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          labels: Sequence | None = None) -> DataFrame:
    """Per-class precision, recall, f1, support, then ``accuracy`` (in the f1
    column), ``macro avg`` and ``weighted avg`` rows; 0/0 counts as 0 (V3).
    Columns ``(label, precision, recall, f1, support)``, label as text."""
    cm = confusion_matrix(df, label, prediction, labels)
    tp = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0))
    per_actual = cm.groupBy(F.col("actual").alias("cls")).agg(
        tp.alias("tp"), F.sum("count").alias("support"))
    per_pred = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("count").alias("pred_n"))
    per = per_actual.join(per_pred, "cls").select(
        F.col("cls").cast("string").alias("label"),
        _safe(F.col("tp"), F.col("pred_n")).alias("precision"),
        _safe(F.col("tp"), F.col("support")).alias("recall"),
        F.col("support").cast("bigint").alias("support"), F.col("tp"))
    per = per.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"),
                                     F.col("precision") + F.col("recall")))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
                  F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    cols = ["label", "precision", "recall", "f1", "support"]
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     _safe(F.col("tp"), F.col("n")).alias("f1"), F.col("n").cast("bigint").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                       F.col("n").cast("bigint").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"),
                          _safe(F.col("wp"), F.col("n")).alias("precision"),
                          _safe(F.col("wr"), F.col("n")).alias("recall"),
                          _safe(F.col("wf"), F.col("n")).alias("f1"),
                          F.col("n").cast("bigint").alias("support"))
    return per.select(*cols).unionByName(acc).unionByName(macro).unionByName(weighted)


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(n, accuracy)`` = mean(prediction == label) over the labelled rows; a
    NULL prediction is an error (V4)."""
    return df.agg(F.count(F.col(label)).cast("bigint").alias("n"),
                  F.avg(_correct(label, prediction)).alias("accuracy"))


def _correct(label: str, prediction: str) -> Column:
    """1.0 or 0.0 for a labelled row, NULL without a label."""
    right = F.coalesce(F.col(prediction) == F.col(label), F.lit(False))
    return F.when(F.col(label).isNotNull(), right.cast("double"))


def bce_column(label: str, probability: str, eps: float = 1e-7) -> Column:
    given = F.col(probability)          # least and greatest would skip a NULL
    p = F.when(given.isNotNull(), F.least(F.greatest(given, F.lit(eps)), F.lit(1.0 - eps)))
    y = F.col(label).cast("double")
    return -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))


def binary_cross_entropy(df: DataFrame, label: str = "label", probability: str = "probability",
                         eps: float = 1e-7) -> DataFrame:
    """``(n, bce)`` = -mean(y ln p + (1-y) ln(1-p)), p clipped to [eps, 1-eps]
    (V5).  ``n`` counts the rows that the mean is taken over: those with a
    label and a probability."""
    loss = bce_column(label, probability, eps)
    return df.agg(F.count(loss).cast("bigint").alias("n"), F.avg(loss).alias("bce"))


def evaluate_by(df: DataFrame, by: str = "split", label: str = "label",
                prediction: str = "prediction", probability: str = "probability",
                overall: str = "all") -> DataFrame:
    """Per-group and overall metrics in one pass (grouping sets (by), ()):
    ``(by, n, accuracy, bce, tp, fp, tn, fn)``; the overall row has
    ``by = overall`` (V8).  ``n`` counts the labelled rows; those without a
    prediction are in none of the four cells and count as errors."""
    y, p = F.col(label), F.col(prediction)
    agg = df.rollup(by).agg(
        F.grouping(by).alias("__g"),
        F.count(y).cast("bigint").alias("n"),
        F.avg(_correct(label, prediction)).alias("accuracy"),
        F.avg(bce_column(label, probability)).alias("bce"),
        F.count_if((y == 1) & (p == 1)).cast("bigint").alias("tp"),
        F.count_if((y == 0) & (p == 1)).cast("bigint").alias("fp"),
        F.count_if((y == 0) & (p == 0)).cast("bigint").alias("tn"),
        F.count_if((y == 1) & (p == 0)).cast("bigint").alias("fn"))
    return agg.select(F.when(F.col("__g") == 1, F.lit(overall)).otherwise(F.col(by)).alias(by),
                      "n", "accuracy", "bce", "tp", "fp", "tn", "fn")


def evaluation_cube(df: DataFrame, by: str = "split", label: str = "label",
                    prediction: str = "prediction", overall: str = "all") -> DataFrame:
    """``(by, actual, predicted, count)`` of every population and of all rows
    together (``by = overall``), in one scan: rows are counted per (by, actual,
    predicted), and these few counts are added up again.  Rows without a truth
    label are left out; a missing prediction is ``predicted`` NULL (V8)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(
        F.col(by).cast("string").alias(by), F.col(label).alias("actual"),
        F.col(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn(by, F.explode(F.array(by, F.lit(overall)))).groupBy(
        by, "actual", "predicted").agg(F.sum("count").cast("bigint").alias("count"))


def _classes(cube: DataFrame, by: str) -> DataFrame:
    """``(by, class)``: in every population the classes that occur in any."""
    values = cube.select(F.explode(F.array("actual", "predicted")).alias("class")).where(
        F.col("class").isNotNull()).distinct()
    return cube.select(by).distinct().join(F.broadcast(values))     # populations x classes


def cube_confusion(cube: DataFrame, by: str = "split") -> DataFrame:
    """Confusion matrices of all populations of a cube, zeros filled:
    ``(by, actual, predicted, count, fraction)``, ``fraction`` of the truth row."""
    grid = _classes(cube, by).withColumnRenamed("class", "actual")
    grid = grid.join(_classes(cube, by).withColumnRenamed("class", "predicted"), by)
    full = grid.join(cube, [by, "actual", "predicted"], "left").unionByName(
        cube.where(F.col("predicted").isNull()))
    rows = cube.groupBy(by, "actual").agg(F.sum("count").alias("__row"))
    return full.join(rows, [by, "actual"], "left").select(
        by, "actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        _safe(F.coalesce("count", F.lit(0)), F.col("__row")).alias("fraction"))


def cube_report(cube: DataFrame, by: str = "split") -> DataFrame:
    """Classification reports of all populations of a cube (V3): ``(by, label,
    precision, recall, f1, support)`` with the rows ``accuracy`` (in the f1
    column), ``macro avg`` and ``weighted avg``; 0/0 counts as 0."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)
    truth = cube.groupBy(by, F.col("actual").alias("class")).agg(
        F.sum("count").alias("support"), F.sum(hit).alias("tp"))
    said = cube.where(F.col("predicted").isNotNull()).groupBy(
        by, F.col("predicted").alias("class")).agg(F.sum("count").alias("said"))
    per = (_classes(cube, by).join(truth, [by, "class"], "left").join(said, [by, "class"], "left")
           .na.fill(0, ["support", "tp", "said"])
           .withColumn("precision", _safe(F.col("tp"), F.col("said")))
           .withColumn("recall", _safe(F.col("tp"), F.col("support")))
           .withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"),
                                   F.col("precision") + F.col("recall"))))
    none, names = F.lit(None).cast("double"), ["precision", "recall", "f1"]
    total = per.groupBy(by).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[F.sum(F.col(c) * F.col("support")).alias(f"w_{c}") for c in names])
    lines = F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), none.alias("precision"), none.alias("recall"),
                 _safe(F.col("tp"), F.col("n")).alias("f1")),
        F.struct(F.lit("macro avg").alias("label"), *[F.col(f"m_{c}").alias(c) for c in names]),
        F.struct(F.lit("weighted avg").alias("label"),
                 *[_safe(F.col(f"w_{c}"), F.col("n")).alias(c) for c in names])))
    support = F.col("support").cast("bigint").alias("support")
    return per.select(by, F.col("class").cast("string").alias("label"), *names, support).unionByName(
        total.select(by, lines.alias("r"), F.col("n").alias("support")).select(
            by, "r.label", *[f"r.{c}" for c in names], support))


def best_configuration(results: DataFrame, metric: str = "accuracy",
                       order: str = "config_idx") -> DataFrame:
    """The configuration with the highest metric; ties go to the first (V7)."""
    return results.orderBy(F.desc(metric), F.asc(order)).limit(1)
