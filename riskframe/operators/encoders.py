"""Fitted encoders.

Scalers and one-hot columns are fitted by one aggregation and applied as pure
Column arithmetic.  Label dictionaries are tables applied by a join
(:mod:`riskframe.operators.dictionaries`); a dictionary that is given as a
parameter is a literal map.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.dictionaries import LabelDictionary, fit_label_dictionary


@dataclass
class LabelEncoding:
    """Label encoder with given dictionaries (E1): ``classes[c]`` lists the values
    of column ``c`` in the order of their codes.  NULL and (with
    ``handle_invalid="keep"``) unseen values get code ``k``; with ``"error"`` an
    unseen non-NULL value fails the task."""

    classes: dict[str, list[str]] = field(default_factory=dict)
    handle_invalid: str = "keep"

    def transform(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        exprs = {}
        for c in cols if cols is not None else self.classes:
            values = self.classes[c]
            pairs = [x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))]
            code = F.create_map(*pairs)[F.col(c).cast("string")] if pairs else F.lit(None)
            if self.handle_invalid == "error":
                unseen = F.col(c).isNotNull() & code.isNull()
                code = F.when(unseen, F.raise_error(F.concat(
                    F.lit(f"unseen label in {c}: "), F.col(c).cast("string")))).otherwise(code)
            exprs[c] = F.coalesce(code, F.lit(len(values))).cast("int")
        return df.withColumns(exprs)

    def to_json(self) -> str:
        return json.dumps({"classes": self.classes, "handle_invalid": self.handle_invalid})

    @classmethod
    def from_json(cls, s: str) -> "LabelEncoding":
        d = json.loads(s)
        return cls(d["classes"], d["handle_invalid"])


def fit_label_encoder(df: DataFrame, cols: Sequence[str],
                      handle_invalid: str = "keep") -> LabelDictionary:
    """Fit E1 on ``cols`` (string or boolean columns; values compared as text)."""
    return fit_label_dictionary(df, cols, handle_invalid)


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fit and apply E1 (booleans are cast to 0/1 first)."""
    df = _bools_to_int(df, cols)
    strings = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    return fit_label_encoder(df, strings).transform(df)


def _bools_to_int(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    bools = {c: F.col(c).cast("int") for c in cols
             if isinstance(df.schema[c].dataType, T.BooleanType)}
    return df.withColumns(bools) if bools else df


@dataclass
class OneHotEncoding:
    """Fitted one-hot encoder (E2): one 0/1 column ``<col>_<value>`` per value,
    sorted as numbers for a numeric column and as text for others; NULL or unseen -> all zeros; the source column is removed."""

    categories: dict[str, list[str]] = field(default_factory=dict)

    def output_columns(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.categories.items() for v in vs]

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {}
        for c, values in self.categories.items():
            for v in values:
                exprs[f"{c}_{v}"] = F.coalesce(F.col(c).cast("string") == F.lit(v),
                                               F.lit(False)).cast("int")
        return df.withColumns(exprs).drop(*self.categories)


def fit_one_hot(df: DataFrame, cols: Sequence[str]) -> OneHotEncoding:
    """The categories of ``cols``; each becomes a column, so a column with more
    of them than Spark allows a pivot (``spark.sql.pivotMaxValues``) is an error
    (:func:`one_hot_vector` has no such bound)."""
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    rows = (df.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, value)")
            .where(F.col("value").isNotNull()).distinct().limit(most * len(cols) + 1).collect())
    values: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        values[r["column"]].append(r["value"])
    too_wide = {c: len(v) for c, v in values.items() if len(v) > most}
    if too_wide:
        raise ValueError(f"one-hot would create too many columns: {too_wide}")
    numeric = {c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)}
    return OneHotEncoding({c: sorted(values[c], key=Decimal if c in numeric else None)
                           for c in cols})


def one_hot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fit_one_hot(df, cols).transform(df)


def one_hot_vector(df: DataFrame, cols: Sequence[str], output: str = "one_hot",
                   dictionary: LabelDictionary | None = None) -> DataFrame:
    """``df`` plus one sparse vector of all of ``cols``: the values of a column, in
    the order of their codes, follow those of the columns before it.  NULL and
    unseen values add nothing.  The width is the number of values altogether,
    which only the vector type bounds; a row stores one entry per column.

    The vector is a struct (size, indices, values) of ascending indices, as Spark
    ML's sparse vectors are; :func:`as_ml_vector` turns it into one."""
    fitted = dictionary or fit_label_dictionary(df, cols)
    names, codes = df.columns, []
    at = 0
    for i, c in enumerate(cols):
        part = fitted.of(c).select(F.col("value").alias(f"__value{i}"), F.col("code").alias(f"__code{i}"))
        df = df.join(part, F.col(f"`{c}`").cast("string") == F.col(f"__value{i}"), "left")
        codes.append((F.col(f"__code{i}") + at).cast("int"))
        at += fitted.sizes[c]
    indices = F.filter(F.array(*codes), lambda x: x.isNotNull())
    vector = F.struct(F.lit(at).alias("size"), indices.alias("indices"),
                      F.transform(indices, lambda x: F.lit(1.0)).alias("values"))
    kept = [F.col(f"`{n}`") for n in names if n.lower() != output.lower()]
    return df.select(*kept, vector.alias(output))


def as_ml_vector(df: DataFrame, column: str) -> DataFrame:
    """The sparse struct of :func:`one_hot_vector` as a Spark ML vector."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    @F.udf(VectorUDT())
    def vector(v):
        return None if v is None else Vectors.sparse(v["size"], v["indices"], v["values"])

    return df.withColumn(column, vector(F.col(f"`{column}`")))


@dataclass
class Standardization:
    """Fitted standard scaler (E4): ``(x - mean) / std`` with the population
    std; a zero (or undefined) std divides by 1.  NULL stays NULL."""

    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)

    def column(self, c: str, source=None):
        x = (F.col(c) if source is None else source).cast("double")
        s = self.std[c]
        s = 1.0 if (s is None or s == 0.0) else s
        m = self.mean[c] if self.mean[c] is not None else 0.0
        return (x - F.lit(m)) / F.lit(s)

    def transform(self, df: DataFrame, cols: Sequence[str] | None = None,
                  suffix: str = "") -> DataFrame:
        cols = list(cols) if cols is not None else list(self.mean)
        return df.withColumns({f"{c}{suffix}": self.column(c) for c in cols})

    def to_json(self) -> str:
        return json.dumps({"mean": self.mean, "std": self.std})

    @classmethod
    def from_json(cls, s: str) -> "Standardization":
        d = json.loads(s)
        return cls(d["mean"], d["std"])


def fit_standard_scaler(df: DataFrame, cols: Sequence[str]) -> Standardization:
    """One aggregation pass for every column (mean and population std)."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggs).collect()[0]
    return Standardization({c: row[f"m{i}"] for i, c in enumerate(cols)},
                           {c: row[f"s{i}"] for i, c in enumerate(cols)})


def assemble(df: DataFrame, cols: Sequence[str], output: str = "features",
             handle_invalid: str = "error") -> DataFrame:
    """Feature matrix as one vector column, column order fixed (E5)."""
    return VectorAssembler(inputCols=list(cols), outputCol=output,
                           handleInvalid=handle_invalid).transform(df)
