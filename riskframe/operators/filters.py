"""Projections and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)

_KINDS = {
    "numeric": NUMERIC_TYPES,
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "string": (T.StringType,),
    "bool": (T.BooleanType,),
}


def columns_of(df: DataFrame, include: Sequence[str] = ("numeric",),
               exclude: Sequence[str] = ()) -> list[str]:
    """Column names whose type is one of the kinds in ``include``."""
    wanted = tuple(t for k in include for t in _KINDS[k])
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, wanted) and f.name not in exclude]


def select_dtypes(df: DataFrame, include: Sequence[str] = ("numeric",),
                  exclude: Sequence[str] = ()) -> DataFrame:
    """Select columns by type kind."""
    return df.select(*columns_of(df, include, exclude))


def select_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fixed-order feature selection."""
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Sequence[str], errors: str = "raise") -> DataFrame:
    """Drop columns (P1).  Strict by default: unknown names raise, duplicates
    in ``cols`` are tolerated; ``errors="ignore"`` skips unknown names."""
    names = list(dict.fromkeys(cols))
    missing = [c for c in names if c not in df.columns]
    if missing and errors == "raise":
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*[c for c in names if c in df.columns])


def outlier_filter(df: DataFrame, bounds: Mapping[str, float]) -> DataFrame:
    """Keep rows where every ``column <= bound`` (F1).

    A NULL or NaN value fails its comparison, so the row is dropped.  Plain
    comparisons with literals push down to the parquet scan.
    """
    conds = []
    for c, bound in bounds.items():
        x = F.col(c)
        cond = x.isNotNull() & (x <= F.lit(bound))
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            cond = cond & ~F.isnan(x)
        conds.append(cond)
    return df.where(reduce(lambda a, b: a & b, conds))


def require_target(df: DataFrame, target: str) -> None:
    """Raise when the target column is absent (F2)."""
    if target not in df.columns:
        raise ValueError(f"target column '{target}' is not in the table")


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows that are NULL/NaN and rows that are +-infinity.

    One aggregation pass; long output ``(column, n_missing, n_infinite)``.
    """
    cols = list(cols) if cols is not None else columns_of(df)
    aggs = []
    for c in cols:
        x = F.col(c)
        is_float = isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
        miss = (x.isNull() | F.isnan(x)) if is_float else x.isNull()
        inf = (F.abs(x) == F.lit(float("inf"))) if is_float else F.lit(False)
        aggs += [F.count_if(miss).alias(f"m{len(aggs)}"),
                 F.count_if(F.coalesce(inf, F.lit(False))).alias(f"m{len(aggs) + 1}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', m{2 * i}, m{2 * i + 1}" for i, c in enumerate(cols))
    return wide.selectExpr(
        f"stack({len(cols)}, {stack}) AS (column, n_missing, n_infinite)").select(
        "column", F.col("n_missing").cast("bigint"), F.col("n_infinite").cast("bigint"))
