"""Readers and writers.

All paths go through Spark's data sources, so they may be any filesystem the
cluster mounts (shared storage, object stores); nothing is written on the
driver's local disk.
"""

from __future__ import annotations

import json
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import presets as P

log = logging.getLogger("riskframe")

# Text markers read as missing in string columns (pandas' default NA markers).
NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
              "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
              "nan", "null"]

HISTORY_SCHEMA = ("run_id string, epoch int, train_loss double, val_loss double, "
                  "train_accuracy double, val_accuracy double")


def read_csv(spark: SparkSession, path: str, schema: T.StructType = P.LOAN_SCHEMA,
             mode: str = "PERMISSIVE", corrupt: str | None = None) -> DataFrame:
    """Header CSV with an explicit schema (no inference pass).

    Columns are taken by their name in the header, in any order; further
    columns of the file are left out, a column that the header lacks raises
    at once, and a file whose header differs from the first file's fails the
    job.  Unparsable or empty numeric fields become NULL (PERMISSIVE) or fail
    the job (FAILFAST); ``corrupt`` names a further column that holds the raw
    line of a record that could not be parsed (else NULL).  NaN is folded into
    NULL; NA text markers in string columns become NULL.  A missing path
    raises at once (S2)."""
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException:
        log.error("cannot read %s", path)
        raise
    absent = [f.name for f in schema.fields if f.name not in header]
    if absent:
        raise ValueError(f"{path}: the header lacks the columns {absent}")
    wanted = {f.name: f.dataType for f in schema.fields}
    in_file = T.StructType([T.StructField(n, wanted.get(n, T.StringType())) for n in header])
    reader = (spark.read.option("header", True).option("mode", mode)
              .option("enforceSchema", False)
              .option("nullValue", "").option("nanValue", "NaN"))
    names = list(wanted)
    if corrupt is not None:
        in_file = in_file.add(corrupt, T.StringType())
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
        names.append(corrupt)
    df = reader.schema(in_file).csv(path).select(*[F.col(f"`{n}`") for n in names])
    fixes = {}
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            fixes[f.name] = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c)
        elif isinstance(f.dataType, T.StringType):
            fixes[f.name] = F.when(c.isin(NA_STRINGS), F.lit(None).cast("string")).otherwise(c)
    return df.withColumns(fixes)


def write_history(df: DataFrame, path: str, mode: str = "append") -> None:
    """S3 sink: one row per epoch/round."""
    df.write.mode(mode).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """S3 source; an absent history is an empty table, not an error."""
    try:
        return spark.read.schema(HISTORY_SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], HISTORY_SCHEMA)


def write_report(df: DataFrame, path: str) -> None:
    """A classification report table as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append this run's result rows."""
    df.write.mode("append").parquet(path)


def save_model(spark: SparkSession, path: str, parts: dict) -> None:
    """Persist a fitted bundle (network weights, scaler, encoders - each a
    JSON string) as a one-row table; the bundle is a few KB."""
    rows = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in parts.items()]
    spark.createDataFrame(rows, "part string, payload string").coalesce(1) \
        .write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return {r["part"]: r["payload"] for r in spark.read.parquet(path).collect()}
