"""Table readers: the driver's parquet test tables and the ``loans`` fixture.

The ``loans`` fixture is a deterministic loan table derived from ``orders`` and
``customer`` (the column formulas are fixed so an independent SQL engine builds
the very same rows).  On real data, read the loan file with
:func:`riskframe.sources.io.read_csv` or ``spark.read.parquet`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import presets

TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
          "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Column formulas of the fixture (fixed values, shared with the SQL oracle).
_BASE_EXPRS = {
    "id": "o_orderkey",
    "person_age": "CAST(18 + c_custkey % 90 AS BIGINT)",
    "person_income": "CAST(floor(o_totalprice * 2.2) AS BIGINT)",
    "person_home_ownership": (
        "CASE WHEN c_custkey % 40 = 0 THEN 'OTHER' "
        "WHEN o_orderstatus = 'F' THEN 'RENT' "
        "WHEN o_orderstatus = 'O' THEN 'MORTGAGE' ELSE 'OWN' END"),
    "person_emp_length": (
        "CASE WHEN o_orderkey % 97 = 0 THEN NULL "
        "ELSE CAST((o_orderkey * 13) % 64 AS DOUBLE) END"),
    "loan_intent": "c_mktsegment",
    "loan_grade": "substr('ABCDEFG', CAST(1 + (o_orderkey * 7919) % 7 AS INT), 1)",
    "loan_amnt": "CAST(500 + 25 * ((o_orderkey * 31) % 1381) AS BIGINT)",
    "loan_int_rate": (
        "CASE WHEN o_orderkey % 89 = 0 THEN NULL "
        "ELSE CAST(50 + (o_orderkey * 17) % 310 AS DOUBLE) / CAST(10 AS DOUBLE) END"),
    "cb_person_default_on_file": "CASE WHEN (o_orderkey * 7) % 11 < 2 THEN 'Y' ELSE 'N' END",
    "cb_person_cred_hist_length": "CAST(2 + (c_custkey * 3) % 52 AS BIGINT)",
}
_DERIVED_EXPRS = {
    "loan_percent_income": "CAST(loan_amnt AS DOUBLE) / CAST(person_income AS DOUBLE)",
    "loan_status": (
        "CASE WHEN (id * 101) % 100 < 6 THEN 1 "
        "WHEN loan_grade >= 'E' AND loan_amnt * 10 > person_income THEN 1 "
        "WHEN loan_grade >= 'C' AND loan_amnt * 4 > person_income THEN 1 "
        "ELSE 0 END"),
}


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``loans`` fixture: one row per order, columns in file order.

    Only the four ``orders`` and two ``customer`` columns used are read; the
    join strategy is left to the optimizer (AQE turns it into a broadcast join
    when ``customer`` is small at run time, a sort-merge join otherwise).
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    base = orders.join(customer, orders.o_custkey == customer.c_custkey)
    base = base.select(*[F.expr(e).alias(n) for n, e in _BASE_EXPRS.items()])
    full = base.select("*", *[F.expr(e).alias(n) for n, e in _DERIVED_EXPRS.items()])
    return full.select(*presets.LOAN_COLUMNS)


def embedding_features(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """``embeddings`` as ``(vec_id, label, e_0..e_{dims-1})`` double columns."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", "label", *[
        F.element_at("embedding", i + 1).cast("double").alias(f"e_{i}") for i in range(dims)])
