"""Label dictionaries as tables.

A fitted dictionary is a table (column, value, code) in the shared folder: the
distinct values of each column in ascending order, numbered from 0 without
gaps by a distributed ranking (:mod:`riskframe.functions.ranking`).  Applying a
dictionary is a join, planned by the dictionary's measured size: a small one is broadcast,
a large one is sorted and merged, a hot value split by AQE.  Neither fitting nor
applying collects a value, so a column may have as many as it likes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.ranking import ROWS_PER_TASK, drop_source, row_numbers
from riskframe.session import cut_lineage, drop_table


def _text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value) of every non-NULL value, as text."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, value)").where(
        F.col("value").isNotNull())


@dataclass
class LabelDictionary:
    """Fitted label encoder: ``table`` (column, value, code) and the number of
    values per column.  NULL and, with ``handle_invalid="keep"``, unseen values
    get the next code after the last; with ``"error"`` an unseen value fails
    the task."""

    table: DataFrame
    sizes: dict[str, int]
    handle_invalid: str = "keep"

    @property
    def classes(self) -> dict[str, list[str]]:
        """The values in order of their codes, collected: for dictionaries known
        to be small (reports, tests)."""
        out = {c: [] for c in self.sizes}
        for r in self.table.orderBy("column", "code").collect():
            out[r["column"]].append(r["value"])
        return out

    def of(self, column: str) -> DataFrame:
        """(value, code) of one column."""
        return self.table.where(F.col("column") == column).select("value", "code")

    def transform(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        """``df`` with the codes (int) in place of the values."""
        names, exprs = df.columns, {}
        for i, c in enumerate(cols if cols is not None else self.sizes):
            value, code = f"__value{i}", f"__code{i}"
            part = self.of(c).select(F.col("value").alias(value), F.col("code").alias(code))
            own = F.col(f"`{c}`").cast("string")
            df = df.join(part, own == F.col(value), "left")
            found = F.col(code)
            if self.handle_invalid == "error":
                found = F.when(own.isNotNull() & found.isNull(), F.raise_error(F.concat(
                    F.lit(f"unseen label in {c}: "), own)).cast("bigint")).otherwise(found)
            exprs[c] = F.coalesce(found, F.lit(self.sizes[c])).cast("int")
        return df.withColumns(exprs).select(*[f"`{n}`" for n in names])

    def save(self, path: str) -> None:
        """Write the dictionary to ``path``; a column without values is kept too."""
        rows = [(c, n, self.handle_invalid) for c, n in self.sizes.items()]
        self.table.write.mode("overwrite").parquet(f"{path}/values")
        self.table.sparkSession.createDataFrame(
            rows, "column string, size bigint, handle_invalid string").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LabelDictionary":
        rows = spark.read.parquet(f"{path}/columns").collect()       # one row per column
        return cls(spark.read.parquet(f"{path}/values"), {r["column"]: r["size"] for r in rows},
                   rows[0]["handle_invalid"] if rows else "keep")


def fit_label_dictionary(df: DataFrame, cols: Sequence[str], handle_invalid: str = "keep",
                         rows_per_task: int = ROWS_PER_TASK) -> LabelDictionary:
    """The dictionary of ``cols`` (values compared as text)."""
    cols = list(cols)
    if not cols:
        empty = df.sparkSession.createDataFrame([], "column string, value string, code bigint")
        return LabelDictionary(empty, {}, handle_invalid)
    values = cut_lineage(_text(df, cols).distinct())
    found = {r["column"]: r["count"] for r in values.groupBy("column").count().collect()}
    sizes = {c: found.get(c, 0) for c in cols}                       # one number per column
    numbered = row_numbers(values, ["value"], ["column"], "code", sum(sizes.values()), rows_per_task)
    table = cut_lineage(numbered, partition_by=["column"])
    drop_table(values)
    drop_source(numbered)
    return LabelDictionary(table, sizes, handle_invalid)
