"""Gap-free row numbers without gathering the rows in one task.

Rows are range-partitioned and sorted by the wanted order, each partition numbers
its own (``monotonically_increasing_id``, fixed by writing the table), and the
running sizes of the partitions, one number each, are added by a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import cut_lineage, drop_table

#: Rows that one task sorts.
ROWS_PER_TASK = 1_000_000
#: Bits of ``monotonically_increasing_id`` below the partition's number.
PARTITION_BITS = 33


def row_numbers(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (),
                output: str = "number", rows: int | None = None,
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` plus the 0-based number of each row in ``order``, per group if given.
    Ties are numbered in any order; ``rows`` saves a count if it is known."""
    rows = df.count() if rows is None else rows
    place = [*groups, *order]
    ordered = cut_lineage(df.repartitionByRange(1 + rows // rows_per_task, *place)
                          .sortWithinPartitions(*place)
                          .withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", PARTITION_BITS)
    keys = [F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(groups)]
    names = [f"__g{i}" for i in range(len(groups))]
    spans = ordered.groupBy(*keys, part.alias("__part")).agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*names).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1)
    spans = spans.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    on = part == F.col("__part")
    for g, n in zip(groups, names):
        on = on & F.col(f"`{g}`").eqNullSafe(F.col(n))
    out = ordered.join(spans, on).select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("__before") + F.col("__at") - F.col("__first")).alias(output))
    out._riskframe_source = ordered
    return out


def drop_source(numbered: DataFrame) -> None:
    """Delete the table behind :func:`row_numbers`, once its result is written."""
    drop_table(numbered._riskframe_source)
