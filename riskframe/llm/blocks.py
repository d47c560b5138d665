"""Cells of rows as block tasks: a cell of any size becomes pairs of bounded
chunks, so no task ever holds a whole large cell.

Rows get a chunk number within their cell from a hash of their node; chunk
counts come from the cell's total weight.  For chunks i <= j of a cell there is
one block task with the rows of both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import map_arrow


def block_rows(rows: DataFrame, cell: list[str], node: str, weight: Column,
               chunk_weight: int) -> DataFrame:
    """``rows`` replicated to the block tasks of their cell: adds ``i``, ``j``
    (chunk pair of the block), ``side`` (this row's chunk) and ``block``.

    Cells with one row are left out: nothing meets there."""
    sizes = (rows.groupBy(*cell).agg(F.count("*").alias("cell_rows"), F.sum(weight).alias("w"))
             .where("cell_rows > 1")
             .select(*cell, F.ceil(F.col("w") / chunk_weight).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64(F.lit(7), node), F.col("chunks").cast("long")).cast("int")
    placed = rows.join(sizes, cell).withColumn("side", chunk)
    others = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    placed = (placed.withColumn("other", others)
              .withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
              .drop("other", "chunks"))
    return placed.withColumn("block", F.xxhash64(*cell, "i", "j"))


def per_block(placed: DataFrame, cell: list[str], columns: list[str],
              judge: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Run ``judge`` on the rows of every block task: a table of ``columns``,
    then ``i``, ``j`` and ``side``."""
    keys = [*cell, "i", "j"]
    dealt = placed.select(*keys, *columns, "side", "block").repartition("block") \
        .sortWithinPartitions(*keys).drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            out = judge(table.select([*columns, "i", "j", "side"]))
            if out is not None and out.num_rows:
                yield out

        for batch in batches:
            marks = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys)))))
            start = 0
            for at in range(1, len(marks) + 1):
                if at == len(marks) or marks[at] != marks[start]:
                    if held and marks[start] != now:
                        yield from done()
                        held.clear()
                    now = marks[start]
                    held.append(batch.slice(start, at - start))
                    start = at
        if held:
            yield from done()

    return map_arrow(dealt, run, schema)


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index that every row reaches over a symmetric link matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new
