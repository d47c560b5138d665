"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.words import parts
from riskframe.session import cut_lineage, ship_package


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    return cut_lineage(df)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def col(name: str) -> Column:
    """Column by literal name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with the package shipped to the Python workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in zero-copy slices of at most ``rows`` rows."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus`` (null key: empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def with_columns_from(df: DataFrame, source: str, fields: list[T.StructField],
                      start: Callable[[], Callable[[pa.Array], list[pa.Array]]],
                      keep: list[str] | None = None) -> DataFrame:
    """``df`` plus ``fields``, computed in the tasks from the column ``source``.

    ``start()`` runs once a task and returns the function that turns a slice of
    ``source`` (bounded in rows and characters, one long text excepted) into one
    Arrow array per field.  ``keep`` names the columns that pass through, by
    default all; a column named like a new one is replaced by it."""
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    own = kept.index(source) if source in kept else len(kept)
    given = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(kept)],
                      *([col(source).alias("own")] if own == len(kept) else []))
    types = [df.schema[c].dataType for c in kept] + [f.dataType for f in fields]
    names = [f"c{i}" for i in range(len(types))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in parts(batch, own):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(kept)], *work(part.column(own))], names)

    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])
    return map_arrow(given, run, schema).toDF(*kept, *[f.name for f in fields])
