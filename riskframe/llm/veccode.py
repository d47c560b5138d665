"""Vector codes by active-entry Lloyd rounds on integer components.

Every component x counts as floor(1024 * x).  A vector is cut into equal
consecutive parts, each part position has a codebook, and a part's code is the
nearest entry (squared distance, ties to the lower index).  The codebooks start
as the parts of the first kept vectors and are moved in rounds: all parts are
assigned, then each entry becomes the componentwise floor of its parts' mean.

Each round reads the table the last one wrote, which holds the assigned entries
with their exact distances.  A part whose entry did not move is compared with
the moved entries only: its stored distance still holds, and its entry still
beats the others that stayed.  The other parts scan the whole codebook.  A round
is one pass without a shuffle of vectors; a task adds one row of component sums
per entry, which Spark adds up.  The driver holds the codebooks only.

Distances are exact: in double precision while all terms stay below 2^53, else
in 64-bit integers.

Cases: vectors that are null or hold null or non-finite components are dropped;
an empty one, one whose length differs from the first other kept vector's, or one
whose components are too large for 64-bit distances stays without a code (null
code and error); equal keys are ordered by vector, null keys come last; with fewer
vectors than entries the codebooks are shorter; an empty table gives an empty
result.  Lengths that ``parts`` does not divide are cut as evenly as possible.
Further columns pass through, one named like a result is replaced by it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import col, fresh_name, map_arrow, shared_table, slices
from riskframe.session import drop_table

#: Vectors compared at a time.
ROWS = 2_048
#: A component counts as floor(SCALE * x).
SCALE = 1024


@dataclass
class Codebooks:
    """Entries of each part position as integers (entries x width)."""

    books: list[np.ndarray]

    def digest(self) -> str:
        """sha256 of all components by part, entry and position, joined by commas."""
        flat = (str(x) for book in self.books for x in book.ravel().tolist())
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def cuts(length: int, parts: int) -> list[int]:
    """Bounds of the parts of a vector."""
    return [length * i // parts for i in range(parts + 1)]


def widest(length: int) -> int:
    """Largest component whose squared distances, summed over a vector, fit 63 bits."""
    return math.isqrt((2 ** 63 - 1) // max(length, 1)) // 2 - 1


def exact_type(book: np.ndarray, x: np.ndarray) -> type:
    """float64 where every term of a distance is an integer below 2^53, else int64."""
    most = max((int(np.abs(v).max()) if v.size else 0) for v in (book, x))
    return np.float64 if 4 * most * most * max(book.shape[1], 1) < 2 ** 53 else np.int64


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all entries, exact (int64)."""
    kind = exact_type(book, x)
    a, b = x.astype(kind), book.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row and its distance, over the whole codebook."""
    d = distances(x, book)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, entry: np.ndarray,
             dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, given the last assignment and which entries have moved since."""
    entry, dist = entry.copy(), dist.copy()
    active = np.flatnonzero(moved)
    if not len(active):
        return entry, dist
    lost = moved[entry]
    if lost.any():
        entry[lost], dist[lost] = assign(x[lost], book)
    stayed = np.flatnonzero(~lost)
    if len(stayed):
        d = distances(x[stayed], book[active])
        j = d.argmin(1)
        d, j = d[np.arange(len(stayed)), j], active[j]
        better = (d < dist[stayed]) | ((d == dist[stayed]) & (j < entry[stayed]))
        entry[stayed[better]], dist[stayed[better]] = j[better], d[better]
    return entry, dist


def integers(column: pa.Array, length: int) -> np.ndarray:
    """floor(SCALE * x) of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, length)


def usable(vector: Column) -> Column:
    """Whether there is a vector whose components are all finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))),
        F.lit(False))


def one_pass(state: DataFrame, kept: int, bounds: list[int], books: list[np.ndarray],
             moved: list[np.ndarray] | None, sums: bool) -> DataFrame:
    """The table with every part assigned anew, and with ``sums`` further rows
    (null but for ``part`` to ``total``) of each task's counts and component sums."""
    length, parts = bounds[-1], len(bounds) - 1
    shared = state.sparkSession.sparkContext.broadcast((books, moved))
    added = T.StructType.fromDDL(
        "entry array<smallint>, dist array<bigint>, part int, slot int, n bigint, total array<bigint>")
    given = state.schema.fields[:kept + 1]
    schema = T.StructType([*given, *added.fields])
    arrow = [pa.list_(pa.int16()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(),
             pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved = shared.value
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        fields = None
        for batch in batches:
            fields = [f.type for f in batch.schema][:kept + 1]
            for some in slices(batch, ROWS):
                x = integers(some.column(kept), length)
                n = len(x)
                entry, dist = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
                if moved is not None:
                    before = [some.column(kept + 1 + k).flatten().to_numpy().reshape(n, parts)
                              .astype(np.int64) for k in (0, 1)]
                for p, book in enumerate(books):
                    own = x[:, bounds[p]:bounds[p + 1]]
                    if moved is None:
                        entry[:, p], dist[:, p] = assign(own, book)
                    else:
                        entry[:, p], dist[:, p] = reassign(own, book, moved[p], before[0][:, p],
                                                           before[1][:, p])
                    if sums:
                        counts[p] += np.bincount(entry[:, p], minlength=len(book))
                        order = np.argsort(entry[:, p], kind="stable")
                        slot, first = np.unique(entry[order, p], return_index=True)
                        if own.shape[1] and n:
                            totals[p][slot] += np.add.reduceat(own[order], first, axis=0)
                ends = pa.array(np.arange(0, (n + 1) * parts, parts, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel().astype(t)))
                         for v, t in ((entry, np.int16), (dist, np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:kept + 1], *lists, *[pa.nulls(n, t) for t in arrow[2:]]],
                    schema.names)
        if sums and fields is not None:
            for p, (c, t) in enumerate(zip(counts, totals)):
                slot = np.flatnonzero(c)
                n, width = len(slot), t.shape[1]
                ends = pa.array(np.arange(0, n * width + 1, max(width, 1), dtype=np.int32)
                                if width else np.zeros(n + 1, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.nulls(n, f) for f in fields], pa.nulls(n, arrow[0]), pa.nulls(n, arrow[1]),
                     pa.array(np.full(n, p, np.int32)), pa.array(slot.astype(np.int32)),
                     pa.array(c[slot]), pa.ListArray.from_arrays(ends, pa.array(t[slot].ravel()))],
                    schema.names)

    return map_arrow(state, run, schema)


def moved_books(table: DataFrame, books: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """New codebooks from a pass's sums, and which of their entries differ."""
    exact = T.DecimalType(19, 0)
    rows = (table.where(F.col("part").isNotNull())
            .select("part", "slot", "n", F.posexplode("total").alias("at", "x"))
            .groupBy("part", "slot", "at")
            .agg(F.sum(F.col("n").cast(exact)).alias("n"), F.sum(F.col("x").cast(exact)).alias("x"))
            .toArrow())                                  # one row per component of the codebooks
    new = [b.copy() for b in books]
    for p, slot, at, n, x in zip(*[rows[c].to_pylist() for c in ("part", "slot", "at", "n", "x")]):
        new[p][slot, at] = int(x) // int(n)
    return new, [(a != b).any(1) for a, b in zip(new, books)]


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 4,
             entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks]:
    """The columns of ``vectors`` but ``vector``, plus ``code`` (two hex digits
    per part) and ``error`` (squared distance); the final codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits needs 1 to 256 entries")
    kept = [c for c in vectors.columns if c != vector and c.lower() not in ("code", "error")]
    types = [vectors.schema[c].dataType for c in kept]
    given = vectors.where(usable(col(vector)))

    def leading(some: DataFrame, n: int) -> list[list[float]]:
        return [r[0] for r in some.orderBy(col(key).asc_nulls_last(), col(vector)).limit(n)
                .select(col(vector)).collect()]

    length = len((leading(given.where(F.size(col(vector)) > 0), 1) or [[]])[0])
    most = widest(length)
    fits = (F.size(col(vector)) == max(length, 1)) & F.forall(
        col(vector), lambda x: F.abs(x.cast("double")) * SCALE < float(most))
    first = leading(given.where(fits), entries)           # at most ``entries`` rows
    bounds = cuts(length, parts)
    start = np.floor(np.array(first, np.float64).reshape(len(first), length) * SCALE).astype(np.int64)
    books = [start[:, a:b] for a, b in zip(bounds, bounds[1:])]
    names = [f"c{i}" for i in range(len(kept))]
    renamed = given.select(*[col(c).alias(n) for c, n in zip(kept, names)],
                           col(vector).alias("v"), fits.alias("fits"))
    left_out = renamed.where(~F.col("fits")).select(
        *names, F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    state, moved = renamed.where("fits").drop("fits"), None
    if len(first):
        for _ in range(rounds):
            table = shared_table(one_pass(state, len(kept), bounds, books, moved, True))
            books, moved = moved_books(table, books)
            before, state = state, table.where(F.col("part").isNull()).select(
                *names, "v", "entry", "dist")
            drop_table(before)
            state._riskframe_table = table._riskframe_table
        last = one_pass(state, len(kept), bounds, books, moved, False)
    else:
        last = renamed.where("fits").select(
            *names, F.array().cast("array<smallint>").alias("entry"),
            F.array().cast("array<bigint>").alias("dist"))
    coded = last.select(
        *names, F.array_join(F.transform("entry", lambda e: F.lower(F.lpad(F.hex(e.cast("bigint")), 2, "0"))),
                             "").alias("code"),
        F.aggregate("dist", F.lit(0).cast("bigint"), lambda a, d: a + d).alias("error"))
    out = shared_table(coded.unionByName(left_out))
    drop_table(state)
    return out.toDF(*kept, "code", "error"), Codebooks(books)


def with_group_error(coded: DataFrame, by: str, name: str = "label_error") -> DataFrame:
    """``coded`` plus the error summed over equal values of ``by`` (nulls
    together).  The sums are a table of their own, so that the join is planned
    by its size; a hot value is summed per task before it is shuffled."""
    group, total = fresh_name(coded, "the_group"), fresh_name(coded, "the_total")
    sums = shared_table(coded.groupBy(col(by).alias(group)).agg(
        F.sum(F.col("error").cast("decimal(19,0)")).cast("bigint").alias(total)))
    out = coded.join(sums, col(by).eqNullSafe(F.col(group)), "left").drop(group)
    return out.drop(*[c for c in out.columns if c.lower() == name.lower()]).withColumnRenamed(total, name)
