"""Exact, reproducible sampling and splitting.

Every row gets ``h = md5(salt:seed:key)``.  "The first ``q`` rows of a group in
``h`` order" is then an exact, partitioning-independent selection that an SQL
engine reproduces with ``row_number() OVER (PARTITION BY g ORDER BY h, key) <=
q``.  Ranking a whole group (possibly a third of the table) would put it into
one task; instead the hash of its ``q``-th row is found, and one comparison
with that hash decides every row, without a shuffle or a window over rows:

1. rows are counted per (group, first 4 hex digits): at most 65,536 evenly
   filled buckets a group, counted map-side first;
2. running sums over the counts name the bucket that holds rank ``q``; the
   hashes of its rows (1/65,536 of the group) are written to the shared folder;
3. the same is done there with the next 4 digits, which leaves 1 row in 2^32
   of the group, and these few are ranked.

Cut points are a table with one row per group and rank, joined to the rows, so
groups may be as many as they like; Spark broadcasts that table while it is
small by its measured size.  A null group is a group like any other; a null key
fails; so does a repeated key if the cut falls between its rows (elsewhere the
rows of one key stay together and every size is exact).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.hashing import hash_hex
from riskframe.session import cut_lineage

#: Hex digits of one step of the search.
DIGITS = 4

_H, _G, _CUT = "__h", "__g", "__cut"


def _hashed(df: DataFrame, key: str, seed: int, salt: str, group: str | None) -> DataFrame:
    return df.select(F.col(group).alias("g") if group is not None else F.lit(0).alias("g"),
                     hash_hex(key, seed, salt).alias("h"))


def group_counts(df: DataFrame, key: str, seed: int, salt: str,
                 group: str | None = None) -> DataFrame:
    """(g, b, n): rows per group and hash bucket, written to the shared folder."""
    rows = _hashed(df, key, seed, salt, group)
    return cut_lineage(rows.groupBy("g", F.substring("h", 1, DIGITS).alias("b"))
                       .agg(F.count("*").alias("n")))


def _holding(counts: DataFrame, bucket: str) -> DataFrame:
    """Of (g, i, q, ``bucket``, n) the buckets that hold the ``q``-th row of
    (g, i); ``q`` becomes its rank in there."""
    before = F.col("end") - F.col("n")
    return (counts.withColumn("end", F.sum("n").over(
                Window.partitionBy("g", "i").orderBy(bucket)
                .rowsBetween(Window.unboundedPreceding, 0)))
            .where((F.col("end") >= F.col("q")) & (before < F.col("q")))
            .select("g", "i", bucket, "n", (F.col("q") - before).alias("q")))


def cut_points(df: DataFrame, counts: DataFrame, ranks: DataFrame, key: str, seed: int,
               salt: str, group: str | None = None) -> DataFrame:
    """(g, i, cut): hash of the ``q``-th row of group ``g`` for every row
    (g, i, q, total) of ``ranks``, of its last row if ``q`` is beyond the
    ``total``; no row if ``q`` is below 1.  ``counts`` comes from
    :func:`group_counts`."""
    wanted = ranks.select(F.col("g").alias("wg"), "i", F.least("q", "total").alias("q"))
    first = cut_lineage(_holding(
        counts.join(wanted, F.col("g").eqNullSafe(F.col("wg"))), "b")
        .select(F.col("g").alias("wg"), "i", "q", "b"))
    near = cut_lineage(_hashed(df, key, seed, salt, group).join(
        first, F.col("g").eqNullSafe(F.col("wg")) & (F.substring("h", 1, DIGITS) == F.col("b")))
        .select("g", "i", "q", "h"))
    part = F.substring("h", DIGITS + 1, DIGITS)
    second = _holding(near.groupBy("g", "i", "q", part.alias("p")).agg(F.count("*").alias("n")),
                      "p").select(F.col("g").alias("wg"), F.col("i").alias("wi"), "q", "p")
    last = _holding(
        near.drop("q").join(second, F.col("g").eqNullSafe(F.col("wg"))
                            & (F.col("i") == F.col("wi")) & (part == F.col("p")))
        .groupBy("g", "i", "q", "h").agg(F.count("*").alias("n")), "h")
    return last.select("g", "i", F.when(F.col("q") == F.col("n"), F.col("h")).otherwise(
        F.raise_error(F.lit("a cut falls between rows with the same key")).cast("string"))
        .alias("cut"))


def balanced_undersample(df: DataFrame, label: str, key: str, seed: int = 42,
                         salt: str = "sample") -> DataFrame:
    """Keep every row of the smallest class and exactly that many rows,
    without replacement, from each other class (same seed -> same rows)."""
    counts = group_counts(df, key, seed, salt, label)
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    smallest = totals.agg(F.min("total")).first()[0]
    ranks = totals.select("g", F.lit(0).alias("i"),
                          F.lit(smallest or 0).cast("bigint").alias("q"), "total")
    cuts = cut_lineage(cut_points(df, counts, ranks, key, seed, salt, label)).select(
        F.col("g").alias(_G), F.col("cut").alias(_CUT))
    rows = df.withColumn(_H, hash_hex(key, seed, salt))
    return (rows.join(cuts, F.col(label).eqNullSafe(F.col(_G)))
            .where(F.col(_H) <= F.col(_CUT)).drop(_H, _G, _CUT))


def split_sizes(n: int, fractions: Sequence[float]) -> list[int]:
    """Nested hold-out sizes: each fraction takes ``ceil(f * remaining)``
    (float arithmetic, as the common train/test split helpers do)."""
    sizes, remaining = [], n
    for f in fractions:
        k = int(math.ceil(f * remaining))
        sizes.append(k)
        remaining -= k
    return sizes


def _cuts_at(df: DataFrame, counts: DataFrame, ranks: Sequence[int], total: int, key: str,
             seed: int, salt: str) -> list[str]:
    """Hashes of the rows of the given ranks in the whole table, in order; a
    rank below 1 has one before all hashes."""
    table = df.sparkSession.createDataFrame(
        [(0, i, int(q), total) for i, q in enumerate(ranks)], "g int, i int, q bigint, total bigint")
    found = cut_points(df, counts, table, key, seed, salt).collect()   # one row per rank
    at = {r["i"]: r["cut"] for r in found}
    return [at.get(i, "") for i in range(len(ranks))]


def random_split(df: DataFrame, key: str, fractions: Sequence[float] = (0.2, 0.2),
                 names: Sequence[str] = ("test", "val", "train"), seed: int = 42,
                 salt: str = "split", output: str = "split") -> DataFrame:
    """Unstratified nested split.  With fractions (0.2, 0.2) the test
    set is ceil(0.2 n), validation ceil(0.2 (n - test)), the rest is train
    (0.64 / 0.16 / 0.20)."""
    if len(names) != len(fractions) + 1:
        raise ValueError("need one name per fraction plus one for the rest")
    counts = group_counts(df, key, seed, salt)
    total = counts.agg(F.sum("n")).first()[0] or 0
    sizes = split_sizes(total, fractions)
    cuts = _cuts_at(df, counts, [sum(sizes[: i + 1]) for i in range(len(sizes))], total, key,
                    seed, salt)
    h, part = hash_hex(key, seed, salt), F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        part = F.when(h <= cut, name).otherwise(part)
    return df.withColumn(output, part)


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42,
                 salt: str = "sample") -> DataFrame:
    """Exactly ``n`` rows without replacement (no stratification)."""
    counts = group_counts(df, key, seed, salt)
    total = counts.agg(F.sum("n")).first()[0] or 0
    cut, = _cuts_at(df, counts, [n], total, key, seed, salt)
    return df.where(hash_hex(key, seed, salt) <= cut)
