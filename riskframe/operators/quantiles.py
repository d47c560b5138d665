"""Exact quantiles by radix selection.

``percentile`` keeps every distinct value of a group in one aggregation buffer,
which a high-cardinality column on a large table cannot afford.  Here the wanted
order statistics are closed in on digit by digit over order-preserving 64-bit
keys of the values (:mod:`riskframe.functions.keys`):

1. values are counted per (group, column, leading ``bits`` bits of the key),
   with the least and the greatest key of each such bucket; running counts name
   the bucket that holds each wanted rank, and the rank inside it;
2. while a bucket still holds unlike keys, the rows between its least and its
   greatest key are counted again by the next ``bits`` bits of their distance
   from the least one.

A digit leaves 2^-bits of a bucket's range at least, so four passes of 16 bits
settle any column; a column of whole numbers is mostly settled by two.  Counting
is map-side first.  Counts, buckets and ranks are tables in the shared folder;
buckets (two per group, column and quantile at most) meet the rows in a join
that Spark plans by their measured size.  Nothing is collected.

Interpolation is linear between order statistics ``floor(p(n-1))`` and the next
one (the usual "linear" quantile definition).  NULL and NaN are missing values;
0.0 and -0.0 are one value; a NULL group is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.keys import from_order_key, with_order_key
from riskframe.session import cut_lineage, drop_table

#: Bits of one digit: at most 2^BITS buckets a group and column in one pass.
BITS = 16


def _same(names: Sequence[str], other: str = "o_") -> Column:
    """Equality with the columns of the other side (prefixed), NULL with NULL."""
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(other + n))
    return on


def _prefixed(df: DataFrame, names: Sequence[str], prefix: str = "o_") -> DataFrame:
    return df.withColumnsRenamed({n: prefix + n for n in names})


def _closer(targets: DataFrame, counts: DataFrame, bucket: Sequence[str]) -> DataFrame:
    """Targets with the counted bucket that holds their rank, and the rank in it.
    ``counts``: (bucket columns, digit, n, least, most)."""
    ends = F.sum("n").over(Window.partitionBy(*bucket).orderBy("digit")
                           .rowsBetween(Window.unboundedPreceding, 0))
    held = _prefixed(counts.withColumn("end", ends).drop("digit"), bucket)
    held = held.withColumn("before", F.col("end") - F.col("n")).withColumnsRenamed({"n": "n_held"})
    return (targets.join(held, _same(bucket) & (F.col("rank") >= F.col("before"))
                         & (F.col("rank") < F.col("end")))
            .withColumn("rank", F.col("rank") - F.col("before")))


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   by: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """``(by..., column, n, min, max, q0, q1, ...)``: one row per group and column
    that has values, ``q<i>`` the quantile ``probs[i]``."""
    cols, by = list(cols), list(by)
    g = [f"g{i}" for i in range(len(by))]
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    rows = (df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, g)],
                      F.expr(f"stack({max(len(cols), 1)}, {pairs or 'NULL, NULL'}) AS (column, x)"))
            .where(F.col("x").isNotNull() & ~F.isnan("x")))
    keyed = with_order_key(rows, "x", "key").drop("x")
    place = [*g, "column"]

    def counted(frame: DataFrame, bucket: Sequence[str], digit: Column) -> DataFrame:
        return frame.groupBy(*bucket, digit.alias("digit")).agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))

    first = cut_lineage(counted(keyed, place, F.shiftright("key", 64 - bits)))
    totals = first.groupBy(*place).agg(F.sum("n").alias("total"), F.min("least").alias("lowest"),
                                       F.max("most").alias("highest"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"),
                                          F.lit(s).alias("side"))
                                 for i, p in enumerate(probs) for s in (0, 1)]))
    at = F.floor(F.col("p") * (F.col("total") - 1))
    targets = totals.select("*", wanted.alias("w")).select(
        *place, "total", "lowest", "highest", "w.i", "w.p", "w.side").withColumn(
        "rank", F.least(at + F.col("side"), F.col("total") - 1))
    kept = [*place, "total", "lowest", "highest", "i", "p", "side", "rank"]
    targets = cut_lineage(_closer(targets, first, place).select(
        *kept, F.col("least").alias("lo"), F.col("most").alias("hi")))
    drop_table(first)
    bucket = [*place, "lo", "hi"]
    open_ = F.col("lo") < F.col("hi")
    while targets.where(open_).limit(1).count():
        held = _prefixed(targets.where(open_).select(*bucket).distinct(), place)
        inside = keyed.join(held, _same(place) & F.col("key").between(F.col("lo"), F.col("hi")))
        digit = F.expr(f"shiftright(key - lo, greatest(0, length(bin(hi - lo)) - {bits}))")
        counts = counted(inside.select(*place, "lo", "hi", "key"), bucket, digit)
        narrowed = _closer(targets.where(open_), counts, bucket).select(
            *kept, F.col("least").alias("lo"), F.col("most").alias("hi"))
        before, targets = targets, cut_lineage(narrowed.unionByName(targets.where(~open_)))
        drop_table(before)
    value = from_order_key(F.col("lo"))
    found = targets.withColumn("v", value)
    aggs = [F.first("total").alias("n"), from_order_key(F.first("lowest")).alias("min"),
            from_order_key(F.first("highest")).alias("max")]
    for i in range(len(probs)):
        for s in (0, 1):
            aggs.append(F.max(F.when((F.col("i") == i) & (F.col("side") == s), F.col("v")))
                        .alias(f"v{i}_{s}"))
    wide = found.groupBy(*place).agg(*aggs)
    quantiles = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        a, b = F.col(f"v{i}_0"), F.col(f"v{i}_1")
        part = pos - F.floor(pos)
        quantiles.append(F.when((a == b) | (part == 0), a).otherwise(a + (b - a) * part)
                         .alias(f"q{i}"))
    out = cut_lineage(wide.select(*place, "n", "min", "max", *quantiles))
    drop_table(targets)
    return out.withColumnsRenamed(dict(zip(g, by)))
