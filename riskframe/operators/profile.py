"""Profiling and feature-scoring operators.

Wide tables are unpivoted once with ``stack`` and aggregated by
``(column, ...)`` keys: partial aggregation collapses every task to at most
(columns x keys) rows before the shuffle, so a hot value or a dominant class
never concentrates raw rows in one task.  Results are long tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.columns import row_percent
from riskframe.operators.filters import columns_of
from riskframe.operators.quantiles import quantile_table
from riskframe.session import cut_lineage, ship_package


def _number(c: str) -> Column:
    """The column as double, NaN as NULL: a missing value like any other."""
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def _stack(df: DataFrame, cols: Sequence[str], cast: str, keep: Sequence[str] = (),
           name: str = "column", value: str = "value") -> DataFrame:
    def item(c: str) -> str:
        kind = df.schema[c].dataType
        if cast == "STRING" and isinstance(kind, (T.DoubleType, T.FloatType)):
            zero = f"CAST(0 AS {kind.simpleString()})"      # -0.0 is the same value as 0.0
            return f"'{c}', CAST(CASE WHEN `{c}` = 0 THEN {zero} ELSE `{c}` END AS STRING)"
        return f"'{c}', CAST(`{c}` AS {cast})"

    pairs = ", ".join(map(item, cols))
    return df.select(*keep, F.expr(f"stack({len(cols)}, {pairs}) AS ({name}, {value})"))


# --------------------------------------------------------------------- A1
def describe(df: DataFrame, cols: Sequence[str] | None = None,
             probs: Sequence[float] = (0.25, 0.5, 0.75), exact: bool = True,
             accuracy: int = 10_000) -> DataFrame:
    """count (neither NULL nor NaN), mean, sample std, min, exact linear quantiles,
    max per numeric column, one row per column (the transposed ``describe``); a
    column without values has count 0 and NULL elsewhere.

    ``exact=False`` answers in one pass with mergeable ``percentile_approx``
    sketches (rank error <= n / accuracy) for very large or wide tables."""
    cols = list(cols) if cols is not None else columns_of(df)
    qnames = [f"p{int(round(p * 100))}" for p in probs]
    if not exact:
        return _describe_one_pass(df, cols, probs, qnames, accuracy)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(_number(c)).alias(f"m{i}"), F.stddev_samp(_number(c)).alias(f"s{i}")]
    items = ", ".join(f"'{c}', m{i}, s{i}" for i, c in enumerate(cols))
    moments = df.agg(*aggs).selectExpr(f"stack({len(cols)}, {items}) AS (column, mean, std)")
    # one row per column on either side
    return moments.join(quantile_table(df, cols, probs), "column", "left").select(
        "column", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("count"), "mean", "std",
        "min", *[F.col(f"q{i}").alias(n) for i, n in enumerate(qnames)], "max")


def _describe_one_pass(df, cols, probs, qnames, accuracy) -> DataFrame:
    """Approximate describe: one aggregation over all columns, unpivoted."""
    aggs = []
    for i, c in enumerate(cols):
        x = _number(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                 F.max(x).alias(f"hi{i}"),
                 F.percentile_approx(x, list(probs), accuracy).alias(f"q{i}")]
    wide = df.agg(*aggs)
    items = ", ".join(
        f"'{c}', n{i}, m{i}, s{i}, lo{i}, " + ", ".join(f"q{i}[{k}]" for k in range(len(probs)))
        + f", hi{i}" for i, c in enumerate(cols))
    names = ", ".join(["column", "count", "mean", "std", "min", *qnames, "max"])
    return wide.selectExpr(f"stack({len(cols)}, {items}) AS ({names})").select(
        "column", F.col("count").cast("bigint").alias("count"), "mean", "std", "min",
        *qnames, "max")


# --------------------------------------------------------------------- A2, A3
def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None,
                    approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct non-NULL values per column: ``(column, n_distinct)``.

    ``approx=True`` uses one pass of HyperLogLog++ sketches (relative
    standard deviation ``rsd``) instead of shuffling the distinct values."""
    cols = list(cols) if cols is not None else df.columns
    if approx:
        wide = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), rsd).alias(f"d{i}")
                        for i, c in enumerate(cols)])
        items = ", ".join(f"'{c}', d{i}" for i, c in enumerate(cols))
        return wide.selectExpr(f"stack({len(cols)}, {items}) AS (column, n_distinct)").select(
            "column", F.col("n_distinct").cast("bigint").alias("n_distinct"))
    long = _stack(df, cols, "STRING")
    return (long.where(F.col("value").isNotNull()).distinct()
            .groupBy("column").agg(F.count(F.lit(1)).cast("bigint").alias("n_distinct")))


def distinct_values(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct values per column including NULL: ``(column, value)``, sorted.

    ``value`` is DOUBLE when every column is numeric, STRING otherwise (numbers
    are not turned into engine-specific text unless mixed with strings)."""
    cols = list(cols) if cols is not None else df.columns
    numeric = set(columns_of(df))
    cast = "DOUBLE" if all(c in numeric for c in cols) else "STRING"
    return _stack(df, cols, cast).distinct().orderBy("column", "value")


# --------------------------------------------------------------------- A4-A7
def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """``(value, count)`` by descending count (ties by value); missing values
    are left out unless ``dropna=False``."""
    if dropna:
        df = df.where(F.col(col).isNotNull())
    return (df.groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("count"))
            .orderBy(F.desc("count"), "value"))


def column_info(df: DataFrame) -> DataFrame:
    """``(position, column, dtype, non_null)`` in one aggregation pass."""
    fields = df.schema.fields
    r = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"c{i}")
                 for i, f in enumerate(fields)]).collect()[0]
    rows = [(i, f.name, f.dataType.simpleString(), int(r[f"c{i}"])) for i, f in enumerate(fields)]
    schema = T.StructType([T.StructField("position", T.LongType()),
                           T.StructField("column", T.StringType()),
                           T.StructField("dtype", T.StringType()),
                           T.StructField("non_null", T.LongType())])
    return df.sparkSession.createDataFrame(rows, schema)


def group_sizes(df: DataFrame, col: str, target: str, dropna: bool = True) -> DataFrame:
    """Two-key group size ``(col, target, n)`` (A6); keys with a missing
    part are left out unless ``dropna=False``."""
    if dropna:
        df = df.where(F.col(col).isNotNull() & F.col(target).isNotNull())
    return df.groupBy(col, target).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def _count_or_null(cond) -> "F.Column":
    """Rows matching ``cond``; NULL when none (an absent cross-tab cell)."""
    n = F.count_if(cond)
    return F.when(n > 0, n).cast("bigint")


def _target_values(df: DataFrame, target: str) -> list:
    """The target's distinct values, sorted.  Each becomes a column, so more of
    them than Spark allows a pivot (``spark.sql.pivotMaxValues``) is an error."""
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    rows = (df.select(F.col(target).alias("v")).where(F.col("v").isNotNull()).distinct()
            .limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"{target} has more than {most} values, each would be a column")
    return sorted(r["v"] for r in rows)


def crosstab(df: DataFrame, col: str, target: str,
             values: Sequence | None = None) -> DataFrame:
    """Target values become columns ``n_<v>``; an absent pair is NULL.
    Without ``values`` one more pass finds all of the target's values; rows
    without a target are in no column."""
    values = _target_values(df, target) if values is None else values
    # conditional counts in one aggregation (one shuffle; a pivot plans two)
    return df.groupBy(col).agg(*[_count_or_null(F.col(target) == F.lit(v)).alias(f"n_{v}")
                                 for v in values])


def crosstab_percent(df: DataFrame, cols: Sequence[str], target: str,
                     values: Sequence | None = None) -> DataFrame:
    """Stacked count + row-percent table for several categoricals (A14, P10):
    ``(column, value, n_<v>..., pct_<v>...)``; one unpivot, one group-by.

    Without ``values`` one more pass finds all of the target's values.
    Percentages are of all rows of the category that have a target, whether
    their value is listed or not."""
    values = _target_values(df, target) if values is None else values
    long = _stack(df, cols, "STRING", keep=[target])
    total = F.count(F.col(target))
    p = long.groupBy("column", "value").agg(
        *[_count_or_null(F.col(target) == F.lit(v)).alias(f"n_{v}") for v in values],
        total.alias("__total"))
    return p.select("column", "value", *[f"`n_{v}`" for v in values],
                    *[row_percent(F.col(f"`n_{v}`"), F.col("__total")).alias(f"pct_{v}")
                      for v in values])


# --------------------------------------------------------------------- A8
#: A variance below this multiple of the squared mean is rounding, not variance.
ROUNDING = 1e-30

_MOMENTS = ("n", "mx", "my", "xx", "yy", "xy")


def co_moments(x: np.ndarray) -> dict[str, np.ndarray]:
    """Moments of every pair of columns over the rows in which both have a value
    (NaN: none): count, the two means, the two sums of squared deviations and
    the sum of products of deviations, as matrices."""
    there = ~np.isnan(x)
    count = there.sum(0)
    shift = np.divide(np.where(there, x, 0.0).sum(0), count, out=np.zeros(x.shape[1]),
                      where=count > 0)
    low = np.where(there, x, np.inf).min(0, initial=np.inf)
    high = np.where(there, x, -np.inf).max(0, initial=-np.inf)
    shift = np.where(low == high, low, shift)              # a constant leaves exact zeros
    z = np.where(there, x - shift, 0.0)
    mask = there.astype(float)
    n = mask.T @ mask
    sums, squares = z.T @ mask, (z * z).T @ mask
    own = np.divide(sums, n, out=np.zeros_like(n), where=n > 0)
    return {"n": n, "mx": shift[:, None] + own, "my": shift[None, :] + own.T,
            "xx": squares - own * sums, "yy": (squares - own * sums).T,
            "xy": z.T @ z - own * sums.T}


def merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Moments of two disjoint sets of rows together."""
    n = a["n"] + b["n"]
    part = np.divide(b["n"], n, out=np.zeros_like(n), where=n > 0)
    both = a["n"] * part
    dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
    return {"n": n, "mx": a["mx"] + dx * part, "my": a["my"] + dy * part,
            "xx": a["xx"] + b["xx"] + dx * dx * both, "yy": a["yy"] + b["yy"] + dy * dy * both,
            "xy": a["xy"] + b["xy"] + dx * dy * both}


def _moment_blocks(width: int):
    """mapInArrow body: the moments of a task's rows, one row per pair a <= b."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float)
                                     for c in batch.columns])
                own = co_moments(x)
                total = own if total is None else merged(total, own)
        if total is not None:
            a, b = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
                 *[pa.array(total[m][a, b]) for m in _MOMENTS]], ["a", "b", *_MOMENTS])
    return run


def correlation(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation over pairwise-complete rows, all ordered pairs.

    One scan: each task reduces its rows to mergeable co-moments of every pair
    (count, means, centred sums; matrix products over Arrow batches), a few
    numbers per pair whatever the rows.  The blocks are a small table, merged by
    the exact rule: centred sums add up, plus the products of the blocks'
    distances from the common mean.  No value is shifted by a guess, so the
    result does not depend on the order of the rows.

    NULL and NaN are missing.  A pair with a constant column, an infinite value
    or fewer than two complete rows has NULL.
    """
    cols = list(cols) if cols is not None else columns_of(df)
    ship_package(df.sparkSession)
    blocks = cut_lineage(df.select(*[_number(c).alias(f"x{i}") for i, c in enumerate(cols)]).mapInArrow(
        _moment_blocks(len(cols)),
        "a int, b int, " + ", ".join(f"{m} double" for m in _MOMENTS)).where("n > 0"))
    means = blocks.groupBy(F.col("a").alias("ka"), F.col("b").alias("kb")).agg(
        F.sum("n").alias("k"), (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("ox"),
        (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("oy"))
    dx, dy, n = F.col("mx") - F.col("ox"), F.col("my") - F.col("oy"), F.col("n")
    sums = blocks.join(means, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb"))).groupBy(
        "a", "b", "k", "ox", "oy").agg(
        F.sum(F.col("xx") + n * dx * dx).alias("xx"), F.sum(F.col("yy") + n * dy * dy).alias("yy"),
        F.sum(F.col("xy") + n * dx * dy).alias("xy"))
    noise = F.lit(ROUNDING) * F.col("k")
    varies = ((F.col("xx") > noise * F.col("ox") ** 2) & (F.col("yy") > noise * F.col("oy") ** 2))
    r = F.nanvl(F.when(varies, F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))),
                F.lit(None).cast("double"))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    grid = df.sparkSession.createDataFrame(
        [(i, j, cols[p], cols[q]) for i, j in pairs for p, q in {(i, j), (j, i)}],
        "ga int, gb int, col_a string, col_b string")
    return grid.join(sums.select("a", "b", r.alias("r")),
                     (F.col("ga") == F.col("a")) & (F.col("gb") == F.col("b")), "left").select(
        "col_a", "col_b", "r")


# --------------------------------------------------------------------- A9, A10
#: Terms after which a continued fraction that has not settled is an error.
MOST_TERMS = 10_000_000


def _f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution: the regularised incomplete beta function
    ``I_x(d2/2, d1/2)`` at ``x = d2 / (d2 + d1 f)``, accurate for any number of
    rows: the logarithms of x and of the beta function are taken without
    differences of large numbers."""
    if f is None or d1 <= 0 or d2 <= 0 or math.isnan(f):
        return float("nan")
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    ratio = d1 * f / d2
    return _betainc(d2 / 2.0, d1 / 2.0, -math.log1p(ratio), -math.log1p(1.0 / ratio),
                    1.0 / (1.0 + ratio), ratio / (1.0 + ratio))


def _stirling(x: float) -> float:
    """lgamma(x) - ((x - 1/2) ln x - x + ln(2 pi)/2) for x of 10 or more."""
    y = 1.0 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x


def _log_beta(a: float, b: float) -> float:
    """ln B(a, b)."""
    a, b = max(a, b), min(a, b)
    if a < 10:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    # lgamma(a) - lgamma(a + b) by Stirling's series, the large terms cancelled by hand
    gone = (b - (a - 0.5) * math.log1p(b / a) - b * math.log(a + b)
            + _stirling(a) - _stirling(a + b))
    if b < 10:
        return math.lgamma(b) + gone
    return ((b - 0.5) * math.log(b) - b + 0.5 * math.log(2 * math.pi) + _stirling(b)) + gone


def _betainc(a: float, b: float, ln_x: float, ln_y: float, x: float, y: float,
             beyond: float | None = None) -> float:
    """I_x(a, b) for x + y = 1, given the logarithms of both: the even part of the
    continued fraction, in terms of the distance from the mean so that nothing
    cancels when x is next to 1, run until it has settled."""
    if x <= 0.0 or y <= 0.0:
        return 0.0 if x <= 0.0 else 1.0
    if beyond is None:
        beyond = (a + b) * y - b               # a - (a + b) x, from the smaller of the two
    if beyond < 0:
        return 1.0 - _betainc(b, a, ln_y, ln_x, y, x, -beyond)
    front = math.exp(a * ln_x + b * ln_y - _log_beta(a, b))
    if front == 0.0:
        return 0.0
    tiny = 1e-300
    h = a / (a + 1.0) * (beyond + 1.0) or tiny
    c, d = h, 0.0
    for n in range(1, MOST_TERMS):
        top = (a + n - 1.0) / (a + 2 * n - 1.0) * n * (b - n) * x * x * (
            (a + b + n - 1.0) / (a + 2 * n - 1.0))
        bottom = (n + n * (b - n) * x / (a + 2 * n - 1.0)
                  + (a + n) / (a + 2 * n + 1.0) * (beyond + 1.0 + n * (1.0 + y)))
        d = 1.0 / (bottom + top * d or tiny)
        c = bottom + top / c or tiny
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front / h
    raise ArithmeticError(f"the tail of F with beta parameters {a}, {b} did not settle")


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Vectorised over the (one row per feature) ANOVA result."""
    return pd.Series([_f_sf(a, b, c) if pd.notna(a) else np.nan
                      for a, b, c in zip(f, d1, d2)], dtype="float64")


def anova_f(df: DataFrame, features: Sequence[str], label: str,
            with_pvalue: bool = False) -> DataFrame:
    """One-way ANOVA F per feature against a class label.

    F = [sum_k n_k (m_k - m)^2 / (K - 1)] / [sum_k n_k var_k / (N - K)] with
    population variances per class; rows with a NULL feature value are left
    out of that feature.  Two aggregation levels: (feature, class) moments,
    then per feature.  Invariant to feature scaling.
    """
    long = _stack(df, features, "DOUBLE", keep=[label], name="feature")
    long = long.where(F.col("value").isNotNull() & F.col(label).isNotNull())
    per_class = long.groupBy("feature", label).agg(
        F.count(F.lit(1)).alias("n_k"), F.avg("value").alias("m_k"),
        F.var_pop("value").alias("v_k"))
    w = Window.partitionBy("feature")
    per_class = per_class.withColumn(
        "m", F.sum(F.col("n_k") * F.col("m_k")).over(w) / F.sum("n_k").over(w))
    res = per_class.groupBy("feature").agg(
        F.sum("n_k").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n_k") * (F.col("m_k") - F.col("m")) ** 2).alias("ssb"),
        F.sum(F.col("n_k") * F.col("v_k")).alias("ssw"))
    res = res.select(
        "feature", F.col("n").cast("bigint").alias("n"), F.col("k").cast("bigint").alias("k"),
        F.try_divide(F.try_divide(F.col("ssb"), (F.col("k") - 1).cast("double")),
                     F.try_divide(F.col("ssw"), (F.col("n") - F.col("k")).cast("double"))
                     ).alias("f_score"))
    if with_pvalue:
        from riskframe.session import ship_package
        ship_package(df.sparkSession)     # the p-value UDF runs in Python workers
        res = res.withColumn("p_value", f_pvalue(
            F.col("f_score"), (F.col("k") - 1).cast("double"),
            (F.col("n") - F.col("k")).cast("double")))
    return res


def select_k_best(df: DataFrame, features: Sequence[str], label: str,
                  k: int | None = None) -> DataFrame:
    """Features ranked by F score, descending, ties by name (A10, O1, O3)."""
    ranked = anova_f(df, features, label).orderBy(F.desc_nulls_last("f_score"), "feature")
    return ranked if k is None else ranked.limit(k)


# --------------------------------------------------------------------- A11
def _finite(c: str) -> Column:
    """The column as double, NULL where it is not a finite number."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def _finite_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., column, value)`` of the finite values."""
    named = df.select(*[F.col(f"`{k}`") for k in keep],
                      *[_finite(c).alias(f"__x{i}") for i, c in enumerate(cols)])
    items = ", ".join(f"'{c}', __x{i}" for i, c in enumerate(cols))
    return named.select(*[F.col(f"`{k}`") for k in keep],
                        F.expr(f"stack({len(cols)}, {items}) AS (column, value)")).where(
        F.col("value").isNotNull())


def _ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Least and greatest finite value per column that has one (half a unit to
    each side of a constant one); one pass, two numbers per column."""
    r = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.min(_finite(c)).alias(f"lo{i}"), F.max(_finite(c)).alias(f"hi{i}"))]).collect()[0]
    out = {}
    for i, c in enumerate(cols):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        if lo is not None:
            out[c] = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    return out


def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """Equal-width histogram per column between its min and max; the last bin
    is closed on the right; a constant column uses ``[v - 0.5, v + 0.5]``.
    All bins are returned, empty ones with count 0:
    ``(column, bin, bin_lo, bin_hi, count)``.  NULL, NaN and infinite values are
    in no bin; a column without finite values, or an empty table, has no bins."""
    cols = list(cols) if cols is not None else columns_of(df)
    ranges = _ranges(df, cols)
    grid = df.sparkSession.createDataFrame(
        [(c, b, lo + (hi - lo) * b / bins, lo + (hi - lo) * (b + 1) / bins)
         for c, (lo, hi) in ranges.items() for b in range(bins)],
        "column string, bin bigint, bin_lo double, bin_hi double")
    if not ranges:
        return grid.withColumn("count", F.lit(0).cast("bigint"))
    exprs = []
    for c, (lo, hi) in ranges.items():
        x = _finite(c)
        b = F.floor((x - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo))
        b = F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1))
        exprs.append(F.when(x.isNotNull(), b).alias(f"b{len(exprs)}"))
    items = ", ".join(f"'{c}', b{i}" for i, c in enumerate(ranges))
    long = df.select(*exprs).selectExpr(f"stack({len(ranges)}, {items}) AS (column, bin)")
    counts = long.where(F.col("bin").isNotNull()).groupBy("column", "bin").agg(
        F.count(F.lit(1)).alias("count"))
    # counts has at most columns x bins rows (bin index is clamped): broadcast
    return (grid.join(F.broadcast(counts), ["column", "bin"], "left")
            .select("column", "bin", "bin_lo", "bin_hi",
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


# --------------------------------------------------------------------- A12
def box_stats(df: DataFrame, cols: Sequence[str], by: str, whis: float = 1.5) -> DataFrame:
    """Box-plot statistics per (column, class): quartiles (exact, linear), the
    whiskers (furthest values within ``whis`` x IQR of the box) and the count
    of values beyond them.  NULL and NaN are missing; a NULL class is a class
    like any other; a class without values of a column has no row for it."""
    q = quantile_table(df, cols, (0.25, 0.5, 0.75), by=[by])
    iqr = F.col("q2") - F.col("q0")
    boxes = q.select(F.col(f"`{by}`").alias("__by"), F.col("column").alias("__column"),
                     F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"),
                     (F.col("q0") - whis * iqr).alias("__lo"), (F.col("q2") + whis * iqr).alias("__hi"))
    long = _stack(df, cols, "DOUBLE", keep=[by]).where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    v = F.col("value")
    # one box per class and column: a written table, joined by its measured size
    joined = long.join(boxes, F.col(by).eqNullSafe(F.col("__by"))
                       & (F.col("column") == F.col("__column")))
    inside = (v >= F.col("__lo")) & (v <= F.col("__hi"))
    box = ["q1", "median", "q3"]
    return joined.groupBy("column", by, *box).agg(
        F.min(F.when(inside, v)).alias("whisker_lo"),
        F.max(F.when(inside, v)).alias("whisker_hi"),
        F.count_if(~inside).cast("bigint").alias("n_outliers"))


# --------------------------------------------------------------------- A13
def class_density(df: DataFrame, cols: Sequence[str], by: str, bins: int = 64) -> DataFrame:
    """Class-conditional Gaussian density of each column on a grid.

    Binned kernel density estimate: values are counted into ``bins`` equal
    bins over the column's range (one pass), then for every (class, column)
    the density at each bin centre is the Gaussian-weighted sum of all bin
    counts of its group (a ``bins``-entry array, so no pairs are materialised
    and nothing grows with the data).  Bandwidth is Scott's rule per class,
    ``h = std * n^(-1/5)``; each class density integrates to 1.  Output
    ``(column, by, bin, x, density)``.

    NULL, NaN and infinite values are left out; a NULL class is a class like any
    other; a class of one value (no bandwidth) has NULL densities; a column
    without finite values, or an empty table, has no rows.
    """
    cols = list(cols)
    ranges = _ranges(df, cols)
    names = f"column string, `{by}` {df.schema[by].dataType.simpleString()}, bin bigint, x double, density double"
    if not ranges:
        return df.sparkSession.createDataFrame([], names)
    lows, steps = ([x for c, (lo, hi) in ranges.items() for x in (F.lit(c), F.lit(v(lo, hi)))]
                   for v in (lambda lo, hi: lo, lambda lo, hi: (hi - lo) / bins))
    low, step = F.create_map(*lows)[F.col("column")], F.create_map(*steps)[F.col("column")]
    long = _finite_long(df, list(ranges), [by]).withColumn("bin", F.least(F.greatest(
        F.floor((F.col("value") - low) / step), F.lit(0)), F.lit(bins - 1)))
    # moments per bin, so that one shuffle of bins x classes x columns gives all
    per_bin = cut_lineage(long.groupBy(by, "column", "bin").agg(
        F.count(F.lit(1)).alias("c"), F.avg("value").alias("m"), F.var_pop("value").alias("v")))
    totals = per_bin.groupBy(F.col(by).alias("__by"), F.col("column").alias("__column")).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("m")).alias("__s"),
        F.map_from_entries(F.collect_list(F.struct("bin", F.col("c").cast("double")))).alias("__counts"))
    totals = totals.withColumn("__mean", F.col("__s") / F.col("n"))
    spread = per_bin.join(totals.select("__by", "__column", "__mean"),
                          F.col(by).eqNullSafe(F.col("__by"))
                          & (F.col("column") == F.col("__column"))).groupBy(
        F.col(by).alias("__b"), F.col("column").alias("__c")).agg(F.sum(
            F.col("c") * (F.col("v") + (F.col("m") - F.col("__mean")) ** 2)).alias("__ss"))
    groups = totals.join(spread, F.col("__by").eqNullSafe(F.col("__b"))
                         & (F.col("__column") == F.col("__c")))
    sd = F.sqrt(F.try_divide(F.col("__ss"), (F.col("n") - 1).cast("double")))
    h = sd * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    all_bins = F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))
    dense = groups.select(
        F.col("__column").alias("column"), F.col("__by").alias(by), "n", h.alias("h"),
        F.transform(all_bins, lambda j: F.coalesce(
            F.col("__counts")[j], F.lit(0.0))).alias("cs"),
        F.explode(all_bins).alias("bin")).withColumn("step", step)
    acc = F.aggregate(
        F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0.0),
        lambda total, j: total + F.element_at("cs", j + 1) * F.exp(
            F.lit(-0.5) * F.pow(F.try_divide((F.col("bin") - j).cast("double") * F.col("step"),
                                             F.col("h")), F.lit(2.0))))
    norm = F.col("n").cast("double") * F.col("h") * F.lit(math.sqrt(2 * math.pi))
    return dense.select("column", by, "bin",
                        (low + (F.col("bin") + F.lit(0.5)) * F.col("step")).alias("x"),
                        F.try_divide(acc, norm).alias("density"))


# --------------------------------------------------------------------- O2
def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First ``n`` rows by key (top-k, not a full sort)."""
    return df.orderBy(key).limit(n)
