"""Column-expression builders.

Everything here returns a :class:`pyspark.sql.Column` built from built-in
functions, so it stays inside whole-stage codegen and works the same on batch
and streaming frames.  Quotients use ``try_divide`` (NULL on a zero divisor;
plain ``/`` raises under ANSI mode).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def product(*factors: str | Column) -> Column:
    """Interaction feature ``a * b [* c ...]`` in double precision."""
    return reduce(lambda a, b: a * b, [col(f).cast("double") for f in factors])


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """``a / b`` as double; NULL when ``b`` is 0 or NULL (P5)."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def total(*terms: str | Column) -> Column:
    """Sum of columns (P6 composite score after standardising the terms)."""
    return reduce(add, [col(t) for t in terms])


def log1p(c: str | Column) -> Column:
    """``ln(1 + x)`` (P7); NULL for x <= -1."""
    return F.log1p(col(c).cast("double"))


def map_values(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Dictionary map (P8): values missing from ``mapping`` become ``default``.

    A literal map lookup (``map[key]`` gives NULL on a miss), evaluated in
    codegen.  Dictionaries are fixed-size parameters; for a data-sized
    dictionary join against it instead (see ``encoders.LabelEncoding``).
    """
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    looked_up = F.create_map(*pairs)[col(c)]
    return looked_up if default is None else F.coalesce(looked_up, F.lit(default))


def right_closed_bins(c: str | Column, edges: Sequence[float],
                      labels: Sequence[str]) -> Column:
    """Interval label of ``x`` for bins ``(e0, e1], (e1, e2], ...``.

    ``x <= e0``, ``x > e_last`` and NULL give NULL.  (``ml.feature.Bucketizer``
    is left-closed and rejects out-of-range values, so it is not used.)
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need exactly one label per interval")
    x = col(c)
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def threshold(probability: str | Column, t: float = 0.5) -> Column:
    """Class from probability, ``p >= t`` -> 1."""
    return (col(probability) >= F.lit(t)).cast("int")


def row_percent(value: str | Column, row_total: str | Column) -> Column:
    """``value / row_total * 100`` (P10); NULL on an empty row."""
    return F.try_divide(col(value).cast("double"), col(row_total).cast("double")) * F.lit(100.0)


def round6(c: str | Column) -> Column:
    """Round to 6 decimals and fold -0.0 into 0.0 (stable value hashes)."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)
