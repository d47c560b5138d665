"""Global sensitivity analysis (Sobol indices, Saltelli design) as Spark jobs.

Y1 ``Problem``: feature names and bounds (fixed, or from data min/max).
Y2 ``saltelli_design``: for each base row two independent uniform vectors
   ``a`` and ``b`` (md5 of the row key, so re-runs and other engines agree).
   The layout is wide: the 2D+2 evaluation points A, B, AB_j (A with column j
   from B) and BA_j are expressions of the same row, so the design needs no
   explode and no join (a small base is only spread over the cores first).
   ``halton_design`` and ``lattice_design`` give low-discrepancy points of the
   same layout over a gap-free row index.
Y3 optional scaling of the raw samples with a fitted scaler.
Y4 model evaluation of all points (compiled MLP - first layer by rank-one
   updates - or any Column function).
Y5 ``sobol_indices``: one aggregation of plain sums - the 2D+2 output columns
   and 3 + 2D (+ D(D-1)/2 for second order) products - gives the Saltelli
   (2010) first-order, Jansen total-order and second-order indices, outputs
   centred by their overall mean.
Y6 ``sobol_confidence``: Poisson bootstrap over hash blocks; replicate
   estimates from (blocks x replicates) weighted block sums.
Y7 long result tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.hashing import uniform
from riskframe.functions.ranking import row_numbers
from riskframe.operators.scoring import MLP, affine, probability_columns, quote, sql_double
from riskframe.session import spread

Z_975 = 1.959963984540054          # standard normal quantile for a 95 % interval


@dataclass
class Problem:
    names: list
    bounds: list                     # [(lo, hi), ...]

    @property
    def d(self) -> int:
        return len(self.names)


def unit_problem(names: Sequence[str]) -> Problem:
    """Every input on [0, 1]."""
    return Problem(list(names), [(0.0, 1.0)] * len(names))


def problem_from_data(df: DataFrame, names: Sequence[str], with_scaler: bool = False):
    """Bounds = observed min/max of each feature (one aggregation).  With
    ``with_scaler`` the same pass also fits the standard scaler (Y3) and
    ``(problem, scaler)`` is returned."""
    from riskframe.operators.encoders import Standardization
    aggs = []
    for i, c in enumerate(names):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if with_scaler:
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    r = df.agg(*aggs).collect()[0]
    problem = Problem(list(names), [(r[f"lo{i}"], r[f"hi{i}"]) for i in range(len(names))])
    if not with_scaler:
        return problem
    return problem, Standardization({c: r[f"m{i}"] for i, c in enumerate(names)},
                                    {c: r[f"s{i}"] for i, c in enumerate(names)})


def saltelli_design(base: DataFrame, key: str, d: int, seed: int = 42) -> DataFrame:
    """``(key, a_0..a_{d-1}, b_0..b_{d-1})`` uniforms in [0, 1), one row per
    base row; the number of model evaluations is ``rows x (2d + 2)``.  Only
    the key is carried; a small base is spread over all cores first because
    every row costs 2d + 2 model evaluations."""
    base = spread(base.select(key))
    return base.select(
        key, *[uniform(key, seed, f"sobol_a{j}").alias(f"a_{j}") for j in range(d)],
        *[uniform(key, seed, f"sobol_b{j}").alias(f"b_{j}") for j in range(d)])


def first_primes(n: int) -> list[int]:
    out, k = [], 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def radical_inverse(index: str, base: int, rows: int) -> str:
    """SQL text of the digits of ``index`` (below ``rows``) in ``base``, mirrored at
    the point: i = sum d_k base^k becomes sum d_k base^-(k+1)."""
    terms, power = [], 1
    while power < rows or not terms:
        terms.append(f"CAST((CAST({index} AS BIGINT) div {power}L) % {base} AS DOUBLE)"
                     f" * {sql_double(1.0 / (power * base))}")
        power *= base
    return "(" + " + ".join(terms) + ")"


def indexed(base: DataFrame, key: str, rows: int) -> DataFrame:
    """``(key, number)``: the rows numbered from 0 in the order of their keys."""
    return row_numbers(base.select(key), [key], output="number", rows=rows)


def halton_design(base: DataFrame, key: str, d: int) -> DataFrame:
    """As :func:`saltelli_design` with the Halton sequence: the point of the n-th
    row (from 1, by key) has the radical inverses of n in the first 2d primes.
    Fills the cube more evenly than independent draws, so the indices' errors
    fall faster with the rows.  Keys must be unique and not NULL."""
    rows = base.count()
    cols = [radical_inverse("(number + 1)", p, rows + 1) for p in first_primes(2 * d)]
    return indexed(base, key, rows).selectExpr(
        quote(key), *[f"{c} AS {'ab'[j // d]}_{j % d}" for j, c in enumerate(cols)])


#: Generator of the lattice rule: its powers modulo the rows are the vector.
LATTICE_GENERATOR = 76


def lattice_design(base: DataFrame, key: str, d: int, generator: int = LATTICE_GENERATOR
                   ) -> DataFrame:
    """As :func:`saltelli_design` with a rank-1 lattice of Korobov's kind: the n-th
    row (from 0, by key) of N has the coordinates frac((n + 1/2) g^j / N), j below
    2d.  The products are exact (decimals); keys must be unique and not NULL."""
    rows = max(base.count(), 1)
    cols = [f"CAST((CAST(2 * number + 1 AS DECIMAL(19,0)) * {pow(generator, j, rows)})"
            f" % {2 * rows} AS DOUBLE) / {sql_double(2.0 * rows)}" for j in range(2 * d)]
    return indexed(base, key, rows).selectExpr(
        quote(key), *[f"{c} AS {'ab'[j // d]}_{j % d}" for j, c in enumerate(cols)])


def _points(problem: Problem, transform: Callable[[int, Column], Column] | None):
    d = problem.d
    xa, xb = [], []
    for j, (lo, hi) in enumerate(problem.bounds):
        for src, dst in (("a", xa), ("b", xb)):
            x = F.lit(float(lo)) + F.lit(float(hi) - float(lo)) * F.col(f"{src}_{j}")
            dst.append(transform(j, x) if transform else x)
    return xa, xb, d


def evaluate_design(design: DataFrame, key: str, problem: Problem,
                    model: MLP | Callable[[list], Column],
                    transform: Callable[[int, Column], Column] | None = None,
                    second_order: bool = True) -> DataFrame:
    """Model outputs at every Saltelli point: ``(key, y_A, y_B, y_AB<j>,
    y_BA<j>)``.  ``transform(j, x)`` maps raw inputs into model space (the
    scaler, Y3)."""
    xa, xb, d = _points(problem, transform)
    inputs = design.select(key, *[x.alias(f"xa_{j}") for j, x in enumerate(xa)],
                           *[x.alias(f"xb_{j}") for j, x in enumerate(xb)])
    if isinstance(model, MLP):
        # First layer is linear: W.AB_j + b = (W.A + b) + W[:, j] (xb_j - xa_j).
        # Compute W.A + b and W.B + b once; every mixed point is a rank-one
        # update, so the generated code grows with D + sets, not D x sets.
        w0, b0 = model.layers[0]
        units = range(len(b0))
        A = [f"xa_{j}" for j in range(d)]
        B = [f"xb_{j}" for j in range(d)]
        pre = inputs.selectExpr(
            quote(key),
            *[f"{affine(A, w0[o], b0[o])} AS za_{o}" for o in units],
            *[f"{affine(B, w0[o], b0[o])} AS zb_{o}" for o in units],
            *[f"(xb_{j} - xa_{j}) AS dx_{j}" for j in range(d)])
        firsts = {"y_A": [f"za_{o}" for o in units], "y_B": [f"zb_{o}" for o in units]}
        for j in range(d):
            firsts[f"y_AB{j}"] = [f"(za_{o} + dx_{j} * {sql_double(w0[o][j])})" for o in units]
            if second_order:
                firsts[f"y_BA{j}"] = [f"(zb_{o} - dx_{j} * {sql_double(w0[o][j])})"
                                      for o in units]
        return probability_columns(pre, model, {}, keep=[key], first_preactivations=firsts)
    A = [F.col(f"xa_{j}") for j in range(d)]
    B = [F.col(f"xb_{j}") for j in range(d)]
    sets = {"y_A": A, "y_B": B}
    for j in range(d):
        sets[f"y_AB{j}"] = [B[i] if i == j else A[i] for i in range(d)]
        if second_order:
            sets[f"y_BA{j}"] = [A[i] if i == j else B[i] for i in range(d)]
    return inputs.select(key, *[model(cols).alias(name) for name, cols in sets.items()])


def evaluate_design_long(design: DataFrame, key: str, problem: Problem,
                         scored: Callable[[DataFrame], DataFrame], output: str = "probability",
                         transform: Callable[[int, Column], Column] | None = None,
                         second_order: bool = True) -> DataFrame:
    """As :func:`evaluate_design` for a model that only scores tables (Y4): any
    pipeline's ``transform``, say.  Each base row becomes its 2d + 2 points, one
    row per point with the features as columns; ``scored`` adds the column
    ``output`` and must keep the columns ``__key`` and ``__set``; the outputs are
    folded back by one aggregate per key.  Unlike the compiled form this shuffles
    the outputs (not the features)."""
    xa, xb, d = _points(problem, transform)
    inputs = design.select(F.col(f"`{key}`").alias("__key"),
                           *[x.alias(f"xa_{j}") for j, x in enumerate(xa)],
                           *[x.alias(f"xb_{j}") for j, x in enumerate(xb)])
    A, B = [f"xa_{j}" for j in range(d)], [f"xb_{j}" for j in range(d)]
    where = {"y_A": A, "y_B": B}
    for j in range(d):
        where[f"y_AB{j}"] = [B[i] if i == j else A[i] for i in range(d)]
        if second_order:
            where[f"y_BA{j}"] = [A[i] if i == j else B[i] for i in range(d)]
    points = F.explode(F.array(*[F.struct(
        F.lit(name).alias("__set"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(cols)])
        for name, cols in where.items()]))
    long = inputs.select("__key", points.alias("p")).select(
        "__key", "p.__set", *[F.col(f"p.x{i}").alias(n) for i, n in enumerate(problem.names)])
    return scored(long).groupBy("__key").agg(*[
        F.max(F.when(F.col("__set") == name, F.col(output))).alias(name) for name in where]
    ).withColumnRenamed("__key", key)


def _quantities(d: int, second_order: bool) -> dict:
    """Per-row quantities (Spark SQL text) whose means give every estimator.

    Linear terms come from the means of the output columns themselves, so
    only products need their own sums: B.AB_j, A.B, (A - AB_j)^2, A^2, B^2
    and, for second order, BA_j.AB_k."""
    outs = ["y_A", "y_B"] + [f"y_AB{j}" for j in range(d)]
    if second_order:
        outs += [f"y_BA{j}" for j in range(d)]
    q = {o: o for o in outs}
    q.update({"A2": "y_A * y_A", "B2": "y_B * y_B", "AxB": "y_A * y_B"})
    for j in range(d):
        q[f"BxAB{j}"] = f"y_B * y_AB{j}"
        q[f"st{j}"] = f"(y_A - y_AB{j}) * (y_A - y_AB{j})"
    if second_order:
        for j in range(d):
            for k in range(j + 1, d):
                q[f"BA{j}xAB{k}"] = f"y_BA{j} * y_AB{k}"
    return q


def _estimate(frame: DataFrame, d: int, second_order: bool, keep: Sequence[str] = ()) -> DataFrame:
    """Indices from a frame of sums: column ``n`` and ``s_<quantity>``.

    Staged projections (means -> variance and centre -> S1, ST -> S2) keep
    every expression small.  Outputs are centred by their overall mean
    ``mu`` (Saltelli 2010 first order, Jansen total order, second order as
    Saltelli 2002 with the same centring)."""
    k = [quote(c) for c in keep]
    names = list(_quantities(d, second_order))
    f = frame.selectExpr(*k, *[f"s_{q} / n AS m_{q}" for q in names])
    outs = ["m_y_A", "m_y_B"] + [f"m_y_AB{j}" for j in range(d)]
    if second_order:
        outs += [f"m_y_BA{j}" for j in range(d)]
    f = f.selectExpr(
        "*",
        "(m_A2 - m_y_A * m_y_A + m_B2 - m_y_B * m_y_B) / 2.0D"
        " + pow((m_y_A - m_y_B) / 2.0D, 2.0D) AS var",
        f"({' + '.join(outs)}) / {float(len(outs))!r}D AS mu")
    first = []
    for j in range(d):
        first += [f"try_divide(m_BxAB{j} - m_AxB - mu * (m_y_AB{j} - m_y_A), var) AS S1_{j}",
                  f"try_divide(m_st{j} / 2.0D, var) AS ST_{j}"]
    f = f.selectExpr("*", *first)
    cols = k + [f"S1_{j}" for j in range(d)] + [f"ST_{j}" for j in range(d)]
    if second_order:
        cols += [f"try_divide(m_BA{j}xAB{m} - m_AxB - mu * (m_y_BA{j} + m_y_AB{m} - m_y_A"
                 f" - m_y_B), var) - S1_{j} - S1_{m} AS S2_{j}_{m}"
                 for j in range(d) for m in range(j + 1, d)]
    return f.selectExpr(*cols)


def _sums(frame: DataFrame, group: Sequence, q: dict, weight: str | None = None) -> DataFrame:
    """``n`` and ``s_<quantity>`` per group; ``weight`` multiplies every term."""
    w = f"{weight} * " if weight else ""
    aggs = [F.expr(f"sum({w}n)" if weight else "count(1)").alias("n")]
    aggs += [F.expr(f"sum({w}{('s_' + name) if weight else '(' + e + ')'})").alias(f"s_{name}")
             for name, e in q.items()]
    return (frame.groupBy(*group) if group else frame).agg(*aggs)


def _indices_row(outputs: DataFrame, d: int, second_order: bool) -> DataFrame:
    """One aggregation of plain sums (one buffer each) and a row count."""
    return _estimate(_sums(outputs, (), _quantities(d, second_order)), d, second_order)


def sobol_indices(outputs: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(feature, s1, st)`` from the evaluated design."""
    d = len(names)
    row = _indices_row(outputs, d, second_order="y_BA0" in outputs.columns)
    items = ", ".join(f"'{n}', S1_{j}, ST_{j}" for j, n in enumerate(names))
    return row.selectExpr(f"stack({d}, {items}) AS (feature, s1, st)")


def sobol_pairs(outputs: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(feature_i, feature_j, s2)`` for i before j."""
    d = len(names)
    row = _indices_row(outputs, d, second_order=True)
    pairs = [(j, k) for j in range(d) for k in range(j + 1, d)]
    items = ", ".join(f"'{names[j]}', '{names[k]}', S2_{j}_{k}" for j, k in pairs)
    return row.selectExpr(f"stack({len(pairs)}, {items}) AS (feature_i, feature_j, s2)")


def _poisson1(u: Column, kmax: int = 12) -> Column:
    """Poisson(1) variate by inverse CDF of a uniform (thresholds from the pmf)."""
    cdf, p, total = [], math.exp(-1.0), 0.0
    for k in range(kmax):
        total += p
        cdf.append(total)
        p /= (k + 1)
    return sum(((u > F.lit(c)).cast("int") for c in cdf), F.lit(0))


def sobol_confidence(outputs: DataFrame, key: str, names: Sequence[str],
                     n_resamples: int = 100, n_blocks: int = 1000, seed: int = 42,
                     z: float = Z_975) -> tuple[DataFrame, DataFrame | None]:
    """Indices with bootstrap half-widths ``z * stddev``.

    Rows are hashed into ``n_blocks`` blocks and reduced to per-block sums
    (one scan); every replicate re-weights the blocks with Poisson(1) weights
    (blocks x replicates rows, independent of the data size).  Replicate 0
    has weight 1 everywhere and carries the point estimate.  Returns
    ``(feature, s1, s1_conf, st, st_conf)`` and, with second-order outputs,
    ``(feature_i, feature_j, s2, s2_conf)``.
    """
    d = len(names)
    second = "y_BA0" in outputs.columns
    q = _quantities(d, second)
    block = F.floor(uniform(key, seed, "boot_block") * F.lit(n_blocks)).cast("int")
    sums = _sums(outputs.withColumn("blk", block), ["blk"], q)
    reps = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_resamples))).alias("rep"))
    w = _poisson1(uniform(F.concat_ws(":", F.col("blk").cast("string"), F.col("rep").cast("string")),
                          seed, "boot_weight"))
    reps = reps.withColumn("w", F.when(F.col("rep") == 0, F.lit(1)).otherwise(w))
    rep_sums = _sums(reps, ["rep"], q, weight="w")
    est_rep = _estimate(rep_sums, d, second, keep=["rep"])
    est = [c for c in est_rep.columns if c != "rep"]
    is_point = F.col("rep") == 0
    both = est_rep.agg(*[F.max(F.when(is_point, F.col(n))).alias(n) for n in est],
                       *[(F.stddev_samp(F.when(~is_point, F.col(n))) * F.lit(z)).alias(f"c_{n}")
                         for n in est])
    first = ", ".join(f"'{nm}', S1_{j}, c_S1_{j}, ST_{j}, c_ST_{j}" for j, nm in enumerate(names))
    indices = both.selectExpr(f"stack({d}, {first}) AS (feature, s1, s1_conf, st, st_conf)")
    pairs = None
    if second:
        pl = [(j, k) for j in range(d) for k in range(j + 1, d)]
        items = ", ".join(f"'{names[j]}', '{names[k]}', S2_{j}_{k}, c_S2_{j}_{k}" for j, k in pl)
        pairs = both.selectExpr(f"stack({len(pl)}, {items}) AS (feature_i, feature_j, s2, s2_conf)")
    return indices, pairs


def ishigami(a: float = 7.0, b: float = 0.1) -> Callable[[list], Column]:
    """The Ishigami test function on inputs already mapped to [-pi, pi]."""
    def f(x: list) -> Column:
        return F.sin(x[0]) + F.lit(a) * F.sin(x[1]) ** 2 + F.lit(b) * x[2] ** 4 * F.sin(x[0])
    return f
