"""Profiling operators against numpy / pandas on literal data."""

import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskframe.operators import profile as PR
from riskframe.functions.keys import from_order_key, with_order_key
from riskframe.operators.quantiles import quantile_table


def test_correlation_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double")
    r = {(x.col_a, x.col_b): x.r for x in PR.correlation(df).collect()}
    assert r[("a", "b")] is None
    assert r[("a", "a")] == pytest.approx(1.0)


def test_correlation_pairwise_complete(spark):
    rows = [(1.0, 2.0), (2.0, None), (3.0, 7.0), (4.0, 8.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {(x.col_a, x.col_b): x.r for x in PR.correlation(df).collect()}
    expect = pd.DataFrame(rows, columns=["a", "b"]).corr().loc["a", "b"]
    assert got[("a", "b")] == pytest.approx(expect)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60),
       st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]))
def test_exact_quantiles_match_numpy(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    q = quantile_table(df, ["x"], [p]).first()
    assert q.q0 == pytest.approx(np.quantile(values, p))
    assert (q.n, q.min, q.max) == (len(values), min(values), max(values))


def test_exact_quantiles_heavy_ties_and_refinement(spark):
    values = [5.0] * 500 + [float(v) for v in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    q = quantile_table(df, ["x"], [0.25, 0.5, 0.75], bits=8).first()
    for p, got in zip((0.25, 0.5, 0.75), (q.q0, q.q1, q.q2)):
        assert got == pytest.approx(np.quantile(values, p))


@pytest.mark.parametrize("bits", [11, 16])
def test_quantiles_by_group_with_missing_values(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice(["a", "b", None]), rng.choice(
        [None, math.nan, float(rng.randint(0, 9)), rng.gauss(0, 1e6), rng.gauss(0, 1e-6)]),
        rng.randint(-3, 3), None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double, y int, z double").repartition(5)
    probs = [0, 0.25, 0.5, 0.9, 1.0]
    got = quantile_table(df, ["x", "y", "z"], probs, ["g"], bits).collect()
    assert len(got) == 6                                # z has no values
    for r in got:
        v = [float(t[1] if r.column == "x" else t[2]) for t in rows
             if t[0] == r.g and t[1 if r.column == "x" else 2] is not None]
        v = [x for x in v if x == x]
        assert r.n == len(v)
        assert [r.q0, r.q1, r.q2, r.q3, r.q4] == pytest.approx(np.quantile(v, probs).tolist())
    assert quantile_table(df.limit(0), ["x"], probs, ["g"], bits).count() == 0


def test_quantiles_of_extreme_values(spark):
    values = [-math.inf, -1.7e308, -5e-324, -0.0, 0.0, 5e-324, 2.0 ** -1022, 1.7e308, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [i / 8 for i in range(9)]
    q = quantile_table(df, ["x"], probs).first()
    assert [q[f"q{i}"] for i in range(9)] == values


def test_order_keys_are_the_bits(spark):
    rng, values = random.Random(3), [0.0, math.inf, 1.7976931348623157e308]
    for e in range(-1074, 1024):
        values += [2.0 ** e, math.nextafter(2.0 ** e, 0.0), math.nextafter(2.0 ** e, math.inf)]
    values += [v for v in (struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0]
                           for _ in range(3000)) if v == v]
    df = spark.createDataFrame([(x,) for v in values for x in (v, -v)], "x double")
    for r in with_order_key(df, "x", "k").withColumn("back", from_order_key(F.col("k"))).collect():
        bits = struct.unpack("q", struct.pack("d", abs(r.x)))[0]
        assert r.k == (-bits if r.x < 0 else bits) and r.back == r.x


def test_profiles_of_empty_tables_and_odd_values(spark):
    schema = "x double, y double, g string"
    empty = spark.createDataFrame([], schema)
    assert [(r["column"], r["count"], r["mean"], r["p50"]) for r in
            PR.describe(empty, ["x", "y"]).orderBy("column").collect()] == [
        ("x", 0, None, None), ("y", 0, None, None)]
    for out in (PR.histogram(empty, ["x", "y"]), PR.class_density(empty, ["x"], "g"),
                PR.box_stats(empty, ["x"], "g")):
        assert out.count() == 0
    rows = [(math.nan, None, "a"), (math.inf, math.nan, "a"), (1.0, None, None), (2.0, None, None),
            (4.0, None, "a"), (None, None, "a")]
    df = spark.createDataFrame(rows, schema)
    d = {r["column"]: r for r in PR.describe(df, ["x", "y"]).collect()}
    assert (d["x"]["count"], d["x"]["min"], d["x"]["p25"], d["y"]["count"]) == (4, 1.0, 1.75, 0)
    h = PR.histogram(df, ["x", "y"], 3).collect()
    assert sorted((r.bin, r.bin_lo, r.bin_hi, r["count"]) for r in h) == [
        (0, 1.0, 2.0, 1), (1, 2.0, 3.0, 1), (2, 3.0, 4.0, 1)]
    b = {r.g: r for r in PR.box_stats(df, ["x", "y"], "g").collect()}
    assert b.keys() == {"a", None} and b[None].median == 1.5 and b[None].n_outliers == 0
    k = PR.class_density(df, ["x", "y"], "g", bins=4).collect()
    assert {r.g for r in k} == {"a", None} and len(k) == 8
    assert all(r.density is None for r in k if r.g == "a")      # one finite value: no bandwidth
    assert all(r.density > 0 for r in k if r.g is None)


def test_describe_matches_pandas(spark):
    rng = np.random.RandomState(1)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.randint(0, 9, 200).astype(float)})
    pdf.loc[3, "a"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double")
    got = {r.column: r for r in PR.describe(df).collect()}
    want = pdf.describe()
    for c in ("a", "b"):
        assert got[c]["count"] == want.loc["count", c]
        for name, key in (("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                          ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert got[c][name] == pytest.approx(want.loc[key, c])


def test_anova_f_matches_formula(spark):
    rng = np.random.RandomState(0)
    y = rng.randint(0, 2, 300)
    x = rng.normal(size=300) + y
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y long")
    r = PR.anova_f(df, ["x"], "y", with_pvalue=True).collect()[0]
    groups = [x[y == k] for k in (0, 1)]
    m = x.mean()
    ssb = sum(len(g) * (g.mean() - m) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    f = (ssb / 1) / (ssw / (len(x) - 2))
    assert r.f_score == pytest.approx(f)
    assert 0 <= r.p_value < 1e-6


def test_f_pvalue_known_values():
    # F(1, 10) upper tail at 4.9646 is 0.05; F(2, 20) at 3.4928 is 0.05.
    assert PR._f_sf(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert PR._f_sf(3.4928, 2, 20) == pytest.approx(0.05, abs=1e-4)


@pytest.mark.parametrize("rows", [30, 1e4, 1e9, 1e12])
def test_f_pvalue_at_any_number_of_rows(rows):
    # two degrees of freedom above: the tail is (1 + 2 f / d2) ^ (-d2 / 2)
    for f in (1e-9, 0.1, 1.0, 3.0, 20.0, 200.0):
        want = math.exp(-rows / 2 * math.log1p(2 * f / rows))
        assert PR._f_sf(f, 2, rows) == pytest.approx(want, rel=1e-8)
    # one degree: the normal tail in the limit; many: a sum of Poisson terms
    if rows >= 1e9:
        for f in (0.01, 1.0, 4.0, 30.0):
            assert PR._f_sf(f, 1, rows) == pytest.approx(math.erfc(math.sqrt(f / 2)), rel=1e-6)
            z = 10 * f / 2
            tail = math.exp(-z) * sum(z ** k / math.factorial(k) for k in range(5))
            assert PR._f_sf(f, 10, rows) == pytest.approx(tail, rel=1e-6)
    assert PR._f_sf(math.inf, 3, rows) == 0.0 and PR._f_sf(0.0, 3, rows) == 1.0


def test_histogram_matches_numpy(spark):
    rng = np.random.RandomState(3)
    v = rng.normal(size=500)
    df = spark.createDataFrame([(float(a),) for a in v], "x double")
    h = sorted((r.bin, r["count"]) for r in PR.histogram(df, ["x"], 20).collect())
    counts, _ = np.histogram(v, bins=20)
    assert [c for _, c in h] == counts.tolist()


def test_box_stats_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([(v, 0) for v in vals], "x double, g int")
    r = PR.box_stats(df, ["x"], "g").collect()[0]
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    assert (r.q1, r.q3) == (pytest.approx(q1), pytest.approx(q3))
    assert r.whisker_hi == 5.0 and r.whisker_lo == 1.0 and r.n_outliers == 1


def test_crosstab_absent_pair_is_null(spark):
    df = spark.createDataFrame([("A", 0), ("A", 1), ("B", 0)], "g string, y int")
    got = {r.g: (r.n_0, r.n_1) for r in PR.crosstab(df, "g", "y").collect()}
    assert got == {"A": (1, 1), "B": (1, None)}
    pct = {(r.column, r.value): (r.pct_0, r.pct_1)
           for r in PR.crosstab_percent(df, ["g"], "y").collect()}
    assert pct[("g", "B")] == (100.0, None)


def test_class_density_matches_direct_kde(spark):
    rng = np.random.RandomState(5)
    x = np.concatenate([rng.normal(0, 1, 400), rng.normal(3, 0.5, 200)])
    y = np.array([0] * 400 + [1] * 200)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    out = PR.class_density(df, ["x"], "y", bins=200).collect()
    step = (x.max() - x.min()) / 200
    for k in (0, 1):
        rows = sorted((r.bin, r.x, r.density) for r in out if r.y == k)
        dens = np.array([d for _, _, d in rows])
        assert dens.sum() * step == pytest.approx(1.0, abs=0.02)
        xs = x[y == k]
        h = xs.std(ddof=1) * len(xs) ** -0.2
        grid = np.array([g for _, g, _ in rows])
        direct = np.exp(-0.5 * ((grid[:, None] - xs[None, :]) / h) ** 2).sum(1) / (
            len(xs) * h * np.sqrt(2 * np.pi))
        assert np.abs(dens - direct).max() < 0.02 * direct.max()


def test_correlation_stable_under_large_offset(spark):
    rng = np.random.RandomState(11)
    a = 1e9 + rng.normal(size=2000)
    b = 0.5 * (a - 1e9) + rng.normal(size=2000) - 3e8
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = {(r.col_a, r.col_b): r.r for r in PR.correlation(df).collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)


def test_value_counts_and_group_sizes_drop_missing(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1), ("b", None)], "c string, y int")
    assert {r.value: r["count"] for r in PR.value_counts(df, "c").collect()} == {"a": 2, "b": 1}
    assert len(PR.value_counts(df, "c", dropna=False).collect()) == 3
    assert PR.group_sizes(df, "c", "y").count() == 2


def test_co_moment_blocks_merge_exactly():
    rng = np.random.default_rng(8)
    x = rng.normal(1e6, 1.0, (500, 3))
    x[rng.random((500, 3)) < 0.2] = np.nan
    x[:, 2] = np.where(np.isnan(x[:, 2]), np.nan, 0.1)      # constant
    whole = PR.co_moments(x)
    merged = PR.co_moments(x[:1])
    for a, b in ((1, 1), (1, 7), (7, 200), (200, 500)):
        merged = PR.merged(merged, PR.co_moments(x[a:b]))
    for name in whole:
        assert np.allclose(whole[name], merged[name], rtol=1e-9, atol=1e-9), name
    both = ~np.isnan(x[:, 0]) & ~np.isnan(x[:, 1])
    assert whole["n"][0, 1] == both.sum()
    assert whole["xy"][0, 1] == pytest.approx(
        ((x[both, 0] - x[both, 0].mean()) * (x[both, 1] - x[both, 1].mean())).sum())


def test_correlation_does_not_depend_on_order_or_leading_rows(spark):
    rng = np.random.default_rng(9)
    a = np.r_[rng.normal(1e9, 1e-3, 1500), rng.normal(0, 1, 3000)]      # a misleading prefix
    pdf = pd.DataFrame({"a": a, "b": a * 0.5 + rng.normal(0, 1e8, len(a)), "c": 0.1,
                        "d": np.where(rng.random(len(a)) < 0.3, np.nan, rng.normal(0, 1, len(a)))})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double")
    want = pdf.corr()
    for some in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("b"))):
        for r in PR.correlation(some).collect():
            if "c" in (r.col_a, r.col_b):
                assert r.r is None
            else:
                assert r.r == pytest.approx(want.loc[r.col_a, r.col_b], abs=1e-12)
    assert all(r.r is None for r in PR.correlation(df.limit(0)).collect())


def test_exact_quantiles_grouped_general_path(spark):
    rng = np.random.RandomState(4)
    vals = rng.randint(0, 40, 600).astype(float)
    grp = rng.randint(0, 3, 600)
    df = spark.createDataFrame([(float(v), int(g)) for v, g in zip(vals, grp)], "x double, g int")
    q = {r.g: r for r in quantile_table(df, ["x"], [0.1, 0.5, 0.9], ["g"], bits=12).collect()}
    for g in range(3):
        for p, got in zip((0.1, 0.5, 0.9), (q[g].q0, q[g].q1, q[g].q2)):
            assert got == pytest.approx(np.quantile(vals[grp == g], p))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(-1e3, 1e3)),
                          st.one_of(st.none(), st.floats(-1e3, 1e3))), min_size=3, max_size=60))
def test_correlation_property_vs_pandas(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double")
    got = {(r.col_a, r.col_b): r.r for r in PR.correlation(df).collect()}
    want = pd.DataFrame(rows, columns=["a", "b"], dtype=float).corr().loc["a", "b"]
    if got[("a", "b")] is None or np.isnan(want):
        # undefined either way: fewer than two complete rows or a constant column
        assert got[("a", "b")] is None or abs(got[("a", "b")]) <= 1 + 1e-9
    else:
        assert got[("a", "b")] == pytest.approx(want, abs=1e-6)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-1000, 1000), min_size=2, max_size=80))
def test_histogram_property_vs_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [c for _, c in sorted((r.bin, r["count"]) for r in PR.histogram(df, ["x"], 20).collect())]
    counts, _ = np.histogram(np.array(values, dtype=float), bins=20)
    assert sum(got) == len(values)
    assert got == counts.tolist()


def test_approximate_modes_close_to_exact(spark):
    rng = np.random.RandomState(9)
    v = rng.normal(size=5000)
    k = rng.randint(0, 700, 5000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, k)], "x double, k long")
    approx = {r.column: r for r in PR.describe(df, ["x"], exact=False).collect()}["x"]
    exact = {r.column: r for r in PR.describe(df, ["x"]).collect()}["x"]
    assert approx["count"] == exact["count"] and approx.mean == pytest.approx(exact.mean)
    for p in ("p25", "p50", "p75"):
        assert abs(approx[p] - exact[p]) < 0.01
    d = {r.column: r.n_distinct for r in PR.distinct_counts(df, ["k"], approx=True).collect()}
    assert abs(d["k"] - len(set(k.tolist()))) <= 0.05 * len(set(k.tolist()))
