"""Exact sampling and splitting: counts, determinism, agreement with a plain
row_number ranking, and partition independence."""

import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskframe.operators import sampling as S


def _md5_rank(keys, seed, salt, n):
    return set(sorted(keys, key=lambda k: (hashlib.md5(f"{salt}:{seed}:{k}".encode()).hexdigest(),
                                           k))[:n])


def test_balanced_matches_brute_force(spark):
    rows = [(i, int(i % 7 == 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, y int")
    got = S.balanced_undersample(df, "y", "id", seed=42)
    counts = dict(got.groupBy("y").count().collect())
    assert counts[0] == counts[1] == sum(1 for _, y in rows if y == 1)
    kept0 = {r.id for r in got.where("y = 0").collect()}
    assert kept0 == _md5_rank([i for i, y in rows if y == 0], 42, "sample", counts[1])


def test_every_rank_is_cut_exactly(spark):
    """Cuts at the edges, in the middle and beyond, several per group, and a
    null group; the search needs its second step in crowded buckets."""
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(3000)],
                               "id long, g int")
    sizes = {None: 600, 0: 1200, 1: 1200}
    ranks = [(g, i, q, n) for g, n in sizes.items() for i, q in enumerate((0, 1, 234, 599, 5000))]
    counts = S.group_counts(df, "id", 7, "t", "g")
    cuts = S.cut_points(df, counts, spark.createDataFrame(ranks, "g int, i int, q long, total long"),
                        "id", 7, "t", "g").collect()
    got = {(r.g, r.i): r.cut for r in cuts}
    assert len(got) == len(cuts) == 12              # none for rank 0
    for g, i, q, _ in ranks:
        keys = [k for k in range(3000) if (None if k % 5 == 0 else k % 2) == g]
        kept = {k for k in keys
                if hashlib.md5(f"t:7:{k}".encode()).hexdigest() <= got.get((g, i), "")}
        assert kept == _md5_rank(keys, 7, "t", q)


def test_rank_inside_one_bucket(spark, monkeypatch):
    """With one digit per step both steps have many rows to tell apart."""
    monkeypatch.setattr(S, "DIGITS", 1)
    df = spark.range(3000)
    assert {r.id for r in S.sample_exact(df, "id", 1234, 7, "t").collect()} == \
        _md5_rank(range(3000), 7, "t", 1234)


def test_repeated_keys(spark):
    """Rows of one key stay together; a cut between them fails."""
    df = spark.range(100).unionAll(spark.range(100))
    assert S.sample_exact(df, "id", 40).count() == 40
    with pytest.raises(Exception, match="same key"):
        S.sample_exact(df, "id", 41).count()


def test_many_groups_and_plan(spark):
    """No bound on the number of groups; rows meet no window and no union."""
    df = spark.range(24_000).withColumn("y", F.col("id") % 12_000)
    df = df.unionAll(spark.range(24_000, 24_500).withColumn("y", F.lit(7).cast("long")))
    out = S.balanced_undersample(df.where("not (y = 3 and id > 12000)"), "y", "id")
    assert out.count() == 12_000 and out.select("y").distinct().count() == 12_000
    split = S.random_split(df, "id")
    for plan in (out._jdf.queryExecution().executedPlan().toString(),
                 split._jdf.queryExecution().executedPlan().toString()):
        assert "Window" not in plan
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()


def test_split_sizes_nested():
    assert S.split_sizes(16698, [0.2, 0.2]) == [3340, 2672]
    assert S.split_sizes(15, [0.2]) == [math.ceil(0.2 * 15)]


@settings(max_examples=8, deadline=None)
@given(st.integers(min_value=5, max_value=400), st.integers(min_value=1, max_value=8))
def test_split_disjoint_complete_and_partition_free(spark, n, parts):
    df = spark.createDataFrame([(i,) for i in range(n)], "id long").repartition(parts)
    out = S.random_split(df, "id", (0.2, 0.2), seed=42)
    rows = out.collect()
    assert len(rows) == n and len({r.id for r in rows}) == n
    sizes = {k: v for k, v in out.groupBy("split").count().collect()}
    n_test, n_val = S.split_sizes(n, [0.2, 0.2])
    assert sizes.get("test", 0) == n_test and sizes.get("val", 0) == n_val
    again = S.random_split(df.coalesce(1), "id", (0.2, 0.2), seed=42)
    assert {(r.id, r.split) for r in rows} == {(r.id, r.split) for r in again.collect()}


def test_sample_exact(spark):
    df = spark.range(1000)
    assert S.sample_exact(df, "id", 123).count() == 123
    assert S.sample_exact(df, "id", 0).count() == 0
    assert S.sample_exact(df, "id", 5000).count() == 1000


def test_skewed_class_spreads(spark):
    """A class holding most rows is still cut exactly."""
    df = spark.range(5000).withColumn("y", (F.col("id") % 50 == 0).cast("int"))
    out = S.balanced_undersample(df, "y", "id")
    assert dict(out.groupBy("y").count().collect()) == {0: 100, 1: 100}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=3), min_size=2, max_size=300),
       st.integers(min_value=1, max_value=6))
def test_balanced_property(spark, labels, parts):
    df = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "id long, y int") \
        .repartition(parts)
    out = S.balanced_undersample(df, "y", "id", seed=3)
    rows = out.collect()
    counts = {}
    for r in rows:
        counts[r.y] = counts.get(r.y, 0) + 1
    n_min = min(labels.count(v) for v in set(labels))
    assert set(counts) == set(labels) and set(counts.values()) == {n_min}
    assert {(r.id, r.y) for r in rows} <= set(enumerate(labels))
    again = S.balanced_undersample(df.coalesce(1), "y", "id", seed=3)
    assert {r.id for r in rows} == {r.id for r in again.collect()}


def test_null_class_is_a_class(spark):
    rows = [(i, None if i % 3 == 0 else i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int")
    out = S.balanced_undersample(df, "y", "id")
    counts = {}
    for r in out.collect():
        counts[r.y] = counts.get(r.y, 0) + 1
    n_min = min(sum(1 for _, y in rows if y == v) for v in (None, 0, 1))
    assert counts == {None: n_min, 0: n_min, 1: n_min}
