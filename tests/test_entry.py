"""Driver contract and the loans fixture statistics (FIXTURES F-1)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskframe import presets as P
from riskframe.operators.filters import outlier_filter
from riskframe.sources.tables import loans

from conftest import SF001, SF01


@pytest.mark.parametrize("sf, rows, null_emp, null_rate, pos, kept, kept_pos", [
    (SF001, 1500, 16, 17, 207, 1131, 157),
    (SF01, 15000, 155, 169, 2095, 10794, 1610),
])
def test_fixture_statistics(spark, sf, rows, null_emp, null_rate, pos, kept, kept_pos):
    df = loans(spark, sf)
    r = df.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"),
               F.count_if(F.col("person_emp_length").isNull()).alias("ne"),
               F.count_if(F.col("loan_int_rate").isNull()).alias("nr"),
               F.sum("loan_status").alias("pos")).collect()[0]
    assert (r.n, r.ids, r.ne, r.nr, r.pos) == (rows, rows, null_emp, null_rate, pos)
    f = outlier_filter(df, P.OUTLIER_BOUNDS).agg(F.count("*"), F.sum("loan_status")).collect()[0]
    assert tuple(f) == (kept, kept_pos)


def test_entry_smoke(spark):
    out = entry.entry(spark)
    rows = out.collect()
    assert len(rows) == 7 and [r.loan_grade for r in rows] == list("ABCDEFG")
    assert out.columns == ["loan_grade", "loan_grade_num", "n_0", "n_1", "pct_0", "pct_1"]


def test_every_sql_query_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("sink, source", [("report_sink", "class_report"), ("metrics_sink", "eval_by_split")])
def test_sinks_give_back_what_they_got(spark, sink, source):
    registered = entry.queries()
    got, want = registered[sink](spark, SF001), registered[source](spark, SF001)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_preparing_without_a_target_fails(spark):
    from riskframe.plans import jobs
    with pytest.raises(ValueError, match=P.TARGET):
        jobs.prepare(loans(spark, SF001).drop(P.TARGET))
