"""End-to-end jobs on the smallest fixture: train -> persist -> evaluate the
saved bundle -> sensitivity, and feature scoring."""

import pytest

from riskframe.plans import jobs
from riskframe.sources.tables import loans

from conftest import SF001


@pytest.mark.parametrize("preset", ["full", "subset"])
def test_train_persist_evaluate(spark, tmp_path, preset):
    df = loans(spark, SF001)
    out = str(tmp_path / preset)
    res = jobs.train_and_evaluate(df, out, preset=preset,
                                  configs=[{"hidden": [5]}, {"hidden": [3]}],
                                  fit_on="train" if preset == "full" else "all",
                                  rounds=2, iters_per_round=20)
    rows = res["results"].collect()
    assert len(rows) == 2 and all(r.test_accuracy > 0.5 for r in rows)
    assert res["best"].count() == 1
    assert spark.read.parquet(f"{out}/history").count() >= 2
    ev = {r.split: r for r in jobs.evaluate_saved(df, f"{out}/model").collect()}
    assert set(ev) == {"train", "val", "test", "all"}
    assert ev["all"].n == ev["train"].n + ev["val"].n + ev["test"].n
    best_acc = max(r.test_accuracy for r in rows)
    assert ev["test"].accuracy == pytest.approx(best_acc)
    if preset == "full":
        ind, pairs = jobs.sensitivity(df, f"{out}/model", n_resamples=20)
        unit, _ = jobs.sensitivity(df, f"{out}/model", n_resamples=5, bounds="unit",
                                   n_base=500)
        assert unit.count() == 11
        got = ind.collect()
        assert len(got) == 11 and all(r.st is not None for r in got)
        assert pairs.count() == 55


def test_feature_scores(spark):
    got = jobs.feature_scores(loans(spark, SF001), k=3).collect()
    assert len(got) == 3 and got[0].f_score >= got[1].f_score >= got[2].f_score
    assert all(0.0 <= r.p_value <= 1.0 for r in got)


def test_explore_tables(spark):
    out = jobs.explore(loans(spark, SF001))
    assert out["describe"].count() == 8
    assert out["column_info"].count() == 13
    assert out["crosstab_pct"].count() > 0 and out["correlation"].count() == 64
    assert out["box_stats"].count() == 14 and out["histogram"].count() == 7 * 20
    full = jobs.feature_scores(loans(spark, SF001), preset="full").collect()
    assert len(full) == 11
