"""End-to-end jobs: the three entry points of the modelled workflow.

``train_and_evaluate``  (E-1) preset features -> balance -> split -> scale
                        (fitted on train) -> sweep -> best -> reports ->
                        persisted bundle, histories and run metrics
``evaluate_saved``      (V8) reload a bundle and score test and all rows
``explore``             profile tables of a labelled table (summary, distincts,
                        histograms, box statistics, densities, correlations,
                        cross-tabs)
``feature_scores``      (E-2) preset features -> ANOVA F ranking
``sensitivity``         (E-3) Sobol indices of a saved bundle

Each job is a composition of the operators; the bundle holds everything a
later job needs (label dictionaries, scaler numbers, network weights), so
scoring never re-fits encoders.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe import presets as P
from riskframe.operators import encoders as E
from riskframe.operators.filters import outlier_filter, require_target
from riskframe.operators import metrics as M
from riskframe.operators import profile as PR
from riskframe.operators import sampling as S
from riskframe.operators import scoring as SC
from riskframe.operators import sensitivity as Y
from riskframe.operators import training as TR
from riskframe.plans import features as FE
from riskframe.session import cut_lineage
from riskframe.sources import io as IO


def prepare(loans: DataFrame, preset: str = "full", seed: int = P.SEED, fit_on: str = "train",
            balance: bool = True):
    """Features, exact balance (unless ``balance`` is off), nested split,
    scaler.  ``fit_on="train"``
    fits the scaler on training rows only; ``"all"`` fits it on the whole
    balanced table before splitting, as the modelled scripts do (it lets test
    statistics into the scaler - for parity runs only)."""
    require_target(loans, P.TARGET)
    plan = {"full": FE.full_features, "subset": FE.subset_features,
            "raw_with_id": FE.raw_with_id_features}[preset](loans)
    rows = (S.balanced_undersample(plan.frame, plan.target, P.KEY, seed=seed) if balance
            else plan.frame)
    balanced = cut_lineage(rows)
    split = cut_lineage(S.random_split(balanced, P.KEY, (P.TEST_FRACTION, P.VAL_FRACTION),
                                       seed=seed))
    fit_rows = split.where(F.col("split") == "train") if fit_on == "train" else split
    scaler = E.fit_standard_scaler(fit_rows, plan.features)
    scaled = scaler.transform(split, plan.features)
    return plan, scaled, scaler


def train_and_evaluate(loans: DataFrame, out_dir: str, preset: str = "full",
                       configs: Sequence[dict] | None = None, seed: int = P.SEED,
                       fit_on: str = "train", balance: bool = True, **train_kw) -> dict:
    """E-1.  Returns ``{"results", "best", "report", "confusion"}`` DataFrames
    and writes ``model``, ``history``, ``report`` and ``metrics`` under
    ``out_dir`` (any shared filesystem path)."""
    spark = loans.sparkSession
    plan, scaled, scaler = prepare(loans, preset, seed, fit_on, balance)
    configs = list(configs or [{"hidden": [h]} for h in P.SWEEP_NEURONS_FULL])
    rows, models = TR.sweep(scaled, plan.features, plan.target, configs, **train_kw)
    results = spark.createDataFrame(
        rows, "config_idx int, hidden string, activation string, val_loss double, "
              "test_accuracy double, seconds double")
    best_row = sorted(rows, key=lambda r: (-(r["test_accuracy"] or 0.0), r["config_idx"]))[0]
    best = models[best_row["config_idx"]].model
    test = SC.score(scaled.where(F.col("split") == "test"), best, plan.features)
    report = M.classification_report(test, plan.target, "prediction", [0, 1])
    confusion = M.confusion_matrix(test, plan.target, "prediction", [0, 1])
    history = TR.history_frame(spark, [h for m in models for h in m.history])
    save_bundle(spark, f"{out_dir}/model", preset, plan, scaler, best, balance)
    IO.write_history(history, f"{out_dir}/history")
    IO.write_report(report, f"{out_dir}/report")
    IO.append_metrics(results.withColumn("run", F.lit(out_dir)), f"{out_dir}/metrics")
    return {"results": results, "best": M.best_configuration(
        results.withColumnRenamed("test_accuracy", "accuracy")), "report": report,
        "confusion": confusion}


def save_bundle(spark, model_dir: str, preset: str, plan: FE.FeaturePlan, scaler: E.Standardization,
                network: SC.MLP, balance: bool = True) -> None:
    """Everything that scoring needs: the fitted numbers as a one-row table,
    the label dictionary as a table beside it."""
    bundle = {"preset": preset, "balanced": json.dumps(balance),
              "features": json.dumps(plan.features), "mlp": network.to_json(),
              "scaler": scaler.to_json(), "labels": json.dumps(plan.label_encoding is not None)}
    if plan.label_encoding is not None:
        plan.label_encoding.save(_labels_of(model_dir))
    if plan.one_hot is not None:
        bundle["one_hot"] = json.dumps(plan.one_hot.categories)
    if plan.risk_scaler is not None:
        bundle["risk_scaler"] = plan.risk_scaler.to_json()
    IO.save_model(spark, model_dir, bundle)


def _labels_of(model_dir: str) -> str:
    """Folder of a bundle's label dictionary: a table beside the bundle."""
    return f"{model_dir.rstrip('/')}_labels"


def _apply_bundle(loans: DataFrame, bundle: dict, model_dir: str) -> tuple[DataFrame, list[str]]:
    """Rebuild the preset's features from the saved fitted state (no re-fit),
    not scaled yet: a key that is a feature too still draws the same samples."""
    preset = bundle["preset"]
    feats = json.loads(bundle["features"])
    labels = (E.LabelDictionary.load(loans.sparkSession, _labels_of(model_dir))
              if json.loads(bundle["labels"]) else None)
    if preset == "subset":
        eng = FE.engineer(loans, E.Standardization.from_json(bundle["risk_scaler"]))
        df = E.OneHotEncoding(json.loads(bundle["one_hot"])).transform(
            outlier_filter(eng, P.OUTLIER_BOUNDS))
    else:
        df = outlier_filter(loans, P.OUTLIER_BOUNDS)
    if labels is not None:
        df = labels.transform(df)
    return df, feats


def score_saved(loans: DataFrame, model_dir: str, seed: int = P.SEED) -> DataFrame:
    """The rows of the saved bundle's population with split, probability and
    prediction; samples and split are re-derived from the same seed."""
    bundle = IO.load_model(loans.sparkSession, model_dir)
    rows, feats = _apply_bundle(loans, bundle, model_dir)
    if json.loads(bundle.get("balanced", "true")):
        rows = S.balanced_undersample(rows, P.TARGET, P.KEY, seed=seed)
    split = S.random_split(rows, P.KEY, (P.TEST_FRACTION, P.VAL_FRACTION), seed=seed)
    scaled = E.Standardization.from_json(bundle["scaler"]).transform(split, feats)
    return SC.score(scaled, SC.MLP.from_json(bundle["mlp"]), feats)


def evaluate_saved(loans: DataFrame, model_dir: str, seed: int = P.SEED) -> DataFrame:
    """V8: per-split and overall metrics of a saved bundle in one pass."""
    return M.evaluate_by(score_saved(loans, model_dir, seed), "split", P.TARGET)


def report_saved(loans: DataFrame, model_dir: str, seed: int = P.SEED) -> dict[str, DataFrame]:
    """V8: classification reports and confusion matrices of a saved bundle on
    every split and on all rows, all from one scan of the scored rows."""
    cube = cut_lineage(M.evaluation_cube(score_saved(loans, model_dir, seed), "split", P.TARGET))
    return {"report": M.cube_report(cube), "confusion": M.cube_confusion(cube)}


def explore(df: DataFrame, target: str = P.TARGET, key: str | None = P.KEY,
            bins: int = 20) -> dict:
    """Profile tables of a labelled table, all lazy or bounded: column info,
    summary statistics, distinct counts and values, histograms, box
    statistics and densities by target, correlations of the numeric columns,
    counts and row percentages of every string column by target."""
    from riskframe.operators.filters import columns_of
    cols = [c for c in df.columns if c != key]
    numeric = [c for c in columns_of(df.select(*cols)) if c != target]
    strings = columns_of(df.select(*cols), ["string"])
    return {
        "column_info": PR.column_info(df),
        "describe": PR.describe(df, numeric + [target]),
        "distinct_counts": PR.distinct_counts(df, cols),
        "distinct_values": PR.distinct_values(df, strings) if strings else None,
        "histogram": PR.histogram(df, numeric, bins),
        "box_stats": PR.box_stats(df, numeric, target),
        "class_density": PR.class_density(df, numeric, target),
        "correlation": PR.correlation(df, numeric + [target]),
        "crosstab_pct": PR.crosstab_percent(df, strings, target) if strings else None,
    }


def feature_scores(loans: DataFrame, k: int | None = None, preset: str = "subset") -> DataFrame:
    """E-2: preset features (``"subset"`` engineered, or ``"full"`` label
    encoded) ranked by ANOVA F, with p-values."""
    sub = FE.subset_features(loans) if preset == "subset" else FE.full_features(loans)
    ranked = PR.anova_f(sub.frame, sub.features, sub.target, with_pvalue=True)
    ranked = ranked.orderBy(F.desc_nulls_last("f_score"), "feature")
    return ranked if k is None else ranked.limit(k)


def sensitivity(loans: DataFrame, model_dir: str, n_resamples: int = P.SOBOL_BOOTSTRAP,
                bounds: str = "data", n_base: int | None = None):
    """E-3: Sobol indices of a saved bundle with bootstrap half-widths.

    The base samples are the table's rows (one per row), or exactly
    ``n_base`` of them drawn without replacement (``P.SOBOL_BASE_SAMPLES`` is
    the modelled run's size).  ``bounds="data"`` samples each feature over
    its observed range; ``"unit"`` samples [0, 1] in raw units as the
    modelled script does."""
    bundle = IO.load_model(loans.sparkSession, model_dir)
    unscaled, feats = _apply_bundle(loans, bundle, model_dir)
    raw = unscaled.select(P.KEY)  # the design only needs the keys
    if n_base is not None:
        raw = S.sample_exact(raw, P.KEY, n_base, salt="sobol_base")
    if bounds == "unit":
        problem = Y.unit_problem(feats)
    else:
        problem = Y.problem_from_data(unscaled, feats)
    scaler = E.Standardization.from_json(bundle["scaler"])
    design = Y.saltelli_design(raw, P.KEY, len(feats))
    out = Y.evaluate_design(design, P.KEY, problem, SC.MLP.from_json(bundle["mlp"]),
                            transform=lambda j, x: scaler.column(feats[j], source=x))
    return Y.sobol_confidence(out, P.KEY, feats, n_resamples=n_resamples)
