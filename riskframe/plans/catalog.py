"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables through the ``loans`` fixture (so its
work grows with the data) and returns a long table whose computed columns are
aliased like the oracle SQL in :mod:`riskframe.plans.oracle`.  Doubles are
rounded to 6 decimals for stable value hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import presets as P
from riskframe.functions import columns as C
from riskframe.operators import encoders as E
from riskframe.operators import filters as FL
from riskframe.operators import metrics as M
from riskframe.operators import minibatch as MB
from riskframe.operators import profile as PR
from riskframe.operators import sampling as S
from riskframe.operators import scoring as SC
from riskframe.operators import sensitivity as Y
from riskframe.operators import stages as ST
from riskframe.operators import training as TR
from riskframe.plans import features as FE
from riskframe.plans.jobs import prepare
from riskframe.session import cut_lineage
from riskframe.sources import io as IO
from riskframe.sources.tables import embedding_features, loans, table


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals (and fold -0.0)."""
    return df.select(*[C.round6(f.name).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


# ------------------------------------------------------------------ building blocks
def filtered(spark, sf) -> DataFrame:
    return FL.outlier_filter(loans(spark, sf), P.OUTLIER_BOUNDS)


def full_plan(spark, sf) -> FE.FeaturePlan:
    return FE.full_features(loans(spark, sf))


def balanced(spark, sf) -> DataFrame:
    """Balanced training table, materialised once in the shared checkpoint
    folder: every later fit/evaluation reads it instead of its lineage."""
    frame = full_plan(spark, sf).frame
    return cut_lineage(S.balanced_undersample(frame, P.TARGET, P.KEY, seed=P.SEED))


def split3(spark, sf) -> DataFrame:
    return cut_lineage(S.random_split(balanced(spark, sf), P.KEY,
                                      (P.TEST_FRACTION, P.VAL_FRACTION), seed=P.SEED))


NUMERIC_LOAN_COLUMNS = ["person_age", "person_income", "person_emp_length", "loan_amnt",
                        "loan_int_rate", "loan_percent_income", "cb_person_cred_hist_length",
                        "loan_status"]


# ------------------------------------------------------------------ flagship
def default_rate_by_grade(spark: SparkSession, sf: str) -> DataFrame:
    """Outlier filter -> per-grade counts of each status as columns ->
    row percentages, with the grade code, ordered by grade."""
    ct = PR.crosstab(filtered(spark, sf), "loan_grade", P.TARGET)
    tot = F.coalesce(F.col("n_0"), F.lit(0)) + F.coalesce(F.col("n_1"), F.lit(0))
    grade_num = C.map_values("loan_grade", P.GRADE_CODES).cast("int")
    out = ct.select("loan_grade", grade_num.alias("loan_grade_num"), "n_0", "n_1",
                    C.row_percent("n_0", tot).alias("pct_0"),
                    C.row_percent("n_1", tot).alias("pct_1"))
    return rounded(out).orderBy("loan_grade")


# ------------------------------------------------------------------ P / F / E
def q_outlier_filter(spark, sf):
    return rounded(filtered(spark, sf))


def q_grade_map(spark, sf):
    df = FE.grade_and_flag(loans(spark, sf))
    return df.select("id", "loan_grade", F.col("loan_grade_num").cast("int"),
                     "cb_person_default_on_file",
                     F.col("cb_person_default_on_file_num").cast("int"))


def q_interactions(spark, sf):
    df = FE.interactions(FE.grade_and_flag(loans(spark, sf)))
    return rounded(df.select("id", *P.INTERACTIONS))


def q_income_ratio(spark, sf):
    df = loans(spark, sf)
    return rounded(df.select("id", *[C.ratio(a, b).alias(n) for n, (a, b) in P.RATIOS.items()]))


def q_log_features(spark, sf):
    return rounded(FE.log_features(loans(spark, sf)).select("id", *P.LOG1P))


def q_risk_score(spark, sf):
    ln = loans(spark, sf)
    scaler = FE.fit_risk_scaler(ln)
    df = FE.risk_score(FE.grade_and_flag(ln), scaler)
    return rounded(df.select("id", "loan_risk_score"))


def q_emp_bins(spark, sf):
    return FE.bins(loans(spark, sf)).select("id", "person_emp_length", "emp_length_bin")


def q_age_bins(spark, sf):
    return FE.bins(loans(spark, sf)).select("id", "person_age", "age_bin")


def q_label_encode(spark, sf):
    df = FE.bins(loans(spark, sf))
    cols = P.CATEGORICAL + ["emp_length_bin", "age_bin"]
    enc = E.fit_label_encoder(df, cols)
    return enc.transform(df).select("id", *cols)


def q_one_hot(spark, sf):
    df = filtered(spark, sf)
    oh = E.fit_one_hot(df, ["person_home_ownership", "loan_intent"])
    return oh.transform(df).select("id", *oh.output_columns())


def q_one_hot_vector(spark, sf):
    """E2 as one sparse vector: order status, customers and order keys, as many
    entries as there are of them; each row's indices as text."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    out = E.one_hot_vector(df, ["o_orderstatus", "o_custkey", "o_orderkey"], "v")
    return out.select("o_orderkey", F.col("v.size").cast("long").alias("width"),
                      F.array_join(F.col("v.indices").cast("array<string>"), ",").alias("indices"))


def q_standard_scale(spark, sf):
    plan = full_plan(spark, sf)
    sc = E.fit_standard_scaler(plan.frame, plan.features)
    return rounded(sc.transform(plan.frame, plan.features).select("id", *plan.features))


def q_features_full(spark, sf):
    return rounded(full_plan(spark, sf).frame)


def q_features_raw_with_id(spark, sf):
    """The preset that keeps the key as a feature, assembled into
    one vector whose places are the columns here."""
    df = loans(spark, sf)
    FL.require_target(df, P.TARGET)
    plan = FE.raw_with_id_features(df)
    places = vector_to_array(F.col("features"))
    return rounded(E.assemble(plan.frame, plan.features).select(
        *[places[i].alias(f"f_{i}") for i in range(len(plan.features))], P.TARGET))


def q_features_subset(spark, sf):
    return rounded(FE.subset_features(loans(spark, sf)).frame)


def q_select_dtypes(spark, sf):
    """Numeric columns only (after dropping the key, P1)."""
    df = FL.drop_columns(loans(spark, sf), [P.KEY])
    return rounded(FL.select_dtypes(df, ["numeric"]))


def q_csv_source(spark, sf):
    """The loan table written as header CSV to the shared folder and read
    back with the explicit schema (NULLs written as empty fields)."""
    import uuid
    from riskframe.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskframe-csv/{uuid.uuid4().hex}"
    loans(spark, sf).write.option("header", True).csv(path)
    return rounded(IO.read_csv(spark, path, P.LOAN_SCHEMA))


def q_csv_by_name(spark, sf):
    """The file's columns stand in another order than the schema's, with
    one more among them; they are read by name."""
    import uuid
    from riskframe.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskframe-csv/{uuid.uuid4().hex}"
    given = loans(spark, sf)
    turned = given.select(F.lit("x").alias("further"), *reversed(given.columns))
    turned.write.option("header", True).csv(path)
    return rounded(IO.read_csv(spark, path, P.LOAN_SCHEMA))


# ------------------------------------------------------------------ R
def q_under_sample(spark, sf):
    frame = full_plan(spark, sf).frame.select(P.KEY, P.TARGET)
    return S.balanced_undersample(frame, P.TARGET, P.KEY, seed=P.SEED)


def q_split_2way(spark, sf):
    """R2: a single 20 % hold-out of the balanced table."""
    out = S.random_split(balanced(spark, sf), P.KEY, (P.TEST_FRACTION,), ("test", "train"),
                         seed=P.SEED)
    return out.select("id", "loan_status", "split")


def q_split_3way(spark, sf):
    """Test, validation and training rows of the balanced table."""
    out = S.random_split(balanced(spark, sf), P.KEY, (P.TEST_FRACTION, P.VAL_FRACTION),
                         seed=P.SEED)
    return out.select("id", "loan_status", "split")


# ------------------------------------------------------------------ A / O
def q_describe(spark, sf):
    return rounded(PR.describe(loans(spark, sf), NUMERIC_LOAN_COLUMNS))


def q_distinct_counts(spark, sf):
    cols = [c for c in P.LOAN_COLUMNS if c != "id"]
    return PR.distinct_counts(loans(spark, sf), cols)


def q_distinct_values(spark, sf):
    return PR.distinct_values(loans(spark, sf), P.CATEGORICAL)


def q_distinct_values_numeric(spark, sf):
    cols = [c for c in P.LOAN_COLUMNS if c not in ("id", *P.CATEGORICAL)]
    return rounded(PR.distinct_values(loans(spark, sf), cols))


def q_value_counts(spark, sf):
    return PR.value_counts(q_under_sample(spark, sf), P.TARGET).withColumnRenamed("value", "loan_status")


def q_column_info(spark, sf):
    return PR.column_info(loans(spark, sf))


def q_missing_counts(spark, sf):
    return FL.missing_counts(loans(spark, sf), NUMERIC_LOAN_COLUMNS)


def q_group_sizes(spark, sf):
    return PR.group_sizes(filtered(spark, sf), "loan_intent", P.TARGET)


def q_crosstab(spark, sf):
    return PR.crosstab(filtered(spark, sf), "loan_grade", P.TARGET)


def q_crosstab_3class(spark, sf):
    """A14 with a target of three classes, found in the data."""
    return rounded(PR.crosstab_percent(table(spark, sf, "orders"), ["o_orderpriority"],
                                       "o_orderstatus"))


def q_crosstab_pct(spark, sf):
    df = FE.bins(filtered(spark, sf))
    cols = P.CATEGORICAL + ["emp_length_bin"]
    return rounded(PR.crosstab_percent(df, cols, P.TARGET))


def q_correlation(spark, sf):
    plan = full_plan(spark, sf)
    return rounded(PR.correlation(plan.frame, plan.features + [P.TARGET]))


def q_anova_f(spark, sf):
    plan = full_plan(spark, sf)
    return rounded(PR.anova_f(plan.frame, plan.features, P.TARGET))


def q_anova_pvalue(spark, sf):
    """A9 with p-values (upper tail of F; the F distribution is not in SQL,
    so this one is rows-only; the p-value is unit-tested)."""
    plan = full_plan(spark, sf)
    return rounded(PR.anova_f(plan.frame, plan.features, P.TARGET, with_pvalue=True))


def q_select_k_best(spark, sf):
    sub = FE.subset_features(loans(spark, sf))
    return rounded(PR.select_k_best(sub.frame, sub.features, P.TARGET, k=5))


def q_histogram20(spark, sf):
    return rounded(PR.histogram(filtered(spark, sf), NUMERIC_LOAN_COLUMNS[:-1], bins=20))


def q_box_stats(spark, sf):
    return rounded(PR.box_stats(filtered(spark, sf), NUMERIC_LOAN_COLUMNS[:-1], P.TARGET))


def q_class_density(spark, sf):
    return rounded(PR.class_density(filtered(spark, sf), NUMERIC_LOAN_COLUMNS[:-1], P.TARGET,
                                    bins=32))


def q_preview(spark, sf):
    return rounded(PR.preview(FE.subset_features(loans(spark, sf)).frame, P.KEY, 10))


# ------------------------------------------------------------------ M6 / V
SCORE_HIDDEN = 5
SWEEP_HIDDEN = [5, 10, 15, 20]


def literal_model(n_inputs: int, hidden: int = SCORE_HIDDEN, phase: float = 0.0) -> SC.MLP:
    """The fixed-weight network of the metric checks (no training)."""
    return SC.rule_weights([n_inputs, hidden, 1], phase=phase)


def scaled_split(spark, sf) -> tuple[DataFrame, list[str]]:
    """Full-preset balanced split, standardised with a scaler fitted on the
    training rows only."""
    plan, scaled, _scaler = prepare(loans(spark, sf), "full", P.SEED)
    return scaled, plan.features


def predictions(spark, sf) -> DataFrame:
    """F-3 predictions: ``(id, split, loan_status, probability, prediction)``."""
    scaled, feats = scaled_split(spark, sf)
    out = SC.score(scaled, literal_model(len(feats)), feats, t=P.THRESHOLD)
    return out.select("id", "split", P.TARGET, "probability", "prediction")


def test_predictions(spark, sf) -> DataFrame:
    return predictions(spark, sf).where(F.col("split") == "test")


def q_mlp_score(spark, sf):
    return rounded(predictions(spark, sf))


#: Networks of the deep scoring check: name -> hidden layers, units in each.
DEEP_SCORED = {"p_10x10": (10, 10), "p_5x15": (5, 15)}


def deep_literal(n_inputs: int, layers: int, units: int) -> SC.MLP:
    """A fixed-weight deep network (no training)."""
    return SC.rule_weights([n_inputs, *[units] * layers, 1], scale=1.6)


def q_mlp_score_deep(spark, sf):
    """M6 of deep networks: 10 layers of 10 units and 5 layers of 15, in one pass."""
    scaled, feats = scaled_split(spark, sf)
    nets = {n: deep_literal(len(feats), *shape) for n, shape in DEEP_SCORED.items()}
    out = SC.batched_probabilities(scaled, nets, feats)
    return rounded(out.select("id", "split", P.TARGET, *nets))


def q_confusion(spark, sf):
    return M.confusion_matrix(test_predictions(spark, sf), P.TARGET, "prediction", [0, 1])


def q_confusion_norm(spark, sf):
    return rounded(M.confusion_normalized(test_predictions(spark, sf), P.TARGET, "prediction",
                                          [0, 1]))


def q_class_report(spark, sf):
    return rounded(M.classification_report(test_predictions(spark, sf), P.TARGET, "prediction",
                                           [0, 1]))


def q_accuracy(spark, sf):
    return rounded(M.accuracy(test_predictions(spark, sf), P.TARGET, "prediction"))


def q_bce(spark, sf):
    return rounded(M.binary_cross_entropy(test_predictions(spark, sf), P.TARGET, "probability"))


def q_eval_by_split(spark, sf):
    return rounded(M.evaluate_by(predictions(spark, sf), "split", P.TARGET))


def q_report_sink(spark, sf):
    """The classification report written as JSON lines and read back."""
    report = q_class_report(spark, sf)
    path = scratch(spark, "report")
    IO.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


def q_metrics_sink(spark, sf):
    """The figures of every split appended by a run of its own, then read
    back as one table."""
    figures = cut_lineage(q_eval_by_split(spark, sf))
    path = scratch(spark, "metrics")
    for split in ("train", "val", "test", "all"):
        IO.append_metrics(figures.where(F.col("split") == split), path)
    return spark.read.schema(figures.schema).parquet(path)


def scratch(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    import uuid
    from riskframe.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskframe-{name}/{uuid.uuid4().hex}"


def saved_literal_bundle(spark, sf) -> str:
    """A bundle of the fixed-weight network with its fitted dictionary and scaler,
    saved as the training job saves one; its folder."""
    from riskframe.plans import jobs
    plan, _, scaler = prepare(loans(spark, sf), "full", P.SEED)
    path = scratch(spark, "bundle") + "/model"
    jobs.save_bundle(spark, path, "full", plan, scaler, literal_model(len(plan.features)))
    return path


def q_saved_report(spark, sf):
    """V8: classification reports of a saved and reloaded model, test and all."""
    from riskframe.plans import jobs
    out = jobs.report_saved(loans(spark, sf), saved_literal_bundle(spark, sf))["report"]
    return rounded(out.where("split IN ('test', 'all')"))


def q_saved_confusion(spark, sf):
    """V8: confusion matrices of a saved and reloaded model, test and all."""
    from riskframe.plans import jobs
    out = jobs.report_saved(loans(spark, sf), saved_literal_bundle(spark, sf))["confusion"]
    return rounded(out.where("split IN ('test', 'all')"))


def q_saved_pipeline_score(spark, sf):
    """Dictionary, scaler and network as one ML pipeline, saved, loaded and
    applied to the raw rows."""
    from pyspark.ml import PipelineModel
    rows = filtered(spark, sf)
    labels = ST.LabelDictionaryEstimator(columns=P.CATEGORICAL).fit(rows)
    sample = cut_lineage(S.balanced_undersample(rows, P.TARGET, P.KEY, seed=P.SEED))
    split = cut_lineage(S.random_split(sample, P.KEY, (P.TEST_FRACTION, P.VAL_FRACTION),
                                       seed=P.SEED))
    scaler = ST.StandardizationEstimator(columns=P.FULL_FEATURES).fit(
        labels.transform(split.where("split = 'train'")))
    network = ST.DenseNetworkModel(columns=P.FULL_FEATURES, threshold=P.THRESHOLD,
                                   network=literal_model(len(P.FULL_FEATURES)).to_json())
    path = scratch(spark, "pipeline")
    PipelineModel([labels, scaler, network]).write().overwrite().save(path)
    out = PipelineModel.load(path).transform(split)
    return rounded(out.select("id", "split", P.TARGET, "probability", "prediction"))


def sweep_results(spark, sf) -> DataFrame:
    """Test accuracy of one fixed-weight network per hidden size, scored in
    one pass: ``(config_idx, neurons, accuracy)``."""
    scaled, feats = scaled_split(spark, sf)
    test = scaled.where(F.col("split") == "test")
    frame = test
    for i, h in enumerate(SWEEP_HIDDEN):
        frame = SC.probability_columns(frame, literal_model(len(feats), h, phase=0.37 * i),
                                       {f"p{i}": SC.feature_inputs(feats)})
    acc = frame.agg(*[F.avg((C.threshold(f"p{i}", P.THRESHOLD) == F.col(P.TARGET))
                            .cast("double")).alias(f"a{i}") for i in range(len(SWEEP_HIDDEN))])
    items = ", ".join(f"{i}, {h}, a{i}" for i, h in enumerate(SWEEP_HIDDEN))
    return acc.selectExpr(f"stack({len(SWEEP_HIDDEN)}, {items}) AS (config_idx, neurons, accuracy)")


def q_best_config(spark, sf):
    res = sweep_results(spark, sf).select(F.col("config_idx").cast("bigint").alias("config_idx"),
                                          F.col("neurons").cast("bigint").alias("neurons"),
                                          "accuracy")
    return rounded(M.best_configuration(res))


# ------------------------------------------------------------------ wide inputs
EMBED_DIMS = 64


def q_embedding_score(spark, sf):
    """M6 on a 64-wide input: fixed-weight 64 -> 8 -> 1 network over the
    ``embeddings`` table, thresholded."""
    df = embedding_features(spark, sf, EMBED_DIMS)
    feats = [f"e_{i}" for i in range(EMBED_DIMS)]
    out = SC.score(df, SC.rule_weights([EMBED_DIMS, 8, 1], scale=0.3), feats, t=P.THRESHOLD)
    return rounded(out.select("vec_id", "label", "probability", "prediction"))


def q_embedding_anova(spark, sf):
    """A9 with ten classes: F score of each embedding dimension against ``label``."""
    df = embedding_features(spark, sf, EMBED_DIMS)
    return rounded(PR.anova_f(df, [f"e_{i}" for i in range(EMBED_DIMS)], "label"))


# ------------------------------------------------------------------ Y
def sobol_outputs(spark, sf) -> tuple[DataFrame, list[str]]:
    """Saltelli design over the rows of the full-preset table (one base sample
    per loan), bounds from the data, samples scaled with the fitted scaler,
    scored with the fixed-weight network at all 2D+2 points."""
    plan = full_plan(spark, sf)
    frame, feats = plan.frame, plan.features
    problem, scaler = Y.problem_from_data(frame, feats, with_scaler=True)
    design = Y.saltelli_design(frame, P.KEY, len(feats), seed=P.SEED)
    out = Y.evaluate_design(design, P.KEY, problem, literal_model(len(feats)),
                            transform=lambda j, x: scaler.column(feats[j], source=x))
    return out, feats


def q_sobol_design(spark, sf):
    plan = full_plan(spark, sf)
    return rounded(Y.saltelli_design(plan.frame, P.KEY, len(plan.features), seed=P.SEED))


def q_sobol_design_halton(spark, sf):
    """Y2: Halton points over the loans in the order of their keys."""
    plan = full_plan(spark, sf)
    return rounded(Y.halton_design(plan.frame, P.KEY, len(plan.features)))


def q_sobol_design_lattice(spark, sf):
    """Y2: rank-1 lattice points over the loans in the order of their keys."""
    plan = full_plan(spark, sf)
    return rounded(Y.lattice_design(plan.frame, P.KEY, len(plan.features)))


def q_sobol_indices(spark, sf):
    out, feats = sobol_outputs(spark, sf)
    return rounded(Y.sobol_indices(out, feats))


def q_sobol_indices_long(spark, sf):
    """Y4 of a model that only scores tables: the design's points as rows, scored by
    a fitted stage, folded back; the same indices as the compiled form."""
    plan = full_plan(spark, sf)
    feats = plan.features
    problem, scaler = Y.problem_from_data(plan.frame, feats, with_scaler=True)
    design = Y.saltelli_design(plan.frame, P.KEY, len(feats), seed=P.SEED)
    stage = ST.DenseNetworkModel(columns=feats, network=literal_model(len(feats)).to_json())
    out = Y.evaluate_design_long(design, P.KEY, problem, stage.transform, "probability",
                                 lambda j, x: scaler.column(feats[j], source=x))
    return rounded(Y.sobol_indices(out, feats))


def q_sobol_pairs(spark, sf):
    out, feats = sobol_outputs(spark, sf)
    return rounded(Y.sobol_pairs(out, feats))


def q_sobol_conf(spark, sf):
    out, feats = sobol_outputs(spark, sf)
    ind, _pairs = Y.sobol_confidence(out, P.KEY, feats, n_resamples=P.SOBOL_BOOTSTRAP)
    return rounded(ind)


def q_sobol_pairs_conf(spark, sf):
    """Y6 of the second order: every pair's index with its half-width."""
    out, feats = sobol_outputs(spark, sf)
    _ind, pairs = Y.sobol_confidence(out, P.KEY, feats, n_resamples=P.SOBOL_BOOTSTRAP)
    return rounded(pairs)


# ------------------------------------------------------------------ M1-M5 (rows-only)
#: Limits at which early stopping ends the sweeps' networks: so many epochs in a
#: row that do not lower the validation loss by a thousandth; and their rate.
SWEEP_LIMITS = {"epochs": 100, "patience": 5, "min_delta": 1e-3, "lr": 0.02}


def q_mlp_train(spark, sf):
    """History of the baseline configuration (5 hidden sigmoid units, L-BFGS
    in rounds, early stopping on the validation split)."""
    scaled, feats = scaled_split(spark, sf)
    res = TR.train_mlpc(scaled, feats, P.TARGET, [5], rounds=5, iters_per_round=20)
    return TR.history_frame(spark, res.history)


SWEEP_SCHEMA = ("config_idx int, hidden string, activation string, val_loss double, "
                "test_accuracy double, epochs int, best_epoch int, stopped_early boolean")


def shared_sweep(spark, scaled, feats, configs, **kw) -> DataFrame:
    """Result table of networks trained side by side, one row per configuration."""
    trained = MB.train_shared(scaled, feats, P.TARGET, configs, P.KEY, **kw)
    return spark.createDataFrame(MB.sweep_rows(configs, trained), SWEEP_SCHEMA)


def q_mlp_minibatch(spark, sf):
    """M3: history of the baseline network (5 hidden units) trained by mini-batches
    as the published run was: batches of 512, rate 0.1, 100 epochs, patience 200."""
    scaled, feats = scaled_split(spark, sf)
    trained = MB.train_shared(scaled, feats, P.TARGET, [{"hidden": [5], "run_id": "minibatch_5"}],
                              P.KEY, epochs=100, batch=512, lr=0.1, patience=200)
    return TR.history_frame(spark, trained[0].history)


def q_mlp_sweep(spark, sf):
    """Sweep of the hidden size (5, 10, 15, 20 units) on the subset features, test
    accuracy each; all configurations share every pass, early stopping ends each."""
    scaled, feats = scaled_split_subset(spark, sf)
    return shared_sweep(spark, scaled, feats, [{"hidden": [h]} for h in P.SWEEP_NEURONS_SUBSET],
                        batch=128, **SWEEP_LIMITS)


def scaled_split_subset(spark, sf) -> tuple[DataFrame, list[str]]:
    """As ``scaled_split`` for the subset preset's nine engineered features."""
    plan, scaled, _scaler = prepare(loans(spark, sf), "subset", P.SEED)
    return scaled, plan.features


def q_mlp_layer_sweep(spark, sf):
    """Depth x activation sweep on the subset features (2, 3, 5 hidden layers
    of 15 units; relu and sigmoid), all networks in shared passes."""
    scaled, feats = scaled_split_subset(spark, sf)
    configs = [{"hidden": [P.LAYER_SWEEP_NEURONS] * n, "activation": act}
               for n, act in P.SWEEP_LAYERS_ACT]
    return shared_sweep(spark, scaled, feats, configs, batch=128, **SWEEP_LIMITS)


def q_mlp_depth_sweep(spark, sf):
    """Relu networks of 2, 3, 4, 5, 7 and 10 hidden layers of 10 units, batches of
    32, rate 0.001, 50 epochs, in shared passes."""
    scaled, feats = scaled_split(spark, sf)
    configs = [{"hidden": [P.DEEP_NEURONS] * n, "activation": "relu"}
               for n in P.SWEEP_LAYERS_DEEP]
    return shared_sweep(spark, scaled, feats, configs, epochs=50, batch=32, lr=1e-3,
                        patience=10)


def q_mlp_deep(spark, sf):
    """Relu network of two hidden layers (the layer sweep's first config),
    full-batch Adam; returns its history."""
    scaled, feats = scaled_split(spark, sf)
    res = TR.train_dense(scaled, feats, P.TARGET, [P.DEEP_NEURONS] * 2, "relu", steps=60,
                         lr=0.05, eval_every=5)
    return TR.history_frame(spark, res.history)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "default_rate_by_grade": default_rate_by_grade,
    "outlier_filter": q_outlier_filter,
    "grade_map": q_grade_map,
    "interactions": q_interactions,
    "income_ratio": q_income_ratio,
    "log_features": q_log_features,
    "risk_score": q_risk_score,
    "emp_bins": q_emp_bins,
    "age_bins": q_age_bins,
    "label_encode": q_label_encode,
    "one_hot": q_one_hot,
    "one_hot_vector": q_one_hot_vector,
    "standard_scale": q_standard_scale,
    "select_dtypes": q_select_dtypes,
    "csv_source": q_csv_source,
    "features_full": q_features_full,
    "features_raw_with_id": q_features_raw_with_id,
    "features_subset": q_features_subset,
    "under_sample": q_under_sample,
    "split_2way": q_split_2way,
    "split_3way": q_split_3way,
    "describe": q_describe,
    "distinct_counts": q_distinct_counts,
    "distinct_values": q_distinct_values,
    "distinct_values_numeric": q_distinct_values_numeric,
    "value_counts": q_value_counts,
    "column_info": q_column_info,
    "missing_counts": q_missing_counts,
    "group_sizes": q_group_sizes,
    "crosstab": q_crosstab,
    "crosstab_pct": q_crosstab_pct,
    "crosstab_3class": q_crosstab_3class,
    "csv_by_name": q_csv_by_name,
    "correlation": q_correlation,
    "anova_f": q_anova_f,
    "anova_pvalue": q_anova_pvalue,
    "select_k_best": q_select_k_best,
    "histogram20": q_histogram20,
    "box_stats": q_box_stats,
    "class_density": q_class_density,
    "preview": q_preview,
    "mlp_score": q_mlp_score,
    "mlp_score_deep": q_mlp_score_deep,
    "confusion": q_confusion,
    "confusion_norm": q_confusion_norm,
    "class_report": q_class_report,
    "accuracy": q_accuracy,
    "bce": q_bce,
    "eval_by_split": q_eval_by_split,
    "report_sink": q_report_sink,
    "metrics_sink": q_metrics_sink,
    "best_config": q_best_config,
    "saved_report": q_saved_report,
    "saved_confusion": q_saved_confusion,
    "saved_pipeline_score": q_saved_pipeline_score,
    "embedding_score": q_embedding_score,
    "embedding_anova": q_embedding_anova,
    "sobol_design": q_sobol_design,
    "sobol_design_halton": q_sobol_design_halton,
    "sobol_design_lattice": q_sobol_design_lattice,
    "sobol_indices": q_sobol_indices,
    "sobol_indices_long": q_sobol_indices_long,
    "sobol_pairs": q_sobol_pairs,
    "sobol_conf": q_sobol_conf,
    "sobol_pairs_conf": q_sobol_pairs_conf,
    "mlp_train": q_mlp_train,
    "mlp_minibatch": q_mlp_minibatch,
    "mlp_sweep": q_mlp_sweep,
    "mlp_depth_sweep": q_mlp_depth_sweep,
    "mlp_deep": q_mlp_deep,
    "mlp_layer_sweep": q_mlp_layer_sweep,
}
