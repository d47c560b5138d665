"""Preset feature plans (E6) and the feature-engineering steps they chain.

``engineer`` adds the derived columns of the subset preset (P4-P8, E3) as one
projection; ``full_features`` / ``subset_features`` / ``raw_with_id_features``
chain filter and encoders.  Fitted state (scaler numbers, label dictionaries)
is returned next to the frame so scoring can reuse it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe import presets as P
from riskframe.functions import columns as C
from riskframe.operators import encoders as E
from riskframe.operators.filters import outlier_filter


@dataclass
class FeaturePlan:
    """A prepared feature table plus everything fitted on the way."""

    frame: DataFrame
    features: list[str]
    target: str
    label_encoding: E.LabelDictionary | None = None
    one_hot: E.OneHotEncoding | None = None
    risk_scaler: E.Standardization | None = None
    extras: dict = field(default_factory=dict)


def grade_and_flag(df: DataFrame, flag_codes=None) -> DataFrame:
    """Grade letter -> 1..7 and default flag -> number (unmapped -> NULL)."""
    flag_codes = flag_codes or P.DEFAULT_FLAG_CODES
    return df.withColumns({
        "loan_grade_num": C.map_values("loan_grade", P.GRADE_CODES),
        "cb_person_default_on_file_num": C.map_values("cb_person_default_on_file", flag_codes),
    })


def interactions(df: DataFrame) -> DataFrame:
    """P4 products and P5 ratios of the preset."""
    cols = {n: C.product(a, b) for n, (a, b) in P.INTERACTIONS.items()}
    cols.update({n: C.ratio(a, b) for n, (a, b) in P.RATIOS.items()})
    return df.withColumns(cols)


def log_features(df: DataFrame) -> DataFrame:
    """P7."""
    return df.withColumns({n: C.log1p(c) for n, c in P.LOG1P.items()})


def bins(df: DataFrame) -> DataFrame:
    """E3 right-closed bins of age and employment length."""
    return df.withColumns({
        "age_bin": C.right_closed_bins("person_age", P.AGE_EDGES, P.AGE_LABELS),
        "emp_length_bin": C.right_closed_bins("person_emp_length", P.EMP_EDGES, P.EMP_LABELS),
    })


def fit_risk_scaler(df: DataFrame) -> E.Standardization:
    """Scaler of the composite score, fitted on the rows given (the preset
    fits it before the outlier filter)."""
    return E.fit_standard_scaler(grade_and_flag(df), P.RISK_SCORE_INPUTS)


def risk_score(df: DataFrame, scaler: E.Standardization) -> DataFrame:
    """Sum of the three standardised inputs."""
    return df.withColumn("loan_risk_score",
                         C.total(*[scaler.column(c) for c in P.RISK_SCORE_INPUTS]))


def engineer(df: DataFrame, scaler: E.Standardization, flag_codes=None) -> DataFrame:
    """All derived columns of the subset preset in one projection chain."""
    out = grade_and_flag(df, flag_codes)
    out = interactions(out)
    out = risk_score(out, scaler)
    out = bins(out)
    return log_features(out)


def full_features(loans: DataFrame, keep_key: bool = True) -> FeaturePlan:
    """Full preset: outlier filter -> label-encode string columns; features are
    every column except key and target (11 for the loan schema)."""
    filtered = outlier_filter(loans, P.OUTLIER_BOUNDS)
    strings = [c for c in P.CATEGORICAL if c in loans.columns]
    enc = E.fit_label_encoder(filtered, strings)
    frame = enc.transform(filtered)
    feats = [c for c in P.FULL_FEATURES if c in frame.columns]
    cols = ([P.KEY] if keep_key else []) + feats + [P.TARGET]
    return FeaturePlan(frame.select(*cols), feats, P.TARGET, label_encoding=enc)


def raw_with_id_features(loans: DataFrame) -> FeaturePlan:
    """As the full preset but the key is kept as a feature (reproduces the
    modelled run's leak only when asked for)."""
    plan = full_features(loans)
    plan.features = [P.KEY] + plan.features
    return plan


def subset_features(loans: DataFrame) -> FeaturePlan:
    """Subset preset: engineer (scaler of the score fitted on all rows) ->
    outlier filter -> one-hot ownership -> label-encode the remaining
    categoricals -> the nine model features."""
    scaler = fit_risk_scaler(loans)
    eng = engineer(loans, scaler)
    filtered = outlier_filter(eng, P.OUTLIER_BOUNDS)
    oh = E.fit_one_hot(filtered, ["person_home_ownership"])
    encoded = oh.transform(filtered)
    # only categoricals that reach the model are fitted (the others would be
    # computed and thrown away)
    cats = [c for c in ("loan_intent", "loan_grade", "cb_person_default_on_file",
                        "emp_length_bin") if c in P.SUBSET_FEATURES]
    le = E.fit_label_encoder(encoded, cats)
    encoded = le.transform(encoded)
    missing = [f for f in P.SUBSET_FEATURES if f not in encoded.columns]
    encoded = encoded.withColumns({f: F.lit(0) for f in missing})  # value absent in data
    frame = encoded.select(P.KEY, *P.SUBSET_FEATURES, P.TARGET)
    return FeaturePlan(frame, list(P.SUBSET_FEATURES), P.TARGET, label_encoding=le,
                       one_hot=oh, risk_scaler=scaler)
