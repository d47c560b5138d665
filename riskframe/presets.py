"""The loan-status preset: schema, bounds, dictionaries and feature lists.

Operators never hard-code these names; they take columns as parameters and the
preset plans in :mod:`riskframe.plans` pass the values below.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the modelled workflow for equal results.
# ---------------------------------------------------------------------------

# Input columns in file order.
LOAN_COLUMNS = [
    "id", "person_age", "person_income", "person_home_ownership",
    "person_emp_length", "loan_intent", "loan_grade", "loan_amnt",
    "loan_int_rate", "loan_percent_income", "cb_person_default_on_file",
    "cb_person_cred_hist_length", "loan_status",
]
KEY = "id"
TARGET = "loan_status"

# Outlier filter: keep rows with column <= bound for every bound (missing drops).
OUTLIER_BOUNDS = {
    "person_age": 100,
    "person_emp_length": 60,
    "person_income": 1_000_000,
    "loan_int_rate": 35,
    "cb_person_cred_hist_length": 50,
}

# Dictionary maps.
GRADE_CODES = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7}
DEFAULT_FLAG_CODES = {"Y": 1, "N": 2}
DEFAULT_FLAG_CODES_LAYER_VARIANT = {"Y": 1, "N": 0}

# Right-closed interval bins.
AGE_EDGES = [0, 15, 25, 35, 45, 55, 100]
AGE_LABELS = ["<15", "15-25", "25-35", "35-45", "45-55", ">55"]
EMP_EDGES = [0, 2, 5, 10, 20, 50]
EMP_LABELS = ["<2", "2-5", "5-10", "10-20", ">20"]

# Composite risk score = sum of these three standardised columns.
RISK_SCORE_INPUTS = ["loan_grade_num", "loan_percent_income", "loan_int_rate"]

# Interaction products (name -> factors) and ratios (name -> numerator, denominator).
INTERACTIONS = {
    "grade_percent_income": ("loan_grade_num", "loan_percent_income"),
    "grade_int_rate": ("loan_grade_num", "loan_int_rate"),
    "percent_income_int_rate": ("loan_percent_income", "loan_int_rate"),
    "default_risk": ("cb_person_default_on_file_num", "loan_int_rate"),
    "cred_length_grade": ("cb_person_cred_hist_length", "loan_grade_num"),
}
RATIOS = {"loan_amnt_income_ratio": ("loan_amnt", "person_income")}
LOG1P = {"log_person_income": "person_income", "log_loan_amnt": "loan_amnt"}

# The nine engineered features of the subset preset, in model order.
SUBSET_FEATURES = [
    "grade_percent_income", "loan_risk_score", "loan_grade",
    "loan_percent_income", "loan_amnt_income_ratio", "loan_int_rate",
    "log_person_income", "person_home_ownership_RENT",
    "person_home_ownership_MORTGAGE",
]

# Split fractions and seed.
TEST_FRACTION = 0.2
VAL_FRACTION = 0.2
SEED = 42
THRESHOLD = 0.5

# Hyper-parameter sweeps (hidden neurons; layers x activation).
SWEEP_NEURONS_SUBSET = [5, 10, 15, 20]
SWEEP_NEURONS_FULL = [20]
SWEEP_NEURONS_TORCH = [5]
SWEEP_LAYERS_ACT = [(2, "relu"), (2, "sigmoid"), (3, "relu"), (3, "sigmoid"),
                    (5, "relu"), (5, "sigmoid")]
SWEEP_LAYERS_DEEP = [2, 3, 4, 5, 7, 10]
LAYER_SWEEP_NEURONS = 15          # per hidden layer, depth x activation sweep
DEEP_NEURONS = 10                 # per hidden layer, relu depth sweep

# Sobol design size of the modelled run (base samples) and bootstrap size.
SOBOL_BASE_SAMPLES = 8192 * 4
SOBOL_BOOTSTRAP = 100
SOBOL_CONF_LEVEL = 0.95
# ---------------------------------------------------------------------------

LOAN_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("person_age", T.LongType(), True),
    T.StructField("person_income", T.LongType(), True),
    T.StructField("person_home_ownership", T.StringType(), True),
    T.StructField("person_emp_length", T.DoubleType(), True),
    T.StructField("loan_intent", T.StringType(), True),
    T.StructField("loan_grade", T.StringType(), True),
    T.StructField("loan_amnt", T.LongType(), True),
    T.StructField("loan_int_rate", T.DoubleType(), True),
    T.StructField("loan_percent_income", T.DoubleType(), True),
    T.StructField("cb_person_default_on_file", T.StringType(), True),
    T.StructField("cb_person_cred_hist_length", T.LongType(), True),
    T.StructField("loan_status", T.IntegerType(), True),
])

CATEGORICAL = ["person_home_ownership", "loan_intent", "loan_grade",
               "cb_person_default_on_file"]

# Features of the "full" preset: every column but key and target, file order.
FULL_FEATURES = [c for c in LOAN_COLUMNS if c not in (KEY, TARGET)]
