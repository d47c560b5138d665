"""Independent SQL (DuckDB dialect) for every registered query with an oracle.

Written directly from the operator semantics, not from the Spark code: plain
``row_number`` windows for the exact samples, ``quantile_cont`` for
quantiles, ``dense_rank`` for label codes.  Every statement starts from the
same ``loans`` fixture CTE that Spark builds with the DataFrame API.
"""

from __future__ import annotations

from riskframe import presets as P
from riskframe.sources.tables import _BASE_EXPRS, _DERIVED_EXPRS

NUM_COLS = ["person_age", "person_income", "person_emp_length", "loan_amnt",
            "loan_int_rate", "loan_percent_income", "cb_person_cred_hist_length",
            "loan_status"]
DOUBLE_LOAN_COLS = {"person_emp_length", "loan_int_rate", "loan_percent_income"}


def R(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


def _loans_cte() -> str:
    base = ",\n         ".join(f"{e} AS {n}" for n, e in _BASE_EXPRS.items())
    derived = ",\n         ".join(f"{e} AS {n}" for n, e in _DERIVED_EXPRS.items())
    cols = ", ".join(P.LOAN_COLUMNS)
    return (f"loans_base AS (\n  SELECT {base}\n  FROM orders JOIN customer ON o_custkey = c_custkey\n),\n"
            f"loans_all AS (SELECT *, {derived} FROM loans_base),\n"
            f"loans AS (SELECT {cols} FROM loans_all)")


LOANS = _loans_cte()

FILTERED = "filtered AS (SELECT * FROM loans WHERE " + " AND ".join(
    f"{c} <= {b}" for c, b in P.OUTLIER_BOUNDS.items()) + ")"


def _case_map(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in mapping.items())
    return f"CAST(CASE {whens} END AS INTEGER)"


def _bins(col: str, edges, labels) -> str:
    whens = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {whens} END"


def _codes(src: str, col: str) -> str:
    """CTE body: label codes of ``col`` in ``src`` (sorted distinct, 0-based)."""
    return (f"SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
            f"FROM (SELECT DISTINCT CAST({col} AS VARCHAR) AS v FROM {src} "
            f"WHERE {col} IS NOT NULL)")


def _encoded_cte(src: str, cols: list[str], name: str, keep: list[str]) -> str:
    """CTEs ``code_<col>`` and ``name`` = src with cols label-coded (NULL/unseen -> k)."""
    parts = [f"code_{name}_{c} AS ({_codes(src, c)})" for c in cols]
    sel = []
    for c in keep:
        if c in cols:
            sel.append(f"CAST(COALESCE((SELECT code FROM code_{name}_{c} k WHERE k.v = "
                       f"CAST(s.{c} AS VARCHAR)), (SELECT count(*) FROM code_{name}_{c})) "
                       f"AS INTEGER) AS {c}")
        else:
            sel.append(f"s.{c}")
    parts.append(f"{name} AS (SELECT {', '.join(sel)} FROM {src} s)")
    return ",\n".join(parts)


FULL = _encoded_cte("filtered", P.CATEGORICAL, "full_enc", P.LOAN_COLUMNS)


def _balanced(src: str = "full_enc") -> str:
    return (f"ranked AS (SELECT *, row_number() OVER (PARTITION BY {P.TARGET} ORDER BY "
            f"md5('sample:{P.SEED}:' || CAST({P.KEY} AS VARCHAR)), {P.KEY}) AS rn FROM {src}),\n"
            f"balanced AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn <= (SELECT min(c) FROM "
            f"(SELECT count(*) AS c FROM {src} GROUP BY {P.TARGET})))")


SPLIT = (
    f"split_rank AS (SELECT *, row_number() OVER (ORDER BY md5('split:{P.SEED}:' || "
    f"CAST({P.KEY} AS VARCHAR)), {P.KEY}) AS rn2 FROM balanced),\n"
    f"sizes AS (SELECT n, CAST(ceil(CAST({P.TEST_FRACTION} AS DOUBLE) * n) AS BIGINT) AS n_test "
    f"FROM (SELECT count(*) AS n FROM balanced)),\n"
    f"sizes2 AS (SELECT n_test, CAST(ceil(CAST({P.VAL_FRACTION} AS DOUBLE) * (n - n_test)) "
    f"AS BIGINT) AS n_val FROM sizes),\n"
    f"split AS (SELECT s.* EXCLUDE (rn2), CASE WHEN rn2 <= n_test THEN 'test' "
    f"WHEN rn2 <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM split_rank s, sizes2)")

GRADE = _case_map("loan_grade", P.GRADE_CODES)
FLAG = _case_map("cb_person_default_on_file", P.DEFAULT_FLAG_CODES)

RISK_STATS = ("risk_stats AS (SELECT " + ", ".join(
    f"avg(CAST({e} AS DOUBLE)) AS m_{n}, stddev_pop(CAST({e} AS DOUBLE)) AS s_{n}"
    for n, e in [("g", GRADE), ("pi", "loan_percent_income"), ("ir", "loan_int_rate")])
    + " FROM loans)")


def _z(x: str, n: str) -> str:
    return (f"((CAST({x} AS DOUBLE) - m_{n}) / CASE WHEN s_{n} = 0 OR s_{n} IS NULL "
            f"THEN 1.0 ELSE s_{n} END)")


RISK = f"({_z(GRADE, 'g')} + {_z('loan_percent_income', 'pi')} + {_z('loan_int_rate', 'ir')})"

SUBSET = (
    RISK_STATS + ",\n"
    f"sub_src AS (SELECT f.*, {RISK} AS loan_risk_score FROM filtered f, risk_stats),\n"
    + _encoded_cte("sub_src", ["loan_grade"], "sub_enc",
                   P.LOAN_COLUMNS + ["loan_risk_score"]) + ",\n"
    "subset AS (SELECT id, "
    f"CAST({GRADE.replace('loan_grade', 'src.loan_grade')} AS DOUBLE) * loan_percent_income "
    "AS grade_percent_income, loan_risk_score, e.loan_grade, loan_percent_income, "
    "CAST(loan_amnt AS DOUBLE) / NULLIF(CAST(person_income AS DOUBLE), 0) AS loan_amnt_income_ratio, "
    "loan_int_rate, ln(1 + CAST(person_income AS DOUBLE)) AS log_person_income, "
    "CAST(person_home_ownership = 'RENT' AS INTEGER) AS person_home_ownership_RENT, "
    "CAST(person_home_ownership = 'MORTGAGE' AS INTEGER) AS person_home_ownership_MORTGAGE, "
    "loan_status FROM sub_enc e JOIN (SELECT id AS sid, loan_grade FROM filtered) src "
    "ON e.id = src.sid)")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join([LOANS, *ctes]) + "\n"


def _r_cols(cols, doubles) -> str:
    return ", ".join(R(c) + f" AS {c}" if c in doubles else c for c in cols)


def _unpivot(src: str, cols: list[str], cast: str, keep: str = "") -> str:
    k = f", {keep}" if keep else ""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS {cast}) AS value{k} FROM {src}" for c in cols)


def _full_feats() -> list[str]:
    return [c for c in P.FULL_FEATURES]


SQL: dict[str, str] = {}

SQL["default_rate_by_grade"] = with_(FILTERED) + f"""
SELECT loan_grade, {GRADE} AS loan_grade_num,
       CAST(NULLIF(count(*) FILTER (WHERE loan_status = 0), 0) AS BIGINT) AS n_0,
       CAST(NULLIF(count(*) FILTER (WHERE loan_status = 1), 0) AS BIGINT) AS n_1,
       {R("100.0 * NULLIF(count(*) FILTER (WHERE loan_status = 0), 0) / count(*)")} AS pct_0,
       {R("100.0 * NULLIF(count(*) FILTER (WHERE loan_status = 1), 0) / count(*)")} AS pct_1
FROM filtered GROUP BY loan_grade ORDER BY loan_grade"""

SQL["outlier_filter"] = with_(FILTERED) + (
    f"SELECT {_r_cols(P.LOAN_COLUMNS, DOUBLE_LOAN_COLS)} FROM filtered")

SQL["grade_map"] = with_() + (
    f"SELECT id, loan_grade, {GRADE} AS loan_grade_num, cb_person_default_on_file, "
    f"{FLAG} AS cb_person_default_on_file_num FROM loans")

SQL["interactions"] = with_() + f"""
SELECT id,
  {R(f"CAST({GRADE} AS DOUBLE) * CAST(loan_percent_income AS DOUBLE)")} AS grade_percent_income,
  {R(f"CAST({GRADE} AS DOUBLE) * CAST(loan_int_rate AS DOUBLE)")} AS grade_int_rate,
  {R("CAST(loan_percent_income AS DOUBLE) * CAST(loan_int_rate AS DOUBLE)")} AS percent_income_int_rate,
  {R(f"CAST({FLAG} AS DOUBLE) * CAST(loan_int_rate AS DOUBLE)")} AS default_risk,
  {R(f"CAST(cb_person_cred_hist_length AS DOUBLE) * CAST({GRADE} AS DOUBLE)")} AS cred_length_grade
FROM loans"""

SQL["income_ratio"] = with_() + (
    f"SELECT id, {R('CAST(loan_amnt AS DOUBLE) / NULLIF(CAST(person_income AS DOUBLE), 0)')} "
    "AS loan_amnt_income_ratio FROM loans")

SQL["log_features"] = with_() + (
    f"SELECT id, {R('ln(1 + CAST(person_income AS DOUBLE))')} AS log_person_income, "
    f"{R('ln(1 + CAST(loan_amnt AS DOUBLE))')} AS log_loan_amnt FROM loans")

SQL["risk_score"] = with_(RISK_STATS) + (
    f"SELECT id, {R(RISK)} AS loan_risk_score FROM loans, risk_stats")

SQL["emp_bins"] = with_() + (
    f"SELECT id, {R('person_emp_length')} AS person_emp_length, "
    f"{_bins('person_emp_length', P.EMP_EDGES, P.EMP_LABELS)} AS emp_length_bin FROM loans")

SQL["age_bins"] = with_() + (
    f"SELECT id, person_age, {_bins('person_age', P.AGE_EDGES, P.AGE_LABELS)} AS age_bin "
    "FROM loans")

_LE_COLS = P.CATEGORICAL + ["emp_length_bin", "age_bin"]
SQL["label_encode"] = with_(
    f"binned AS (SELECT *, {_bins('person_emp_length', P.EMP_EDGES, P.EMP_LABELS)} AS "
    f"emp_length_bin, {_bins('person_age', P.AGE_EDGES, P.AGE_LABELS)} AS age_bin FROM loans)",
    _encoded_cte("binned", _LE_COLS, "le", ["id"] + _LE_COLS)) + (
    f"SELECT id, {', '.join(_LE_COLS)} FROM le")

_HOME = ["MORTGAGE", "OTHER", "OWN", "RENT"]
_INTENT = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SQL["one_hot"] = with_(FILTERED) + "SELECT id, " + ", ".join(
    [f"CAST(COALESCE(person_home_ownership = '{v}', false) AS INTEGER) AS person_home_ownership_{v}"
     for v in _HOME]
    + [f"CAST(COALESCE(loan_intent = '{v}', false) AS INTEGER) AS loan_intent_{v}"
       for v in _INTENT]) + " FROM filtered"

_FF = _full_feats()
_SCALE_STATS = ("scale_stats AS (SELECT " + ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in _FF)
    + " FROM full_enc)")


def _zs(c: str) -> str:
    return _z(c, c)


SQL["select_dtypes"] = with_() + (
    f"SELECT {_r_cols([c for c in NUM_COLS], DOUBLE_LOAN_COLS)} FROM loans")

SQL["csv_source"] = with_() + f"SELECT {_r_cols(P.LOAN_COLUMNS, DOUBLE_LOAN_COLS)} FROM loans"

SQL["standard_scale"] = with_(FILTERED, FULL, _SCALE_STATS) + (
    "SELECT id, " + ", ".join(f"{R(_zs(c))} AS {c}" for c in _FF) + " FROM full_enc, scale_stats")

SQL["features_full"] = with_(FILTERED, FULL) + (
    f"SELECT {_r_cols(P.LOAN_COLUMNS, DOUBLE_LOAN_COLS)} FROM full_enc")

_SUB_DOUBLES = {"grade_percent_income", "loan_risk_score", "loan_percent_income",
                "loan_amnt_income_ratio", "loan_int_rate", "log_person_income"}
SQL["features_subset"] = with_(FILTERED, SUBSET) + (
    f"SELECT {_r_cols(['id'] + P.SUBSET_FEATURES + ['loan_status'], _SUB_DOUBLES)} FROM subset")

SQL["under_sample"] = with_(FILTERED, FULL, _balanced()) + "SELECT id, loan_status FROM balanced"

SQL["split_3way"] = with_(FILTERED, FULL, _balanced(), SPLIT) + (
    "SELECT id, loan_status, split FROM split")

SQL["split_2way"] = with_(FILTERED, FULL, _balanced(), (
    f"s2_rank AS (SELECT *, row_number() OVER (ORDER BY md5('split:{P.SEED}:' || "
    f"CAST({P.KEY} AS VARCHAR)), {P.KEY}) AS rn2 FROM balanced),\n"
    f"s2_size AS (SELECT CAST(ceil(CAST({P.TEST_FRACTION} AS DOUBLE) * count(*)) AS BIGINT) "
    "AS n_test FROM balanced)")) + (
    "SELECT id, loan_status, CASE WHEN rn2 <= n_test THEN 'test' ELSE 'train' END AS split "
    "FROM s2_rank, s2_size")

SQL["describe"] = with_() + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS count, "
    f"{R(f'avg(CAST({c} AS DOUBLE))')} AS mean, {R(f'stddev_samp(CAST({c} AS DOUBLE))')} AS std, "
    f"{R(f'min(CAST({c} AS DOUBLE))')} AS min, "
    f"{R(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS p25, "
    f"{R(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS p50, "
    f"{R(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS p75, "
    f"{R(f'max(CAST({c} AS DOUBLE))')} AS max FROM loans" for c in NUM_COLS)

_NO_ID = [c for c in P.LOAN_COLUMNS if c != "id"]
SQL["distinct_counts"] = with_() + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM loans"
    for c in _NO_ID)

SQL["distinct_values"] = with_() + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS column, CAST({c} AS VARCHAR) AS value FROM loans"
    for c in P.CATEGORICAL)

SQL["distinct_values_numeric"] = with_() + " UNION ALL ".join(
    f"SELECT '{c}' AS column, {R('v')} AS value FROM (SELECT DISTINCT CAST({c} AS DOUBLE) AS v "
    "FROM loans)" for c in _NO_ID if c not in P.CATEGORICAL)

SQL["value_counts"] = with_(FILTERED, FULL, _balanced()) + (
    "SELECT loan_status, CAST(count(*) AS BIGINT) AS count FROM balanced GROUP BY loan_status")

_DTYPES = {"id": "bigint", "person_age": "bigint", "person_income": "bigint",
           "person_home_ownership": "string", "person_emp_length": "double",
           "loan_intent": "string", "loan_grade": "string", "loan_amnt": "bigint",
           "loan_int_rate": "double", "loan_percent_income": "double",
           "cb_person_default_on_file": "string", "cb_person_cred_hist_length": "bigint",
           "loan_status": "int"}
SQL["column_info"] = with_() + " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column, '{_DTYPES[c]}' AS dtype, "
    f"CAST(count({c}) AS BIGINT) AS non_null FROM loans" for i, c in enumerate(P.LOAN_COLUMNS))

SQL["missing_counts"] = with_() + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE {c} IS NULL"
    + (f" OR isnan({c})" if c in DOUBLE_LOAN_COLS else "") + ") AS BIGINT) AS n_missing, "
    + (f"CAST(count(*) FILTER (WHERE isinf({c})) AS BIGINT)" if c in DOUBLE_LOAN_COLS
       else "CAST(0 AS BIGINT)") + " AS n_infinite FROM loans" for c in NUM_COLS)

SQL["group_sizes"] = with_(FILTERED) + (
    "SELECT loan_intent, loan_status, CAST(count(*) AS BIGINT) AS n FROM filtered "
    "GROUP BY loan_intent, loan_status")

SQL["crosstab"] = with_(FILTERED) + (
    "SELECT loan_grade, CAST(NULLIF(count(*) FILTER (WHERE loan_status = 0), 0) AS BIGINT) AS n_0, "
    "CAST(NULLIF(count(*) FILTER (WHERE loan_status = 1), 0) AS BIGINT) AS n_1 "
    "FROM filtered GROUP BY loan_grade")

_CT_COLS = P.CATEGORICAL + ["emp_length_bin"]
_STATUS = ("F", "O", "P")
SQL["crosstab_3class"] = (
    "WITH c AS (SELECT o_orderpriority AS value, count(*) AS tot, "
    + ", ".join(f"NULLIF(count(*) FILTER (WHERE o_orderstatus = '{v}'), 0) AS n_{v}"
                for v in _STATUS)
    + " FROM orders GROUP BY o_orderpriority) SELECT 'o_orderpriority' AS column, value, "
    + ", ".join(f"CAST(n_{v} AS BIGINT) AS n_{v}" for v in _STATUS) + ", "
    + ", ".join(f"{R(f'100.0 * n_{v} / tot')} AS pct_{v}" for v in _STATUS) + " FROM c")
SQL["crosstab_pct"] = with_(
    FILTERED,
    f"binned AS (SELECT *, {_bins('person_emp_length', P.EMP_EDGES, P.EMP_LABELS)} "
    "AS emp_length_bin FROM filtered)",
    f"long AS ({_unpivot('binned', _CT_COLS, 'VARCHAR', 'loan_status')}),\n"
    "ct AS (SELECT col, value, NULLIF(count(*) FILTER (WHERE loan_status = 0), 0) AS n0, "
    "NULLIF(count(*) FILTER (WHERE loan_status = 1), 0) AS n1, count(*) AS tot "
    "FROM long GROUP BY col, value)") + (
    "SELECT col AS column, value, CAST(n0 AS BIGINT) AS n_0, CAST(n1 AS BIGINT) AS n_1, "
    f"{R('100.0 * n0 / tot')} AS pct_0, {R('100.0 * n1 / tot')} AS pct_1 FROM ct")


def _corr_sql(src: str, cols: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = []
    for k, (a, b) in enumerate(pairs):
        x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
        aggs.append(
            f"covar_pop({x}, {y}) / NULLIF(stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * "
            f"stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END), 0) AS r{k}")
    out = []
    for k, (a, b) in enumerate(pairs):
        out.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f'r{k}')} AS r FROM cm")
        if a != b:
            out.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {R(f'r{k}')} AS r FROM cm")
    return f"cm AS (SELECT {', '.join(aggs)} FROM {src})", " UNION ALL ".join(out)


_cm, _corr_body = _corr_sql("full_enc", _FF + [P.TARGET])
SQL["correlation"] = with_(FILTERED, FULL, _cm) + _corr_body


def _anova_sql(src: str, feats: list[str]) -> tuple[str, str]:
    cte = (f"a_long AS ({_unpivot(src, feats, 'DOUBLE', P.TARGET)}),\n"
           f"a_cls AS (SELECT col, {P.TARGET}, count(*) AS n_k, avg(value) AS m_k, "
           f"var_pop(value) AS v_k FROM a_long WHERE value IS NOT NULL AND {P.TARGET} IS NOT NULL "
           f"GROUP BY col, {P.TARGET}),\n"
           "a_m AS (SELECT col, sum(n_k * m_k) / sum(n_k) AS m FROM a_cls GROUP BY col),\n"
           "a_f AS (SELECT c.col AS feature, CAST(sum(n_k) AS BIGINT) AS n, "
           "CAST(count(*) AS BIGINT) AS k, sum(n_k * (m_k - m) * (m_k - m)) AS ssb, "
           "sum(n_k * v_k) AS ssw FROM a_cls c JOIN a_m USING (col) GROUP BY c.col),\n"
           "anova AS (SELECT feature, n, k, (ssb / NULLIF(k - 1, 0)) / "
           "NULLIF(ssw / NULLIF(n - k, 0), 0) AS f_score FROM a_f)")
    return cte, f"SELECT feature, n, k, {R('f_score')} AS f_score FROM anova"


_an_cte, _an_body = _anova_sql("full_enc", _FF)
SQL["anova_f"] = with_(FILTERED, FULL, _an_cte) + _an_body

_sk_cte, _sk_body = _anova_sql("subset", P.SUBSET_FEATURES)
SQL["select_k_best"] = with_(FILTERED, SUBSET, _sk_cte) + (
    _sk_body + " ORDER BY f_score DESC NULLS LAST, feature LIMIT 5")

_H_COLS = NUM_COLS[:-1]
SQL["histogram20"] = with_(
    FILTERED,
    f"h_long AS ({_unpivot('filtered', _H_COLS, 'DOUBLE')}),\n"
    "h_rng0 AS (SELECT col, min(value) AS lo0, max(value) AS hi0 FROM h_long GROUP BY col),\n"
    "h_rng AS (SELECT col, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, "
    "CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM h_rng0),\n"
    "h_bin AS (SELECT l.col, CAST(least(greatest(floor((value - lo) * 20.0 / (hi - lo)), 0), 19) "
    "AS BIGINT) AS bin FROM h_long l JOIN h_rng r USING (col) WHERE value IS NOT NULL),\n"
    "h_cnt AS (SELECT col, bin, count(*) AS n FROM h_bin GROUP BY col, bin),\n"
    "h_grid AS (SELECT col, CAST(b AS BIGINT) AS bin, lo + (hi - lo) * b / 20 AS bin_lo, "
    "lo + (hi - lo) * (b + 1) / 20 AS bin_hi FROM h_rng, range(20) t(b))") + (
    f"SELECT g.col AS column, g.bin, {R('bin_lo')} AS bin_lo, {R('bin_hi')} AS bin_hi, "
    "CAST(COALESCE(n, 0) AS BIGINT) AS count FROM h_grid g LEFT JOIN h_cnt c "
    "ON g.col = c.col AND g.bin = c.bin")

SQL["box_stats"] = with_(
    FILTERED,
    f"b_long AS ({_unpivot('filtered', _H_COLS, 'DOUBLE', P.TARGET)}),\n"
    f"b_q AS (SELECT col, {P.TARGET}, quantile_cont(value, 0.25) AS q1, "
    f"quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM b_long "
    f"WHERE value IS NOT NULL GROUP BY col, {P.TARGET}),\n"
    "b_f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b_q)") + (
    f"SELECT f.col AS column, f.{P.TARGET}, {R('q1')} AS q1, {R('median')} AS median, "
    f"{R('q3')} AS q3, {R('min(value) FILTER (WHERE value >= lo AND value <= hi)')} AS whisker_lo, "
    f"{R('max(value) FILTER (WHERE value >= lo AND value <= hi)')} AS whisker_hi, "
    "CAST(count(*) FILTER (WHERE value < lo OR value > hi) AS BIGINT) AS n_outliers "
    f"FROM b_f f JOIN b_long l ON f.col = l.col AND f.{P.TARGET} = l.{P.TARGET} "
    f"WHERE value IS NOT NULL GROUP BY f.col, f.{P.TARGET}, q1, median, q3")

_KB = 32
SQL["class_density"] = with_(
    FILTERED,
    f"d_long AS ({_unpivot('filtered', _H_COLS, 'DOUBLE', P.TARGET)}),\n"
    "d_rng AS (SELECT col, min(value) AS lo0, max(value) AS hi0 FROM d_long GROUP BY col),\n"
    "d_r AS (SELECT col, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, "
    f"(CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END - CASE WHEN lo0 = hi0 THEN lo0 - 0.5 "
    f"ELSE lo0 END) / {_KB} AS step FROM d_rng),\n"
    f"d_bin AS (SELECT l.col, {P.TARGET}, value, CAST(least(greatest(floor((value - lo) / step), "
    f"0), {_KB - 1}) AS BIGINT) AS bin FROM d_long l JOIN d_r USING (col) "
    "WHERE value IS NOT NULL),\n"
    f"d_stats AS (SELECT col, {P.TARGET}, count(*) AS n, stddev_samp(value) AS sd FROM d_bin "
    f"GROUP BY col, {P.TARGET}),\n"
    f"d_cnt AS (SELECT col, {P.TARGET}, bin, count(*) AS c FROM d_bin GROUP BY col, {P.TARGET}, bin),\n"
    f"d_grid AS (SELECT s.col, s.{P.TARGET}, CAST(b AS BIGINT) AS bin, n, sd * pow(n, -0.2) AS h, "
    f"lo, step FROM d_stats s JOIN d_r USING (col), range({_KB}) t(b))") + (
    f"SELECT g.col AS column, g.{P.TARGET}, g.bin, {R('lo + (g.bin + 0.5) * step')} AS x, "
    f"{R('sum(COALESCE(c.c, 0) * exp(-0.5 * ((g.bin - c.bin) * step / h) * ((g.bin - c.bin) * step / h))) / (n * h * sqrt(2 * pi()))')} AS density "
    f"FROM d_grid g LEFT JOIN d_cnt c ON c.col = g.col AND c.{P.TARGET} = g.{P.TARGET} "
    f"GROUP BY g.col, g.{P.TARGET}, g.bin, lo, step, n, h")

SQL["preview"] = with_(FILTERED, SUBSET) + (
    f"SELECT {_r_cols(['id'] + P.SUBSET_FEATURES + ['loan_status'], _SUB_DOUBLES)} FROM subset "
    "ORDER BY id LIMIT 10")


# ------------------------------------------------------------------ M6 / V
def D(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def mlp_sql(mlp, inputs: list[str], prefix: str) -> tuple[list[str], str]:
    """SQL for a dense sigmoid network: a list of per-layer select lists
    (hidden units named ``<prefix>_l<i>_<o>``) and the output expression."""
    layers = []
    cur = inputs
    for li, (w, b) in enumerate(mlp.layers):
        last = li == len(mlp.layers) - 1
        exprs, names = [], []
        for o, (row, bias) in enumerate(zip(w, b)):
            z = " + ".join([D(bias)] + [f"{x} * {D(wi)}" for x, wi in zip(cur, row)])
            name = f"{prefix}_l{li}_{o}"
            exprs.append((f"({z})" if last else f"1.0 / (1.0 + exp(-({z})))") + f" AS {name}")
            names.append(name)
        layers.append(exprs)
        cur = names
    if mlp.output == "softmax2":
        out = f"1.0 / (1.0 + exp(-({cur[1]} - {cur[0]})))"
    else:
        out = f"1.0 / (1.0 + exp(-({cur[0]})))"
    return layers, out


def _pred_ctes(models: dict, src: str = "scaled", keep: str = "id, split, loan_status") -> str:
    """CTEs scoring each model on ``src``; final CTE ``scored`` has one
    probability column per model name."""
    ctes = []
    prev = src
    carry = keep
    n_layers = len(next(iter(models.values())).layers)
    outs = []
    for li in range(n_layers):
        sel = []
        for name, mlp in models.items():
            layers, out = mlp_sql(mlp, [f"z_{f}" for f in P.FULL_FEATURES], name)
            sel += layers[li]
            if li == n_layers - 1:
                outs.append(f"{out} AS {name}")
        ctes.append(f"layer{li} AS (SELECT {carry}, {', '.join(sel)} FROM {prev})")
        carry_cols = [s.rsplit(' AS ', 1)[1] for s in sel]
        prev = f"layer{li}"
        if li < n_layers - 1:
            carry = keep + ", " + ", ".join(carry_cols)
    ctes.append(f"scored AS (SELECT {keep}, {', '.join(outs)} FROM {prev})")
    return ",\n".join(ctes)


def _scaled_split_cte() -> str:
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}"
                      for c in _FF)
    z = ", ".join(f"{_zs(c)} AS z_{c}" for c in _FF)
    return (f"train_stats AS (SELECT {stats} FROM split WHERE split = 'train'),\n"
            f"scaled AS (SELECT id, split, loan_status, {z} FROM split, train_stats)")


def _literal(h: int, phase: float = 0.0):
    from riskframe.operators.scoring import rule_weights
    return rule_weights([len(P.FULL_FEATURES), h, 1], phase=phase)


_PRED = [FILTERED, FULL, _balanced(), SPLIT, _scaled_split_cte(),
         _pred_ctes({"p": _literal(5)}),
         "preds AS (SELECT id, split, loan_status, p AS probability, "
         "CAST(p >= 0.5 AS INTEGER) AS prediction FROM scored)",
         "tpred AS (SELECT * FROM preds WHERE split = 'test')"]

SQL["mlp_score"] = with_(*_PRED) + (
    f"SELECT id, split, loan_status, {R('probability')} AS probability, prediction FROM preds")



def _deep_ctes(shapes: dict) -> str:
    """Deep networks one after another, a relation per layer; final relation ``deep``."""
    from riskframe.operators.scoring import rule_weights
    z = [f"z_{f}" for f in P.FULL_FEATURES]
    carry, prev, ctes, done = ["id", "split", "loan_status", *z], "scaled", [], []
    for name, (depth, units) in shapes.items():
        layers, out = mlp_sql(rule_weights([len(z), *[units] * depth, 1], scale=1.6), z, name)
        for li, exprs in enumerate(layers):
            ctes.append(f"{name}_{li} AS (SELECT {', '.join(carry + done + exprs)} FROM {prev})")
            prev = f"{name}_{li}"
        ctes.append(f"{name}_out AS (SELECT {', '.join(carry + done)}, {out} AS {name} FROM {prev})")
        prev = f"{name}_out"
        done.append(name)
    return ",\n".join([*ctes, f"deep AS (SELECT * FROM {prev})"])


SQL["mlp_score_deep"] = with_(FILTERED, FULL, _balanced(), SPLIT, _scaled_split_cte(),
                              _deep_ctes({"p_10x10": (10, 10), "p_5x15": (5, 15)})) + (
    f"SELECT id, split, loan_status, {R('p_10x10')} AS p_10x10, {R('p_5x15')} AS p_5x15 FROM deep")

_CM = ("cm AS (SELECT a.v AS actual, b.v AS predicted, CAST(count(t.id) AS BIGINT) AS count "
       "FROM (VALUES (0), (1)) a(v) CROSS JOIN (VALUES (0), (1)) b(v) "
       "LEFT JOIN tpred t ON t.loan_status = a.v AND t.prediction = b.v GROUP BY a.v, b.v)")
SQL["confusion"] = with_(*_PRED, _CM) + (
    "SELECT CAST(actual AS INTEGER) AS actual, CAST(predicted AS INTEGER) AS predicted, count FROM cm")

SQL["confusion_norm"] = with_(*_PRED, _CM) + (
    "SELECT CAST(actual AS INTEGER) AS actual, CAST(predicted AS INTEGER) AS predicted, "
    f"{R('COALESCE(count / NULLIF(sum(count) OVER (PARTITION BY actual), 0), 0.0)')} AS fraction "
    "FROM cm")

_PER = ("per AS (SELECT CAST(c.v AS VARCHAR) AS label, "
        "COALESCE(sum(CASE WHEN actual = c.v AND predicted = c.v THEN count END) / "
        "NULLIF(sum(CASE WHEN predicted = c.v THEN count END), 0), 0.0) AS precision, "
        "COALESCE(sum(CASE WHEN actual = c.v AND predicted = c.v THEN count END) / "
        "NULLIF(sum(CASE WHEN actual = c.v THEN count END), 0), 0.0) AS recall, "
        "sum(CASE WHEN actual = c.v THEN count END) AS support, "
        "sum(CASE WHEN actual = c.v AND predicted = c.v THEN count END) AS tp "
        "FROM cm, (VALUES (0), (1)) c(v) GROUP BY c.v),\n"
        "per2 AS (SELECT *, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0.0) "
        "AS f1 FROM per)")
SQL["class_report"] = with_(*_PRED, _CM, _PER) + f"""
SELECT label, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1')} AS f1,
       CAST(support AS BIGINT) AS support FROM per2
UNION ALL SELECT 'accuracy', NULL, NULL, {R('sum(tp) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'macro avg', {R('avg(precision)')}, {R('avg(recall)')}, {R('avg(f1)')},
       CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'weighted avg', {R('sum(precision * support) / sum(support)')},
       {R('sum(recall * support) / sum(support)')}, {R('sum(f1 * support) / sum(support)')},
       CAST(sum(support) AS BIGINT) FROM per2"""

SQL["accuracy"] = with_(*_PRED) + (
    f"SELECT CAST(count(*) AS BIGINT) AS n, {R('avg(CAST(prediction = loan_status AS DOUBLE))')} "
    "AS accuracy FROM tpred")

_BCE = ("-(CAST(loan_status AS DOUBLE) * ln(least(greatest(probability, 1e-7), 1 - 1e-7)) + "
        "(1.0 - CAST(loan_status AS DOUBLE)) * ln(1.0 - least(greatest(probability, 1e-7), 1 - 1e-7)))")
SQL["bce"] = with_(*_PRED) + (
    f"SELECT CAST(count(*) AS BIGINT) AS n, {R(f'avg({_BCE})')} AS bce FROM tpred")

SQL["eval_by_split"] = with_(*_PRED) + f"""
SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split,
       CAST(count(*) AS BIGINT) AS n,
       {R('avg(CAST(prediction = loan_status AS DOUBLE))')} AS accuracy,
       {R(f'avg({_BCE})')} AS bce,
       CAST(count(*) FILTER (WHERE loan_status = 1 AND prediction = 1) AS BIGINT) AS tp,
       CAST(count(*) FILTER (WHERE loan_status = 0 AND prediction = 1) AS BIGINT) AS fp,
       CAST(count(*) FILTER (WHERE loan_status = 0 AND prediction = 0) AS BIGINT) AS tn,
       CAST(count(*) FILTER (WHERE loan_status = 1 AND prediction = 0) AS BIGINT) AS fn
FROM preds GROUP BY GROUPING SETS ((split), ())"""

SQL["saved_pipeline_score"] = SQL["mlp_score"]

_POPS = ("pops AS (SELECT split, loan_status AS a, prediction AS p FROM preds WHERE split = 'test' "
         "UNION ALL SELECT 'all', loan_status, prediction FROM preds),\n"
         "cells AS (SELECT s.split, x.v AS actual, y.v AS predicted, (SELECT count(*) FROM pops "
         "WHERE pops.split = s.split AND a = x.v AND p = y.v) AS count "
         "FROM (SELECT DISTINCT split FROM pops) s, (VALUES (0), (1)) x(v), (VALUES (0), (1)) y(v))")
SQL["saved_confusion"] = with_(*_PRED, _POPS) + f"""
SELECT split, actual, predicted, CAST(count AS BIGINT) AS count,
       {R('coalesce(count / nullif(sum(count) OVER (PARTITION BY split, actual), 0), 0.0)')} AS fraction
FROM cells"""

_PER_POP = ("cls AS (SELECT split, v AS class, "
            "sum(count) FILTER (WHERE actual = v) AS support, "
            "sum(count) FILTER (WHERE predicted = v) AS said, "
            "sum(count) FILTER (WHERE actual = v AND predicted = v) AS tp "
            "FROM cells, (VALUES (0), (1)) c(v) GROUP BY split, v),\n"
            "pr AS (SELECT *, coalesce(tp / nullif(said, 0), 0.0) AS pre, "
            "coalesce(tp / nullif(support, 0), 0.0) AS rec FROM cls),\n"
            "prf AS (SELECT *, coalesce(2 * pre * rec / nullif(pre + rec, 0), 0.0) AS f FROM pr)")
SQL["saved_report"] = with_(*_PRED, _POPS, _PER_POP) + f"""
SELECT split, CAST(class AS VARCHAR) AS label, {R('pre')} AS precision, {R('rec')} AS recall,
       {R('f')} AS f1, CAST(support AS BIGINT) AS support FROM prf
UNION ALL SELECT split, 'accuracy', NULL, NULL, {R('sum(tp) / sum(support)')}, CAST(sum(support) AS BIGINT)
FROM prf GROUP BY split
UNION ALL SELECT split, 'macro avg', {R('avg(pre)')}, {R('avg(rec)')}, {R('avg(f)')},
       CAST(sum(support) AS BIGINT) FROM prf GROUP BY split
UNION ALL SELECT split, 'weighted avg', {R('sum(pre * support) / sum(support)')},
       {R('sum(rec * support) / sum(support)')}, {R('sum(f * support) / sum(support)')},
       CAST(sum(support) AS BIGINT) FROM prf GROUP BY split"""

_SWEEP = [5, 10, 15, 20]
_SW_MODELS = {f"p{i}": _literal(h, 0.37 * i) for i, h in enumerate(_SWEEP)}
SQL["best_config"] = with_(
    FILTERED, FULL, _balanced(), SPLIT, _scaled_split_cte(),
    _pred_ctes(_SW_MODELS, src="(SELECT * FROM scaled WHERE split = 'test')"),
    "acc AS (" + " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS config_idx, CAST({h} AS BIGINT) AS neurons, "
        f"avg(CAST(CAST(p{i} >= 0.5 AS INTEGER) = loan_status AS DOUBLE)) AS accuracy FROM scored"
        for i, h in enumerate(_SWEEP)) + ")") + (
    f"SELECT config_idx, neurons, {R('accuracy')} AS accuracy FROM acc "
    "ORDER BY accuracy DESC, config_idx LIMIT 1")


# ------------------------------------------------------------------ Y
def _u(salt: str) -> str:
    h = f"md5('{salt}:{P.SEED}:' || CAST(id AS VARCHAR))"
    return f"(CAST(('0x' || substr({h}, 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0)"


_D = len(_FF)
_DESIGN = ("design AS (SELECT id, " + ", ".join(
    [f"{_u(f'sobol_a{j}')} AS a_{j}" for j in range(_D)]
    + [f"{_u(f'sobol_b{j}')} AS b_{j}" for j in range(_D)]) + " FROM full_enc)")

SQL["sobol_design"] = with_(FILTERED, FULL, _DESIGN) + (
    "SELECT id, " + ", ".join([f"{R(f'a_{j}')} AS a_{j}" for j in range(_D)]
                               + [f"{R(f'b_{j}')} AS b_{j}" for j in range(_D)]) + " FROM design")



def _mirrored(index: str, base: int, digits: int) -> str:
    """Radical inverse by the digits of the index."""
    return " + ".join(f"CAST(({index} // CAST({base ** k} AS BIGINT)) % {base} AS DOUBLE) / "
                      f"CAST({base ** (k + 1)} AS DOUBLE)" for k in range(digits))


_PRIMES = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79]
_NUMBERED = "numbered AS (SELECT id, row_number() OVER (ORDER BY id) AS k, count(*) OVER () AS n FROM full_enc)"
_AB = [f"{x}_{j}" for x in "ab" for j in range(_D)]
SQL["sobol_design_halton"] = with_(FILTERED, FULL, _NUMBERED) + "SELECT id, " + ", ".join(
    f"{R(_mirrored('k', p, 1 + next(d for d in range(60) if p ** d > 10 ** 7)))} AS {c}"
    for p, c in zip(_PRIMES, _AB)) + " FROM numbered"

_GENERATORS = ",\n".join(
    ["g0 AS (SELECT CAST(max(n) AS HUGEINT) AS big_n, CAST(1 AS HUGEINT) % max(n) AS z0 FROM numbered)"]
    + [f"g{j} AS (SELECT *, z{j - 1} * 76 % big_n AS z{j} FROM g{j - 1})" for j in range(1, 2 * _D)])
SQL["sobol_design_lattice"] = with_(FILTERED, FULL, _NUMBERED, _GENERATORS) + "SELECT id, " + ", ".join(
    f"{R(f'CAST(((2 * (k - 1) + 1) * z{j}) % (2 * big_n) AS DOUBLE) / CAST(2 * big_n AS DOUBLE)')} AS {c}"
    for j, c in enumerate(_AB)) + f" FROM numbered, g{2 * _D - 1}"

_BOUNDS = ("bounds AS (SELECT " + ", ".join(
    f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in _FF)
    + " FROM full_enc)")


def _x(c: str, j: int, src: str) -> str:
    raw = f"(lo_{c} + (hi_{c} - lo_{c}) * {src}_{j})"
    return _z(raw, c)


_POINTS = ("points AS (SELECT id, " + ", ".join(
    [f"{_x(c, j, 'a')} AS xa_{j}" for j, c in enumerate(_FF)]
    + [f"{_x(c, j, 'b')} AS xb_{j}" for j, c in enumerate(_FF)])
    + " FROM design, bounds, scale_stats)")


def _sets() -> dict:
    A = [f"xa_{j}" for j in range(_D)]
    B = [f"xb_{j}" for j in range(_D)]
    sets = {"y_A": A, "y_B": B}
    for j in range(_D):
        sets[f"y_AB{j}"] = [B[i] if i == j else A[i] for i in range(_D)]
        sets[f"y_BA{j}"] = [A[i] if i == j else B[i] for i in range(_D)]
    return sets


def _eval_ctes() -> str:
    mlp = _literal(5)
    hidden, lin, outs = [], [], []
    for name, inputs in _sets().items():
        layers, out = mlp_sql(mlp, inputs, name)
        hidden += layers[0]
        lin += layers[1]
        outs.append(f"{out} AS {name}")
    return (f"hid AS (SELECT id, {', '.join(hidden)} FROM points),\n"
            f"lin AS (SELECT id, {', '.join(lin)} FROM hid),\n"
            f"outs AS (SELECT id, {', '.join(outs)} FROM lin)")


def _means() -> str:
    allsum = " + ".join(["y_A", "y_B"] + [f"y_AB{j} + y_BA{j}" for j in range(_D)])
    m = [("A", "y_A"), ("B", "y_B"), ("A2", "y_A * y_A"), ("B2", "y_B * y_B"),
         ("mu", f"({allsum}) / {float(2 * _D + 2)}")]
    for j in range(_D):
        m += [(f"s1n{j}", f"y_B * (y_AB{j} - y_A)"), (f"d{j}", f"y_AB{j} - y_A"),
              (f"st{j}", f"(y_A - y_AB{j}) * (y_A - y_AB{j})")]
    for j in range(_D):
        for k in range(j + 1, _D):
            m += [(f"v{j}_{k}", f"y_BA{j} * y_AB{k} - y_A * y_B"),
                  (f"e{j}_{k}", f"y_BA{j} + y_AB{k} - y_A - y_B")]
    body = ", ".join(f"avg({e}) AS {n}" for n, e in m)
    return (f"means AS (SELECT {body} FROM outs),\n"
            "mv AS (SELECT *, (A2 - A * A + B2 - B * B) / 2.0 + ((A - B) / 2.0) * ((A - B) / 2.0) "
            "AS var FROM means),\n"
            "s1 AS (SELECT " + ", ".join(
                [f"(s1n{j} - mu * d{j}) / NULLIF(var, 0) AS S1_{j}" for j in range(_D)]
                + [f"(st{j} / 2.0) / NULLIF(var, 0) AS ST_{j}" for j in range(_D)]
                + [f"(v{j}_{k} - mu * e{j}_{k}) / NULLIF(var, 0) AS V_{j}_{k}"
                   for j in range(_D) for k in range(j + 1, _D)]) + " FROM mv)")


_SOBOL = [FILTERED, FULL, _DESIGN, _BOUNDS, _SCALE_STATS, _POINTS, _eval_ctes(), _means()]

SQL["sobol_indices"] = with_(*_SOBOL) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'S1_{j}')} AS s1, {R(f'ST_{j}')} AS st FROM s1"
    for j, c in enumerate(_FF))

SQL["sobol_pairs"] = with_(*_SOBOL) + " UNION ALL ".join(
    f"SELECT '{_FF[j]}' AS feature_i, '{_FF[k]}' AS feature_j, "
    f"{R(f'V_{j}_{k} - S1_{j} - S1_{k}')} AS s2 FROM s1"
    for j in range(_D) for k in range(j + 1, _D))


# ------------------------------------------------------------------ wide inputs
_E = 64
_EMB = ("emb AS (SELECT vec_id, label, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS e_{i}" for i in range(_E)) + " FROM embeddings)")


def _emb_model():
    from riskframe.operators.scoring import rule_weights
    return rule_weights([_E, 8, 1], scale=0.3)


_el, _eo = mlp_sql(_emb_model(), [f"e_{i}" for i in range(_E)], "m")
SQL["embedding_score"] = ("WITH " + _EMB + ",\n"
                          f"eh AS (SELECT vec_id, label, {', '.join(_el[0])} FROM emb),\n"
                          f"el AS (SELECT vec_id, label, {', '.join(_el[1])} FROM eh),\n"
                          f"ep AS (SELECT vec_id, label, {_eo} AS p FROM el)\n"
                          f"SELECT vec_id, label, {R('p')} AS probability, "
                          "CAST(p >= 0.5 AS INTEGER) AS prediction FROM ep")

_ea_cte, _ea_body = _anova_sql("emb", [f"e_{i}" for i in range(_E)])
SQL["embedding_anova"] = ("WITH " + _EMB + ",\n" + _ea_cte.replace(P.TARGET, "label")
                          + "\n" + _ea_body)



def _u_text(text_sql: str, salt: str) -> str:
    """Uniform from md5('salt:seed:' || text) (same rule as the Spark side)."""
    h = f"md5('{salt}:{P.SEED}:' || {text_sql})"
    return f"(CAST(('0x' || substr({h}, 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0)"


def _poisson_sql(u: str) -> str:
    import math
    cdf, p, total = [], math.exp(-1.0), 0.0
    for k in range(12):
        total += p
        cdf.append(total)
        p /= (k + 1)
    return "(" + " + ".join(f"CAST({u} > {D(c)} AS INTEGER)" for c in cdf) + ")"


def _boot_sql(n_rep: int = 100, n_blocks: int = 1000, second: bool = False) -> str:
    pairs = [(j, k) for j in range(_D) for k in range(j + 1, _D)] if second else []
    qs = [("y_A", "y_A"), ("y_B", "y_B")] + [(f"y_AB{j}", f"y_AB{j}") for j in range(_D)] \
        + [(f"y_BA{j}", f"y_BA{j}") for j in range(_D)] \
        + [("A2", "y_A * y_A"), ("B2", "y_B * y_B"), ("AxB", "y_A * y_B")] \
        + [(f"BxAB{j}", f"y_B * y_AB{j}") for j in range(_D)] \
        + [(f"st{j}", f"(y_A - y_AB{j}) * (y_A - y_AB{j})") for j in range(_D)] \
        + [(f"p{j}_{k}", f"y_BA{j} * y_AB{k}") for j, k in pairs]
    blk = f"CAST(floor({_u_text('CAST(id AS VARCHAR)', 'boot_block')} * {n_blocks}) AS INTEGER)"
    blocks = ("b_sums AS (SELECT blk, count(*) AS n, " + ", ".join(
        f"sum({e}) AS s_{n}" for n, e in qs) + f" FROM (SELECT *, {blk} AS blk FROM outs) "
        "GROUP BY blk)")
    w_u = _u_text("CAST(blk AS VARCHAR) || ':' || CAST(rep AS VARCHAR)", "boot_weight")
    reps = (f"b_reps AS (SELECT b.*, rep, CASE WHEN rep = 0 THEN 1 ELSE {_poisson_sql(w_u)} END "
            f"AS w FROM b_sums b, range(0, {n_rep + 1}) t(rep))")
    rsums = ("r_sums AS (SELECT rep, sum(w * n) AS n, " + ", ".join(
        f"sum(w * s_{n}) AS s_{n}" for n, _ in qs) + " FROM b_reps GROUP BY rep)")
    means = ("r_m AS (SELECT rep, " + ", ".join(f"s_{n} / n AS m_{n}" for n, _ in qs)
             + " FROM r_sums)")
    outs = ["m_y_A", "m_y_B"] + [f"m_y_AB{j}" for j in range(_D)] + [f"m_y_BA{j}" for j in range(_D)]
    mv = ("r_v AS (SELECT *, (m_A2 - m_y_A * m_y_A + m_B2 - m_y_B * m_y_B) / 2.0 "
          "+ ((m_y_A - m_y_B) / 2.0) * ((m_y_A - m_y_B) / 2.0) AS var, "
          f"({' + '.join(outs)}) / {float(len(outs))} AS mu FROM r_m)")
    est = ("r_e AS (SELECT rep, " + ", ".join(
        [f"(m_BxAB{j} - m_AxB - mu * (m_y_AB{j} - m_y_A)) / NULLIF(var, 0) AS S1_{j}"
         for j in range(_D)]
        + [f"(m_st{j} / 2.0) / NULLIF(var, 0) AS ST_{j}" for j in range(_D)]
        + [f"(m_p{j}_{k} - m_AxB - mu * (m_y_BA{j} + m_y_AB{k} - m_y_A - m_y_B)) / NULLIF(var, 0) "
           f"AS V_{j}_{k}" for j, k in pairs]) + " FROM r_v)")
    z = 1.959963984540054
    fin = ("r_f AS (SELECT " + ", ".join(
        [f"max(CASE WHEN rep = 0 THEN S1_{j} END) AS S1_{j}, "
         f"stddev_samp(CASE WHEN rep > 0 THEN S1_{j} END) * {z} AS c_S1_{j}, "
         f"max(CASE WHEN rep = 0 THEN ST_{j} END) AS ST_{j}, "
         f"stddev_samp(CASE WHEN rep > 0 THEN ST_{j} END) * {z} AS c_ST_{j}"
         for j in range(_D)]) + " FROM r_e)")
    if second:
        s2 = [(j, k, f"V_{j}_{k} - S1_{j} - S1_{k}") for j, k in pairs]
        fin = ("r_f AS (SELECT " + ", ".join(
            f"max(CASE WHEN rep = 0 THEN {e} END) AS S2_{j}_{k}, "
            f"stddev_samp(CASE WHEN rep > 0 THEN {e} END) * {z} AS c_S2_{j}_{k}"
            for j, k, e in s2) + " FROM r_e)")
        body = " UNION ALL ".join(
            f"SELECT '{_FF[j]}' AS feature_i, '{_FF[k]}' AS feature_j, {R(f'S2_{j}_{k}')} AS s2, "
            f"{R(f'c_S2_{j}_{k}')} AS s2_conf FROM r_f" for j, k in pairs)
        return with_(*_SOBOL[:-1], blocks, reps, rsums, means, mv, est, fin) + body
    body = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {R(f'S1_{j}')} AS s1, {R(f'c_S1_{j}')} AS s1_conf, "
        f"{R(f'ST_{j}')} AS st, {R(f'c_ST_{j}')} AS st_conf FROM r_f" for j, c in enumerate(_FF))
    return with_(*_SOBOL[:-1], blocks, reps, rsums, means, mv, est, fin) + body


SQL["sobol_conf"] = _boot_sql(P.SOBOL_BOOTSTRAP)
SQL["sobol_pairs_conf"] = _boot_sql(P.SOBOL_BOOTSTRAP, second=True)

# the same rows, whatever order the file has its columns in
SQL["csv_by_name"] = SQL["csv_source"]

SQL["sobol_indices_long"] = SQL["sobol_indices"]

SQL["one_hot_vector"] = """
WITH s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)),
c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
      FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders)),
k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
      FROM (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS v FROM orders)),
n AS (SELECT (SELECT count(*) FROM s) AS ns, (SELECT count(*) FROM c) AS nc, (SELECT count(*) FROM k) AS nk)
SELECT o_orderkey, CAST(ns + nc + nk AS BIGINT) AS width,
       s.code || ',' || (ns + c.code) || ',' || (ns + nc + k.code) AS indices
FROM orders, n, s, c, k WHERE s.v = o_orderstatus AND c.v = CAST(o_custkey AS VARCHAR)
  AND k.v = CAST(o_orderkey AS VARCHAR)"""

SQL["features_raw_with_id"] = with_(FILTERED, FULL) + "SELECT " + ", ".join(
    f"{R(c)} AS f_{i}" for i, c in enumerate([P.KEY, *P.FULL_FEATURES])) + ", loan_status FROM full_enc"

SQL["report_sink"] = SQL["class_report"]

SQL["metrics_sink"] = SQL["eval_by_split"]
