"""Registered queries: sources, cleaning, feature functions and statistics
(SURVEY §2.1-2.5), each with its DuckDB twin."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from loanlens import constants as K
from loanlens.functions import columns as C
from loanlens.functions.derive import derive, prep_features
from loanlens.operators import clean, stats
from loanlens.oracle import (LOADED_CTE, D, bands_sql, clip_sql, round_sql, with_customers,
                             with_profiles)
from loanlens.plans.registry import register
from loanlens.sources.customers import customers, preview, template
from loanlens.sources.fixtures import profiles

R6 = 6


def _present(cols):
    return [c for c in cols if c in K.CUSTOMER_COLUMNS]


def _q(c: str) -> str:
    return f'"{c}"'


# ---------------------------------------------------------------- sources ---
register("profiles_table", with_profiles("SELECT * FROM profiles"))(profiles)
register("customer_features", with_customers("SELECT * FROM customers"))(customers)


@register("template_rows", with_customers(
    f"SELECT RespondentID, {', '.join(_present(K.REQUIRED_BATCH_COLUMNS))} FROM customers "
    "ORDER BY RespondentID LIMIT 10"))
def template_rows(spark, d):
    """The download template: required columns of the first 10 rows."""
    return template(customers(spark, d))


@register("preview_rows", with_profiles("SELECT * FROM profiles ORDER BY RespondentID LIMIT 50"))
def preview_rows(spark, d):
    """The raw-data preview (first 50 rows)."""
    return preview(profiles(spark, d), 50)


# ---------------------------------------------------------------- KPIs ------
@register("kpis", with_customers(
    f"SELECT count(*) AS n_rows, CAST({len(K.CUSTOMER_COLUMNS)} AS BIGINT) AS n_columns, "
    f"avg(CAST(LoanApproved AS DOUBLE)) * {D(100)} AS approval_rate_pct, "
    "avg(CAST(CreditScore AS DOUBLE)) AS mean_score, "
    "count(*) FILTER (WHERE MarketingSegment = 'Prime') AS n_prime FROM customers"),
    digits={"approval_rate_pct": R6, "mean_score": R6})
def kpis(spark, d):
    return stats.kpis(customers(spark, d))


_null_sum = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in K.CUSTOMER_COLUMNS)


_CAP = ["AnnualIncome_INR", "SavingsBalance_INR", "ExistingDebt_INR", "UPI_TxnMonthly",
        "EmergencyFundMonths"]
_beyond = " + ".join(f"CASE WHEN {c} < lo_{c} OR {c} > hi_{c} THEN 1 ELSE 0 END" for c in _CAP)
_fences = ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.25) - {D(3)} * (quantile_cont(CAST({c} AS DOUBLE), 0.75) "
    f"- quantile_cont(CAST({c} AS DOUBLE), 0.25)) AS lo_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.75) "
    f"+ {D(3)} * (quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)) AS hi_{c}"
    for c in _CAP)


@register("quality_report", with_customers(
    f"SELECT count(*) AS n_rows, CAST(sum({_null_sum}) AS BIGINT) AS null_cells, "
    f"CAST(sum({_beyond}) AS BIGINT) AS capped_cells, "
    "count(*) - count(DISTINCT RespondentID) AS duplicate_ids, "
    f"CAST({len(K.ENGINEERED)} AS BIGINT) AS engineered_columns, "
    f"CAST(0 AS BIGINT) AS encoded_columns FROM customers, (SELECT {_fences} FROM customers) AS __f"))
def quality_report(spark, d):
    return stats.quality_report(customers(spark, d), engineered=K.ENGINEERED, capped=_CAP)


@register("null_counts", with_customers(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM customers"
    for c in K.CUSTOMER_COLUMNS)))
def null_counts(spark, d):
    return stats.null_counts(customers(spark, d))


# ------------------------------------------------------------- summaries ----
def _summary_sql(cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, avg(CAST({c} AS DOUBLE)) AS mean, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, "
        f"stddev_samp(CAST({c} AS DOUBLE)) AS std FROM customers WHERE {c} IS NOT NULL"
        for c in cols)


@register("summary_stats", with_customers(_summary_sql(_present(K.EDA_NUMERIC))),
          digits={"mean": R6, "median": R6, "std": R6})
def summary_stats(spark, d):
    """A3 for every numeric EDA column."""
    return stats.summary_stats(customers(spark, d), _present(K.EDA_NUMERIC))


def _describe_sql(cols):
    r = lambda x: round_sql(x, 2)
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS count, {r(f'avg(CAST({c} AS DOUBLE))')} AS mean, "
        f"{r(f'stddev_samp(CAST({c} AS DOUBLE))')} AS std, "
        f"{r(f'CAST(min({c}) AS DOUBLE)')} AS min, "
        f"{r(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS p25, "
        f"{r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS p50, "
        f"{r(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS p75, "
        f"{r(f'CAST(max({c}) AS DOUBLE)')} AS max FROM customers WHERE {c} IS NOT NULL"
        for c in cols)


def _describe_query(cols):
    def run(spark, d):
        return stats.describe_group(customers(spark, d), cols)
    return run


for _group, _cols in K.FEATURE_GROUPS.items():
    _num = [c for c in _present(_cols) if c not in K.CUSTOMER_STRING_COLUMNS]
    if _num:
        _slug = "describe_" + re.sub(r"[^a-z0-9]+", "_", _group.lower()).strip("_")
        register(_slug, with_customers(_describe_sql(_num)))(_describe_query(_num))


# --------------------------------------------------------- categoricals -----
_CATS = ["MarketingSegment", "CityTier", "RepaymentHistory", "Persona", "AgeGroup",
         "CreditScoreBand"]


def _vc_query(c):
    return lambda spark, d: stats.value_counts(customers(spark, d), c, 10)


def _rate_query(c):
    return lambda spark, d: stats.rate_by(customers(spark, d), c, "LoanApproved", 10)


for _c in _CATS:
    register(f"value_counts_{_c}", with_customers(
        f'SELECT {_c}, count(*) AS "count" FROM customers WHERE {_c} IS NOT NULL '
        f'GROUP BY {_c} ORDER BY "count" DESC, {_c} LIMIT 10'))(_vc_query(_c))
    register(f"approval_rate_by_{_c}", with_customers(
        f"SELECT {_c}, rate_pct, n, CASE WHEN rate_pct >= 50 THEN 'high' WHEN rate_pct >= 30 "
        f"THEN 'mid' ELSE 'low' END AS band FROM (SELECT {_c}, "
        f"avg(CAST(LoanApproved AS DOUBLE)) * {D(100)} AS rate_pct, count(*) AS n "
        f"FROM customers WHERE {_c} IS NOT NULL GROUP BY {_c}) AS __r "
        f"ORDER BY rate_pct DESC, {_c} LIMIT 10"), digits={"rate_pct": R6})(_rate_query(_c))


@register("value_shares_Persona", with_customers(
    f'SELECT Persona, "count", "count" * {D(100)} / (SELECT sum("count") FROM vc) AS share_pct '
    'FROM vc', 'vc AS (SELECT Persona, count(*) AS "count" FROM customers '
    'WHERE Persona IS NOT NULL GROUP BY Persona ORDER BY "count" DESC, Persona LIMIT 10)'),
    digits={"share_pct": R6})
def value_shares_persona(spark, d):
    """A6 with the pie's base (the kept top 10)."""
    return stats.value_shares(customers(spark, d), "Persona", 10, base="kept")


@register("segment_shares", with_customers(
    'SELECT MarketingSegment, count(*) AS "count", '
    f'count(*) * {D(100)} / (SELECT count(*) FROM customers) AS share_pct '
    'FROM customers WHERE MarketingSegment IS NOT NULL GROUP BY MarketingSegment'),
    digits={"share_pct": R6})
def segment_shares(spark, d):
    """A6 with all rows as the base (the segment list)."""
    return stats.value_shares(customers(spark, d), "MarketingSegment", None, base="all")


def _grouped_sql(key, c):
    r = lambda x: round_sql(x, 2)
    k = f"coalesce(CAST({key} AS VARCHAR), 'nan')"
    return with_customers(
        f'SELECT {k} AS "group", {r(f"avg({c})")} AS mean, '
        f"{r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS median, "
        f"{r(f'stddev_samp({c})')} AS std, {r(f'CAST(min({c}) AS DOUBLE)')} AS min, "
        f"{r(f'CAST(max({c}) AS DOUBLE)')} AS max FROM customers GROUP BY {k}")


for _key, _c in [("RepaymentHistory", "CreditScore"), ("LoanApproved", "AnnualIncome_INR"),
                 ("CityTier", "EmergencyFundMonths")]:
    register(f"grouped_stats_{_c}_by_{_key}", _grouped_sql(_key, _c))(
        (lambda k, c: lambda spark, d: stats.grouped_stats(customers(spark, d), k, c))(_key, _c))


@register("median_extremes_CreditScore_by_Persona", with_customers(
    "SELECT (SELECT g FROM m ORDER BY median DESC, g LIMIT 1) AS top_group, "
    "(SELECT max(median) FROM m) AS top_median, "
    "(SELECT g FROM m ORDER BY median ASC, g LIMIT 1) AS bottom_group, "
    "(SELECT min(median) FROM m) AS bottom_median",
    "m AS (SELECT CAST(Persona AS VARCHAR) AS g, "
    "quantile_cont(CAST(CreditScore AS DOUBLE), 0.5) AS median FROM customers "
    "WHERE Persona IS NOT NULL AND CreditScore IS NOT NULL GROUP BY Persona)"),
    digits={"top_median": R6, "bottom_median": R6})
def median_extremes(spark, d):
    """A9."""
    return stats.median_extremes(customers(spark, d), "Persona", "CreditScore")


def _shape_sql(cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS feature, cnt AS n, m3 / power(m2, {D(1.5)}) AS skewness, "
            f"m4 / (m2 * m2) - {D(3)} AS kurtosis FROM ("
            f"SELECT count(*) AS cnt, avg(power({x} - mu, 2)) AS m2, "
            f"avg(power({x} - mu, 3)) AS m3, avg(power({x} - mu, 4)) AS m4 FROM customers, "
            f"(SELECT avg({x}) AS mu FROM customers WHERE {c} IS NOT NULL) AS __mu "
            f"WHERE {c} IS NOT NULL) AS __mom")
    body = " UNION ALL ".join(parts)
    return with_customers(
        "SELECT feature, n, skewness, kurtosis, "
        f"CASE WHEN skewness > {D(0.5)} THEN 'right-skewed' WHEN skewness < {D(-0.5)} "
        "THEN 'left-skewed' ELSE 'approx normal' END AS skew_shape, "
        f"CASE WHEN kurtosis > {D(1)} THEN 'heavy tails' WHEN kurtosis < {D(-1)} "
        f"THEN 'thin tails' ELSE 'normal tails' END AS tail_shape FROM ({body}) AS __s")


@register("shape_stats", _shape_sql(_present(K.GRID_COLUMNS)),
          digits={"skewness": R6, "kurtosis": R6})
def shape_stats(spark, d):
    """A10 + F21 over the overview-grid columns."""
    return stats.shape_stats(customers(spark, d), _present(K.GRID_COLUMNS))


for _c in ["RepaymentHistory", "CreditScoreBand", "AgeGroup"]:
    register(f"distinct_{_c}", with_customers(
        f"SELECT DISTINCT {_c} FROM customers WHERE {_c} IS NOT NULL ORDER BY {_c}"))(
        (lambda c: lambda spark, d: stats.distinct_values(customers(spark, d), c))(_c))


@register("category_headline_Persona", with_customers(
    "SELECT (SELECT Persona FROM g ORDER BY cnt DESC, Persona LIMIT 1) AS top_value, "
    "(SELECT max(cnt) FROM g) AS top_count, "
    f"(SELECT max(cnt) FROM g) * {D(100)} / (SELECT count(*) FROM customers) AS top_share_pct, "
    "(SELECT Persona FROM g ORDER BY rate DESC, Persona LIMIT 1) AS best_rate_value, "
    "(SELECT max(rate) FROM g) AS best_rate_pct",
    f"g AS (SELECT Persona, count(*) AS cnt, avg(CAST(LoanApproved AS DOUBLE)) * {D(100)} "
    "AS rate FROM customers WHERE Persona IS NOT NULL GROUP BY Persona)"),
    digits={"top_share_pct": R6, "best_rate_pct": R6})
def category_headline(spark, d):
    """A26."""
    return stats.category_headline(customers(spark, d), "Persona")


def _segment_profile_sql():
    r2 = lambda x: round_sql(x, 2)
    order = " ".join(f"WHEN '{s}' THEN {i + 1}"
                     for i, s in enumerate(K.CLUSTER_NAMES + ["AtRisk"]))
    metrics = ", ".join(f"{r2(f'avg({m})')} AS {m}" for m in _present(K.PROFILE_METRICS))
    return with_customers(
        f"SELECT MarketingSegment, {metrics}, "
        f"{round_sql(f'avg(CAST(LoanApproved AS DOUBLE)) * {D(100)}', 1)} AS Approval_pct, "
        f"count(*) AS n, CAST(CASE MarketingSegment {order} ELSE 99 END AS INTEGER) AS seg_order "
        "FROM customers GROUP BY MarketingSegment")


@register("segment_profile", _segment_profile_sql())
def segment_profile(spark, d):
    """A16 on the marketing segments."""
    return stats.segment_profile(customers(spark, d))


# ------------------------------------------------------------- cleaning -----
def _impute_sql():
    return with_customers("SELECT * FROM loaded", LOADED_CTE)


@register("impute_median", _impute_sql())
def impute_median(spark, d):
    """Every numeric null replaced by its column's exact median."""
    return clean.impute_median(customers(spark, d))


@register("model_inputs", with_customers(
    "SELECT RespondentID, " + ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), {D(0)}) AS {c}" if c in K.CUSTOMER_COLUMNS
        else f"{D(0)} AS {c}" for c in K.CLF_FEATURES) + " FROM customers"))
def model_inputs(spark, d):
    """P1 + P2 + P4: the classifier input in model order, null/absent -> 0."""
    return prep_features(customers(spark, d), K.CLF_FEATURES, keep=["RespondentID"])


@register("income_quartiles", with_customers(
    "SELECT RespondentID, AnnualIncome_INR, CASE WHEN AnnualIncome_INR IS NULL THEN NULL "
    "WHEN AnnualIncome_INR <= q1 THEN 'Q1' WHEN AnnualIncome_INR <= q2 THEN 'Q2' "
    "WHEN AnnualIncome_INR <= q3 THEN 'Q3' ELSE 'Q4' END AS IncomeQuartile "
    "FROM customers, (SELECT quantile_cont(AnnualIncome_INR, 0.25) AS q1, "
    "quantile_cont(AnnualIncome_INR, 0.5) AS q2, quantile_cont(AnnualIncome_INR, 0.75) AS q3 "
    "FROM customers) AS __q"))
def income_quartiles(spark, d):
    """F11."""
    return clean.quartile_bins(customers(spark, d), "AnnualIncome_INR") \
        .select("RespondentID", "AnnualIncome_INR", "IncomeQuartile")


_ENC = ["CityTier", "RepaymentHistory", "MarketingSegment", "Persona", "CreditScoreBand",
        "AgeGroup"]


@register("label_codes", with_customers(
    "SELECT RespondentID, " + ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY coalesce(CAST({c} AS VARCHAR), 'nan')) - 1 "
        f"AS INTEGER) AS {c}_Enc" for c in _ENC) + " FROM customers"))
def label_codes(spark, d):
    """F13 on the categorical columns present."""
    out = clean.label_encode(customers(spark, d), _ENC)
    return out.select("RespondentID", *[f"{c}_Enc" for c in _ENC])


@register("outlier_report", with_customers(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} < lower OR {c} > upper) AS n_capped, "
    "q1, q3, lower, upper FROM customers, (SELECT q1, q3, "
    f"q1 - {D(3)} * (q3 - q1) AS lower, q3 + {D(3)} * (q3 - q1) AS upper FROM "
    f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM customers) AS __qq) AS __f "
    "GROUP BY q1, q3, lower, upper" for c in _CAP)),
    digits={"q1": R6, "q3": R6, "lower": R6, "upper": R6})
def outlier_report(spark, d):
    """capped-cell counts per column at 3 x IQR."""
    _, report = clean.cap_outliers(customers(spark, d), _CAP, 3.0)
    return report


def derived_columns_sql(mode) -> dict[str, str]:
    """The derived features of a mode over ``profiles``, by name."""
    if mode == "batch":
        cols = {
            "MonthlyEMI_INR": f"ExistingDebt_INR / {D(36)}",
            "EMI_to_Income": f"ExistingDebt_INR / {D(36)} / (AnnualIncome_INR / {D(12)} + {D(1)})",
            "SavingsToDebt": f"SavingsBalance_INR / (ExistingDebt_INR + {D(1)})",
            "RiskScore": f"MissedPayments * {D(0.25)} + Bankruptcies * {D(0.4)} + "
                         f"DebtToIncomeRatio * {D(0.2)} + CreditUtilization * {D(0.15)}",
            "FamilyBurdenScore": f"NumDependents * {D(0.15)}",
        }
    else:
        emi = (f"(CASE WHEN ExistingDebt_INR > 0 THEN ExistingDebt_INR / {D(36)} "
               f"ELSE {D(0)} END)")
        cols = {
            "MonthlyEMI_INR": emi,
            "EMI_to_Income": f"{emi} / greatest(AnnualIncome_INR / {D(12)}, {D(1)})",
            "SavingsToDebt": f"SavingsBalance_INR / greatest(ExistingDebt_INR, {D(1)})",
            "RiskScore": f"MissedPayments * {D(0.25)} + Bankruptcies * {D(0.4)} + "
                         f"DebtToIncomeRatio * {D(0.2)} + CreditUtilization * {D(0.15)}",
            "FamilyBurdenScore": f"NumDependents * {D(0.15)}",
        }
    return cols


def _derived_sql(mode):
    sel = ", ".join(f"{v} AS {k}" for k, v in derived_columns_sql(mode).items())
    return with_profiles(f"SELECT RespondentID, RepaymentHistory_Ord, {sel} FROM profiles")


def _derived_query(mode):
    def run(spark, d):
        base = profiles(spark, d).drop("MonthlyEMI_INR")
        out = derive(base, mode)
        return out.select("RespondentID", "RepaymentHistory_Ord", "MonthlyEMI_INR",
                          "EMI_to_Income", "SavingsToDebt", "RiskScore", "FamilyBurdenScore")
    return run


for _mode in ("batch", "live"):
    register(f"derived_{_mode}", _derived_sql(_mode))(_derived_query(_mode))


@register("clip_bands", with_customers(
    "SELECT RespondentID, CreditScore, "
    + bands_sql("CreditScore", K.SCORE_BAND_EDGES, K.SCORE_BAND_LABELS, True)
    + " AS score_zone, "
    + f"{clip_sql('EmergencyFundMonths', D(1), D(6))} AS fund_clipped, "
    + "CAST(CASE WHEN HasProperty = 1 THEN 'Yes' ELSE 'No' END = 'Yes' AS INTEGER) AS yes_flag, "
    + "printf('R%04d', cust_key) AS short_id FROM customers"))
def clip_bands(spark, d):
    """F9 (null-preserving clip), F18 (Yes/No), F19 (padded id), F20 (zones
    with the lowest edge included)."""
    df = customers(spark, d)
    return df.select(
        "RespondentID", "CreditScore",
        C.score_band("CreditScore", include_lowest=True).alias("score_zone"),
        C.clip("EmergencyFundMonths", 1.0, 6.0).alias("fund_clipped"),
        C.yes_no(F.when(F.col("HasProperty") == 1, "Yes").otherwise("No")).alias("yes_flag"),
        C.padded_id("cust_key", "R", 4).alias("short_id"))
