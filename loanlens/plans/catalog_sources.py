"""Registered queries: CSV scan and batch upload (S1-S3), absent-column
defaults (P7), loan amount and term (F3, F8, F13), the capped table (F23) and
the batch summary on given decisions (A19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens import constants as K
from loanlens.functions import columns as C
from loanlens.functions.derive import derive
from loanlens.operators import clean, corr, stats
from loanlens.oracle import D, cents_sql, clip_sql, with_customers, with_profiles
from loanlens.plans.catalog_eval import GIVEN_CTE, given_probabilities
from loanlens.plans.registry import register
from loanlens.session import ensure_checkpoint_dir, table_path
from loanlens.sources.customers import customers, read_batch, read_customers, write_table
from loanlens.sources.fixtures import profiles

R6 = 6


def _csv(spark, d, kind, build):
    """A CSV copy of a derived table in the shared folder, per call."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/{kind}-{uuid.uuid4().hex}"
    write_table(build(), path, fmt="csv")
    return path


# ------------------------------------------------------------- S1, S2, S3 ---
@register("csv_customers", with_profiles("SELECT * FROM profiles"))
def csv_customers(spark, d):
    """S3 + S1: the customer table written as CSV and scanned back, typed by
    the table's schema."""
    base = profiles(spark, d)
    return read_customers(spark, _csv(spark, d, "customers", lambda: base), schema=base.schema, fmt="csv")


_UPLOAD = [c for c in K.REQUIRED_BATCH_COLUMNS if c in K.PROFILE_COLUMNS]
#: Every seventh customer's score cell is "NA" and every eleventh's age "NaN".
_HOLES = {"CreditScore": (7, "NA"), "Age": (11, "NaN")}


@register("batch_upload", with_profiles(
    "SELECT RespondentID, RepaymentHistory, "
    "CASE WHEN cust_key % 7 = 0 THEN NULL ELSE CreditScore END AS CreditScore, "
    "CASE WHEN cust_key % 11 = 0 THEN NULL ELSE CAST(Age AS DOUBLE) END AS Age, "
    + ", ".join(c for c in _UPLOAD if c != "Age") + " FROM profiles"))
def batch_upload(spark, d):
    """An uploaded CSV with NA tokens in numeric columns, types inferred,
    required columns checked."""
    cells = profiles(spark, d).select("RespondentID", "RepaymentHistory", *[
        F.when(F.col("cust_key") % _HOLES[c][0] == 0, F.lit(_HOLES[c][1]))
        .otherwise(F.col(c).cast("string")).alias(c) if c in _HOLES else F.col(c)
        for c in ["CreditScore", *_UPLOAD]])
    return read_batch(spark, _csv(spark, d, "upload", lambda: cells), fmt="csv") \
        .withColumn("Age", F.col("Age").cast("double"))  # as pandas holds whole numbers with gaps


# --------------------------------------------------------------------- P7 ---
_DEFAULTS = {"ExistingDebt_INR": 0.0, "AnnualIncome_INR": 1.0, "NumDependents": 2,
             "MissedPayments": 0}


@register("absent_defaults", with_profiles(
    "SELECT RespondentID, CreditUtilization, " + ", ".join(
        f"{D(v) if isinstance(v, float) else v} AS {c}" for c, v in _DEFAULTS.items())
    + " FROM profiles"))
def absent_defaults(spark, d):
    """Columns that the table lacks, with each one's default."""
    return clean.with_default(profiles(spark, d).select("RespondentID", "CreditUtilization"), _DEFAULTS)


_BARE_COLS = {
    "RepaymentHistory_Ord": "2", "MonthlyEMI_INR": f"{D(0)} / {D(36)}",
    "EMI_to_Income": f"({D(0)} / {D(36)}) / ({D(1)} / {D(12)} + {D(1)})",
    "SavingsToDebt": f"{D(0)} / ({D(0)} + {D(1)})",
    "RiskScore": f"0 * {D(0.25)} + 0 * {D(0.4)} + {D(0)} * {D(0.2)} + CreditUtilization * {D(0.15)}",
    "FamilyBurdenScore": f"2 * {D(0.15)}",
    **{c: "0" for c in K.BATCH_ZERO_DEFAULTS},
}


@register("batch_defaults", with_profiles(
    "SELECT RespondentID, " + ", ".join(f"{v} AS {c}" for c, v in _BARE_COLS.items())
    + " FROM profiles"))
def batch_defaults(spark, d):
    """P7 in the batch derivation: a batch that lacks every optional column."""
    bare = derive(profiles(spark, d).select("RespondentID", "CreditUtilization"), "batch")
    return bare.select("RespondentID", *_BARE_COLS)


# ------------------------------------------------------------ F3, F8, F13 ---
_PURPOSES = ["Business", "Education", "Home", "Medical", "Vehicle"]


def loans(spark, d):
    """Loan amount (mean order value), term (12 (1 + c_custkey mod 5), and 0
    for every 13th customer) and purpose of each customer."""
    cents = F.round(F.col("o_totalprice") * C.dlit(100)).cast("bigint")
    amounts = (spark.read.parquet(table_path(d, "orders")).groupBy("o_custkey")
               .agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("n")))
    base = profiles(spark, d).select("cust_key", "RespondentID", "ExistingDebt_INR")
    purpose = F.element_at(F.array(*[F.lit(p) for p in _PURPOSES]), (F.col("cust_key") % 5 + 1).cast("int"))
    return base.join(amounts, F.col("cust_key") == F.col("o_custkey"), "left").select(
        "RespondentID", "ExistingDebt_INR",
        (F.col("cents").cast("double") / C.dlit(100) / F.col("n").cast("double")).alias("LoanAmountSought"),
        F.when(F.col("cust_key") % 13 == 0, F.lit(0)).otherwise((F.col("cust_key") % 5 + 1) * 12)
        .cast("int").alias("LoanTermMonths"),
        F.when(F.col("cust_key") % 9 != 0, purpose).alias("LoanPurpose_New"))


_PURPOSE_SQL = ("CASE WHEN cust_key % 9 <> 0 THEN CASE cust_key % 5 " + " ".join(
    f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PURPOSES)) + " END END")


@register("loan_features", with_profiles(
    "SELECT RespondentID, LoanAmountSought, LoanTermMonths, LoanPurpose_New, "
    "CASE WHEN LoanAmountSought IS NULL THEN NULL ELSE ln(1 + LoanAmountSought) END AS LoanAmountLog, "
    f"ExistingDebt_INR / CASE WHEN LoanTermMonths = 0 THEN {D(36)} ELSE CAST(LoanTermMonths AS DOUBLE) END "
    "AS MonthlyEMI_INR, CAST(dense_rank() OVER (ORDER BY coalesce(LoanPurpose_New, 'nan')) - 1 AS INTEGER) "
    "AS LoanPurpose_New_Enc, CAST(dense_rank() OVER (ORDER BY CAST(LoanTermMonths AS VARCHAR)) - 1 AS INTEGER) "
    "AS LoanTermMonths_Enc FROM ln",
    f"oa2 AS (SELECT o_custkey, sum({cents_sql('o_totalprice')}) AS cents, count(*) AS n FROM orders GROUP BY 1), "
    f"ln AS (SELECT RespondentID, ExistingDebt_INR, CAST(cents AS DOUBLE) / {D(100)} / CAST(n AS DOUBLE) "
    "AS LoanAmountSought, CAST(CASE WHEN cust_key % 13 = 0 THEN 0 ELSE (cust_key % 5 + 1) * 12 END AS INTEGER) "
    f"AS LoanTermMonths, {_PURPOSE_SQL} AS LoanPurpose_New FROM profiles LEFT JOIN oa2 ON cust_key = o_custkey)"),
    digits={"LoanAmountLog": R6, "MonthlyEMI_INR": R6, "LoanAmountSought": R6})
def loan_features(spark, d):
    """F3 with a term (0 -> 36), F8 of the loan amount, F13 on the purpose and
    the term."""
    x = loans(spark, d).withColumns({
        "LoanAmountLog": C.log1p("LoanAmountSought"),
        "MonthlyEMI_INR": C.monthly_emi("ExistingDebt_INR", "LoanTermMonths")})
    return clean.label_encode(x, ["LoanPurpose_New", "LoanTermMonths"]).drop("ExistingDebt_INR")


# -------------------------------------------------------------------- F23 ---
_CAP = ["AnnualIncome_INR", "SavingsBalance_INR", "ExistingDebt_INR"]


@register("capped_table", with_customers(
    "SELECT RespondentID, " + ", ".join(
        f"{clip_sql(c, f'lo_{c}', f'hi_{c}')} AS {c}" for c in _CAP)
    + " FROM customers, (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.25) - {D(3)} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
        f"quantile_cont({c}, 0.75) + {D(3)} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
        for c in _CAP) + " FROM customers) AS __f"), digits={c: 4 for c in _CAP})
def capped_table(spark, d):
    """the table with its columns clipped to 3 x IQR fences."""
    capped, _ = clean.cap_outliers(customers(spark, d), _CAP, 3.0)
    return capped.select("RespondentID", *_CAP)


# --------------------------------------------------------------- A19, A25 ---
@register("batch_summary_given", with_customers(
    f"SELECT count(*) AS scored, count(*) FILTER (WHERE ens >= {D(0.6)}) AS approved, "
    f"count(*) FILTER (WHERE ens >= {D(0.4)} AND ens < {D(0.6)}) AS borderline, "
    f"count(*) FILTER (WHERE ens < {D(0.4)}) AS rejected, avg(CAST(round_even("
    f"{clip_sql(f'{D(900)} - RiskScore * {D(200)}', D(300), D(900))}, 0) AS DOUBLE)) AS mean_score "
    f"FROM (SELECT *, p_gb * {D(0.5)} + p_rf * {D(0.3)} + p_lr * {D(0.2)} AS ens FROM gp) AS __e",
    GIVEN_CTE), digits={"mean_score": R6})
def batch_summary_given(spark, d):
    """A19 over decisions from given probabilities."""
    g = given_probabilities(spark, d)
    score = C.clip(C.dlit(900) - F.col("RiskScore") * C.dlit(200), 300.0, 900.0)
    return stats.batch_summary(g.select(
        C.decision(C.soft_vote("p_gb", "p_rf", "p_lr")).alias("Loan_Decision"),
        C.round_half_even(score, 0).cast("int").alias("Predicted_CreditScore")))


@register("linregress_p")
def linregress_p(spark, d):
    """A25 with its p-value (Student's t; SQL has no such function)."""
    return corr.linregress_p(customers(spark, d), "AnnualIncome_INR", "CreditScore")
