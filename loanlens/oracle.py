"""ANSI-SQL twins (DuckDB dialect subset) of the registered queries.

Every twin starts from the same ``profiles`` prelude, a CTE chain that
derives the FIXTURES §5 customer table from the driver's views. Literals are
written as explicit DOUBLEs so both engines do the same float arithmetic.
"""

from __future__ import annotations


def D(x) -> str:
    """A DOUBLE literal."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def clip_sql(x: str, lo=None, hi=None, nullable: bool = True) -> str:
    out = x
    if hi is not None:
        out = f"least({out}, {hi})"
    if lo is not None:
        out = f"greatest({out}, {lo})"
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE {out} END)" if nullable else f"({out})"


def cents_sql(x: str) -> str:
    return f"CAST(round({x} * {D(100)}) AS BIGINT)"


def ordinal_sql(x: str) -> str:
    return (f"(CASE WHEN {x} = 'Excellent' THEN 4 WHEN {x} = 'Good' THEN 3 "
            f"WHEN {x} = 'Fair' THEN 2 WHEN {x} = 'Poor' THEN 1 ELSE 2 END)")


def scorecard_sql(ordv="RepaymentHistory_Ord", util="CreditUtilization", missed="MissedPayments",
                  bankr="Bankruptcies", hist="CreditHistoryYears", lit="FinLiteracyScore",
                  prop="HasProperty", sav="SavingsPct_Monthly", dti="DebtToIncomeRatio") -> str:
    return (f"({D(600)} + ({ordv} - 2) * {D(30)} + ({D(1)} - {util}) * {D(80)}"
            f" - {missed} * {D(40)} - {bankr} * {D(80)} + {hist} * {D(3)}"
            f" + {lit} * {D(5)} + {prop} * {D(20)} + ({sav} - {D(15)}) * {D(1.5)}"
            f" - {dti} * {D(50)})")


def credit_score_sql(nullable: bool = True, **kw) -> str:
    clipped = clip_sql(scorecard_sql(**kw), D(300), D(900), nullable)
    return f"CAST(floor({clipped} + {D(0.5)}) AS DOUBLE)"


def approval_sql(cs="CreditScore", dti="DebtToIncomeRatio", missed="MissedPayments",
                 ordv="RepaymentHistory_Ord", bankr="Bankruptcies") -> str:
    return (f"(CASE WHEN (CASE WHEN {cs} >= 650 THEN 1 ELSE 0 END)"
            f" + (CASE WHEN {dti} < {D(0.4)} THEN 1 ELSE 0 END)"
            f" + (CASE WHEN {missed} = 0 THEN 1 ELSE 0 END)"
            f" + (CASE WHEN {ordv} >= 3 THEN 1 ELSE 0 END)"
            f" - 2 * (CASE WHEN {bankr} > 0 THEN 1 ELSE 0 END) >= 2 THEN 1 ELSE 0 END)")


def segment_sql(cs="CreditScore") -> str:
    return (f"(CASE WHEN {cs} >= 740 THEN 'Prime' WHEN {cs} >= 620 THEN 'Emerging' "
            f"ELSE 'AtRisk' END)")


def _profiles_ctes() -> str:
    tot = f"CAST(coalesce(tot_c, 0) AS DOUBLE) / {D(100)}"
    open_tot = f"CAST(coalesce(open_c, 0) AS DOUBLE) / {D(100)}"
    disc = f"coalesce(CAST(disc_c AS DOUBLE) / {D(100)} / CAST(n_line AS DOUBLE), {D(0)})"
    qty = f"coalesce(CAST(qty_c AS DOUBLE) / {D(100)} / CAST(n_line AS DOUBLE), {D(25)})"
    rshare = "(CAST(n_r AS DOUBLE) / CAST(n_line AS DOUBLE))"
    av = f"(CAST(val_c AS DOUBLE) / {D(100)} / CAST(n_ev AS DOUBLE))"
    emi = f"(ExistingDebt_INR / {D(36)})"
    return f"""
__ln AS (
  SELECT l_orderkey, count(*) AS ln_n,
         sum({cents_sql('l_discount')}) AS ln_disc_c,
         sum({cents_sql('l_quantity')}) AS ln_qty_c,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS ln_r
  FROM lineitem GROUP BY l_orderkey),
__oa AS (
  SELECT o_custkey,
         sum({cents_sql('o_totalprice')}) AS tot_c,
         sum(CASE WHEN o_orderstatus = 'O' THEN {cents_sql('o_totalprice')} ELSE 0 END) AS open_c,
         count(*) AS n_ord,
         sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS n_p,
         sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS n_urg,
         year(max(o_orderdate)) - year(min(o_orderdate)) AS yrs,
         sum(ln_n) AS n_line, sum(ln_disc_c) AS disc_c, sum(ln_qty_c) AS qty_c,
         sum(ln_r) AS n_r
  FROM orders LEFT JOIN __ln ON o_orderkey = l_orderkey GROUP BY o_custkey),
__ea AS (
  SELECT user_id, count(*) AS n_ev, sum({cents_sql('value')}) AS val_c,
         sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS n_buy,
         sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS n_err
  FROM events GROUP BY user_id),
__p1 AS (
  SELECT
    c_custkey AS cust_key,
    'R' || lpad(CAST(c_custkey + 1 AS VARCHAR), 7, '0') AS RespondentID,
    c_mktsegment AS Persona,
    'Tier' || CAST(n_regionkey % 3 + 1 AS VARCHAR) AS CityTier,
    CAST(21 + (c_custkey * 7) % 44 AS INTEGER) AS Age,
    CAST(c_nationkey % 6 AS INTEGER) AS NumDependents,
    {clip_sql(f'{tot} * {D(0.4)}', D(80000), D(5000000), False)} AS AnnualIncome_INR,
    greatest(c_acctbal, {D(0)}) * {D(200)} AS SavingsBalance_INR,
    {clip_sql(f'c_acctbal / {D(200)}', D(0), D(60), False)} AS SavingsPct_Monthly,
    least({open_tot} * {D(0.5)}, {D(3000000)}) AS ExistingDebt_INR,
    {clip_sql(f'{disc} * {D(10)}', D(0), D(1), False)} AS CreditUtilization,
    CAST(coalesce(yrs, 0) AS INTEGER) AS CreditHistoryYears,
    CAST({clip_sql('coalesce(n_ord, 0)', 1, 11, False)} AS INTEGER) AS NumCreditAccounts,
    CAST(least(coalesce(n_urg, 0), 10) AS INTEGER) AS NumHardInquiries,
    CAST({clip_sql('coalesce(n_p, 0) - 2', 0, 3, False)} AS INTEGER) AS MissedPayments,
    CAST(CASE WHEN c_acctbal < {D(-500)} THEN 2 WHEN c_acctbal < {D(0)} THEN 1 ELSE 0 END
         AS INTEGER) AS Bankruptcies,
    CASE WHEN coalesce(n_line, 0) = 0 THEN NULL
         WHEN {rshare} < {D(0.25)} THEN 'Excellent' WHEN {rshare} < {D(0.33)} THEN 'Good'
         WHEN {rshare} < {D(0.42)} THEN 'Fair' ELSE 'Poor' END AS RepaymentHistory,
    {D(1)} + {D(9)} * {qty} / {D(50)} AS FinLiteracyScore,
    CAST(coalesce(n_line, 0) AS INTEGER) AS UPI_TxnMonthly,
    CASE WHEN n_ev IS NOT NULL THEN least({av} / {D(10)}, {D(12)}) END AS EmergencyFundMonths,
    CAST(CASE WHEN c_acctbal > {D(5000)} THEN 1 ELSE 0 END AS INTEGER) AS HasProperty,
    CAST(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS INTEGER) AS HasVehicle,
    CAST(CASE WHEN coalesce(n_urg, 0) > 1 THEN 1 ELSE 0 END AS INTEGER) AS HasCreditCard,
    CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS HasFinancialPlan,
    CAST(CASE WHEN coalesce(n_err, 0) > 12 THEN 1 ELSE 0 END AS INTEGER) AS IncomeShockLast3Yr,
    CAST(CASE WHEN coalesce(n_buy, 0) > 12 THEN 1 ELSE 0 END AS INTEGER) AS AppBasedLoan,
    CAST(coalesce(yrs, 0) * 2 + c_custkey % 5 AS INTEGER) AS YearsEmployed
  FROM customer
  JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN __oa ON c_custkey = o_custkey
  LEFT JOIN __ea ON c_custkey = user_id),
__p2 AS (
  SELECT *, {emi} AS MonthlyEMI_INR,
         least({emi} * {D(12)} / (AnnualIncome_INR + {D(1)}), {D(3)}) AS DebtToIncomeRatio,
         CAST({ordinal_sql('RepaymentHistory')} AS INTEGER) AS RepaymentHistory_Ord
  FROM __p1),
__p3 AS (SELECT *, {credit_score_sql(False)} AS CreditScore FROM __p2),
profiles AS (
  SELECT *, CAST({approval_sql()} AS INTEGER) AS LoanApproved,
         {segment_sql()} AS MarketingSegment
  FROM __p3)"""


PROFILES_CTES = _profiles_ctes()


def with_profiles(body: str, extra_ctes: str = "") -> str:
    """``WITH <profiles chain>[, extra] <body>``."""
    extra = f",\n{extra_ctes}" if extra_ctes.strip() else ""
    return f"WITH {PROFILES_CTES}{extra}\n{body}"


def bands_sql(x: str, edges, labels, include_lowest: bool = False) -> str:
    below = f"{x} < {edges[0]}" if include_lowest else f"{x} <= {edges[0]}"
    parts = [f"WHEN {below} OR {x} > {edges[-1]} THEN NULL"]
    parts += [f"WHEN {x} <= {hi} THEN '{lab}'" for lab, hi in zip(labels, edges[1:])]
    return "(CASE " + " ".join(parts) + " END)"


def round_sql(x: str, digits: int) -> str:
    m = float(10 ** digits)
    return f"(CAST(floor({x} * {D(m)} + {D(0.5)}) AS DOUBLE) / {D(m)})"


def _customers_cte() -> str:
    from loanlens import constants as K
    risk = clip_sql(f"MissedPayments * {D(0.25)} + Bankruptcies * {D(0.4)}"
                    f" + DebtToIncomeRatio * {D(0.2)} + CreditUtilization * {D(0.15)}",
                    D(0), D(3))
    emi_inc = clip_sql(f"MonthlyEMI_INR / (AnnualIncome_INR / {D(12)} + {D(1)})", D(0), D(3))
    sav_debt = clip_sql(f"SavingsBalance_INR / (ExistingDebt_INR + {D(1)})", D(0), D(50))
    burden = clip_sql(f"NumDependents * {D(0.15)}", D(0), D(1.5))
    prob = clip_sql(f"(CreditScore - {D(300)}) / {D(600)} * {D(0.8)} + LoanApproved * {D(0.2)}",
                    D(0), D(1))
    return f"""customers AS (
  SELECT *, {risk} AS RiskScore, {emi_inc} AS EMI_to_Income, {sav_debt} AS SavingsToDebt,
         {burden} AS FamilyBurdenScore,
         {bands_sql('CreditScore', K.SCORE_BAND_EDGES, K.SCORE_BAND_LABELS)} AS CreditScoreBand,
         {bands_sql('Age', K.AGE_GROUP_EDGES, K.AGE_GROUP_LABELS)} AS AgeGroup,
         {round_sql(f'ln({D(1)} + AnnualIncome_INR)', 4)} AS IncomeLog,
         {round_sql(prob, 4)} AS ApprovalProbability
  FROM profiles)"""


CUSTOMERS_CTE = _customers_cte()


def with_customers(body: str, extra_ctes: str = "") -> str:
    extra = f",\n{extra_ctes}" if extra_ctes.strip() else ""
    return f"WITH {PROFILES_CTES},\n{CUSTOMERS_CTE}{extra}\n{body}"


def wrap_round(sql: str, digits: dict[str, int]) -> str:
    """Round the named double columns of a query's output, as the Spark side
    does, so values hash alike across engines."""
    if not digits:
        return sql
    repl = ", ".join(f"{round_sql(c, k)} AS {c}" for c, k in digits.items())
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) AS __q"


def _loaded_cte() -> str:
    """The load path (P3): every numeric null replaced by its column median."""
    from loanlens import constants as K
    parts = []
    for c in K.CUSTOMER_NUMERIC_COLUMNS:
        t = ("BIGINT" if c == "cust_key" else
             "INTEGER" if c in K.CUSTOMER_INT_COLUMNS else "DOUBLE")
        parts.append(f"coalesce({c}, CAST((SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) "
                     f"FROM customers) AS {t})) AS {c}")
    return f"loaded AS (SELECT * REPLACE ({', '.join(parts)}) FROM customers)"


LOADED_CTE = _loaded_cte()
