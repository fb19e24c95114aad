"""Derived-feature chains (P2, P7, P8 with F1-F20).

The reference has three disagreeing formula sets; they are kept as modes of
one function, since they are its query semantics:

* ``train`` (load path): derive a column only if it is absent, clipped.
* ``batch`` (upload scoring): always overwrite EMI, ratios, risk and burden,
  unclipped, with per-column defaults for absent inputs.
* ``live`` (one application / stream record): the form's own formulas.

``train`` is the recommended mode. All modes are a single ``select`` (no
``withColumn`` loop), so the plan stays one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens import constants as K
from loanlens.functions import columns as C


def _get(df: DataFrame, name: str, default: float) -> Column:
    """pandas ``df.get(name, default)``: the column when present, else a literal."""
    return F.col(name) if name in df.columns else F.lit(default)


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that overwrites or appends the given columns."""
    keep = [F.col(c) if c not in new else new[c].alias(c) for c in df.columns]
    extra = [v.alias(k) for k, v in new.items() if k not in df.columns]
    return df.select(*keep, *extra)


def derive(df: DataFrame, mode: str = "train") -> DataFrame:
    if mode == "train":
        return _derive_train(df)
    if mode == "batch":
        return _derive_batch(df)
    if mode == "live":
        return _derive_live(df)
    raise ValueError(f"unknown mode {mode!r}")


def _derive_train(df: DataFrame) -> DataFrame:
    cols = set(df.columns)
    new: dict[str, Column] = {}
    if "RepaymentHistory_Ord" not in cols and "RepaymentHistory" in cols:
        new["RepaymentHistory_Ord"] = C.repayment_ordinal("RepaymentHistory")
    if "RiskScore" not in cols:
        new["RiskScore"] = C.risk_score("MissedPayments", _get(df, "Bankruptcies", 0),
                                        "DebtToIncomeRatio", "CreditUtilization")
    if "EMI_to_Income" not in cols:
        new["EMI_to_Income"] = C.emi_to_income(_get(df, "MonthlyEMI_INR", 0.0),
                                               "AnnualIncome_INR", "train")
    if "SavingsToDebt" not in cols:
        new["SavingsToDebt"] = C.savings_to_debt("SavingsBalance_INR",
                                                 _get(df, "ExistingDebt_INR", 1.0), "train")
    if "FamilyBurdenScore" not in cols:
        new["FamilyBurdenScore"] = C.family_burden("NumDependents", clipped=True)
    return _replace(df, new) if new else df


def _derive_batch(df: DataFrame) -> DataFrame:
    cols = set(df.columns)
    ed = _get(df, "ExistingDebt_INR", 0.0)
    ai = _get(df, "AnnualIncome_INR", 1.0)
    sb = _get(df, "SavingsBalance_INR", 0.0)
    mp = _get(df, "MissedPayments", 0)
    bk = _get(df, "Bankruptcies", 0)
    dti = _get(df, "DebtToIncomeRatio", 0.0)
    cu = _get(df, "CreditUtilization", 0.0)
    nd = _get(df, "NumDependents", 2)
    emi = C.monthly_emi(ed)
    new: dict[str, Column] = {
        "RepaymentHistory_Ord": (C.repayment_ordinal("RepaymentHistory")
                                 if "RepaymentHistory" in cols
                                 else F.lit(K.REPAYMENT_UNKNOWN)),
        "MonthlyEMI_INR": emi,
        "EMI_to_Income": C.emi_to_income(emi, ai, "batch"),
        "SavingsToDebt": C.savings_to_debt(sb, ed, "batch"),
        "RiskScore": C.risk_score(mp, bk, dti, cu, clipped=False),
        "FamilyBurdenScore": C.family_burden(nd, clipped=False),
    }
    for c in K.BATCH_ZERO_DEFAULTS:
        if c not in cols:
            new[c] = F.lit(0)
    return _replace(df, new)


def _derive_live(df: DataFrame) -> DataFrame:
    """Live form: EMI = debt/36 when debt > 0; ratios with max(.,1) guards;
    risk and burden unclipped; Yes/No answers become 0/1."""
    cols = set(df.columns)
    debt = _get(df, "ExistingDebt_INR", 0.0)
    emi = F.when(debt > F.lit(0), debt / C.dlit(36.0)).otherwise(C.dlit(0.0))
    new: dict[str, Column] = {
        "RepaymentHistory_Ord": (C.repayment_ordinal("RepaymentHistory")
                                 if "RepaymentHistory" in cols
                                 else F.lit(K.REPAYMENT_UNKNOWN)),
        "MonthlyEMI_INR": emi,
        "RiskScore": C.risk_score(_get(df, "MissedPayments", 0), _get(df, "Bankruptcies", 0),
                                  _get(df, "DebtToIncomeRatio", 0.0),
                                  _get(df, "CreditUtilization", 0.0), clipped=False),
        "EMI_to_Income": C.emi_to_income(emi, _get(df, "AnnualIncome_INR", 0.0), "live"),
        "SavingsToDebt": C.savings_to_debt(_get(df, "SavingsBalance_INR", 0.0), debt, "live"),
        "FamilyBurdenScore": C.family_burden(_get(df, "NumDependents", 0), clipped=False),
    }
    for c in ["HasProperty", "HasVehicle", "HasCreditCard", "HasFinancialPlan",
              "IncomeShockLast3Yr", "AppBasedLoan"]:
        if c in cols and dict(df.dtypes)[c] == "string":
            new[c] = C.yes_no(c)
    return _replace(df, new)


def enrich(df: DataFrame) -> DataFrame:
    """Simulator-derived descriptive columns that need no aggregate: score band,
    age group, logs, heuristic probability (F8, F10, F12, F16); logs and the
    probability are rounded to 4 places as the reference stores them."""
    new: dict[str, Column] = {
        "CreditScoreBand": C.score_band("CreditScore"),
        "AgeGroup": C.age_group("Age"),
        "IncomeLog": C.round_half_up(C.log1p("AnnualIncome_INR"), 4),
        "ApprovalProbability": C.round_half_up(
            C.heuristic_probability("CreditScore", "LoanApproved"), 4),
    }
    if "LoanAmountSought" in df.columns:
        new["LoanAmountLog"] = C.round_half_up(C.log1p("LoanAmountSought"), 4)
    if "MarketingSegment" not in df.columns:
        new["MarketingSegment"] = C.marketing_segment("CreditScore")
    return _replace(df, new)


def prep_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """The model input in a fixed order; an absent column is 0, a null or
    NaN 0.
    One ``select``; ``keep`` columns are carried along unchanged."""
    present = set(df.columns)
    exprs = [(F.coalesce(C.no_nan(c), F.lit(0.0)) if c in present
              else F.lit(0.0)).alias(c) for c in features]
    return df.select(*[F.col(k) for k in keep if k not in features], *exprs)
