"""Scalar feature functions as Spark ``Column`` expressions.

Everything here stays inside whole-stage codegen: no Python UDF. Helpers
accept a column name or a ``Column``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanlens import constants as K


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dlit(x: float) -> Column:
    """A DOUBLE literal (never a decimal), so arithmetic matches the SQL twin."""
    return F.lit(float(x))


def no_nan(c: str | Column) -> Column:
    """The value as a double, NaN as null (pandas reads both as missing)."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def clip(c: str | Column, lo: float | None = None, hi: float | None = None,
         nullable: bool = True) -> Column:
    """pandas ``clip``: null stays null. ``greatest``/``least`` skip nulls, so
    the null guard is required; ``nullable=False`` drops the guard for inputs
    that are non-null by construction (the expression then references its
    input once, which keeps deep feature chains small in generated code)."""
    x = col(c)
    out = x
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(x.isNotNull(), out) if nullable else out


def round_half_even(c: str | Column, scale: int = 0) -> Column:
    """numpy ``round`` (banker's rounding)."""
    return F.bround(col(c), scale)


def round_half_up(c: str | Column, scale: int = 0) -> Column:
    """Rounding written identically in Spark and DuckDB: floor(x*10^k + .5)/10^k."""
    m = float(10 ** scale)
    return F.floor(col(c) * F.lit(m) + F.lit(0.5)).cast("double") / F.lit(m)


def repayment_ordinal(c: str | Column) -> Column:
    """Excellent 4, Good 3, Fair 2, Poor 1, unknown/null 2."""
    x = col(c)
    expr = None
    for name, code in K.REPAYMENT_ORDINAL.items():
        expr = (F.when(x == name, F.lit(code)) if expr is None
                else expr.when(x == name, F.lit(code)))
    return expr.otherwise(F.lit(K.REPAYMENT_UNKNOWN)).cast("int")


def risk_score(missed, bankruptcies, dti, util, clipped: bool = True) -> Column:
    """F2: 0.25 missed + 0.40 bankruptcies + 0.20 dti + 0.15 util."""
    raw = (col(missed) * dlit(0.25) + col(bankruptcies) * dlit(0.40)
           + col(dti) * dlit(0.20) + col(util) * dlit(0.15))
    return clip(raw, 0.0, 3.0) if clipped else raw


def monthly_emi(debt, term=None) -> Column:
    """debt / term, term 0 or absent -> 36."""
    if term is None:
        return col(debt) / dlit(36.0)
    t = col(term)
    return col(debt) / F.when((t == 0) | t.isNull(), dlit(36.0)).otherwise(t.cast("double"))


def emi_to_income(emi, income, mode: str = "train") -> Column:
    """train: clip(emi/(income/12+1), 0, 3); batch: unclipped;
    live: emi / max(income/12, 1)."""
    if mode == "live":
        return col(emi) / F.greatest(col(income) / dlit(12.0), dlit(1.0))
    raw = col(emi) / (col(income) / dlit(12.0) + dlit(1.0))
    return clip(raw, 0.0, 3.0) if mode == "train" else raw


def savings_to_debt(savings, debt, mode: str = "train") -> Column:
    """train: clip(s/(d+1), 0, 50); batch unclipped; live s/max(d,1)."""
    if mode == "live":
        return col(savings) / F.greatest(col(debt), dlit(1.0))
    raw = col(savings) / (col(debt) + dlit(1.0))
    return clip(raw, 0.0, 50.0) if mode == "train" else raw


def family_burden(dependents, clipped: bool = True) -> Column:
    """0.15 dependents, clip 0-1.5 on the load path."""
    raw = col(dependents) * dlit(0.15)
    return clip(raw, 0.0, 1.5) if clipped else raw


def log1p(c) -> Column:
    """F8."""
    return F.log1p(col(c))


def fixed_bins(c, edges: Sequence[float], labels: Sequence[str],
               include_lowest: bool = False) -> Column:
    """pandas ``cut`` with right-closed intervals (lo, hi]; values at
    or below the first edge (unless ``include_lowest``) and above the last are
    null. Not ``Bucketizer``: that one is [lo, hi)."""
    x = col(c)
    below = (x < F.lit(edges[0])) if include_lowest else (x <= F.lit(edges[0]))
    expr = F.when(below | (x > F.lit(edges[-1])), F.lit(None).cast("string"))
    for label, hi in zip(labels, edges[1:]):
        expr = expr.when(x <= F.lit(hi), F.lit(label))
    return expr


def score_band(c, include_lowest: bool = False) -> Column:
    return fixed_bins(c, K.SCORE_BAND_EDGES, K.SCORE_BAND_LABELS, include_lowest)


def age_group(c) -> Column:
    return fixed_bins(c, K.AGE_GROUP_EDGES, K.AGE_GROUP_LABELS)


def quartile_label(c, q1: Column, q2: Column, q3: Column, lo: Column) -> Column:
    """pandas ``qcut(x, 4)`` given the interpolated quartiles and the
    minimum: (lo, q1] with the minimum included, (q1, q2], (q2, q3], (q3, max]."""
    x = col(c)
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(x <= q1, F.lit("Q1"))
            .when(x <= q2, F.lit("Q2"))
            .when(x <= q3, F.lit("Q3"))
            .otherwise(F.lit("Q4")))


def marketing_segment(score) -> Column:
    """>=740 Prime, >=620 Emerging, else AtRisk."""
    s = col(score)
    return (F.when(s >= F.lit(K.MARKETING_PRIME_MIN), F.lit("Prime"))
            .when(s >= F.lit(K.MARKETING_EMERGING_MIN), F.lit("Emerging"))
            .otherwise(F.lit("AtRisk")))


def scorecard_raw(ordinal, util, missed, bankruptcies, hist_years, literacy,
                  has_property, savings_pct, dti) -> Column:
    """F14 before clipping/rounding (the simulator's noise term is dropped)."""
    return (dlit(600.0)
            + (col(ordinal) - F.lit(2)) * dlit(30.0)
            + (dlit(1.0) - col(util)) * dlit(80.0)
            - col(missed) * dlit(40.0)
            - col(bankruptcies) * dlit(80.0)
            + col(hist_years) * dlit(3.0)
            + col(literacy) * dlit(5.0)
            + col(has_property) * dlit(20.0)
            + (col(savings_pct) - dlit(15.0)) * dlit(1.5)
            - col(dti) * dlit(50.0))


def credit_score(ordinal, util, missed, bankruptcies, hist_years, literacy,
                 has_property, savings_pct, dti, rounding: str = "half_up",
                 nullable: bool = True) -> Column:
    """scorecard clipped to 300-900 and rounded to a whole number."""
    clipped = clip(scorecard_raw(ordinal, util, missed, bankruptcies, hist_years,
                                 literacy, has_property, savings_pct, dti), 300.0, 900.0,
                   nullable=nullable)
    if rounding == "half_even":
        return round_half_even(clipped, 0).cast("double")
    return F.floor(clipped + dlit(0.5)).cast("double")


def approval_rule(score, dti, missed, ordinal, bankruptcies) -> Column:
    """votes (cs>=650)+(dti<.4)+(missed=0)+(ord>=3)-2(bankr>0) >= 2.
    A comparison with a null input counts as false, as in numpy."""
    def vote(cond: Column) -> Column:
        return F.when(cond, F.lit(1)).otherwise(F.lit(0))
    votes = (vote(col(score) >= F.lit(650)) + vote(col(dti) < dlit(0.4))
             + vote(col(missed) == F.lit(0)) + vote(col(ordinal) >= F.lit(3))
             - vote(col(bankruptcies) > F.lit(0)) * F.lit(2))
    return vote(votes >= F.lit(2)).cast("int")


def heuristic_probability(score, approved) -> Column:
    """F16: clip(0.8 (cs-300)/600 + 0.2 approved, 0, 1)."""
    return clip((col(score) - dlit(300.0)) / dlit(600.0) * dlit(0.8)
                + col(approved) * dlit(0.2), 0.0, 1.0)


def yes_no(c) -> Column:
    """"Yes" -> 1, anything else -> 0."""
    return (col(c) == F.lit("Yes")).cast("int")


def padded_id(n, prefix: str = "R", width: int = 4) -> Column:
    """R0001."""
    return F.format_string(f"{prefix}%0{width}d", col(n).cast("long"))


def skew_verdict(s) -> Column:
    """F21 (skewness part)."""
    x = col(s)
    return (F.when(x > dlit(0.5), F.lit("right-skewed"))
            .when(x < dlit(-0.5), F.lit("left-skewed"))
            .otherwise(F.lit("approx normal")))


def kurtosis_verdict(k) -> Column:
    """F21 (kurtosis part)."""
    x = col(k)
    return (F.when(x > dlit(1.0), F.lit("heavy tails"))
            .when(x < dlit(-1.0), F.lit("thin tails"))
            .otherwise(F.lit("normal tails")))


def rate_band(rate) -> Column:
    """approval-rate band (>=50 high, >=30 mid, else low)."""
    x = col(rate)
    return (F.when(x >= F.lit(50), F.lit("high"))
            .when(x >= F.lit(30), F.lit("mid")).otherwise(F.lit("low")))


def importance_band(v) -> Column:
    """importance band (>.05 high, >.02 mid, else low)."""
    x = col(v)
    return (F.when(x > dlit(0.05), F.lit("high"))
            .when(x > dlit(0.02), F.lit("mid")).otherwise(F.lit("low")))


def sign_band(v) -> Column:
    """sign of a correlation or coefficient."""
    return F.when(col(v) < F.lit(0), F.lit("negative")).otherwise(F.lit("positive"))


def decision(prob) -> Column:
    """>=0.60 Approved, >=0.40 Borderline, else Rejected."""
    p = col(prob)
    return (F.when(p >= dlit(K.APPROVE_MIN), F.lit("Approved"))
            .when(p >= dlit(K.BORDERLINE_MIN), F.lit("Borderline"))
            .otherwise(F.lit("Rejected")))


def soft_vote(gb, rf, lr) -> Column:
    """0.5 gb + 0.3 rf + 0.2 lr."""
    w = K.VOTE_WEIGHTS
    return col(gb) * dlit(w["gb"]) + col(rf) * dlit(w["rf"]) + col(lr) * dlit(w["lr"])


def map_lookup(c, mapping: dict, default) -> Column:
    """J1 for a handful of fixed keys: a literal map, looked up per row."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(m, col(c)), F.lit(default))
