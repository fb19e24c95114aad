"""Edge rules of the scalar feature functions."""

import math

from pyspark.sql import functions as F

from loanlens.functions import columns as C
from loanlens.functions.derive import derive, prep_features


def one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_score_bands_edges(spark):
    got = one(spark, C.score_band("s"), [(300.0,), (300.5,), (500.0,), (500.1,), (900.0,),
                                         (901.0,), (None,)], "s double")
    assert got == [None, "Poor", "Poor", "Below Avg", "Exceptional", None, None]
    zones = one(spark, C.score_band("s", include_lowest=True), [(300.0,)], "s double")
    assert zones == ["Poor"]


def test_age_groups(spark):
    got = one(spark, C.age_group("a"), [(18,), (19,), (25,), (26,), (65,), (66,)], "a int")
    assert got == [None, "18-25", "18-25", "26-35", "56-65", None]


def test_clip_keeps_null(spark):
    got = one(spark, C.clip("x", 0.0, 1.0), [(None,), (-1.0,), (0.5,), (3.0,)], "x double")
    assert got == [None, 0.0, 0.5, 1.0]


def test_repayment_ordinal_unknown(spark):
    got = one(spark, C.repayment_ordinal("r"),
              [("Excellent",), ("Good",), ("Fair",), ("Poor",), ("Other",), (None,)], "r string")
    assert got == [4, 3, 2, 1, 2, 2]


def test_approval_rule_and_nulls(spark):
    rows = [(700.0, 0.1, 0, 4, 0), (600.0, 0.5, 1, 2, 0), (700.0, 0.1, 0, 4, 1),
            (None, None, 0, 3, 0)]
    got = one(spark, C.approval_rule("cs", "dti", "m", "o", "b"), rows,
              "cs double, dti double, m int, o int, b int")
    # 4 votes; 0 votes; 4-2=2 votes; nulls count as false: 0+0+1+1 = 2
    assert got == [1, 0, 1, 1]


def test_decision_thresholds(spark):
    got = one(spark, C.decision("p"), [(0.6,), (0.5999,), (0.4,), (0.3999,)], "p double")
    assert got == ["Approved", "Borderline", "Borderline", "Rejected"]


def test_yes_no_and_padded_id(spark):
    assert one(spark, C.yes_no("y"), [("Yes",), ("No",), (None,)], "y string") == [1, 0, None]
    assert one(spark, C.padded_id("n"), [(1,), (2000,)], "n long") == ["R0001", "R2000"]


def test_rounding(spark):
    assert one(spark, C.round_half_even("x", 0), [(2.5,), (3.5,)], "x double") == [2.0, 4.0]
    assert one(spark, C.round_half_up("x", 0), [(2.5,), (-0.0,)], "x double") == [3.0, 0.0]


def test_marketing_segment(spark):
    got = one(spark, C.marketing_segment("s"), [(740.0,), (739.0,), (620.0,), (619.0,)],
              "s double")
    assert got == ["Prime", "Emerging", "Emerging", "AtRisk"]


def test_derive_batch_defaults(spark):
    df = spark.createDataFrame([(100000.0, 3600.0, 0.0)],
                               "AnnualIncome_INR double, ExistingDebt_INR double, "
                               "SavingsBalance_INR double")
    r = derive(df, "batch").first()
    assert r["MonthlyEMI_INR"] == 100.0
    assert math.isclose(r["EMI_to_Income"], 100.0 / (100000.0 / 12 + 1))
    assert r["RepaymentHistory_Ord"] == 2
    assert r["FamilyBurdenScore"] == 2 * 0.15          # dependents default 2 for the burden
    assert r["NumDependents"] == 0                      # but 0 as a feature
    assert r["RiskScore"] == 0.0


def test_derive_live_income_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0, 5000.0, "Yes")],
                               "AnnualIncome_INR double, ExistingDebt_INR double, "
                               "SavingsBalance_INR double, HasProperty string")
    r = derive(df, "live").first()
    assert r["MonthlyEMI_INR"] == 0.0 and r["EMI_to_Income"] == 0.0
    assert r["SavingsToDebt"] == 5000.0 and r["HasProperty"] == 1


def test_derive_train_keeps_existing(spark):
    df = spark.createDataFrame([(1, 0, 0.5, 0.2, 1.23, 120000.0, 1000.0, 500.0, 2)],
                               "MissedPayments int, Bankruptcies int, DebtToIncomeRatio double, "
                               "CreditUtilization double, RiskScore double, "
                               "AnnualIncome_INR double, SavingsBalance_INR double, "
                               "ExistingDebt_INR double, NumDependents int")
    r = derive(df, "train").first()
    assert r["RiskScore"] == 1.23                      # present: kept
    assert r["EMI_to_Income"] == 0.0                   # MonthlyEMI absent: 0 / ...
    assert r["SavingsToDebt"] == 1000.0 / 501.0 and r["FamilyBurdenScore"] == 0.3


def test_prep_features_absent_and_null(spark):
    df = spark.createDataFrame([(None, 2)], "a double, b int")
    r = prep_features(df, ["a", "b", "c"]).first()
    assert (r["a"], r["b"], r["c"]) == (0.0, 2.0, 0.0)


def test_map_lookup_default(spark):
    got = one(spark, C.map_lookup("k", {0: "Prime", 1: "At-Risk"}, "Emerging"),
              [(0,), (1,), (7,)], "k int")
    assert got == ["Prime", "At-Risk", "Emerging"]
    assert one(spark, F.lit(1), [(0,)], "k int") == [1]
