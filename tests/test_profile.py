"""The profiling job's shared passes give what each operator gives by itself,
and read the table a few times only."""

import math

import pytest
from loanlens import constants as K
from loanlens.operators import clean, corr, distribution, histogram, sample, stats
from loanlens.plans.table_profile import Profile, profile_analyses
from loanlens.sources.customers import customers
from pyspark.sql import Window
from pyspark.sql import functions as F


def direct_analyses(df):
    """Every profiling analysis by its own operator over the rows."""
    have = lambda cols: [c for c in cols if c in df.columns]
    numeric, cats = have(K.EDA_NUMERIC), have(K.EDA_CATEGORICAL)
    out = {
        "kpis": lambda: stats.kpis(df),
        "quality_report": lambda: stats.quality_report(df, engineered=K.ENGINEERED),
        "null_counts": lambda: stats.null_counts(df),
        "summary_stats": lambda: stats.summary_stats(df, numeric),
        "shape_stats": lambda: stats.shape_stats(df, have(K.GRID_COLUMNS)),
        "histogram_grid": lambda: histogram.histogram_grid(df, have(K.GRID_COLUMNS), 30),
        "segment_shares": lambda: stats.value_shares(df, "MarketingSegment", None, base="all"),
        "segment_profile": lambda: stats.segment_profile(df),
        "corr_matrix": lambda: corr.corr_matrix(df, have(K.CORR_COLUMNS)),
        "corr_lower_triangle": lambda: corr.corr_matrix(df, have(K.CORR_COLUMNS), triangle=True),
        "pair_sample": lambda: sample.pair_table(df, have(K.PAIRPLOT_DEFAULTS)),
        "pair_diagonal": lambda: sample.pair_diagonal(df, have(K.PAIRPLOT_DEFAULTS)),
        "scatter_sample": lambda: sample.scatter_table(df, "AnnualIncome_INR", "CreditScore"),
        "linregress": lambda: corr.linregress_p(df, "AnnualIncome_INR", "CreditScore"),
        "outlier_report": lambda: clean.cap_outliers(df, numeric, 3.0)[1],
        "capped_table": lambda: clean.cap_outliers(df, numeric, 3.0)[0],
    }
    for group, cols in K.FEATURE_GROUPS.items():
        out[f"describe_{'_'.join(group.replace('&', ' ').split())}"] = (
            lambda cols=cols: stats.describe_group(df, have(cols)))
    for c in ("CreditScore", "LoanApproved"):
        out[f"corr_with_{c}"] = lambda c=c: corr.corr_with(df, have(K.CORR_COLUMNS), c)
        out[f"top_drivers_{c}"] = lambda c=c: corr.top_drivers(df, have(K.CORR_COLUMNS), c)
    for c in numeric:
        out[f"histogram_{c}"] = lambda c=c: histogram.histogram(df, c, 45)
        out[f"qq_points_{c}"] = lambda c=c: distribution.qq_points(df, c)
        out[f"qq_fit_{c}"] = lambda c=c: distribution.qq_fit(df, c)
        out[f"histogram_{c}_by_LoanApproved"] = lambda c=c: histogram.histogram_by(df, c, "LoanApproved", 40)
    for c in cats:
        out[f"value_counts_{c}"] = lambda c=c: stats.value_counts(df, c, 10)
        out[f"value_shares_{c}"] = lambda c=c: stats.value_shares(df, c, 10, base="kept")
        out[f"approval_rate_by_{c}"] = lambda c=c: stats.rate_by(df, c, "LoanApproved", 10)
        out[f"category_headline_{c}"] = lambda c=c: stats.category_headline(df, c)
        out[f"distinct_{c}"] = lambda c=c: stats.distinct_values(df, c)
    for c in have(K.BOX_NUMERIC):
        for g in have(K.BOX_GROUPS):
            out[f"box_{c}_by_{g}"] = lambda c=c, g=g: distribution.box_stats(df, g, c)
            out[f"box_fliers_{c}_by_{g}"] = lambda c=c, g=g: distribution.box_fliers(df, g, c)
            out[f"grouped_stats_{c}_by_{g}"] = lambda c=c, g=g: stats.grouped_stats(df, g, c)
            out[f"median_extremes_{c}_by_{g}"] = lambda c=c, g=g: stats.median_extremes(df, g, c)
    return out


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))
    return a == b


def rows(df):
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    return cols, sorted(got, key=lambda r: [(v is None, str(round(v, 6) if isinstance(v, float) else v)) for v in r])


def odd_table(base):
    """Null, NaN and constant columns, null groups, groups of one row, a group
    named "nan", repeated rows and a hot value."""
    odd = base.withColumn("__n", F.row_number().over(Window.orderBy("RespondentID")))
    hot = F.when(F.col("__n") % 3 == 0, F.lit(1000.0)).otherwise(F.col("AnnualIncome_INR"))
    odd = odd.withColumns({
        "AnnualIncome_INR": F.when(F.col("__n") % 7 == 0, F.lit(float("nan"))).when(F.col("__n") % 11 == 0, F.lit(None)).otherwise(hot),
        "RiskScore": F.lit(2.5), "FinLiteracyScore": F.lit(None).cast("double"),
        "CityTier": F.when(F.col("__n") % 5 == 0, F.lit(None)).when(F.col("__n") % 5 == 1, F.lit("nan"))
                     .when(F.col("__n") == 2, F.lit("one")).otherwise(F.col("CityTier")),
        "RepaymentHistory": F.when(F.col("__n") % 4 == 0, F.lit(None)).otherwise(F.col("RepaymentHistory")),
        "MarketingSegment": F.when(F.col("__n") % 9 == 0, F.lit(None)).otherwise(F.col("MarketingSegment"))})
    odd = odd.drop("__n")
    return odd.unionByName(odd.orderBy("RespondentID").limit(10))


def some_of(names):
    """All kinds of analyses, for a few columns."""
    for name in names:
        if name.startswith(("box_", "grouped_", "median_")):
            if "AnnualIncome_INR" in name and name.endswith(("CityTier", "RepaymentHistory", "LoanApproved")):
                yield name
        elif name.startswith(("histogram_", "qq_")) and name != "histogram_grid":
            if "AnnualIncome_INR" in name or "RiskScore" in name or "histogram_FinLiteracyScore" in name:
                yield name
        elif not name.startswith(("value_", "distinct_", "approval_", "category_", "describe_")) or name.endswith(
                ("CityTier", "MarketingSegment", "Income", "Debt")):
            yield name


def test_shared_passes_give_what_the_operators_give(spark, sf0001, tmp_path):
    odd_table(customers(spark, sf0001)).write.parquet(str(tmp_path / "odd"))
    df = spark.read.parquet(str(tmp_path / "odd"))
    shared, direct = profile_analyses(df), direct_analyses(df)
    assert set(shared) == set(direct)
    for name in some_of(direct):
        a, b = rows(shared[name]()), rows(direct[name]())
        assert a[0] == b[0], name
        assert len(a[1]) == len(b[1]) and all(same(x, y) for r, s in zip(a[1], b[1]) for x, y in zip(r, s)), (
            name, a[1][:3], b[1][:3])


def test_the_whole_job_reads_the_table_a_few_times(spark, sf0001):
    df = customers(spark, sf0001)
    profile = Profile(df)
    source = set(df.inputFiles())
    n_direct = 0
    for name, make in profile_analyses(df, profile).items():
        reads = bool(source & set(make().inputFiles()))
        n_direct += reads
        assert reads == (name in ("scatter_sample", "capped_table")), name
    assert set(profile.passes) == {"wide", "counts", "values", "pairs", "pair_sample", "scatter_sample", "linregress",
                                   "capped_table"}
    assert len(profile.passes) == 8


def test_a_pass_runs_only_for_what_is_asked(spark, sf0001):
    profile = Profile(customers(spark, sf0001))
    analyses = profile_analyses(profile.df, profile)
    analyses["value_counts_Persona"]()
    assert profile.passes == ["counts"]
    analyses["box_CreditScore_by_CityTier"]()
    analyses["qq_fit_CreditScore"]()
    assert profile.passes == ["counts", "values"]
