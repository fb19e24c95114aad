"""Box-plot statistics (A15) and the normal Q-Q table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions import columns as C
from loanlens.operators.quantiles import (NAME, expand_positions, global_positions,
                                          quantiles_wide, repeated, value_counts)
from loanlens.session import SMALL_ROWS, small_table


def _box_input(df: DataFrame, key: str, c: str) -> DataFrame:
    return (df.where(F.col(key).isNotNull())
            .select(F.col(key).cast("string").alias("group"), C.no_nan(c).alias("x"))
            .where(F.col("x").isNotNull()))


def box_fences(df: DataFrame, key: str, c: str, whis: float = 1.5) -> DataFrame:
    """Quartiles and whisker fences per group (exact, distributed)."""
    q = quantiles_wide(_box_input(df, key, c), ["x"], [0.25, 0.5, 0.75],
                       ["q1", "median", "q3"], by=["group"]).drop(NAME)
    iqr = F.col("q3") - F.col("q1")
    return q.select("group", "q1", "median", "q3",
                    (F.col("q1") - C.dlit(whis) * iqr).alias("lo_fence"),
                    (F.col("q3") + C.dlit(whis) * iqr).alias("hi_fence"))


def _with_fences(df: DataFrame, key: str, c: str, whis: float, small: int) -> DataFrame:
    """``(group, x, cnt, q1, median, q3, lo_fence, hi_fence)``. The fences, a
    row a group, are broadcast after a check of their number; the rows stay
    where they are (cnt 1). With more groups the rows are first counted by
    (group, value)."""
    data, fences = _box_input(df, key, c), box_fences(df, key, c, whis)
    known = small_table(fences, small)
    if known is not None:
        return data.withColumn("cnt", F.lit(1).cast("long")).join(known, "group")
    return value_counts(data, ["group"]).join(fences, "group")


def box_summary(fenced: DataFrame, keys: Sequence[str] = ("group",)) -> DataFrame:
    """Whiskers and number of fliers from values with counts and fences."""
    x, cnt = F.col("x"), F.col("cnt")
    inside_lo, inside_hi = x >= F.col("lo_fence"), x <= F.col("hi_fence")
    agg = fenced.groupBy(*keys, "q1", "median", "q3").agg(
        F.sum(cnt).alias("n"),
        F.min(F.when(inside_lo, x)).alias("whisker_lo"),
        F.max(F.when(inside_hi, x)).alias("whisker_hi"),
        F.sum(F.when(~inside_lo | ~inside_hi, cnt).otherwise(F.lit(0))).alias("n_fliers"))
    return agg.select(*keys, "n", "q1", "median", "q3",
                      F.coalesce("whisker_lo", "q1").alias("whisker_lo"),
                      F.coalesce("whisker_hi", "q3").alias("whisker_hi"), "n_fliers")


def box_stats(df: DataFrame, key: str, c: str, whis: float = 1.5, small: int = SMALL_ROWS) -> DataFrame:
    """Per group Q1, median, Q3, whiskers (most extreme data inside the
    1.5 IQR fences, as matplotlib draws them) and the number of fliers.
    ``small``: the number of groups up to which their fences are broadcast."""
    return box_summary(_with_fences(df, key, c, whis, small))


def outside(fenced: DataFrame) -> DataFrame:
    return fenced.where((F.col("x") < F.col("lo_fence")) | (F.col("x") > F.col("hi_fence")))


def box_fliers(df: DataFrame, key: str, c: str, whis: float = 1.5, small: int = SMALL_ROWS) -> DataFrame:
    """The flier points themselves ``(group, x)`` (a distributed filter)."""
    return repeated(outside(_with_fences(df, key, c, whis, small))).select("group", "x")


# --- FIXED VALUES: Acklam's rational approximation of the inverse normal CDF
# (published coefficients; absolute error below 1.15e-9 over (0, 1)).
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00]
_P_LOW = 0.02425


def _horner(coefs, x: Column, tail_one: bool = False) -> Column:
    acc = C.dlit(coefs[0])
    for k in coefs[1:]:
        acc = acc * x + C.dlit(k)
    return acc * x + C.dlit(1.0) if tail_one else acc


def norm_ppf(p) -> Column:
    """Inverse standard-normal CDF as a codegen-able ``Column`` expression."""
    p = C.col(p)
    q = p - C.dlit(0.5)
    r = q * q
    central = _horner(_A, r) * q / _horner(_B, r, tail_one=True)
    ql = F.sqrt(C.dlit(-2.0) * F.ln(p))
    lower = _horner(_C, ql) / _horner(_D, ql, tail_one=True)
    qu = F.sqrt(C.dlit(-2.0) * F.ln(C.dlit(1.0) - p))
    upper = -(_horner(_C, qu) / _horner(_D, qu, tail_one=True))
    return (F.when(p < C.dlit(_P_LOW), lower)
            .when(p > C.dlit(1.0 - _P_LOW), upper).otherwise(central))


def order_statistic_median(i: Column, n: Column) -> Column:
    """Filliben's uniform order-statistic medians for 0-based position i of n."""
    last = F.pow(C.dlit(0.5), C.dlit(1.0) / n.cast("double"))
    mid = ((i + 1).cast("double") - C.dlit(0.3175)) / (n.cast("double") + C.dlit(0.365))
    return (F.when(i == n - 1, last).when(i == 0, C.dlit(1.0) - last).otherwise(mid))


def qq_points(df: DataFrame, c: str) -> DataFrame:
    """``(i, p, theoretical, sample)`` for every non-null value: the
    i-th order statistic against the normal quantile of its Filliben
    median. Ranks come from the distributed cumulative counts; repeated
    values are expanded in bounded chunks."""
    pos, total = global_positions(df, c, with_totals=True)
    return points_of(pos, F.lit((total.first() or [0])[0] or 0).cast("long"))


def points_of(pos: DataFrame, n: Column) -> DataFrame:
    """Q-Q points of ``(x, cnt, before)``, ``n`` rows in all."""
    pts = expand_positions(pos).select(
        "i", order_statistic_median(F.col("i"), n).alias("p"), F.col("x").alias("sample"))
    return pts.select("i", "p", norm_ppf("p").alias("theoretical"), "sample")


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares slope, intercept and Pearson r of ``y`` on ``x`` over
    complete pairs. A constant side (exact min == max test) gives null
    slope/intercept (constant x) and null r, never an ANSI error."""
    both = df.select(C.no_nan(x).alias("x"), C.no_nan(y).alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    xd, yd = F.col("x"), F.col("y")
    m = both.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(yd, xd).alias("slope"), F.regr_intercept(yd, xd).alias("intercept"),
        F.try_divide(F.covar_pop(xd, yd), F.stddev_pop(xd) * F.stddev_pop(yd)).alias("r"),
        (F.min(xd) < F.max(xd)).alias("vx"), (F.min(yd) < F.max(yd)).alias("vy"))
    return m.select("n", F.when(F.col("vx"), F.col("slope")).alias("slope"),
                    F.when(F.col("vx"), F.col("intercept")).alias("intercept"),
                    F.when(F.col("vx") & F.col("vy"), F.col("r")).alias("r"))


def qq_fit(df: DataFrame, c: str) -> DataFrame:
    """A14 line: slope, intercept and r of sample on theoretical quantiles."""
    return fit_line(qq_points(df, c), "theoretical", "sample")
