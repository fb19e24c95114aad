"""Aggregations and statistics. Each operator is one
``DataFrame -> DataFrame`` function; results are small tables bounded by the
number of columns, groups or ``n``, never by rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens import constants as K
from loanlens.functions import columns as C
from loanlens.operators.clean import nan_to_null, outlier_fences
from loanlens.operators.quantiles import NAME, long_values, quantiles_wide


def kpis(df: DataFrame, target: str = "LoanApproved", score: str = "CreditScore",
         segment: str = "MarketingSegment") -> DataFrame:
    """A1: rows, columns, approval rate %, mean score, Prime count (one scan)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        (F.avg(F.col(target).cast("double")) * C.dlit(100)).alias("approval_rate_pct"),
        F.avg(F.col(score).cast("double")).alias("mean_score"),
        F.count_if(F.col(segment) == "Prime").alias("n_prime"),
    )


def quality_report(df: DataFrame, key: str = "RespondentID",
                   engineered: Sequence[str] = (), encoded_suffix: str = "_Enc",
                   capped: Sequence[str] = (), k: float = 3.0) -> DataFrame:
    """A2: total null cells, duplicate ids, cells of the ``capped`` columns
    beyond their k x IQR fences, engineered and encoded column counts
    (computed, not hard-coded). One aggregate over the table, after the fences
    (two values per column)."""
    df = nan_to_null(df)
    fences = {r[NAME]: r for r in outlier_fences(df, capped, k).collect()} if capped else {}
    beyond = sum((F.coalesce((F.col(c) < C.dlit(f["lower"])) | (F.col(c) > C.dlit(f["upper"])), F.lit(False))
                  .cast("long") for c, f in fences.items()), F.lit(0).cast("long"))
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(nulls).alias("null_cells"),
        F.sum(beyond).alias("capped_cells"),
        (F.count(F.lit(1)) - F.count_distinct(F.col(key))).alias("duplicate_ids"),
    ).select("*",
             F.lit(len([c for c in engineered if c in df.columns])).cast("long")
             .alias("engineered_columns"),
             F.lit(len([c for c in df.columns if c.endswith(encoded_suffix)])).cast("long")
             .alias("encoded_columns"))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per-column null counts as a long table ``(column, n_null)``."""
    cols = list(cols or df.columns)
    wide = nan_to_null(df, cols).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS ({NAME}, n_null)")


def summary_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A3: mean, median (exact), sample std per column, nulls dropped."""
    base = _moments(df, cols, ["mean", "std"])
    med = quantiles_wide(df, cols, [0.5], ["median"])
    return base.join(med, NAME, "left").select(NAME, "n", "mean", "median", "std")


def _moments(df: DataFrame, cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``(feature, n, <names>)``: one wide aggregate over the rows as they are
    (no row per column), then one row per column."""
    cols = list(cols)
    made = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.select(*[C.no_nan(c).alias(c) for c in cols]).agg(
        *[made[m](F.col(c)).alias(f"{c}__{m}") for c in cols for m in ("n", *names)])
    rows = ", ".join(f"'{c}', " + ", ".join(f"`{c}__{m}`" for m in ("n", *names)) for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {rows}) AS ({NAME}, n, {', '.join(names)})") \
               .where("n > 0")


def describe_group(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """A4: pandas ``describe().round(2).T`` for a feature group: count, mean,
    std, min, 25/50/75 %, max, one row per numeric column (exact percentiles)."""
    numeric = [c for c in cols if c in df.columns and _is_numeric(df, c)]
    m = _moments(df, numeric, ["mean", "std", "min", "max"])
    q = quantiles_wide(df, numeric, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    r = lambda c: C.round_half_up(c, digits).alias(c)
    return m.join(q, NAME, "left").select(
        NAME, F.col("n").alias("count"), r("mean"), r("std"), r("min"), r("p25"), r("p50"),
        r("p75"), r("max"))


def _is_numeric(df: DataFrame, c: str) -> bool:
    from pyspark.sql.types import NumericType
    return isinstance(df.schema[c].dataType, NumericType)


def value_counts(df: DataFrame, c: str, n: int | None = None) -> DataFrame:
    """A5: counts per value, descending (value as tie-break), nulls excluded
    (Spark would keep a null group; pandas does not)."""
    out = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("count"))
    out = out.orderBy(F.desc("count"), F.asc(c))
    return out.limit(n) if n else out


def value_shares(df: DataFrame, c: str, n: int | None = None, base: str = "kept") -> DataFrame:
    """Share % of each value. ``base="kept"`` divides by the kept top-n
    (the pie); ``base="all"`` by all rows of the table."""
    vc = value_counts(df, c, n)
    if base == "all":
        total = df.agg(F.count(F.lit(1))).scalar()
    else:
        total = vc.agg(F.sum("count")).scalar()
    return vc.select(c, "count", (F.col("count") * C.dlit(100) / total).alias("share_pct"))


def rate_by(df: DataFrame, c: str, target: str = "LoanApproved", n: int | None = 10) -> DataFrame:
    """A7 + F22: mean of ``target`` x 100 per value of ``c`` with its rate band,
    descending, top ``n``."""
    out = (df.where(F.col(c).isNotNull()).groupBy(c)
           .agg((F.avg(F.col(target).cast("double")) * C.dlit(100)).alias("rate_pct"),
                F.count(F.lit(1)).alias("n"))
           .withColumn("band", C.rate_band("rate_pct")))
    out = out.orderBy(F.desc("rate_pct"), F.asc(c))
    return out.limit(n) if n else out


def string_key(c: str) -> F.Column:
    """pandas ``astype(str)`` of a key: null becomes the group "nan"."""
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def grouped_stats(df: DataFrame, key: str, c: str, digits: int = 2) -> DataFrame:
    """Mean, median, sample std, min, max of ``c`` per string-cast ``key``
    (nulls form the group "nan"), rounded."""
    keyed = df.select(string_key(key).alias("group"), C.no_nan(c).alias(c))
    agg = keyed.groupBy("group").agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                                     F.min(F.col(c).cast("double")).alias("min"),
                                     F.max(F.col(c).cast("double")).alias("max"))
    med = quantiles_wide(keyed, [c], [0.5], ["median"], by=["group"]).drop(NAME)
    r = lambda x: C.round_half_up(x, digits).alias(x)
    return agg.join(med, "group", "left").select("group", r("mean"), r("median"), r("std"),
                                                 r("min"), r("max"))


def group_medians(df: DataFrame, key: str, c: str) -> DataFrame:
    """Median of ``c`` per non-null ``key`` (as string)."""
    keyed = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("group"),
                                                    F.col(c))
    return quantiles_wide(keyed, [c], [0.5], ["median"], by=["group"]).drop(NAME)


def median_extremes(df: DataFrame, key: str, c: str) -> DataFrame:
    """The group with the highest and the lowest median (ties -> smallest key)."""
    return extremes_of(group_medians(df, key, c))


def extremes_of(medians: DataFrame) -> DataFrame:
    """The extremes of ``(group, median)``."""
    return medians.where(F.col("median").isNotNull()).agg(
        F.min_by("group", F.struct(-F.col("median"), F.col("group"))).alias("top_group"),
        F.max("median").alias("top_median"),
        F.min_by("group", F.struct(F.col("median"), F.col("group"))).alias("bottom_group"),
        F.min("median").alias("bottom_median"))


def shape_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A10 + F21: population skewness and excess kurtosis, with verdicts."""
    # One row per column: an aggregate of all columns side by side is one method
    # too long for the JVM to compile.
    m = long_values(df, cols).groupBy(NAME).agg(
        F.count("x").alias("n"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"))
    return verdicts_of(m)


def verdicts_of(m: DataFrame) -> DataFrame:
    """The verdicts on ``(feature, n, skew, kurt)``."""
    return m.select(NAME, "n", F.col("skew").alias("skewness"), F.col("kurt").alias("kurtosis"),
                    C.skew_verdict("skew").alias("skew_shape"),
                    C.kurtosis_verdict("kurt").alias("tail_shape"))


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    """Sorted distinct non-null values."""
    return df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)


def category_headline(df: DataFrame, c: str, target: str = "LoanApproved") -> DataFrame:
    """Most common value with its share of all rows, and the value with
    the best approval rate."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = (df.where(F.col(c).isNotNull()).groupBy(c)
              .agg(F.count(F.lit(1)).alias("cnt"),
                   (F.avg(F.col(target).cast("double")) * C.dlit(100)).alias("rate")))
    return headline_of(counts, c, total)


def headline_of(counts: DataFrame, c: str, total) -> DataFrame:
    """The headline from ``(c, cnt, rate)`` and the number of all rows."""
    head = counts.agg(
        F.min_by(c, F.struct(-F.col("cnt"), F.col(c))).alias("top_value"),
        F.max("cnt").alias("top_count"),
        F.min_by(c, F.struct(-F.col("rate"), F.col(c))).alias("best_rate_value"),
        F.max("rate").alias("best_rate_pct"))
    return head.select(
        "top_value", "top_count",
        (F.col("top_count") * C.dlit(100) / total).alias("top_share_pct"),
        "best_rate_value", "best_rate_pct")


def segment_profile(df: DataFrame, label: str = "MarketingSegment",
                    metrics: Sequence[str] = tuple(K.PROFILE_METRICS),
                    target: str = "LoanApproved") -> DataFrame:
    """Mean of the profile metrics (round 2) and approval % (round 1) per
    segment, ordered Prime, Emerging, Rebuilder, At-Risk, then others."""
    present = [m for m in metrics if m in df.columns]
    order = F.coalesce(
        F.array_position(F.array(*[F.lit(s) for s in K.CLUSTER_NAMES + ["AtRisk"]]),
                         F.col(label)), F.lit(99))
    agg = df.groupBy(label).agg(
        *[C.round_half_up(F.avg(C.no_nan(m)), 2).alias(m) for m in present],
        C.round_half_up(F.avg(F.col(target).cast("double")) * C.dlit(100), 1)
        .alias("Approval_pct"),
        F.count(F.lit(1)).alias("n"))
    return agg.withColumn("seg_order", order.cast("int")).orderBy("seg_order", label)


def batch_summary(scored: DataFrame) -> DataFrame:
    """Scored / approved / borderline / rejected counts and mean score."""
    d = F.col("Loan_Decision")
    return scored.agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if(d == "Approved").alias("approved"),
        F.count_if(d == "Borderline").alias("borderline"),
        F.count_if(d == "Rejected").alias("rejected"),
        F.avg(F.col("Predicted_CreditScore").cast("double")).alias("mean_score"))


def rank_groups(df: DataFrame, by_value: str, names: Sequence[str], key: str) -> DataFrame:
    """K5: order a small per-group table by ``by_value`` descending and give
    the i-th group the i-th name (row_number over at most k rows)."""
    w = Window.orderBy(F.desc(by_value), F.asc(key))
    arr = F.array(*[F.lit(n) for n in names])
    return df.withColumn("rank", F.row_number().over(w)).withColumn(
        "label", F.try_element_at(arr, F.col("rank").cast("int")))
