"""The profiling analyses of one table from a few shared passes.

``counts``: one GROUPING SETS aggregate counts the rows and approvals of every
category of every group column.

``values``: one range-partitioned pass ranks the values of all (group column,
group, numeric column) triples: distinct values with their counts and the number
of rows before them. Quantiles, moments, box plots, fliers, histograms, Q-Q
points and outlier counts of all columns and groups come from that stored table
and not from the rows.

``wide``: one aggregate for the table-wide counts; ``pairs``: one pass for all
correlations. The two samples and the capped table read the rows once each.

A pass runs when the first analysis asks for it. ``passes`` lists those that
have read the table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens import constants as K
from loanlens.functions import columns as C
from loanlens.operators import clean, corr, distribution, histogram, sample, stats
from loanlens.operators.clean import nan_to_null, numeric_cols
from loanlens.operators.quantiles import NAME, cumulative_before, quantiles_at, repeated
from loanlens.session import materialize, small_table

#: Keys of a distribution: the group column ("" for the whole table), the
#: group, the numeric column.
KEYS = ("by", "key", NAME)
TARGET, SCORE, LABEL = "LoanApproved", "CreditScore", "MarketingSegment"
WHISKERS, CAPPED = 1.5, 3.0


def bounded(df: DataFrame) -> DataFrame:
    """A small result as a local table; a checkpoint where the data have more
    groups than may be broadcast."""
    local = small_table(df)
    return materialize(df) if local is None else local


def with_keys(values: DataFrame, known: DataFrame) -> DataFrame:
    """``values`` with the columns of ``known`` for their keys."""
    other = known.select(*[F.col(k).alias(f"_{k}") for k in KEYS], *[c for c in known.columns if c not in KEYS])
    cond = F.lit(True)
    for k in KEYS:
        cond = cond & values[k].eqNullSafe(F.col(f"_{k}"))
    return values.join(other, cond).drop(*[f"_{k}" for k in KEYS])


class Profile:
    """Shared passes over ``df`` (the analysis base)."""

    def __init__(self, df: DataFrame, key: str = "RespondentID"):
        self.df, self.key, self.passes = df, key, []
        have = lambda cols: [c for c in cols if c in df.columns]
        numbers = set(numeric_cols(df))
        self.numeric, self.categories = have(K.EDA_NUMERIC), have(K.EDA_CATEGORICAL)
        self.grid, self.corr_columns = have(K.GRID_COLUMNS), have(K.CORR_COLUMNS)
        self.box_numeric, self.box_groups = have(K.BOX_NUMERIC), have(K.BOX_GROUPS)
        self.metrics, self.pair_columns = have(K.PROFILE_METRICS), have(K.PAIRPLOT_DEFAULTS)
        self.described = {group: [c for c in have(cols) if c in numbers] for group, cols in K.FEATURE_GROUPS.items()}
        self.whole = list(dict.fromkeys([*self.numeric, *self.grid, *self.corr_columns,
                                         *[c for cols in self.described.values() for c in cols]]))
        #: Numeric columns by group column.
        self.by = {g: list(self.box_numeric) for g in self.box_groups}
        for g, cols in ((TARGET, self.numeric), (LABEL, self.metrics)):
            if g in df.columns:
                self.by[g] = list(dict.fromkeys([*self.by.get(g, []), *cols]))

    def read(self, name: str) -> DataFrame:
        """The table, for the pass ``name``."""
        self.passes.append(name)
        return self.df

    # --------------------------------------------------------- the passes ---
    @cached_property
    def wide(self) -> dict:
        """Row, null, score, approval and duplicate counts in one aggregate."""
        df = nan_to_null(self.read("wide"))
        n = F.count(F.lit(1))
        return df.agg(
            n.alias("n_rows"), (F.avg(F.col(TARGET).cast("double")) * C.dlit(100)).alias("approval_rate_pct"),
            F.avg(F.col(SCORE).cast("double")).alias("mean_score"), F.count_if(F.col(LABEL) == "Prime").alias("n_prime"),
            (n - F.count_distinct(F.col(self.key))).alias("duplicate_ids"),
            *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]).first().asDict()

    @cached_property
    def counts(self) -> DataFrame:
        """``(by, key, n, n_target, rate)`` of each category of each group
        column, null among them: one GROUPING SETS aggregate."""
        groups = list(dict.fromkeys([*self.categories, *self.by]))
        keyed = self.read("counts").select(*[F.col(g).cast("string").alias(g) for g in groups],
                                           F.col(TARGET).cast("double").alias("__target"))
        sets = keyed.groupingSets([[F.col(g)] for g in groups], *[F.col(g) for g in groups])
        out = sets.agg(F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("n"),
                       F.avg("__target").alias("rate"))
        # A group column's bit is 0 in the set that it forms.
        everything = (1 << len(groups)) - 1
        place = {g: everything - (1 << (len(groups) - 1 - k)) for k, g in enumerate(groups)}
        by, key = F.lit(None).cast("string"), F.lit(None).cast("string")
        for g, number in place.items():
            by = F.when(F.col("__set") == number, F.lit(g)).otherwise(by)
            key = F.when(F.col("__set") == number, F.col(g)).otherwise(key)
        return bounded(out.select(by.alias("by"), key.alias("key"), "n", "rate"))

    @cached_property
    def values(self) -> DataFrame:
        """``(by, key, feature, x, cnt, before)``: the ranked distinct values."""
        df = self.read("values")
        cells = F.array(*[F.struct(F.lit(c).alias(NAME), C.no_nan(c).alias("x")) for c in self.whole])
        long = df.select(*[F.col(g).cast("string").alias(f"__{g}") for g in self.by], F.explode(cells).alias("cell"))
        long = long.select(*[f"__{g}" for g in self.by], "cell.*").where(F.col("x").isNotNull())
        sets = [F.struct(F.lit("").alias("by"), F.lit(None).cast("string").alias("key"))]
        sets += [F.when(F.col(NAME).isin(cols), F.struct(F.lit(g).alias("by"), F.col(f"__{g}").alias("key")))
                 for g, cols in self.by.items()]
        keyed = long.select(NAME, "x", F.explode(F.array_compact(F.array(*sets))).alias("s")).select("s.*", NAME, "x")
        counted = keyed.groupBy(*KEYS, "x").agg(F.count(F.lit(1)).alias("cnt"))
        return materialize(cumulative_before(counted, KEYS, ["x"]))

    @cached_property
    def pairs(self) -> DataFrame:
        """``pair_moments`` of the correlation columns' lower half."""
        centres = {r[NAME]: r["mean"] for r in self.moments.where("by = ''").collect()}
        return materialize(corr.pair_moments(self.read("pairs"), corr.lower_pairs(self.corr_columns), centres))

    @cached_property
    def pair_rows(self) -> DataFrame:
        return bounded(sample.pair_table(self.read("pair_sample"), self.pair_columns))

    # ------------------------------------------------ from the shared tables ---
    @cached_property
    def moments(self) -> DataFrame:
        """``(by, key, feature, n, mean, std, min, max, skew, kurt)``, the
        powers about the mean."""
        n, x, cnt = F.col("n"), F.col("x"), F.col("cnt")
        first = bounded(self.values.groupBy(*KEYS).agg(
            F.sum(cnt).alias("n"), (F.sum(x * cnt) / F.sum(cnt)).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max")))
        d = F.when(F.col("min") == F.col("max"), C.dlit(0)).otherwise(x - F.col("mean"))
        powers = with_keys(self.values, first).groupBy(*KEYS, "n", "mean", "min", "max").agg(
            *[F.sum(F.pow(d, F.lit(k)) * cnt).alias(f"m{k}") for k in (2, 3, 4)])
        m2 = F.when(F.col("m2") > 0, F.col("m2"))
        return bounded(powers.select(
            *KEYS, "n", F.when(F.col("min") == F.col("max"), F.col("min")).otherwise(F.col("mean")).alias("mean"),
            F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"), "min", "max",
            (F.sqrt(n.cast("double")) * F.col("m3") / F.pow(m2, F.lit(1.5))).alias("skew"),
            (n * F.col("m4") / (m2 * m2) - C.dlit(3)).alias("kurt")))

    @cached_property
    def quantiles(self) -> DataFrame:
        """``(by, key, feature, q1, median, q3)`` of all distributions."""
        q = quantiles_at(self.values, self.moments.select(*KEYS, "n"), KEYS, [0.25, 0.5, 0.75])
        at = lambda p: F.max(F.when(F.col("p") == F.lit(p), F.col("value")))
        return bounded(q.groupBy(*KEYS).agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3")))

    def fenced(self, k: float) -> DataFrame:
        iqr = F.col("q3") - F.col("q1")
        fences = self.quantiles.select("*", (F.col("q1") - C.dlit(k) * iqr).alias("lo_fence"),
                                       (F.col("q3") + C.dlit(k) * iqr).alias("hi_fence"))
        return with_keys(self.values, F.broadcast(fences) if small_table(fences) is not None else fences)

    @cached_property
    def boxes(self) -> DataFrame:
        groups = self.fenced(WHISKERS).where((F.col("by") != "") & F.col("key").isNotNull())
        return bounded(distribution.box_summary(groups, KEYS))

    @cached_property
    def fliers(self) -> DataFrame:
        groups = self.fenced(WHISKERS).where((F.col("by") != "") & F.col("key").isNotNull())
        return materialize(distribution.outside(groups).select(*KEYS, "x", "cnt"))

    @cached_property
    def histograms(self) -> dict[int, DataFrame]:
        """By number of bins: 45 for the columns, 30 for the grid, 40 by the
        target; ``(by, key, feature, bin, bin_lo, bin_hi, count)``."""
        ranges = self.moments.select(*KEYS, *[c.alias(a) for c, a in zip(
            histogram.value_range(F.col("min"), F.col("max")), ("lo", "hi"))])
        out = {}
        for bins, of in ((45, F.col("by") == ""), (30, (F.col("by") == "") & F.col(NAME).isin(self.grid)),
                         (40, (F.col("by") == TARGET) & F.col("key").isNotNull())):
            some = ranges.where(of)
            idx = histogram.bin_index(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")
            counts = (with_keys(self.values.where(of), some).groupBy(*KEYS, idx)
                      .agg(F.sum("cnt").alias("count")))
            known = some.withColumn("key", F.coalesce("key", F.lit("")))
            filled = histogram.filled(known, counts.withColumn("key", F.coalesce("key", F.lit(""))), KEYS, bins)
            out[bins] = bounded(filled)
        return out

    # ------------------------------------------------------- the analyses ---
    def of(self, table: DataFrame, by: str = "", features=None) -> DataFrame:
        """Rows of a shared table: one group column (null groups left out), and
        the given numeric columns."""
        out = table.where(F.col("by") == by)
        if by:
            out = out.where(F.col("key").isNotNull())
        return out if features is None else out.where(F.col(NAME).isin(list(features)))

    def category(self, c: str) -> DataFrame:
        """``(c, cnt, rate)``: counts and approval rate (%) of the categories."""
        typed = F.col("key").cast(self.df.schema[c].dataType).alias(c)
        return (self.of(self.counts, c).select(typed, F.col("n").alias("cnt"),
                                               (F.col("rate") * C.dlit(100)).alias("rate")))

    def kpis(self) -> DataFrame:
        w = self.wide
        return self.df.sparkSession.createDataFrame(
            [(w["n_rows"], len(self.df.columns), w["approval_rate_pct"], w["mean_score"], w["n_prime"])],
            "n_rows long, n_columns long, approval_rate_pct double, mean_score double, n_prime long")

    def quality_report(self) -> DataFrame:
        w, names = self.wide, self.df.columns
        return self.df.sparkSession.createDataFrame(
            [(w["n_rows"], sum(w[f"null_{c}"] for c in names), 0, w["duplicate_ids"],
              sum(c in names for c in K.ENGINEERED), sum(c.endswith("_Enc") for c in names))],
            "n_rows long, null_cells long, capped_cells long, duplicate_ids long, engineered_columns long, "
            "encoded_columns long")

    def null_counts(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame([(c, self.wide[f"null_{c}"]) for c in self.df.columns],
                                                    f"{NAME} string, n_null long")

    def described_columns(self, cols) -> DataFrame:
        return (self.of(self.moments, "", cols).drop("by", "key")
                .join(self.of(self.quantiles, "", cols).drop("by", "key"), NAME))

    def summary_stats(self) -> DataFrame:
        return self.described_columns(self.numeric).select(NAME, "n", "mean", "median", "std")

    def describe(self, group: str) -> DataFrame:
        r = lambda c, out: C.round_half_up(c, 2).alias(out)
        return self.described_columns(self.described[group]).select(
            NAME, F.col("n").alias("count"), r("mean", "mean"), r("std", "std"), r("min", "min"), r("q1", "p25"),
            r("median", "p50"), r("q3", "p75"), r("max", "max"))

    def shape_stats(self) -> DataFrame:
        return stats.verdicts_of(self.of(self.moments, "", self.grid))

    def histogram_grid(self) -> DataFrame:
        more = self.of(self.moments, "", self.grid).select(NAME, "mean", "skew")
        return self.histograms[30].drop("by", "key").join(more, NAME)

    def histogram(self, c: str) -> DataFrame:
        return self.histograms[45].where(F.col(NAME) == c).drop(*KEYS)

    def histogram_by_target(self, c: str) -> DataFrame:
        typed = F.col("key").cast(self.df.schema[TARGET].dataType).alias(TARGET)
        return self.histograms[40].where(F.col(NAME) == c).select(typed, "bin", "bin_lo", "bin_hi", "count")

    def qq_points(self, c: str) -> DataFrame:
        n = next((r["n"] for r in self.of(self.moments, "", [c]).collect()), 0)
        pos = self.of(self.values, "", [c]).select("x", "cnt", "before")
        return distribution.points_of(pos, F.lit(n).cast("long"))

    def qq_fit(self, c: str) -> DataFrame:
        return distribution.fit_line(self.qq_points(c), "theoretical", "sample")

    def value_counts(self, c: str, n: int | None = 10) -> DataFrame:
        out = self.category(c).select(c, F.col("cnt").alias("count")).orderBy(F.desc("count"), F.asc(c))
        return out.limit(n) if n else out

    def value_shares(self, c: str, n: int | None = 10, base: str = "kept") -> DataFrame:
        vc = self.value_counts(c, n)
        total = (F.lit(self.wide["n_rows"]) if base == "all" else vc.agg(F.sum("count")).scalar())
        return vc.select(c, "count", (F.col("count") * C.dlit(100) / total).alias("share_pct"))

    def rate_by(self, c: str, n: int = 10) -> DataFrame:
        return (self.category(c).select(c, F.col("rate").alias("rate_pct"), F.col("cnt").alias("n"))
                .withColumn("band", C.rate_band("rate_pct")).orderBy(F.desc("rate_pct"), F.asc(c)).limit(n))

    def category_headline(self, c: str) -> DataFrame:
        return stats.headline_of(self.category(c), c, F.lit(self.wide["n_rows"]))

    def distinct_values(self, c: str) -> DataFrame:
        return self.category(c).select(c).orderBy(c)

    def segment_profile(self) -> DataFrame:
        means = (self.moments.where(F.col("by") == LABEL).groupBy(F.col("key").alias("k"))
                 .agg(*[C.round_half_up(F.max(F.when(F.col(NAME) == m, F.col("mean"))), 2).alias(m) for m in self.metrics]))
        rows = self.counts.where(F.col("by") == LABEL)
        order = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in K.CLUSTER_NAMES + ["AtRisk"]]), F.col(LABEL)),
                           F.lit(99))
        return (rows.join(means, rows["key"].eqNullSafe(means["k"]), "left")
                .select(F.col("key").alias(LABEL), *self.metrics,
                        C.round_half_up(F.col("rate") * C.dlit(100), 1).alias("Approval_pct"), "n")
                .withColumn("seg_order", order.cast("int")).orderBy("seg_order", LABEL))

    def box_stats(self, c: str, g: str) -> DataFrame:
        return self.of(self.boxes, g, [c]).drop("by", NAME).withColumnRenamed("key", "group")

    def box_fliers(self, c: str, g: str) -> DataFrame:
        return repeated(self.of(self.fliers, g, [c]).select(F.col("key").alias("group"), "x", "cnt")).select("group", "x")

    def grouped_stats(self, c: str, g: str) -> DataFrame:
        """Here nulls form the group "nan". If the column has that string
        too, both are one group, which only the rows can give."""
        keys = {r["key"] for r in self.counts.where(F.col("by") == g).select("key").collect()} \
            if g in self.by else set()
        if {None, "nan"} <= keys:
            return stats.grouped_stats(self.read(f"grouped_stats_{c}_by_{g}"), g, c)
        mine = lambda t: t.where((F.col("by") == g) & (F.col(NAME) == c))
        r = lambda x: C.round_half_up(x, 2).alias(x)
        rows = with_keys(mine(self.moments), mine(self.quantiles)).select(
            F.coalesce("key", F.lit("nan")).alias("group"), r("mean"), r("median"), r("std"), r("min"), r("max"))
        # A group without a value has a row of nulls.
        groups = self.counts.where(F.col("by") == g).select(F.coalesce("key", F.lit("nan")).alias("group"))
        return groups.join(rows, "group", "left")

    def median_extremes(self, c: str, g: str) -> DataFrame:
        return stats.extremes_of(self.of(self.quantiles, g, [c]).select(F.col("key").alias("group"), "median"))

    def corr_matrix(self, triangle: bool = False) -> DataFrame:
        return corr.matrix_of(self.pairs, self.corr_columns, triangle)

    def corr_with(self, target: str) -> DataFrame:
        return (self.corr_matrix().where((F.col("b") == target) & (F.col("a") != target))
                .select(F.col("a").alias(NAME), "r").orderBy(F.asc("r"), F.asc(NAME)))

    def linregress(self, x: str, y: str) -> DataFrame:
        return corr.linregress_p(self.read("linregress"), x, y)

    def pair_diagonal(self) -> DataFrame:
        return sample.diagonal_of(self.pair_rows, self.pair_columns)

    def outlier_report(self) -> DataFrame:
        out = distribution.outside(self.of(self.fenced(CAPPED), "", self.numeric))
        n = out.groupBy(NAME).agg(F.sum("cnt").alias("n_capped"))
        iqr = F.col("q3") - F.col("q1")
        fences = self.of(self.quantiles, "", self.numeric).select(
            NAME, "q1", "q3", (F.col("q1") - C.dlit(CAPPED) * iqr).alias("lower"),
            (F.col("q3") + C.dlit(CAPPED) * iqr).alias("upper"))
        every = self.df.sparkSession.createDataFrame([(c,) for c in self.numeric], f"{NAME} string")
        return (every.join(n, NAME, "left").join(fences, NAME, "left")
                .select(NAME, F.coalesce("n_capped", F.lit(0).cast("long")).alias("n_capped"), "q1", "q3", "lower", "upper"))

    def capped_table(self) -> DataFrame:
        q = {r[NAME]: r for r in self.of(self.quantiles, "", self.numeric).collect()}
        fences = {c: (r["q1"] - CAPPED * (r["q3"] - r["q1"]), r["q3"] + CAPPED * (r["q3"] - r["q1"]))
                  for c, r in q.items()}
        return clean.clipped(nan_to_null(self.read("capped_table"), self.numeric), fences)


def profile_analyses(df: DataFrame, profile: Profile | None = None) -> dict[str, Callable[[], DataFrame]]:
    """Every profiling analysis over the default column lists, as far as
    the table has the columns, by name."""
    p = profile or Profile(df)
    out: dict[str, Callable[[], DataFrame]] = {
        "kpis": p.kpis, "quality_report": p.quality_report, "null_counts": p.null_counts,
        "summary_stats": p.summary_stats, "shape_stats": p.shape_stats, "histogram_grid": p.histogram_grid,
        "segment_shares": lambda: p.value_shares(LABEL, None, base="all"), "segment_profile": p.segment_profile,
        "corr_matrix": p.corr_matrix, "corr_lower_triangle": lambda: p.corr_matrix(triangle=True),
        "pair_sample": lambda: p.pair_rows, "pair_diagonal": p.pair_diagonal,
        "scatter_sample": lambda: sample.scatter_table(p.read("scatter_sample"), "AnnualIncome_INR", SCORE),
        "linregress": lambda: p.linregress("AnnualIncome_INR", SCORE),
        "outlier_report": p.outlier_report, "capped_table": p.capped_table,
    }
    for group in p.described:
        out[f"describe_{'_'.join(group.replace('&', ' ').split())}"] = lambda g=group: p.describe(g)
    for c in (SCORE, TARGET):
        out[f"corr_with_{c}"] = lambda c=c: p.corr_with(c)
        out[f"top_drivers_{c}"] = lambda c=c: corr.strongest(p.corr_with(c), 4)
    for c in p.numeric:
        out[f"histogram_{c}"] = lambda c=c: p.histogram(c)
        out[f"qq_points_{c}"] = lambda c=c: p.qq_points(c)
        out[f"qq_fit_{c}"] = lambda c=c: p.qq_fit(c)
        out[f"histogram_{c}_by_{TARGET}"] = lambda c=c: p.histogram_by_target(c)
    for c in p.categories:
        out[f"value_counts_{c}"] = lambda c=c: p.value_counts(c)
        out[f"value_shares_{c}"] = lambda c=c: p.value_shares(c)
        out[f"approval_rate_by_{c}"] = lambda c=c: p.rate_by(c)
        out[f"category_headline_{c}"] = lambda c=c: p.category_headline(c)
        out[f"distinct_{c}"] = lambda c=c: p.distinct_values(c)
    for c in p.box_numeric:
        for g in p.box_groups:
            out[f"box_{c}_by_{g}"] = lambda c=c, g=g: p.box_stats(c, g)
            out[f"box_fliers_{c}_by_{g}"] = lambda c=c, g=g: p.box_fliers(c, g)
            out[f"grouped_stats_{c}_by_{g}"] = lambda c=c, g=g: p.grouped_stats(c, g)
            out[f"median_extremes_{c}_by_{g}"] = lambda c=c, g=g: p.median_extremes(c, g)
    return out
