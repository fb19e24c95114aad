"""Statistics, histograms, box plots, Q-Q and correlation on small frames."""

import math
import statistics

import numpy as np
from pyspark.sql import functions as F

from loanlens.operators import corr, distribution, histogram, stats


def frame(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"R{i:04d}", ["A", "B", "C"][i % 3], float(rng.normal(50, 10)),
             float(rng.normal()) if i % 5 else None, int(rng.integers(0, 2)), 7.0)
            for i in range(n)]
    return spark.createDataFrame(rows, "id string, cat string, x double, y double, "
                                       "label int, const double")


def test_histogram_counts_and_last_bin(spark):
    df = frame(spark)
    h = histogram.histogram(df, "x", 13).orderBy("bin").collect()
    assert len(h) == 13 and sum(r["count"] for r in h) == 200
    xs = [r["x"] for r in df.collect()]
    want, edges = np.histogram(xs, bins=13)
    assert [r["count"] for r in h] == list(want)
    assert np.allclose([r["bin_lo"] for r in h], edges[:-1])
    assert h[-1]["bin_hi"] == max(xs)                     # the maximum is in the last bin


def test_histogram_constant_column(spark):
    h = histogram.histogram(frame(spark), "const", 4).orderBy("bin").collect()
    want, edges = np.histogram([7.0] * 200, bins=4)
    assert [r["count"] for r in h] == list(want)
    assert np.allclose([r["bin_lo"] for r in h], edges[:-1])


def test_histogram_by_uses_own_range(spark):
    df = frame(spark)
    h = histogram.histogram_by(df, "x", "cat", 5).collect()
    for cat in "ABC":
        xs = [r["x"] for r in df.where(F.col("cat") == cat).collect()]
        want, _ = np.histogram(xs, bins=5)
        got = [r["count"] for r in sorted((r for r in h if r["cat"] == cat), key=lambda r: r["bin"])]
        assert got == list(want)


def test_value_counts_ties_and_shares(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",), (None,)], "v string")
    vc = stats.value_counts(df, "v", 2).collect()
    assert [(r["v"], r["count"]) for r in vc] == [("a", 2), ("b", 2)]
    shares = stats.value_shares(df, "v", None, base="kept").collect()
    assert math.isclose(sum(r["share_pct"] for r in shares), 100.0)


def test_summary_and_shape(spark):
    df = frame(spark)
    ys = [r["y"] for r in df.collect() if r["y"] is not None]
    s = stats.summary_stats(df, ["y"]).first()
    assert s["n"] == len(ys)
    assert math.isclose(s["median"], statistics.median(ys))
    assert math.isclose(s["std"], statistics.stdev(ys))
    sh = stats.shape_stats(df, ["y"]).first()
    a = np.array(ys)
    m2, m3 = ((a - a.mean()) ** 2).mean(), ((a - a.mean()) ** 3).mean()
    assert math.isclose(sh["skewness"], m3 / m2 ** 1.5, rel_tol=1e-9)


def test_grouped_stats_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 3.0), ("a", 2.0)], "k string, x double")
    got = {r["group"]: r["median"] for r in stats.grouped_stats(df, "k", "x").collect()}
    assert got == {"a": 1.5, "nan": 3.0}


def test_box_stats_match_numpy(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in vals], "k string, x double")
    b = distribution.box_stats(df, "k", "x").first()
    q1, q3 = np.percentile(vals, [25, 75])
    hi = q3 + 1.5 * (q3 - q1)
    assert (b["q1"], b["q3"]) == (q1, q3)
    assert b["whisker_hi"] == max(v for v in vals if v <= hi) and b["n_fliers"] == 1


def test_norm_ppf_accuracy(spark):
    ps = [1e-6, 0.001, 0.02, 0.02425, 0.1, 0.5, 0.9, 0.975, 0.999999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double")
           .select(distribution.norm_ppf("p")).collect()]
    for p, g in zip(ps, got):
        assert abs(g - statistics.NormalDist().inv_cdf(p)) < 1e-8


def test_qq_fit_reasonable(spark):
    df = frame(spark, 400)
    fit = distribution.qq_fit(df, "x").first()
    assert fit["n"] == 400 and fit["r"] > 0.98 and 8 < fit["slope"] < 12


def test_corr_pairwise_complete_and_constant(spark):
    df = frame(spark)
    m = {(r["a"], r["b"]): r["r"] for r in corr.corr_matrix(df, ["x", "y", "const"]).collect()}
    rows = [r for r in df.collect() if r["y"] is not None]
    want = np.corrcoef([r["x"] for r in rows], [r["y"] for r in rows])[0, 1]
    assert math.isclose(m[("x", "y")], want, rel_tol=1e-9)
    assert m[("x", "y")] == m[("y", "x")] and m[("x", "x")] == 1.0
    assert m[("x", "const")] is None and m[("const", "const")] is None
    low = corr.corr_matrix(df, ["x", "y", "const"], triangle=True).collect()
    assert len(low) == 3 and all(r["j"] < r["i"] for r in low)


def test_rank_groups_names(spark):
    prof = spark.createDataFrame([(0, 600.0), (1, 700.0), (2, 650.0)], "Cluster int, s double")
    got = {r["Cluster"]: r["label"] for r in stats.rank_groups(prof, "s", ["P", "E", "R"],
                                                               "Cluster").collect()}
    assert got == {1: "P", 2: "E", 0: "R"}


def test_box_stats_hot_group(spark):
    """A group holding over a third of all rows, with one value repeated in
    a third of that group, gives numpy's quartiles, whiskers and flier
    count."""
    import pytest

    rng = np.random.default_rng(5)
    hot = [40.0] * 300 + list(np.round(rng.normal(50, 10, 600), 3)) + [500.0, -300.0]
    cold = {g: list(np.round(rng.normal(g * 10, 3, 120), 3)) for g in range(1, 11)}
    rows = [("hot", float(v)) for v in hot] + [(f"g{g}", float(v))
                                               for g, vs in cold.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    groups = {"hot": hot, **{f"g{g}": vs for g, vs in cold.items()}}
    got = {r["group"]: r for r in distribution.box_stats(df, "k", "x").collect()}
    assert set(got) == set(groups)
    for g, vals in groups.items():
        v = np.array(vals)
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        b = got[g]
        assert b["n"] == len(v)
        assert (b["q1"], b["median"], b["q3"]) == pytest.approx((q1, med, q3), abs=1e-9)
        assert b["whisker_lo"] == v[v >= lo].min() and b["whisker_hi"] == v[v <= hi].max()
        assert b["n_fliers"] == int(((v < lo) | (v > hi)).sum())


NAN = float("nan")


def nan_frame(spark):
    return spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 4.0, 8.0), ("b", NAN, 1.0), ("b", 7.0, NAN), ("b", None, 3.0)],
        "k string, x double, y double")


def test_nan_counts_as_missing(spark):
    """As in pandas: NaN is no value of a histogram, box, correlation, mean
    or fit, is counted as null and is imputed."""
    from loanlens.operators import clean, histogram
    df = nan_frame(spark)
    h = histogram.histogram(df, "x", 3).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 1, 1] and (h[0]["bin_lo"], h[-1]["bin_hi"]) == (1.0, 7.0)
    by = histogram.histogram_by(df, "x", "k", 2).collect()
    assert sum(r["count"] for r in by) == 4
    assert {r["feature"]: r["n_null"] for r in stats.null_counts(df).collect()} == {"k": 0, "x": 2, "y": 1}
    assert stats.quality_report(df, key="k").first()["null_cells"] == 3
    g = {r["group"]: r for r in stats.grouped_stats(df, "k", "x").collect()}
    assert (g["b"]["mean"], g["b"]["max"], g["b"]["median"]) == (7.0, 7.0, 7.0)
    assert {r["group"]: r["n"] for r in distribution.box_stats(df, "k", "x").collect()} == {"a": 3, "b": 1}
    m = {(r["a"], r["b"]): r["r"] for r in corr.corr_matrix(df, ["x", "y"]).collect()}
    assert math.isclose(m[("x", "y")], 1.0)
    fit = distribution.fit_line(df, "x", "y").first()
    assert fit["n"] == 3 and math.isclose(fit["slope"], 2.0)
    assert {r["feature"]: (r["n"], r["mean"]) for r in stats.summary_stats(df, ["x", "y"]).collect()} == {
        "x": (4, 3.5), "y": (5, 3.6)}
    filled = clean.impute_median(df, ["x", "y"]).orderBy("k", "y").collect()
    assert all(r["x"] is not None and not math.isnan(r["x"]) and not math.isnan(r["y"]) for r in filled)
    capped, report = clean.cap_outliers(df, ["x"], 3.0)
    assert capped.where("x is null").count() == 2 and report.first()["n_capped"] == 0


def test_slope_p_value_is_students_t(spark):
    """Against the t density integrated by Simpson's rule."""
    def tail(t, df, n=20_000):
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        h = t / n
        total = sum((1 if k in (0, n) else 4 if k % 2 else 2) * (1 + (k * h) ** 2 / df) ** (-(df + 1) / 2)
                    for k in range(n + 1))
        return 1 - 2 * total * h / 3 * c
    rng = np.random.default_rng(4)
    for n, slope in ((6, 2.0), (10, 0.5), (40, 0.1), (300, -0.05), (12, 0.0)):
        x = rng.normal(size=n) * 10 + 50
        y = slope * x + rng.normal(size=n)
        row = corr.linregress_p(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"),
                                "x", "y").first()
        r = float(np.corrcoef(x, y)[0, 1])
        t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
        assert row["n"] == n and math.isclose(row["r"], r, rel_tol=1e-9)
        assert math.isclose(row["p_value"], tail(t, n - 2), rel_tol=1e-6, abs_tol=1e-9)
    constant = spark.createDataFrame([(1.0, float(k)) for k in range(8)], "x double, y double")
    assert corr.linregress_p(constant, "x", "y").first()["p_value"] is None
    assert corr.linregress_p(constant, "y", "x").first()["p_value"] is None
    assert corr.linregress_p(constant.limit(3), "x", "y").collect() == []
    row = corr.linregress_p(nan_frame(spark), "x", "y", min_rows=3).first()
    assert row["n"] == 3 and row["p_value"] < 1e-6

def test_qq_points_read_the_count_once(spark):
    df = spark.createDataFrame([(float(k),) for k in range(50)], "x double")
    plan = distribution.qq_points(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" not in plan
    assert distribution.qq_points(spark.createDataFrame([], "x double"), "x").count() == 0
