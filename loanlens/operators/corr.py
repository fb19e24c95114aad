"""Pearson correlation.

All pairs come from one scan of the rows as they are: each task adds up, for
every pair of columns over its pairwise-complete rows, the counts, sums and
products of its Arrow batches (matrix products, centred by the columns' means so
that the sums stay small) and returns one row per pair; one small ``groupBy``
adds the tasks' rows. No row is paired with or copied for anything.
r = try_divide(cov, sa*sb) is null for a constant side (Spark's ``corr`` raises
under ANSI there)."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions import columns as C

# Task functions are serialised by value: executors need only pandas/numpy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class PairSums:
    """Running sums of a task over pairs (a, b) of column positions."""

    def __init__(self, means: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.means, self.a, self.b = means, a, b
        k = len(means)
        self.n, self.sx, self.sxx, self.sxy = (np.zeros((k, k)) for _ in range(4))
        self.low, self.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)

    def add(self, values: np.ndarray) -> None:
        """``values``: rows x columns, NaN where missing. Entry (i, j) of the
        sums is over column i, in rows that have columns i and j."""
        there = ~np.isnan(values)
        x = np.where(there, values - self.means, 0.0)
        m = there.astype(float)
        self.n += m.T @ m
        self.sx += x.T @ m
        self.sxx += (x * x).T @ m
        self.sxy += x.T @ x
        for j in range(values.shape[1]):
            rows = there[:, j]
            if rows.any():
                both = there[rows]
                self.low[:, j] = np.minimum(self.low[:, j], np.where(both, values[rows], np.inf).min(axis=0))
                self.high[:, j] = np.maximum(self.high[:, j], np.where(both, values[rows], -np.inf).max(axis=0))

    def frame(self) -> pd.DataFrame:
        a, b = self.a, self.b
        return pd.DataFrame({
            "pair": np.arange(len(a)), "n": self.n[a, b], "sx": self.sx[a, b], "sy": self.sx[b, a],
            "sxx": self.sxx[a, b], "syy": self.sxx[b, a], "sxy": self.sxy[a, b],
            "xl": self.low[a, b], "xh": self.high[a, b], "yl": self.low[b, a], "yh": self.high[b, a]})


def pair_moments(df: DataFrame, pairs: Sequence[tuple[str, str]],
                 centres: dict[str, float] | None = None) -> DataFrame:
    """``(pair, n, cov, sa, sb, vx, vy)`` for each column pair over its
    complete rows: population covariance and standard deviations, and whether
    each side varies (by its exact least and largest value). Values are taken from ``centres`` (near the means, so that sums stay
    small; without it, one more pass finds the means)."""
    cols = list(dict.fromkeys([c for ab in pairs for c in ab]))
    values = df.select(*[C.no_nan(c).alias(c) for c in cols])
    if centres is None:
        centres = values.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    means = np.array([centres.get(c) or 0.0 for c in cols])
    a = np.array([cols.index(x) for x, _ in pairs])
    b = np.array([cols.index(y) for _, y in pairs])

    def run(batches):
        sums = PairSums(means, a, b)
        for pdf in batches:
            if len(pdf):
                sums.add(pdf.to_numpy(dtype=float))
        yield sums.frame()

    fields = ["n", "sx", "sy", "sxx", "syy", "sxy", "xl", "xh", "yl", "yh"]
    tasks = values.mapInPandas(run, "pair int, " + ", ".join(f"{f} double" for f in fields))
    least, most = {"xl", "yl"}, {"xh", "yh"}
    total = tasks.groupBy("pair").agg(*[
        (F.min if f in least else F.max if f in most else F.sum)(f).alias(f) for f in fields])
    n = F.col("n")
    spread = lambda ss, s: F.sqrt(F.greatest(
        F.try_divide(F.col(ss), n) - F.pow(F.try_divide(F.col(s), n), F.lit(2)), C.dlit(0)))
    return total.select(
        "pair", n.cast("long").alias("n"),
        (F.try_divide(F.col("sxy"), n) - F.try_divide(F.col("sx"), n) * F.try_divide(F.col("sy"), n)).alias("cov"),
        spread("sxx", "sx").alias("sa"), spread("syy", "sy").alias("sb"),
        (F.col("xl") < F.col("xh")).alias("vx"), (F.col("yl") < F.col("yh")).alias("vy"))


def _r() -> F.Column:
    """r, null when a side is constant (exact min == max test: the streaming
    std of a constant column need not be exactly 0)."""
    return F.when(F.col("vx") & F.col("vy"),
                  F.try_divide(F.col("cov"), F.col("sa") * F.col("sb")))


def corr_matrix(df: DataFrame, cols: Sequence[str], triangle: bool = False) -> DataFrame:
    """Long table ``(a, b, i, j, r)`` over all ordered pairs
    (diagonal r = 1 for a non-constant column); ``triangle=True`` keeps the
    strict lower triangle (j < i) as the masked heatmap shows it. One scan
    (``pair_moments``); the upper half is mirrored from the lower."""
    cols = list(cols)
    return matrix_of(pair_moments(df, lower_pairs(cols)), cols, triangle)


def lower_pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    """The pairs of a matrix's lower half and diagonal, row by row."""
    return [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1)]


def matrix_of(m: DataFrame, cols: Sequence[str], triangle: bool = False) -> DataFrame:
    """The matrix from the ``pair_moments`` of ``lower_pairs``."""
    idx = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    ij = F.array(*[F.array(F.lit(i), F.lit(j)) for (i, j) in idx])
    m = m.select(F.element_at(ij, F.col("pair") + 1).alias("ij"), "sa", "cov", "sb", "vx", "vy")
    m = m.select(F.col("ij")[0].alias("i"), F.col("ij")[1].alias("j"),
                 F.when(F.col("ij")[0] == F.col("ij")[1],
                        F.when(F.col("vx"), C.dlit(1.0))).otherwise(_r()).alias("r"))
    lower = m.where(F.col("i") > F.col("j"))
    if triangle:
        out = lower
    else:
        out = m.unionByName(lower.select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    names = F.array(*[F.lit(c) for c in cols])
    return out.select(F.element_at(names, F.col("i") + 1).alias("a"),
                      F.element_at(names, F.col("j") + 1).alias("b"), "i", "j", "r")


def corr_with(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """R of every other column with ``target``, ascending, the target
    itself dropped."""
    others = [c for c in cols if c != target]
    m = pair_moments(df, [(c, target) for c in others])
    names = F.array(*[F.lit(c) for c in others])
    return m.select(F.element_at(names, F.col("pair") + 1).alias("feature"),
                    _r().alias("r")).orderBy(F.asc("r"), F.asc("feature"))


def top_drivers(df: DataFrame, cols: Sequence[str], target: str, k: int = 4) -> DataFrame:
    """The k largest positive correlations (descending) and the k most
    negative (ascending), tagged; ranks within each side."""
    return strongest(corr_with(df, cols, target), k)


def strongest(cw: DataFrame, k: int) -> DataFrame:
    """The k largest positive and the k most negative r of ``(feature, r)``."""
    pos = cw.where(F.col("r") > 0).orderBy(F.desc("r"), F.asc("feature")).limit(k)
    neg = cw.where(F.col("r") < 0).orderBy(F.asc("r"), F.asc("feature")).limit(k)
    return (pos.select(F.lit("positive").alias("side"), "feature", "r")
            .unionByName(neg.select(F.lit("negative").alias("side"), "feature", "r")))


def linregress(df: DataFrame, x: str, y: str, min_rows: int = 6) -> DataFrame:
    """Slope, intercept and r over complete pairs; rows are returned
    only when there are more than five pairs (the reference's guard)."""
    from loanlens.operators.distribution import fit_line
    return fit_line(df, x, y).where(F.col("n") >= min_rows)


def linregress_p(df: DataFrame, x: str, y: str, min_rows: int = 6) -> DataFrame:
    """A25 with the two-sided p-value of a zero slope, from Spark ML's least
    squares summary (null where r is null). The complete pairs are read once
    and kept for both fits."""
    pairs = df.select(C.no_nan(x).alias(x), C.no_nan(y).alias(y)).na.drop().persist()
    try:
        rows = []
        for fit in linregress(pairs, x, y, min_rows).collect():
            p = None
            if fit["r"] is not None:
                vectors = VectorAssembler(inputCols=[x], outputCol="features").transform(pairs)
                p = LinearRegression(featuresCol="features", labelCol=y, solver="normal").fit(vectors).summary.pValues[0]
            rows.append((*fit, p))
    finally:
        pairs.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "n long, slope double, intercept double, r double, p_value double")
