"""Equal-width histograms.

numpy semantics: bins span [min, max] (a constant column uses
[v - .5, v + .5]); the last bin is closed; a value's bin is
floor((x - lo) / (hi - lo) * bins), corrected against the linspace edges
e_i = i * step + lo (e_bins = hi). ``width_bucket`` is not used: it puts the
maximum in bin n+1.

No row of the table moves. Ranges come first; then every row is binned where it
is read, and only partial counts, at most one row a task, key and bin, are
shuffled. Ranges by column are literals (bounded by the schema); ranges by group
are broadcast after a check of their number. Beyond that number the rows are
counted by (group, value) before they meet the ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions import columns as C
from loanlens.operators.quantiles import NAME, value_counts
from loanlens.session import SMALL_ROWS, small_table


def _edge(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    step = (hi - lo) / C.dlit(bins)
    return F.when(i >= F.lit(bins), hi).otherwise(i.cast("double") * step + lo)


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    raw = F.floor((x - lo) / (hi - lo) * C.dlit(bins)).cast("int")
    i0 = F.least(raw, F.lit(bins - 1))
    i1 = F.when(x < _edge(i0, lo, hi, bins), i0 - 1).otherwise(i0)
    return F.when((x >= _edge(i1 + 1, lo, hi, bins)) & (i1 != F.lit(bins - 1)),
                  i1 + 1).otherwise(i1)


def value_range(mn: Column, mx: Column) -> tuple[Column, Column]:
    """The histogram's range: a constant column is half a unit off both ends."""
    same = mn == mx
    return (F.when(same, mn - C.dlit(0.5)).otherwise(mn), F.when(same, mx + C.dlit(0.5)).otherwise(mx))


def filled(ranges: DataFrame, counts: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Every bin of every range, with 0 where nothing was counted."""
    grid = ranges.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, [*keys, "bin"], "left")
    return out.select(*keys, "bin",
                      _edge(F.col("bin"), F.col("lo"), F.col("hi"), bins).alias("bin_lo"),
                      _edge(F.col("bin") + 1, F.col("lo"), F.col("hi"), bins).alias("bin_hi"),
                      F.coalesce(F.col("count"), F.lit(0).cast("long")).alias("count"))


def _column_ranges(df: DataFrame, cols: Sequence[str], more=()) -> list[tuple]:
    """(column, lo, hi, values of ``more``...) of the columns that have a value:
    one aggregate over the rows as they are, read once."""
    made = [F.struct(*value_range(F.min(C.no_nan(c)), F.max(C.no_nan(c))), *[m(C.no_nan(c)) for m in more]).alias(f"c{k}")
            for k, c in enumerate(cols)]
    row = df.agg(*made).first()
    return [(c, *row[k]) for k, c in enumerate(cols) if row[k][0] is not None]


def _column_histograms(df: DataFrame, ranges: list[tuple], bins: int) -> DataFrame:
    """``(feature, bin, bin_lo, bin_hi, count)``: each row gives its bins by
    the columns' literal ranges, where it is read."""
    spark = df.sparkSession
    known = spark.createDataFrame([r[:3] for r in ranges], f"{NAME} string, lo double, hi double")
    if not ranges:
        return filled(known, known.select(NAME, F.lit(0).alias("bin"), F.lit(0).cast("long").alias("count")),
                       [NAME], bins)
    cells = F.array(*[F.struct(F.lit(c).alias(NAME), C.no_nan(c).alias("x"), C.dlit(lo).alias("lo"), C.dlit(hi).alias("hi"))
                      for c, lo, hi, *_ in ranges])
    counts = (df.select(F.explode(cells).alias("cell")).select("cell.*").where(F.col("x").isNotNull())
              .groupBy(NAME, bin_index(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    return filled(known, counts, [NAME], bins)


def histogram(df: DataFrame, c: str, bins: int = 40) -> DataFrame:
    """``(bin, bin_lo, bin_hi, count)`` of one column, nulls and NaN
    dropped. Two aggregates; no row of its own without a value."""
    return _column_histograms(df, _column_ranges(df, [c]), bins).drop(NAME)


def histogram_by(df: DataFrame, c: str, key: str, bins: int = 40, small: int = SMALL_ROWS) -> DataFrame:
    """One histogram per non-null ``key`` value, each on its own range."""
    values = (df.where(F.col(key).isNotNull())
              .select(F.col(key).alias(key), C.no_nan(c).alias("x"))
              .where(F.col("x").isNotNull()))
    return histogram_of(values, [key], bins, small)


def histogram_of(values: DataFrame, keys: Sequence[str], bins: int, small: int = SMALL_ROWS) -> DataFrame:
    """Histograms of ``(keys..., x)`` without nulls, one on its own range per
    keys; the ranges are broadcast if there are at most ``small``."""
    keys = list(keys)
    lo, hi = value_range(F.min("x"), F.max("x"))
    ranges = values.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"))
    idx = bin_index(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")
    known = small_table(ranges, small)
    if known is not None:
        counts = values.join(known, keys).groupBy(*keys, idx).agg(F.count(F.lit(1)).alias("count"))
    else:
        known = ranges
        counts = (value_counts(values, keys).join(ranges, keys)
                  .groupBy(*keys, idx).agg(F.sum("cnt").alias("count")))
    return filled(known, counts, keys, bins)


def histogram_grid(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """Histograms of many columns at once, with each column's mean and
    population skewness. One wide aggregate gives ranges and moments, one pass
    bins all columns of a row."""
    ranges = _column_ranges(df, cols, (F.avg, F.skewness))
    moments = df.sparkSession.createDataFrame([(r[0], r[3], r[4]) for r in ranges],
                                              f"{NAME} string, mean double, skew double")
    return _column_histograms(df, ranges, bins).join(F.broadcast(moments), NAME, "left")
