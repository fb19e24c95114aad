"""Deterministic sampling and splitting (K3, K4, M2).

Both are functions of a row's key and a seed only: the md5 of
``key|seed`` orders rows for an exact-n sample (a bounded top-n, planned as
TakeOrderedAndProject), and its first 32 bits modulo 100 assign the split.
They do not depend on partitioning or executor loss, and DuckDB computes
the same md5, so the oracle sees the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.operators.histogram import histogram_of
from loanlens.operators.quantiles import NAME, long_values


def row_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def hash_bucket(key: str, seed: int, buckets: int = 100) -> Column:
    head = F.conv(F.substring(row_hash(key, seed), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(buckets))


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "RespondentID") -> DataFrame:
    """K3: exactly min(n, rows) rows without replacement, reproducible."""
    return df.orderBy(row_hash(key, seed), F.col(key)).limit(n)


def split(df: DataFrame, test_pct: int = 20, seed: int = 42, key: str = "RespondentID",
          col: str = "is_test") -> DataFrame:
    """M2: flag ``test_pct`` % of rows (by hash) as hold-out."""
    return df.withColumn(col, (hash_bucket(key, seed) < F.lit(test_pct)).cast("int"))


def pair_table(df: DataFrame, cols: Sequence[str], cls: str = "LoanApproved", n: int = 500,
               seed: int = 42, key: str = "RespondentID") -> DataFrame:
    """K4: the pair-plot sample: chosen columns + class for n sampled rows."""
    return sample_n(df, n, seed, key).select(key, cls, *cols)


def pair_diagonal(df: DataFrame, cols: Sequence[str], cls: str = "LoanApproved",
                  n: int = 500, seed: int = 42, key: str = "RespondentID",
                  bins: int = 20) -> DataFrame:
    """K4 diagonal: per column, a histogram of the sample per class. The
    sample is unpivoted to ``(class, feature, x)`` and binned by (feature,
    class), each on its own range."""
    return diagonal_of(sample_n(df, n, seed, key), cols, cls, bins)


def diagonal_of(rows: DataFrame, cols: Sequence[str], cls: str = "LoanApproved", bins: int = 20) -> DataFrame:
    """The diagonal of the sampled rows."""
    values = long_values(rows.where(F.col(cls).isNotNull()), cols, by=[cls])
    return histogram_of(values, [NAME, cls], bins)


def scatter_table(df: DataFrame, x: str, y: str, cls: str = "LoanApproved", n: int = 700,
                  seed: int = 1, key: str = "RespondentID") -> DataFrame:
    """K4 scatter: ``(key, x, y, class)`` for n sampled rows."""
    return sample_n(df, n, seed, key).select(key, x, y, cls)
