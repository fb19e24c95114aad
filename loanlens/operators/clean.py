"""Projection and cleaning operators plus the aggregate-driven
column functions F11 (quartile bins), F13 (label codes) and F23 (outlier
capping)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from loanlens.functions import columns as C
from loanlens.operators.quantiles import NAME, quantiles_wide


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN -> null in the float columns (of ``cols``): pandas, whose rules the
    statistics follow, treats both as missing."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))
              and (cols is None or f.name in cols)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def numeric_cols(df: DataFrame) -> list[str]:
    """Names of numeric columns, by schema."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def with_default(df: DataFrame, defaults: dict) -> DataFrame:
    """Add absent columns with a per-column default value (exact-case
    names)."""
    new = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(new) if new else df


def impute_median(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Replace nulls (and NaN) of numeric columns by the column's median
    (``fit_medians``), as literals of one projection over ``df``."""
    return fill_medians(df, fit_medians(df, cols, exact))


#: Rank error of the approximate median: at most rows / ACCURACY.
ACCURACY = 10_000


def fit_medians(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> dict[str, float]:
    """Median of each numeric column that holds nulls or NaN (one value per
    column, bounded by the schema; a column without any value is left out).

    ``exact``: a first pass finds the columns with nulls, exact medians
    (distributed, §4.3) follow for those. Otherwise one aggregate gives both, the
    medians from mergeable quantile sketches whose rank is off by at most one in
    ``ACCURACY`` of the rows."""
    cols = list(cols or numeric_cols(df))
    df = nan_to_null(df, cols)
    counts = [F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols]
    if not exact:
        sketches = [F.percentile_approx(F.col(c).cast("double"), 0.5, ACCURACY).alias(f"m_{c}") for c in cols]
        row = df.agg(*counts, *sketches).first()
        return {c: row[f"m_{c}"] for c in cols if row[f"n_{c}"] and row[f"m_{c}"] is not None}
    row = df.agg(*counts).first()
    with_nulls = [c for c in cols if row[f"n_{c}"]]
    if not with_nulls:
        return {}
    return {r[NAME]: r["median"] for r in quantiles_wide(df, with_nulls, [0.5], ["median"]).collect()}


def fill_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Nulls (and NaN) of the columns replaced by the given values."""
    df = nan_to_null(df)
    repl = {c: F.coalesce(F.col(c), F.lit(m).cast(df.schema[c].dataType))
            for c, m in medians.items() if c in df.columns}
    return df.withColumns(repl) if repl else df


def quartile_bins(df: DataFrame, c: str, out: str = "IncomeQuartile") -> DataFrame:
    """pandas ``qcut(x, 4, labels=Q1..Q4)`` with exact interpolated
    quartiles (three values, read once)."""
    q = quantiles_wide(df, [c], [0.25, 0.5, 0.75], ["q1", "q2", "q3"]).first()
    lit = lambda v: F.lit(v).cast("double")
    return df.withColumn(out, C.quartile_label(F.col(c).cast("double"), lit(q["q1"]),
                                                lit(q["q2"]), lit(q["q3"]), None))


def _category(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def fit_label_codes(df: DataFrame, cols: Sequence[str]) -> StringIndexerModel | None:
    """F13, the fitted dictionary: one model for all of ``cols`` that the
    table has (None if it has none), from one aggregation. Each column's
    distinct values, sorted, are its labels; null counts as the string "nan",
    as in the reference. Persist it with ``model.write()``; the same model
    encodes batches and streams."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return None
    indexer = StringIndexer(inputCols=cols, outputCols=[f"__{c}_code" for c in cols],
                            stringOrderType="alphabetAsc", handleInvalid="keep")
    return indexer.fit(df.select(*[_category(c).alias(c) for c in cols]))


def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_Enc",
                 model: StringIndexerModel | None = None) -> DataFrame:
    """code = position of the string value among the column's sorted
    distinct values, looked up in ``model`` (fitted on ``df`` if not given). A
    value that the model has not seen gets the number of its labels. A
    projection: no join, so it runs on a stream as well."""
    model = model or fit_label_codes(df, cols)
    if model is None:
        return df
    known = {c: out for c, out in zip(model.getInputCols(), model.getOutputCols())
             if c in cols and c in df.columns}
    # The categories stand beside the columns while they are looked up.
    lookup = model.copy()
    lookup.setInputCols([f"__{c}" for c in model.getInputCols()])
    held = df.withColumns({f"__{c}": _category(c) if c in known else F.lit("nan") for c in model.getInputCols()})
    return lookup.transform(held).select(
        *df.columns, *[F.col(out).cast("int").alias(c + suffix) for c, out in known.items()])


def outlier_fences(df: DataFrame, cols: Sequence[str], k: float = 3.0) -> DataFrame:
    """F23 fences: ``(feature, q1, q3, lower, upper)`` with lower = q1 - k IQR
    and upper = q3 + k IQR (exact quartiles)."""
    q = quantiles_wide(df, cols, [0.25, 0.75], ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select(NAME, "q1", "q3", (F.col("q1") - C.dlit(k) * iqr).alias("lower"),
                    (F.col("q3") + C.dlit(k) * iqr).alias("upper"))


def clipped(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """Each column with fences clipped to them; null stays null."""
    repl = {}
    for c, (lo, hi) in fences.items():
        x = F.col(c)
        repl[c] = (F.when(x.isNull(), x).when(x < C.dlit(lo), C.dlit(lo)).when(x > C.dlit(hi), C.dlit(hi))
                   .otherwise(x).cast(df.schema[c].dataType))
    return df.withColumns(repl) if repl else df


def cap_outliers(df: DataFrame, cols: Sequence[str], k: float = 3.0):
    """clip each column to its k x IQR fences. Returns
    ``(capped_df, report)`` where the report counts the capped cells per
    column; the fences (two values per column) are read once."""
    df = nan_to_null(df, cols)
    fences = outlier_fences(df, cols, k)
    fv = {r[NAME]: (r["lower"], r["upper"]) for r in fences.collect()}
    counts = [F.count_if((F.col(c) < C.dlit(lo)) | (F.col(c) > C.dlit(hi))).alias(c) for c, (lo, hi) in fv.items()] \
        + [F.lit(0).cast("long").alias(c) for c in cols if c not in fv]
    capped = clipped(df, fv)
    wide = df.agg(*counts)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    report = wide.selectExpr(f"stack({len(cols)}, {stack}) AS ({NAME}, n_capped)")
    report = report.join(fences, NAME, "left")
    return capped, report
