"""Customer-table sources and sinks (S1-S5, S9) and the analysis base table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import constants as K
from loanlens.functions.derive import derive, enrich
from loanlens.operators.clean import fill_medians, fit_medians, nan_to_null
from loanlens.sources.fixtures import profiles
from loanlens.store import stored_value


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis base: ``profiles`` + load-path derivations (train mode) +
    descriptive bands. Nulls are kept (the statistics drop them per column).
    A projection over the stored profiles: an analysis reads and derives only
    the columns it uses."""
    return enrich(derive(profiles(spark, sf_dir), "train"))


def load_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's load path (E-1): the analysis base with every numeric
    null replaced by the column's exact median (P3). The medians are found once
    for the input's content and become literals of a projection."""
    base = customers(spark, sf_dir)
    return fill_medians(base, stored_value("medians", spark, sf_dir, lambda: fit_medians(base)))


def null_tokens(df: DataFrame, tokens: Sequence[str] = tuple(K.PANDAS_NA_TOKENS)) -> DataFrame:
    """Null every string cell that equals one of ``tokens`` (pandas' CSV
    reader treats "NA", "None", "nan", ... as missing)."""
    toks = list(tokens)
    exprs = [(F.when(F.col(f.name).isin(toks), F.lit(None).cast("string"))
              .otherwise(F.col(f.name)).alias(f.name)
              if isinstance(f.dataType, T.StringType) else F.col(f.name))
             for f in df.schema.fields]
    return df.select(*exprs)


def _inferred_types(cells: DataFrame) -> dict[str, str]:
    """Column types of a table of strings, from one aggregate: int or bigint
    when every cell that is there is a whole number, else double when every
    cell is a number, else string."""
    whole = r"^[+-]?[0-9]{1,18}$"
    checks = []
    for c in cells.columns:
        x = F.col(f"`{c}`")
        checks += [F.count(x).alias(f"{c}__n"), F.count_if(x.rlike(whole)).alias(f"{c}__int"),
                   F.max(F.when(x.rlike(whole), F.abs(x.try_cast("bigint")))).alias(f"{c}__max"),
                   F.count(x.try_cast("double")).alias(f"{c}__num")]
    seen = cells.agg(*checks).first()
    out = {}
    for c in cells.columns:
        n = seen[f"{c}__n"]
        if n and seen[f"{c}__int"] == n:
            out[c] = "int" if seen[f"{c}__max"] < 2 ** 31 else "bigint"
        else:
            out[c] = "double" if n and seen[f"{c}__num"] == n else "string"
    return out


def read_customers(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   na_tokens: Sequence[str] = tuple(K.PANDAS_NA_TOKENS),
                   fmt: str | None = None) -> DataFrame:
    """CSV (header) or parquet scan of a customer table; ``fmt`` is "csv"
    or "parquet" (default: by the suffix .csv, else parquet).

    CSV cells are read as text, the listed NA tokens become null, and only
    then the cells are typed, so a numeric column with "NA" or "NaN" in it
    stays numeric. Types come from ``schema``, or from one inference pass; a
    cell that does not parse becomes null. NaN in a float column is null."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return nan_to_null(null_tokens(df, na_tokens) if na_tokens else df)
    cells = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    cells = null_tokens(cells, na_tokens) if na_tokens else cells
    types = ({f.name: f.dataType.simpleString() for f in schema.fields} if schema is not None
             else _inferred_types(cells))
    typed = cells.select(*[(F.col(f"`{c}`").try_cast(types[c]) if c in types
                            else F.col(f"`{c}`")).alias(c) for c in cells.columns])
    return nan_to_null(typed)


class MissingColumnsError(ValueError):
    pass


def check_required(df: DataFrame, required: Sequence[str] = tuple(K.REQUIRED_BATCH_COLUMNS)):
    """Exact-case check of the required batch columns (Spark's own
    resolution is case-insensitive, so the check compares names directly)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing required columns: {', '.join(missing)}")
    return df


def read_batch(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Scan a batch to score and verify the required columns."""
    return check_required(read_customers(spark, path, **kw))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """S3: distributed write (CSV with header, or parquet)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def template(df: DataFrame, key: str = "RespondentID", n: int = 10,
             cols: Sequence[str] = tuple(K.REQUIRED_BATCH_COLUMNS)) -> DataFrame:
    """The required columns of the first ``n`` rows (by ``key``)."""
    present = [c for c in cols if c in df.columns]
    return df.orderBy(key).limit(n).select(key, *present)


def preview(df: DataFrame, n: int, cols: Sequence[str] | None = None,
            key: str = "RespondentID") -> DataFrame:
    """First ``n`` rows in key order, optionally a column subset."""
    chosen = [c for c in (cols or df.columns) if c in df.columns]
    if key not in chosen:
        chosen = [key] + chosen
    return df.orderBy(key).limit(n).select(*chosen)
