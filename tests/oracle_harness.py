"""Spark-vs-DuckDB comparison used by the tests (mirrors the driver's gate:
row count, column names, order-insensitive values)."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duck(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0)
                                           for x in r))


def compare(spark_df, sql: str, sf_dir: str, rel_tol: float = 0.0):
    """Return (ok, message)."""
    s = spark_df.toPandas()
    d = duck(sql, sf_dir)
    if sorted(s.columns) != sorted(d.columns):
        return False, f"columns differ: {sorted(s.columns)} vs {sorted(d.columns)}"
    if len(s) != len(d):
        return False, f"row count {len(s)} vs {len(d)}"
    rs, rd = rows_of(s), rows_of(d)
    cols = sorted(s.columns)
    bad = 0
    first = None
    for a, b in zip(rs, rd):
        for name, x, y in zip(cols, a, b):
            same = x == y
            if not same and rel_tol and isinstance(x, (int, float)) and isinstance(y, (int, float)):
                same = math.isclose(x, y, rel_tol=rel_tol, abs_tol=rel_tol)
            if not same:
                bad += 1
                if first is None:
                    first = (name, x, y)
    if bad:
        return False, f"{bad} cell(s) differ, first {first}"
    return True, f"{len(s)} rows equal"
