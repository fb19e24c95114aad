"""Registry of named queries: a Spark function and, where SQL can express
it, its DuckDB twin. ``digits`` names double columns that both sides round
the same way (floor(x*10^k+.5)/10^k) so aggregate results hash alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loanlens.functions import columns as C
from loanlens.oracle import wrap_round


@dataclass
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    digits: dict[str, int] = field(default_factory=dict)


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, digits: dict[str, int] | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(fn, sql, dict(digits or {}))
        return fn
    return deco


def run_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    e = REGISTRY[name]
    df = e.run(spark, sf_dir)
    if e.digits:
        df = df.withColumns({c: C.round_half_up(c, k) for c, k in e.digits.items()})
    return df


def query_sql(name: str) -> str | None:
    e = REGISTRY[name]
    if e.sql is None:
        return None
    return wrap_round(e.sql, e.digits)


def load_all() -> dict[str, Entry]:
    """Import the catalog modules (they register on import)."""
    from loanlens.plans import (catalog_dist, catalog_eval, catalog_given,  # noqa: F401
                                catalog_models, catalog_sources, catalog_stats)
    return REGISTRY
