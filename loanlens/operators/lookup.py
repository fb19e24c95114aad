"""J1 dictionary lookups. Joins carry no hint: Spark broadcasts a side by
its measured size (``spark.sql.autoBroadcastJoinThreshold``, adaptive
execution) and otherwise shuffles and splits skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dict_frame(spark: SparkSession, mapping: dict, key: str, value: str,
               key_type: str = "string", value_type: str = "string") -> DataFrame:
    """A small dimension DataFrame from a Python dict (bounded by the dict)."""
    rows = [(k, v) for k, v in mapping.items()]
    return spark.createDataFrame(rows, f"{key} {key_type}, {value} {value_type}")


def lookup(df: DataFrame, dim: DataFrame, on: str, value: str, default=None,
           dim_key: str | None = None) -> DataFrame:
    """Left join ``dim`` on ``on`` and replace a missing ``value`` by
    ``default`` (pandas ``map(...).fillna(default)``)."""
    dim_key = dim_key or on
    d = dim.select(F.col(dim_key).alias("__lk_key"), F.col(value).alias("__lk_val"))
    out = df.join(d, F.col(on) == F.col("__lk_key"), "left")
    val = F.col("__lk_val") if default is None else F.coalesce(F.col("__lk_val"),
                                                                F.lit(default))
    return out.withColumn(value, val).drop("__lk_key", "__lk_val")
