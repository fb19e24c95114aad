"""Distributed ordered statistics: cumulative counts, exact
quantiles and global ranks, without moving a whole group to one task.

Recipe:
  1. collapse rows to ``(keys, x, cnt)``; partial aggregation means a value
     held by a third of all rows becomes a single row per map task;
  2. ``repartitionByRange`` on ``(keys, x)`` and record ``spark_partition_id``;
     the frame is checkpointed so both passes see the same partitions;
  3. per (partition, keys) totals form a table of at most
     ``#partitions + #keys`` rows; a window over it gives each partition the
     count of everything before it (the offset);
  4. each range partition, sorted locally, streams through one task that
     keeps an exclusive running sum per key across Arrow batches (the local
     prefix). This keeps the range partitioning: a ``Window`` partitioned by
     (partition id, keys) would re-shuffle the whole table first, because
     range partitioning on (keys, x) does not satisfy that clustering.
     offset + prefix = number of rows strictly before ``x`` in its key.
No step keeps more than one range partition's distinct values in one task,
and no task holds more than one Arrow batch plus one running total per key.
The same recipe runs at every size.

Quantiles interpolate linearly between order statistics like pandas and
DuckDB's ``quantile_cont``: with h = (n-1)p, value = x[floor h] +
(x[ceil h] - x[floor h]) * (h - floor h).
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.session import materialize

NAME = "feature"

# Task functions are serialised by value: executors need only pandas/numpy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _num_partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Unpivot ``cols`` to ``(by..., column, x DOUBLE)``, nulls dropped (P5)."""
    by = list(by)
    structs = [F.struct(F.lit(c).alias(NAME), F.col(c).cast("double").alias("x"))
               for c in cols]
    out = df.select(*by, F.explode(F.array(*structs)).alias("__kv"))
    out = out.select(*by, F.col(f"__kv.{NAME}").alias(NAME), F.col("__kv.x").alias("x"))
    return out.where(F.col("x").isNotNull() & ~F.isnan("x"))


def value_counts(long_df: DataFrame, keys: Sequence[str], value: str = "x") -> DataFrame:
    """Collapse to one row per distinct ``(keys, value)`` with its multiplicity."""
    return long_df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))


def _schema_bounded(keys: Sequence[str]) -> bool:
    """True when the only keys are the unpivoted column name (or none): the
    number of key values is then bounded by the schema, not by the data."""
    return all(k == NAME for k in keys)


def _local_prefix(ranged: DataFrame, keys: Sequence[str], order_cols: Sequence,
                  weights: Sequence[str]) -> DataFrame:
    """Step 4: ``__loc{i}`` = sum of weight i over the rows of the same keys
    that come earlier *in this partition*, computed in place (narrow:
    ``sortWithinPartitions`` + ``mapInPandas``, no shuffle). The running
    totals are carried across batches in a dict with one entry per key
    value seen in the partition."""
    keys, wcols = list(keys), list(weights)
    nw = len(wcols)
    locs = [f"__loc{i}" for i in range(nw)]
    schema = T.StructType(ranged.schema.fields
                          + [T.StructField(c, T.LongType(), False) for c in locs])

    def norm(v):
        return None if pd.isna(v) else v

    def run(batches):
        carry: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            w = pdf[wcols].fillna(0).to_numpy(dtype=np.int64).reshape(len(pdf), nw)
            if len(pdf) == 0:
                excl = w
            elif keys:
                g = pdf.groupby(keys, sort=False, dropna=False)
                codes = g.ngroup().to_numpy()
                firsts = g.head(1)
                uniq = [tuple(norm(v) for v in row)
                        for row in firsts[keys].itertuples(index=False, name=None)]
                base = np.array([carry.get(u, np.zeros(nw, np.int64)) for u in uniq])
                incl = pd.DataFrame(w).groupby(codes, sort=False).cumsum().to_numpy()
                excl = incl - w + base[codes]
                tot = np.zeros((len(uniq), nw), np.int64)
                np.add.at(tot, codes, w)
                for j, u in enumerate(uniq):
                    carry[u] = base[j] + tot[j]
            else:
                base = carry.get((), np.zeros(nw, np.int64))
                excl = np.cumsum(w, axis=0) - w + base
                carry[()] = base + w.sum(axis=0)
            yield pdf.assign(**{c: excl[:, i] for i, c in enumerate(locs)})

    return ranged.sortWithinPartitions(*[F.col(k) for k in keys], *order_cols) \
        .mapInPandas(run, schema)


def cumulative_before(counted: DataFrame, keys: Sequence[str], order: Sequence,
                      weight="cnt", out="before", with_totals: bool = False):
    """Add ``out`` = sum of ``weight`` over rows of the same ``keys`` that come
    strictly before this row in ``order`` (rows must be distinct in ``order``
    within a key). ``weight``/``out`` may be lists for several running sums.
    With ``with_totals`` also return the per-key totals of the first weight
    ``(keys..., n)``, read from the small partition table."""
    keys = list(keys)
    weights = [weight] if isinstance(weight, str) else list(weight)
    outs = [out] if isinstance(out, str) else list(out)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    n = _num_partitions(counted)
    ranged = counted.repartitionByRange(n, *[F.col(k) for k in keys], *order_cols)
    ranged = materialize(ranged.withColumn("__pid", F.spark_partition_id()))

    totals = ranged.groupBy("__pid", *keys).agg(
        *[F.sum(w).alias(f"__ptot{i}") for i, w in enumerate(weights)])
    w_off = (Window.partitionBy(*keys).orderBy("__pid")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("__pid", *keys, *[
        F.coalesce(F.sum(f"__ptot{i}").over(w_off), F.lit(0)).alias(f"__off{i}")
        for i in range(len(weights))])
    local = _local_prefix(ranged, keys, order_cols, weights)
    # offsets: at most #partitions x #key values rows
    # null-safe on the keys: a null group is a group too
    offsets = offsets.select("__pid", *[F.col(k).alias(f"__ok_{k}") for k in keys],
                             *[f"__off{i}" for i in range(len(weights))]) \
        .withColumnRenamed("__pid", "__opid")
    cond = [F.col("__pid") == F.col("__opid")] + [F.col(k).eqNullSafe(F.col(f"__ok_{k}"))
                                                   for k in keys]
    joined = local.join(offsets, cond, "inner") \
        .drop("__opid", *[f"__ok_{k}" for k in keys])
    result = joined.withColumns({
        o: (F.col(f"__off{i}") + F.col(f"__loc{i}")).cast("long") for i, o in enumerate(outs)})
    result = result.drop("__pid", *[f"__off{i}" for i in range(len(weights))],
                         *[f"__loc{i}" for i in range(len(weights))])
    if with_totals:
        return result, totals.groupBy(*keys).agg(F.sum("__ptot0").cast("long").alias("n"))
    return result


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """``(by..., column, p, value)``: exact interpolated quantiles of each
    column per group of ``by`` (nulls ignored)."""
    by = list(by)
    keys = by + [NAME]
    counted = value_counts(long_values(df, cols, by), keys)
    ranked, sizes = cumulative_before(counted, keys, ["x"], with_totals=True)
    return quantiles_at(ranked, sizes, keys, probs)


def quantiles_at(ranked: DataFrame, sizes: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(keys..., p, value)`` from values with their counts and the numbers of
    rows before them, and the keys' numbers of rows ``n``."""
    keys = list(keys)
    p_arr = F.array(*[F.lit(float(p)) for p in probs])
    targets = (sizes.select(*keys, "n", F.explode(p_arr).alias("p"))
               .withColumn("h", (F.col("n") - 1).cast("double") * F.col("p"))
               .withColumn("k_lo", F.floor("h").cast("long"))
               .withColumn("k_hi", F.ceil("h").cast("long"))
               .withColumn("frac", F.col("h") - F.col("k_lo").cast("double")))
    pos = targets.select(*[F.col(k).alias(f"__t_{k}") for k in keys], "p", "frac",
                         F.explode(F.array(
                             F.struct(F.lit("lo").alias("side"), F.col("k_lo").alias("k")),
                             F.struct(F.lit("hi").alias("side"), F.col("k_hi").alias("k"))))
                         .alias("t")).select(*[f"__t_{k}" for k in keys], "p", "frac",
                                             "t.side", "t.k")
    if _schema_bounded(keys):
        pos = F.broadcast(pos)  # #columns x #probs x 2 rows, whatever the data
    cond = [F.col(k).eqNullSafe(F.col(f"__t_{k}")) for k in keys] + [
        F.col("k") >= F.col("before"), F.col("k") < F.col("before") + F.col("cnt")]
    hit = ranked.join(pos, cond, "inner").select(*keys, "p", "frac", "side", "x")
    pairs = hit.groupBy(*keys, "p", "frac").agg(
        F.max(F.when(F.col("side") == "lo", F.col("x"))).alias("x_lo"),
        F.max(F.when(F.col("side") == "hi", F.col("x"))).alias("x_hi"))
    return pairs.select(*keys, "p", (F.col("x_lo") + (F.col("x_hi") - F.col("x_lo"))
                                     * F.col("frac")).alias("value"))


def quantiles_wide(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``exact_quantiles`` with one column per probability, named ``names``."""
    q = exact_quantiles(df, cols, probs, by)
    aggs = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(nm)
            for p, nm in zip(probs, names)]
    return q.groupBy(*by, NAME).agg(*aggs)


def global_positions(df: DataFrame, value: str, keys: Sequence[str] = (),
                     with_totals: bool = False):
    """Per distinct ``(keys, value)``: ``cnt`` and ``before`` (rows strictly
    before it). Rows with that value occupy 0-based positions
    ``before .. before+cnt-1`` of the ascending order. With ``with_totals``
    also the rows per key."""
    keys = list(keys)
    base = df.select(*keys, F.col(value).cast("double").alias("x")).where(
        F.col("x").isNotNull() & ~F.isnan("x"))
    return cumulative_before(value_counts(base, keys), keys, ["x"], with_totals=with_totals)


def repeated(counted: DataFrame, chunk: int = 100_000) -> DataFrame:
    """One row per data point of a table with counts ``cnt``; a heavily
    repeated value is dealt over tasks in chunks of at most ``chunk`` rows."""
    once, more = counted.where("cnt = 1"), counted.where("cnt > 1")
    return once.unionByName(expand_positions(more.withColumn("before", F.lit(0).cast("long")), chunk)
                            .drop("before", "i").select(*counted.columns))


def expand_positions(positions: DataFrame, chunk: int = 100_000) -> DataFrame:
    """One row per data point with its 0-based position ``i`` from the
    ``(x, cnt, before)`` table. A heavily repeated value is first split into
    chunks of at most ``chunk`` rows, which are spread over tasks, so no task
    materialises an unbounded array."""
    nchunks = ((F.col("cnt") + F.lit(chunk - 1)) / F.lit(chunk)).cast("long")
    chunks = positions.select("*", F.explode(F.sequence(F.lit(0).cast("long"),
                                                        nchunks - 1)).alias("__c"))
    chunks = chunks.repartition(_num_partitions(positions))
    start = F.col("before") + F.col("__c") * F.lit(chunk)
    stop = F.least(F.col("before") + F.col("cnt"), start + F.lit(chunk)) - 1
    return chunks.select("*", F.explode(F.sequence(start, stop)).alias("i")) \
                 .drop("__c")
