"""Scaling and segmentation with given centroids.

Centroids are a k x d table with k small (the number of segments). They
are read to the driver once -- bounded by k, like Spark ML's KMeansModel,
which broadcasts its centers -- and become literal column expressions:
each row computes k squared distances and takes the first minimum. No row
is paired with anything else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens import constants as K
from loanlens.functions import columns as C
from loanlens.operators.lookup import dict_frame, lookup


def scaler_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M1 fit: one aggregate with mean and *population* std per column
    (sklearn's StandardScaler; Spark ML's uses the sample std)."""
    return df.agg(*[e for c in cols for e in (
        F.avg(F.col(c).cast("double")).alias(f"mean_{c}"),
        F.stddev_pop(F.col(c).cast("double")).alias(f"std_{c}"))])


def standard_scale(df: DataFrame, cols: Sequence[str], stats: dict | None = None,
                   fill: float | None = 0.0, keep: Sequence[str] = (),
                   prefix: str = "") -> DataFrame:
    """M1 transform: (x - mean) / std, a zero std scaling by 1. The fitted
    statistics (two numbers per column, from :func:`fit_scaler`) become
    literals of one projection. ``fill`` replaces nulls first (the
    reference's ``fillna(0)``)."""
    base = df if fill is None else df.na.fill(fill, subset=list(cols))
    stats = stats if stats is not None else fit_scaler(base, cols)
    out = []
    for c in cols:
        mu, sd = stats[f"mean_{c}"], stats[f"std_{c}"]
        scale = 1.0 if not sd else sd
        out.append(((F.col(c).cast("double") - C.dlit(mu)) / C.dlit(scale)).alias(prefix + c))
    return base.select(*keep, *out)


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict:
    """M1 fit, read to the driver: {mean_c, std_c} (bounded by #columns)."""
    return scaler_stats(df, cols).first().asDict()


def centroids_by(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Mean of each column per ``key`` value, ordered by key; row i is
    centroid i."""
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in cols]).orderBy(key)


def nearest_centroid(cols: Sequence[str], centers: Sequence[Sequence[float]]) -> Column:
    """0-based index of the closest centre (squared Euclidean, first
    minimum on ties)."""
    dists = []
    for center in centers:
        d = None
        for c, v in zip(cols, center):
            term = (F.col(c) - C.dlit(v)) * (F.col(c) - C.dlit(v))
            d = term if d is None else d + term
        dists.append(d)
    expr = None
    for i, di in enumerate(dists[:-1]):
        cond = None
        for dj in dists[i + 1:]:
            cmp = di <= dj
            cond = cmp if cond is None else cond & cmp
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    last = F.lit(len(dists) - 1)
    return last if expr is None else expr.otherwise(last)


def assign(df: DataFrame, cols: Sequence[str], centers: Sequence[Sequence[float]],
           out: str = "Cluster") -> DataFrame:
    return df.withColumn(out, nearest_centroid(cols, centers))


def cluster_profile(df: DataFrame, cols: Sequence[str], cluster: str = "Cluster",
                    score: str = "CreditScore", extra: Sequence[str] = ()) -> DataFrame:
    """A17 (+ J2): mean of the clustering features (and ``extra``) and the
    mean score per cluster, round 2, in one aggregate."""
    return df.groupBy(cluster).agg(
        *[C.round_half_up(F.avg(c), 2).alias(c) for c in [*cols, *extra]],
        C.round_half_up(F.avg(score), 2).alias("AvgCreditScore")).orderBy(cluster)


def cluster_sizes(df: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """Rows per cluster."""
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).orderBy(cluster)


def cluster_size_map(df: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """A18 as one row: the map ``sizes`` from cluster to rows."""
    sizes = cluster_sizes(df, cluster)
    return sizes.agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct(F.col(cluster).alias("key"), F.col("n").alias("value"))))).alias("sizes"))


def name_clusters(profile: DataFrame, cluster: str = "Cluster",
                  by: str = "AvgCreditScore",
                  names: Sequence[str] = tuple(K.CLUSTER_NAMES)) -> DataFrame:
    """K5 + M11: clusters ordered by mean score get Prime, Emerging,
    Rebuilder, At-Risk (the profile has one row per cluster)."""
    from loanlens.operators.stats import rank_groups
    return rank_groups(profile, by, names, cluster).select(cluster, "rank", "label")


def label_segments(df: DataFrame, labels: DataFrame, cluster: str = "Cluster",
                   out: str = "Cluster_Label") -> DataFrame:
    """Cluster -> name, default Emerging."""
    dim = labels.select(F.col(cluster).alias("__c"), F.col("label").alias(out))
    return lookup(df.withColumn("__c", F.col(cluster)), dim, "__c", out,
                  K.DEFAULT_SEGMENT).drop("__c")


def recommend(df: DataFrame, segment: str = "Marketing_Segment",
              out: str = "Recommended_Action") -> DataFrame:
    """Segment -> recommended action, default "Nurture campaign"."""
    dim = dict_frame(df.sparkSession, K.SEGMENT_ACTIONS, "__seg", out)
    return lookup(df.withColumn("__seg", F.col(segment)), dim, "__seg", out,
                  K.DEFAULT_ACTION).drop("__seg")
