"""Connected components of an edge table by alternating large-star and
small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014). Rounds run as DataFrame joins; each round's edges are written
to the shared folder. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import stored


def _finished(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars: one v for each u, and no u that is
    a v. Then every v is the smallest node of its component."""
    again = edges.groupBy("u").count().where("count > 1").select("u")
    inner = edges.join(edges.select(F.col("v").alias("w")), F.col("u") == F.col("w"), "left_semi")
    return again.union(inner.select("u")).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.join(least, "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (edges.join(least, "u").where("v <> m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (u long, v long) -> (node long, root long): every node that
    has a link to another node, with the smallest node it can reach. Rows with
    a null or with u = v are no links. No links: no rows."""
    edges = stored(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(), "edges")
    while not _finished(edges):
        edges = stored(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
