"""Connected components over a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that can be reached, for each node that has a link to another one.

    Every round hangs larger neighbours on the smallest one known (large star) and then the rest (small star), both as
    pre-aggregated minima and joins; it ends when the links no longer change. Rounds are about the logarithm of the
    longest chain. Each round is checkpointed, so that a lost executor costs one round. No links: an empty table. Null
    ends are left out.
    """
    x, y = F.least(a, b), F.greatest(a, b)
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        y.alias("u"), x.alias("v")).distinct()
    edges = checkpointed(edges)
    sign = None
    while True:
        edges = _large_star(edges)
        edges = checkpointed(_small_star(edges))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        sign = now


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u")
    return (hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(hung.select("u", F.col("m").alias("v"))).where("u != v").distinct())
