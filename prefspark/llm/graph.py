"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.session import materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least_neighbour(both), "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them; every edge has u > v."""
    joined = edges.join(_least_neighbour(edges), "u")
    others = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(joined.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node that has an edge; ``edges`` has long columns u and v.

    Ends when the edges are stars; the number of rounds grows with the
    logarithm of the number of nodes.  Only two sums a round reach the driver.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct(), "edges")
    seen = None
    while True:
        now = materialize(_small_star(_large_star(now).distinct()).distinct(), "stars")
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
