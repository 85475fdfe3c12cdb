"""Connected components of a graph of links, as rounds of Spark joins.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): each round hangs every node's neighbours under the least of
them, until nothing moves. A node with very many links costs rows, not one task: minima
are combined before the shuffle and the joins are ones that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import discard, materialize


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v); component is the least node reachable."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "cc")
    seen = _checksum(edges)
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        # The minima are written, so that each join is of two plain shuffles: Spark splits those where a node has many links.
        first = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        large = both.join(first, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = materialize(large, "cc-large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        past, edges = edges, materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "cc")
        discard(first, large, least, past)
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
