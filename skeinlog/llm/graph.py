"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _spread(pairs: DataFrame) -> DataFrame:
    """pairs (a, b): each a's least neighbour, itself included, joined to each of its pairs."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(least, "a")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges (a, b of type bigint) to (node, component): the least node reachable from each node of an edge.

    Alternating large-star and small-star rounds until nothing changes. A round aggregates with
    partial sums and joins on the node, so a hub's edges can be split by AQE; every round is stored
    in the shared folder, so a lost executor costs one round. Null ends and self-edges are no edges.
    """
    edges = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = common.store(edges)
    seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _spread(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = _spread(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = common.store(small)
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        common.drop_stored(edges)
        edges = after
        if now == seen:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
