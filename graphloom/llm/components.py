"""Connected components by alternating large-star and small-star, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``: the smallest node that each node reaches.

    Large-star links every larger neighbour of a node to the smallest node about; small-star does so
    for the smaller neighbours. Either is a ``min`` per node (combined before the shuffle) joined back
    to the edges, so no neighbour list is ever gathered, however large a hub is. Each round is
    written to the shared folder. Nodes without an edge to another node aren't in the result; null
    ends and self-loops are ignored, repeated edges count once, no edges give no rows.
    """
    link = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    link = materialise(link.where("a < b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = link.union(link.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small_low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(small_low, "u")
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a < b")
            .distinct()
        )
        old, link = link, materialise(small, "stars")
        discard(old)
        state = link.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = link.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return link.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
