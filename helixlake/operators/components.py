"""Connected components as DataFrames: alternating large-star and small-star rounds, each cut by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.runtime import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge list; ``root`` is the least node of its component.

    Null ends and loops are ignored, repeated edges count once.  A hub's neighbours are never gathered: each star step takes the
    least neighbour by a partial aggregate and joins it back.  Raises ``RuntimeError`` if ``max_rounds`` (rounds grow with the
    logarithm of the size) don't suffice.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(e):
            break
        # Large star: every larger neighbour of u is linked to u's least neighbour.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every smaller neighbour of u, and u, is linked to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _settled(e: DataFrame) -> bool:
    """Whether the links are stars: each node has one link, to a node that has none.  The rounds keep components together, so stars are
    components."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 OR out > 0 AND into > 0").isEmpty()
