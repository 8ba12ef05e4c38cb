"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, packed


def _pairs(df: DataFrame, u: str, v: str) -> DataFrame:
    return df.select(F.col(u).alias("u"), F.col(v).alias("v"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: (u, v) ids. Returns (id, component): the smallest id reachable, for every id that isn't that itself.

    Large-star and small-star rounds in turn hang every node below the
    smallest neighbour known, until nothing moves; their number grows with the
    logarithm of the longest path. Each round is written to the checkpoint
    folder, in as many partitions as the edges fill.
    """
    rows = edges.count()
    stars = cut(packed(packed(edges, rows).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows))
    seen, written = None, stars
    while True:
        # Large star: larger neighbours of each node move to its smallest neighbour.
        both = packed(stars.unionByName(_pairs(stars, "v", "u")), rows)
        least = packed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), rows)
        stars = packed(packed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), rows).distinct(), rows)
        # Small star: smaller neighbours of each node, and the node, move to the smallest of them.
        least = packed(stars.groupBy("u").agg(F.min("v").alias("m")), rows)
        moved = stars.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, stars = written, cut(packed(packed(moved.unionByName(_pairs(least, "u", "m")), rows).distinct(), rows))
        discard(old)
        written = stars
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now
