"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` of every linked node but the roots; a root is the least node it reaches.

    Alternates large and small stars until nothing changes: a number of rounds that
    grows with the logarithm of the longest path.  Minima are aggregated before the
    shuffle.  They are written before links are joined with them, so that both sides of
    such a join are shuffles of its own and Spark's adaptive execution splits a node with
    very many links.  Links of a node with itself, and null ends, are ignored.
    """
    a, b = F.col(left), F.col(right)
    edges = stage(
        links.filter(a != b).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct(), "links"
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            return edges
        before = tuple(state)
        both = edges.union(edges.select("root", "node")).toDF("node", "next")
        least = stage(both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("root")), "minima")
        large = stage(both.filter("next > node").join(least, "node").select(F.col("next").alias("node"), "root").distinct(), "large-stars")
        least = stage(large.groupBy("node").agg(F.min("root").alias("least")), "minima")
        moved = large.join(least, "node")
        small = moved.filter("root <> least").select("root", "least").union(least.select("node", "least"))
        edges = stage(small.toDF("node", "root").distinct(), "stars")
