"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import forget, written


def _nearest(edges: DataFrame) -> DataFrame:
    """u, v, m: m is the least of u and all its neighbours. Map-side minima and a join, so hubs are split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for all nodes of the edge list; the component is its least node.

    Every round is written to the shared folder; the number of rounds is logarithmic in the longest path.
    An empty list gives an empty table; loops and repeated edges are allowed.
    """
    nodes = edges.select(F.col(u).alias("node")).union(edges.select(F.col(v).alias("node"))).distinct()
    now = written(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "components")
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _nearest(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "components")
        forget(before)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            break
        state = new
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
