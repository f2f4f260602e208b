"""Connected components by alternating star contraction.

A large star step links each node's larger neighbours to the smallest node
it sees; a small star step does so with its smaller neighbours. Both keep
the components, and together they turn every component into one star around
its smallest node in about log(n) rounds. Each step is an aggregation and a
join; nothing is gathered on the driver but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spill


def _smallest_seen(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest node among u and its neighbours v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``u, v``, long):
    the smallest node that links reach. Nodes without a link are left out."""
    edges = spill(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .filter("u > v").distinct(), "cc-edges")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest_seen(both)
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = spill(large.filter("u != v").distinct(), "cc-large")
        # Every u is larger than its v here, so all neighbours in the table are smaller.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        edges = spill(small.filter("u != v").distinct(), "cc-small")
        # Done when every node is either a centre or has one edge, to a centre.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        unsettled = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not unsettled.filter("up + down > 1").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
