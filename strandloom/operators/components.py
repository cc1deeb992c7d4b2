"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import Scratch


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node with an edge to another; a component is named by its smallest node.

    Alternating large and small stars: each round hooks neighbours to the smallest one, and the number of
    rounds grows with the logarithm of the component's size. Every round is a few aggregations and joins on the
    node; a hub's edges are combined before the shuffle and its join is split by AQE. The result reads the last
    round's table, "stars" of the scratch.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    now = scratch.put("stars", edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    stamp = _stamp(now)
    while stamp[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(low, "u")
        now = scratch.put("stars", hooked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        before, stamp = stamp, _stamp(now)
        if before == stamp:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionAll(roots)
