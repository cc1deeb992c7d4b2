"""Compaction of non-branching paths by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import Scratch


def unambiguous(edges: DataFrame) -> DataFrame:
    """Edges (a, b, ...) of which a has no other successor and b no other predecessor."""
    out = edges.groupBy("a").agg(F.count("*").alias("n")).where("n = 1").select("a")
    into = edges.groupBy("b").agg(F.count("*").alias("n")).where("n = 1").select("b")
    return edges.join(out, "a", "left_semi").join(into, "b", "left_semi")


def _cycle_starts(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(b): the smallest node of each cycle; edges hold cycles alone. Minima over doubled stretches are final once no node's changes."""
    now = scratch.put("cycles", edges.select(F.col("b").alias("node"), F.col("a").alias("up"), F.least("a", "b").alias("low"), F.lit(True).alias("changed")))
    while not now.where("changed").isEmpty():
        far = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        now = scratch.put("cycles", now.join(far, "up").select("node", F.col("up2").alias("up"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("changed")))
    return now.where("node = low").select(F.col("node").alias("b"))


def chain_positions(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, chain, position, shift) of paths of unambiguous edges (a, b, step).

    chain is the path's first node, position counts from 0 and shift sums the edges' steps from the first node; a cycle
    starts at its smallest node. The number of rounds is the logarithm of the longest path; each is one equi-join. In every
    round fewer nodes of a path are still on their way, so those left when their number stays the same are on cycles.
    """
    scratch = scratch or Scratch(edges.sparkSession, "chains")
    edges = scratch.put("edges", edges.where("a <> b").select("a", "b", F.col("step").cast("long").alias("step")))
    back = edges.select(F.col("b").alias("node"), F.col("a").alias("up"), F.lit(1).cast("long").alias("hops"), F.col("step").alias("shift"))
    heads = edges.select(F.col("a").alias("node")).join(edges.select(F.col("b").alias("node")), "node", "left_anti")
    now = scratch.put("now", back.unionAll(heads.select("node", F.col("node").alias("up"), F.lit(0).cast("long"), F.lit(0).cast("long"))))
    left, before = -1, None
    while left and left != before:
        far = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("shift").alias("shift2"))
        now = now.join(far, "up").select("node", F.col("up2").alias("up"), (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("shift") + F.col("shift2")).alias("shift"), (F.col("hops2") > 0).alias("moved"))
        now = scratch.put("now", now)
        before, left = left, now.where("moved").count()
    placed = now.where("NOT moved").select("node", F.col("up").alias("chain"), F.col("hops").alias("position"), "shift")
    if left:
        round_ = edges.join(now.where("moved").select(F.col("node").alias("b")), "b", "left_semi")
        opened = round_.join(_cycle_starts(round_, scratch), "b", "left_anti")
        placed = placed.unionAll(chain_positions(opened, Scratch(edges.sparkSession, "opened")))
    return placed
