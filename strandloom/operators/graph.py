"""Graph operators over vertex and edge tables.

edges: (a, b, ovlp) between vertex ends; a graph holds every edge in both directions.
vertices: (id, len, nsr, ...). For operators on sides, an edge's a is an oriented vertex 2 * id + side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import Scratch

LN2 = 0.6931471805599453


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """The longest edge of each (a, b)."""
    return edges.groupBy("a", "b").agg(F.max("ovlp").alias("ovlp"))


def amend_edges(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges whose target exists in ends (end) and answers with an edge of the same overlap."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "ovlp").distinct()
    return edges.join(ends.select(F.col("end").alias("b")), "b", "left_semi").join(back, ["a", "b", "ovlp"], "left_semi").select("a", "b", "ovlp")


def ambiguous_ends(ends: DataFrame) -> DataFrame:
    """Ends that more than one vertex claims."""
    return ends.groupBy("end").agg(F.count("*").alias("n")).where("n > 1").select("end")


def neighbor_cap(edges: DataFrame, most: int) -> DataFrame:
    """Edges of an end that are strictly longer than its (most + 1)-th; ends with up to `most` keep all."""
    nth = Window.partitionBy("a").orderBy(F.desc("ovlp"))
    limit = edges.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") == most + 1).select("a", F.col("ovlp").alias("limit"))
    return edges.join(limit, "a", "left").where(F.col("limit").isNull() | (F.col("ovlp") > F.col("limit"))).select("a", "b", "ovlp")


def relative_edges(edges: DataFrame, ratio: float) -> DataFrame:
    """Edges that reach ratio times the second longest of their end (the longest where there is one alone), rounded to a whole number of bases."""
    order = Window.partitionBy("a").orderBy(F.desc("ovlp")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.coalesce(F.nth_value("ovlp", 2).over(order), F.col("ovlp"))
    return edges.withColumn("second", second).where(F.col("ovlp") >= F.floor(ratio * F.col("second") + 0.499)).select("a", "b", "ovlp")


def weak_edges(edges: DataFrame, min_overlap: int, ratio: float, tips: DataFrame | None = None, oriented: bool = False) -> DataFrame:
    """What stays of edges once weak ones are gone in both directions.

    Weak: below min_overlap, or below ratio times the end's reference: its longest overlap, min_overlap at least, and
    min_overlap where the longest leads to a tip (tips: end). Of equal longest edges the smallest target decides. The edges
    that start at a tip are not looked at from there. The other direction of (a, b) is (b, a), or (b ^ 1, a ^ 1) of oriented vertices.
    """
    longest = edges.groupBy("a").agg(F.max(F.struct("ovlp", (-F.col("b")).alias("order"))).alias("top")).select("a", F.col("top.ovlp").alias("top"), (-F.col("top.order")).alias("target"))
    if tips is not None:
        flags = tips.select(F.col("end").alias("target"), F.lit(True).alias("tip")).distinct()
        longest = longest.join(flags, "target", "left").withColumn("top", F.when(F.col("tip"), F.lit(min_overlap)).otherwise(F.col("top")))
    reference = longest.select("a", F.greatest("top", F.lit(min_overlap)).alias("reference"))
    weak = edges.join(reference, "a").where((F.col("ovlp") < min_overlap) | (F.col("ovlp") / F.col("reference") < ratio)).select("a", "b")
    if tips is not None:
        weak = weak.join(tips.select(F.col("end").alias("a")).distinct(), "a", "left_anti")
    flip = F.lit(1 if oriented else 0).cast("long")
    gone = weak.unionAll(weak.select(F.col("b").bitwiseXOR(flip).alias("a"), F.col("a").bitwiseXOR(flip).alias("b"))).distinct()
    return edges.join(gone, ["a", "b"], "left_anti").select("a", "b", "ovlp")


def tips(vertices: DataFrame, edges: DataFrame, max_len: int, max_nsr: int) -> DataFrame:
    """Vertices shorter than max_len with fewer than max_nsr reads and a side without neighbours (edges leave 2 * id + side)."""
    sides = edges.select(F.floor(F.col("a") / 2).alias("id"), (F.col("a") % 2).alias("side")).distinct().groupBy("id").agg(F.count("*").alias("sides"))
    return vertices.join(sides, "id", "left").where((F.col("len") < max_len) & (F.col("nsr") < max_nsr) & (F.coalesce("sides", F.lit(0)) < 2)).drop("sides")


def drop_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the vertices of gone (id)."""
    ids = gone.select("id").distinct()
    ends = ids.select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("end"))
    left = edges.join(ends.select(F.col("end").alias("a")), "a", "left_anti").join(ends.select(F.col("end").alias("b")), "b", "left_anti")
    return vertices.join(ids, "id", "left_anti"), left.select("a", "b", "ovlp")


def _apart(waiting: DataFrame, edges: DataFrame) -> DataFrame:
    """Of waiting (id, nsr), those without a waiting neighbour that comes before them by (nsr, id)."""
    near = edges.select(F.shiftright("a", 1).alias("id"), F.shiftright("b", 1).alias("other")).where("id <> other").distinct()
    other = waiting.select(F.col("id").alias("other"), F.col("nsr").alias("other_nsr"))
    pairs = near.join(waiting, "id").join(other, "other")
    later = pairs.where(F.struct("other_nsr", "other") < F.struct("nsr", "id")).select("id").distinct()
    return waiting.join(later, "id", "left_anti")


def bridge_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame, min_overlap: int) -> tuple[DataFrame, DataFrame]:
    """drop_vertices, with edges from before to after a vertex where they would overlap by min_overlap at least.

    Neighbours don't go at once: each round takes those that come before all their neighbours by (nsr, id), until none is left, so a path over several of them
    is bridged as one after the other would. Rounds are as many as the longest run of neighbours in that order.
    """
    scratch = Scratch(vertices.sparkSession, "bridges")
    waiting = scratch.put("waiting", gone.select("id").distinct().join(vertices.select("id", "nsr", "len"), "id"))
    kept = vertices.join(gone.select("id").distinct(), "id", "left_anti")
    while not waiting.isEmpty():
        now = scratch.put("now", _apart(waiting, edges))
        oriented = now.select("len", F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("v"))
        into = edges.select("a", F.col("b").alias("v"), F.col("ovlp").alias("o1")).join(oriented, "v")
        past = edges.select(F.col("a").alias("v"), "b", F.col("ovlp").alias("o2"))
        bridged = into.join(past, "v").select("a", "b", (F.col("o1") + F.col("o2") - F.col("len")).cast("int").alias("ovlp")).where((F.col("ovlp") >= min_overlap) & (F.col("a") != F.col("b")))
        ends = oriented.select("v")
        whole = edges.unionAll(bridged)
        left = whole.join(ends.select(F.col("v").alias("a")), "a", "left_anti").join(ends.select(F.col("v").alias("b")), "b", "left_anti")
        edges = scratch.put("edges", dedupe_edges(left.select("a", "b", "ovlp")))
        waiting = scratch.put("waiting", waiting.join(now.select("id"), "id", "left_anti"))
    return kept, dedupe_edges(edges)


def likely_unique(vertices: DataFrame, floor: float = 20.0) -> DataFrame:
    """Vertices whose A-statistic says that they are there once."""
    return vertices.join(a_statistic(vertices).where(F.col("a") >= floor), "id")


def read_distance(vertices: DataFrame, passes: int = 2, floor: float = 20.0) -> DataFrame:
    """One row (rdist, reads): bases for each read over the vertices with the most reads that hold half of all.

    The second pass leaves out vertices whose A-statistic under the first distance is below floor. len - maxo is a vertex's
    own length. Vertices are summed by their number of reads, so the running total goes over one row for each number.
    """
    total = vertices.agg(F.sum("nsr").alias("total"))
    order = Window.orderBy(F.desc("nsr")).rowsBetween(Window.unboundedPreceding, -1)
    now = vertices.withColumn("own", F.col("len") - F.col("maxo"))
    rdist = None
    for _ in range(passes):
        rows = now if rdist is None else now.crossJoin(F.broadcast(rdist)).where(F.col("own") / F.col("rdist") - F.col("nsr") * LN2 >= floor).drop("rdist", "reads")
        groups = rows.groupBy("nsr").agg(F.sum("nsr").alias("reads"), F.sum("own").alias("bases")).withColumn("before", F.coalesce(F.sum("reads").over(order), F.lit(0)))
        half = groups.crossJoin(F.broadcast(total)).where(F.col("before") < F.col("total") * 0.5)
        rdist = half.agg((F.sum("bases") / F.sum("reads")).alias("rdist"), F.sum("reads").alias("reads"))
    return rdist


def genome_size(vertices: DataFrame) -> DataFrame:
    """(size): the read distance times all reads."""
    return read_distance(vertices).crossJoin(vertices.agg(F.sum("nsr").alias("n"))).select(F.floor(F.col("rdist") * F.col("n") + 0.5).alias("size"))


def a_statistic(vertices: DataFrame) -> DataFrame:
    """(id, a): how sure a vertex is to be there once; a missing maxo is the average one."""
    mean = vertices.agg(F.avg("maxo").alias("mean"))
    rows = vertices.crossJoin(F.broadcast(mean)).withColumn("maxo", F.coalesce("maxo", "mean"))
    return rows.crossJoin(F.broadcast(read_distance(vertices))).select("id", ((F.col("len") - F.col("maxo")) / F.col("rdist") - F.col("nsr") * LN2).alias("a"))


def bubbles(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(arm1, arm2, source, sink): two oriented arms, each with one neighbour on both sides, between the same ends. arm1 < arm2."""
    out = edges.groupBy("a").agg(F.count("*").alias("n_out"), F.min("b").alias("sink")).where("n_out = 1")
    into = edges.groupBy("b").agg(F.count("*").alias("n_in"), F.min("a").alias("source")).where("n_in = 1")
    arms = out.join(into, F.col("a") == F.col("b")).select(F.col("a").alias("arm"), "source", "sink")
    fork = edges.groupBy(F.col("a").alias("source")).agg(F.count("*").alias("n")).where("n = 2").select("source")
    arms = arms.join(fork, "source", "left_semi")
    pair = arms.groupBy("source", "sink").agg(F.sort_array(F.collect_list("arm")).alias("arms")).where(F.size("arms") == 2)
    rows = pair.select(F.col("arms")[0].alias("arm1"), F.col("arms")[1].alias("arm2"), "source", "sink")
    return rows.where((F.floor(F.col("arm1") / 2) != F.floor(F.col("arm2") / 2)) & (F.col("source") < F.col("sink").bitwiseXOR(F.lit(1).cast("long"))))
