"""Closing gaps between linked contig ends by assembling the reads around each, all links at once.

The sequences around a link are a group of their own: the overlaps of reads, unitigs and cleaning run once over the reads of all
links, and only sequences of one link overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequences import revcomp
from strandloom.operators.align import align
from strandloom.operators.assembly import read_graph
from strandloom.operators.cleaning import Cleaning, merge_graph, pop_bubbles, remove_tips, simplify_bubbles
from strandloom.operators.scaffold import link_p_values
from strandloom.session import Scratch

PATCHES = ["end_a", "end_b", "l", "back", "patch", "p"]
#: An overlap of ends: fewer bases beyond it than MOST_LOOSE, and a score of LEAST_SCORE and one for each of them (fixed values).
MOST_LOOSE, LEAST_SCORE = 7, 13


def tails(links: DataFrame, contigs: DataFrame, reach: int) -> DataFrame:
    """(end_a, end_b, t0, t1): up to `reach` bases of both contigs as they lie before and after the gap."""

    def side(end: str, name: str, before: bool) -> DataFrame:
        own = contigs.select(F.col("contig").alias("of"), "seq")
        at = links.select("end_a", "end_b").join(own, F.floor(F.col(end) / 2) == F.col("of"))
        turned = F.when(F.col(end) % 2 == (1 if before else 0), F.col("seq")).otherwise(revcomp(F.col("seq")))
        return at.select("end_a", "end_b", (F.right(turned, F.lit(reach)) if before else F.left(turned, F.lit(reach))).alias(name))

    return side("end_a", "t0", True).join(side("end_b", "t1", False), ["end_a", "end_b"])


def local_patches(ends: DataFrame, around: DataFrame, min_overlap: int, reach: int) -> DataFrame:
    """(end_a, end_b, l, patch): gaps closed by the longest unitig of tails (end_a, end_b, t0, t1) and reads (end_a, seq), if it holds both tails in order.

    l bases of patch lie between the contigs; where l is below 0, they overlap by so many.
    """
    scratch = Scratch(ends.sparkSession, "patching")
    tips_ = ends.select("end_a", F.explode(F.array("t0", "t1")).alias("s"))
    local = scratch.put("local", tips_.unionAll(around.select("end_a", F.col("seq").alias("s"))).distinct().where("NOT contains(s, 'N')").select("end_a", "s", F.monotonically_increasing_id().alias("rid")))
    vertices, edges = merge_graph(*read_graph(local, min_overlap, group="end_a"))
    vertices, edges = merge_graph(*remove_tips(vertices, edges, int(reach * 1.1), 4))
    vertices, edges = merge_graph(*simplify_bubbles(vertices, edges, 25, 2 * reach))
    vertices, edges = merge_graph(*pop_bubbles(vertices, edges, Cleaning(aggressive=True)))
    best = vertices.join(local.select(F.col("rid").alias("id"), "end_a"), "id").groupBy("end_a").agg(F.max(F.struct("len", "seq")).alias("top")).select("end_a", F.col("top.seq").alias("s"))
    rows = ends.join(best, "end_a")
    found = rows.select("end_a", "end_b", "t0", "t1", F.explode(F.array("s", revcomp(F.col("s")))).alias("s"))
    found = found.withColumn("a", F.expr("locate(t0, s)")).withColumn("b", F.expr("locate(t1, s)")).where("a > 0 AND b > a").withColumn("l", (F.col("b") - F.col("a") - F.length("t0")).cast("int"))
    one = found.groupBy("end_a", "end_b").agg(F.min(F.struct("l", F.expr("CASE WHEN l > 0 THEN substring(s, a + length(t0), l) ELSE '' END").alias("patch"))).alias("x"))
    return one.select("end_a", "end_b", "x.l", "x.patch")


def overlap_patches(links: DataFrame, contigs: DataFrame, distances: DataFrame, avg: float, std: float, reach: int, read_len: int) -> DataFrame:
    """PATCHES of links (end_a, end_b, avg_dist) whose pairs lie farther apart than inserts are long: contigs that overlap, though not to the letter.

    The tails are aligned (1 for a match, -3 for a mismatch, a gap of n costs 5 + 2 * n). What of the left tail lies after the alignment and of the right one before it
    is loose: one of both is nothing, the other shorter than MOST_LOOSE, and the score reaches LEAST_SCORE and the loose bases. The loose ones count as overlap on both contigs,
    so the right one loses -l bases, or, read the other way round, the left one -back, and neither is used up.
    """
    far = links.where(F.col("avg_dist") > avg).select("end_a", "end_b")
    found = align(tails(far, contigs, reach), "t1", "t0", whole=True, match=1, mismatch=-3, gap_open=5, gap_extend=2)
    before, after = F.col("query_start"), F.length("t0") - F.col("target_end") - 1
    loose = F.greatest(before, after)
    found = found.where((F.least(before, after) == 0) & (loose < MOST_LOOSE) & (F.col("score") >= LEAST_SCORE + loose))
    l, back = (-(F.col(f"{x}_end") + 1 - F.col(f"{x}_start") + loose) for x in ("query", "target"))
    size = contigs.select(F.col("contig"), F.length("seq").alias("size"))
    sized = found.select("end_a", "end_b", l.cast("int").alias("l"), back.cast("int").alias("back"))
    for end, lost in (("end_a", "back"), ("end_b", "l")):
        sized = sized.join(size, F.floor(F.col(end) / 2) == F.col("contig")).where(-F.col(lost) < F.col("size")).drop("contig", "size")
    p = link_p_values(distances.join(sized.select("end_a", F.col("back").alias("patch")), "end_a"), avg, std, read_len)
    return sized.join(p.select("end_a", "p"), "end_a", "left").select("end_a", "end_b", "l", "back", F.lit("").alias("patch"), "p")


def patch_gaps(links: DataFrame, contigs: DataFrame, attached: DataFrame, reads: DataFrame, avg: float, std: float, reach: int, read_len: int, min_overlap: int | None = None) -> DataFrame:
    """PATCHES of reciprocal links (end_a, end_b) that can be closed.

    attached: (read_id, end_id, dist) of reads that point at an end; reads: (read_id, seq), mates being 2p and 2p + 1. First the pairs that make a link
    are assembled with both tails, and a patch stays with a P-value above 1e-5; where that gives none, the reads of both ends and all their mates, above 1e-10; where
    that gives none and links tell avg_dist, the ends themselves may overlap (overlap_patches). Overlaps of reads are of 17 bases at least, or a third of read_len.
    """
    min_overlap = min_overlap or min(17, read_len // 3)
    scratch = Scratch(links.sparkSession, "patches")
    told = ["avg_dist"] if "avg_dist" in links.columns else []
    links = scratch.put("links", links.select("end_a", "end_b", *told).where("end_a < end_b"))
    ends = scratch.put("ends", tails(links, contigs, reach))
    both = links.select("end_a", "end_b", F.explode(F.array("end_a", "end_b")).alias("end_id")).join(attached, "end_id")
    mate = F.col("read_id").bitwiseXOR(F.lit(1).cast("long"))
    at_end = scratch.put("at_end", both.select("end_a", "end_b", "end_id", "read_id", mate.alias("mate"), "dist"))
    other = at_end.select("end_a", F.col("read_id").alias("mate"), F.col("end_id").alias("mate_end"), F.col("dist").alias("mate_dist"))
    pairs = scratch.put("pairs", at_end.join(other, ["end_a", "mate"]).where("end_id <> mate_end"))
    distances = pairs.where("end_id = end_a").select("end_a", "end_b", (F.col("dist") + F.col("mate_dist")).alias("dist"))
    done = None
    for least, ids in ((1e-5, pairs.select("end_a", "read_id")), (1e-10, at_end.select("end_a", F.explode(F.array("read_id", "mate")).alias("read_id")))):
        left = ends if done is None else scratch.put("left", ends.join(done.select("end_a"), "end_a", "left_anti"))
        if left.isEmpty():
            break
        around = ids.distinct().join(left.select("end_a"), "end_a", "left_semi").join(reads, "read_id").select("end_a", "seq")
        found = scratch.put(f"found{least}", local_patches(left, around, min_overlap, reach))
        p = link_p_values(distances.join(found.select("end_a", F.col("l").alias("patch")), "end_a"), avg, std, read_len)
        sure = found.join(p.select("end_a", "p"), "end_a").where(F.col("p") > least).withColumn("back", F.col("l")).select(*PATCHES)
        done = sure if done is None else done.unionAll(sure)
    if done is None:
        return links.select("end_a", "end_b", F.lit(0).alias("l"), F.lit(0).alias("back"), F.lit("").alias("patch"), F.lit(None).cast("double").alias("p")).limit(0)
    if told:
        done = scratch.put("assembled", done)
        done = done.unionAll(overlap_patches(links.join(done.select("end_a"), "end_a", "left_anti"), contigs, distances, avg, std, reach, read_len))
    return done
