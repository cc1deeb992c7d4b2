"""Assembly as DataFrames: reads to a graph of unitigs, MAG records, and the whole way from raw reads in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequences import auto_k
from strandloom.operators import graph as Gr
from strandloom.operators import overlaps as O
from strandloom.operators.cleaning import Cleaning, clean, merge_graph
from strandloom.operators.correct import correct_reads, keep_good
from strandloom.operators.kmers import next_base_table, unique_kmer_filter
from strandloom.operators.suffixes import both_strands
from strandloom.session import Scratch

NEIGHBOURS = "array<struct<k:bigint,ovlp:int>>"


def read_graph(reads: DataFrame, min_overlap: int, *, id_col: str = "rid", seq_col: str = "s", group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of reads: those that no other holds, and their irreducible overlaps.

    With group, only reads of one group overlap; ids are unique over all groups. Reads shorter than the seed are no vertices, as no overlap can reach them.
    """
    scratch = Scratch(reads.sparkSession, "reads")
    both = scratch.put("both", both_strands(reads.where(F.length(seq_col) >= min_overlap), id_col, seq_col, *([group] if group else [])))
    # A read goes with both its strands: where either is held, so is the other by the other's mate.
    inside = O.contained_reads(both, min_overlap, group).select(F.shiftright("oriented_id", 1).alias("id")).distinct()
    own = scratch.put("own", both.join(inside, F.shiftright("oriented_id", 1) == F.col("id"), "left_anti"))
    edges = scratch.put("edges", O.irreducible(O.longest_overlaps(O.overhangs(own, min_overlap, group))))
    vertices = own.where("oriented_id % 2 = 0").select(F.shiftright("oriented_id", 1).alias("id"), F.length("seq").cast("long").alias("len"), F.lit(1).cast("long").alias("nsr"), "seq", F.repeat(F.lit('"'), F.length("seq")).alias("cov"), *([group] if group else []))
    scratch.drop("both")
    return vertices, edges


def unitig_graph(reads: DataFrame, min_overlap: int, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of unitigs: maximal unambiguous paths of reads with their reads counted, depth by base, and overlaps between them."""
    vertices, edges = read_graph(reads, min_overlap, **columns)
    return merge_graph(vertices, edges)


def mag_records(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(k0, k1, nsr, nei0, nei1, seq, cov): a record for each vertex. Its ends are 2 * id on the left and 2 * id + 1 on the right; an edge a -> b leaves by end a ^ 1 and enters by end b."""
    one = F.lit(1).cast("long")
    near = edges.groupBy(F.col("a").bitwiseXOR(one).alias("end")).agg(F.array_sort(F.collect_list(F.struct(F.col("b").alias("k"), F.col("ovlp").cast("int").alias("ovlp")))).alias("nei"))
    rows = vertices.select((F.col("id") * 2).alias("k0"), (F.col("id") * 2 + 1).alias("k1"), F.col("nsr").cast("int").alias("nsr"), "seq", "cov")
    for side in (0, 1):
        rows = rows.join(near.select(F.col("end").alias(f"k{side}"), F.col("nei").alias(f"nei{side}")), f"k{side}", "left").withColumn(f"nei{side}", F.coalesce(f"nei{side}", F.array().cast(NEIGHBOURS)))
    return rows.select("k0", "k1", "nsr", "nei0", "nei1", "seq", "cov")


def mag_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of MAG records, whatever their ends are called; a vertex takes its left end as its id. Neighbours that are no end of any record, or of several, are left out."""
    vertices = records.select(F.col("k0").alias("id"), F.length("seq").cast("long").alias("len"), F.col("nsr").cast("long").alias("nsr"), "seq", F.coalesce("cov", F.repeat(F.lit('"'), F.length("seq"))).alias("cov"))
    ends = records.select(F.explode(F.array(*(F.struct(F.col(f"k{s}").alias("k"), (F.col("k0") * 2 + s).alias("enters")) for s in (0, 1)))).alias("e")).select("e.*")
    ends = ends.join(Gr.ambiguous_ends(ends.select(F.col("k").alias("end"))), F.col("k") == F.col("end"), "left_anti")
    sides = F.array(*(F.struct((F.col("k0") * 2 + 1 - s).alias("a"), F.coalesce(f"nei{s}", F.array().cast(NEIGHBOURS)).alias("nei")) for s in (0, 1)))
    rows = records.select(F.explode(sides).alias("x")).select("x.a", F.explode("x.nei").alias("n")).select("a", F.col("n.k").alias("k"), F.col("n.ovlp").alias("ovlp"))
    return vertices, rows.join(ends, "k").select("a", F.col("enters").alias("b"), "ovlp")


def load_graph(records: DataFrame, *, ratio: float = 0.7, most: int = 512, tip_len: int = 300, amend: bool = True) -> tuple[DataFrame, DataFrame]:
    """mag_graph, pruned while it is read: overlaps below ratio of their end's second longest, of several to one end all but the longest, and of ends with more than
    `most` those up to the first beyond; then short records of one read with a side without neighbours. With amend, an edge stays where its target answers with the same overlap."""
    vertices, edges = mag_graph(records)
    edges = Gr.neighbor_cap(Gr.dedupe_edges(Gr.relative_edges(edges, ratio)), most)
    flat = Gr.tips(vertices, edges, tip_len, 2)
    vertices, edges = Gr.drop_vertices(vertices, edges, flat)
    if not amend:
        return vertices, edges
    one = F.lit(1).cast("long")
    back = edges.select(F.col("b").bitwiseXOR(one).alias("a"), F.col("a").bitwiseXOR(one).alias("b"), "ovlp")
    return vertices, edges.join(back, ["a", "b", "ovlp"], "left_semi").select("a", "b", "ovlp")


def correct_all(reads: DataFrame, k: int = 19, min_occ: int = 3, *, id_col: str = "rid", seq_col: str = "s", qual_col: str | None = None, drop_bad: bool = False) -> DataFrame:
    """Reads corrected against their own k-mers, bad ones kept unless drop_bad: the whole of correction in one call."""
    solid = next_base_table(reads, k, min_occ, seq_col=seq_col)
    fixed = correct_reads(reads, solid, k, id_col=id_col, seq_col=seq_col, qual_col=qual_col)
    return keep_good(fixed) if drop_bad else fixed


def assemble(reads: DataFrame, min_overlap: int = 30, *, id_col: str = "rid", seq_col: str = "s", correct: bool = True, rules: Cleaning | None = Cleaning()) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of raw reads: correction, the filter of rare k-mers, unitigs and, with rules, cleaning.

    The k-mer lengths of correction and filter follow from the total length of the reads.
    """
    scratch = Scratch(reads.sparkSession, "assembly")
    now = scratch.put("raw", reads.select(F.col(id_col).alias("rid"), F.col(seq_col).alias("s")))
    if correct:
        total = now.agg(F.coalesce(F.sum(F.length("s")), F.lit(0)).alias("n"))
        w, k = total.select(auto_k(F.greatest("n", F.lit(1)), 8.499, 1, 27), auto_k(F.greatest("n", F.lit(1)), 1.499, 15, 18)).first()
        good = keep_good(correct_all(now, w))
        now = scratch.put("good", good.select(F.col("read_id").alias("rid"), F.upper("seq").alias("s")))
        now = scratch.put("kept", unique_kmer_filter(now, k))
    graph = unitig_graph(now, min_overlap)
    return clean(*graph, rules) if rules else graph
