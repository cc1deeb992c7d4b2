import random

from strandloom.operators import graph as Gr
from strandloom.operators import overlaps as O
from strandloom.operators.cleaning import Cleaning, clean, drop_weak, merge_graph, pop_bubbles
from strandloom.operators.matches import smem
from strandloom.operators.suffixes import both_strands
from pyspark.sql import functions as F

RC = str.maketrans("ACGT", "TGCA")


def canonical(s):
    return min(s, s[::-1].translate(RC))


def graph(spark, reads, min_overlap):
    frame = spark.createDataFrame([(k, s) for k, s in enumerate(reads)], "rid long, s string")
    both = both_strands(frame)
    edges = O.irreducible(O.overhangs(both, min_overlap))
    vertices = frame.select(F.col("rid").alias("id"), F.length("s").cast("long").alias("len"), F.lit(3).cast("long").alias("nsr"), F.col("s").alias("seq"))
    return vertices, edges


def genome(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_tiled_reads_become_the_genome(spark):
    g = genome(600, 1)
    reads = [g[i : i + 60] if i % 24 else g[i : i + 60][::-1].translate(RC) for i in range(0, 541, 12)]
    v, e = merge_graph(*graph(spark, reads, 31))
    assert [(canonical(r.seq), r.nsr) for r in v.collect()] == [(canonical(g), 3 * len(reads))] and e.count() == 0


def test_bubble_and_tip_are_cleaned(spark):
    g = genome(400, 2)
    alt = g[:200] + g[200].translate(RC) + g[201:]
    reads = [g[i : i + 60] for i in range(0, 341, 4)] + [alt[i : i + 60] for i in range(144, 201, 8)]
    reads = list(dict.fromkeys(reads)) + [g[20:60] + genome(20, 9)]
    v, e = merge_graph(*graph(spark, reads, 31))
    assert v.count() >= 4
    v, e = pop_bubbles(v, e, Cleaning(aggressive=True))
    v, e = clean(v, e, Cleaning(min_overlap=31, tip_len=100, tip_nsr=4, aggressive=True))
    assert max((r.len for r in v.collect())) >= 390


def test_smem(spark):
    g = genome(200, 3)
    q = g[20:49] + g[49].translate(RC) + g[50:80]
    queries = spark.createDataFrame([(1, q), (2, g[100:130])], "query long, seq string")
    strings = spark.createDataFrame([(0, g), (2, g[100:140])], "oriented_id long, seq string")
    got = sorted(map(tuple, smem(queries, strings, 11).collect()))
    assert got == [(1, 0, 29, 1, False, False), (1, 30, 60, 1, False, False), (2, 0, 30, 2, True, False)]
    assert [r.query for r in smem(queries, strings, 11, min_hits=2).collect()] == [2]


def bubble(spark, deep, shallow):
    """Two arms that differ in a base; their overlaps are 90 deep, their own parts as given."""
    g = genome(160, 7)
    arm = g[31:99]
    alt = arm[:33] + arm[33].translate(RC) + arm[34:]
    cov = lambda n: chr(33 + 90) * 30 + chr(33 + n) * 8 + chr(33 + 90) * 30
    rows = [(0, g[:61], 300, chr(123) * 61), (1, arm, 40, cov(deep)), (2, alt, 6, cov(shallow)), (3, g[69:160], 300, chr(123) * 91)]
    vertices = spark.createDataFrame(rows, "id long, seq string, nsr long, cov string").withColumn("len", F.length("seq").cast("long"))
    one_way = [(0, 2, 30), (0, 4, 30), (2, 6, 30), (4, 6, 30)]
    return vertices, spark.createDataFrame(one_way + [(b ^ 1, a ^ 1, o) for a, b, o in one_way], "a long, b long, ovlp int")


def test_bubble_arms_go_by_the_depth_of_their_own_parts(spark):
    left = lambda deep, shallow: sorted(r.id for r in pop_bubbles(*bubble(spark, deep, shallow))[0].collect())
    assert left(80, 12) == [0, 1, 2, 3]
    assert left(80, 9) == [0, 1, 3]
    assert left(9, 80) == [0, 2, 3]


def test_merging_adds_coverage(spark):
    g = genome(40, 8)
    rows = [(0, g[:20], "#" * 20), (1, g[8:28][::-1].translate(RC), "$" * 15 + "%" * 5), (2, g[16:40], "~" * 24)]
    vertices = spark.createDataFrame(rows, "id long, seq string, cov string").withColumn("len", F.length("seq").cast("long")).withColumn("nsr", F.lit(1).cast("long"))
    one_way = [(0, 3, 12), (3, 4, 12)]
    v, _ = merge_graph(vertices, spark.createDataFrame(one_way + [(b ^ 1, a ^ 1, o) for a, b, o in one_way], "a long, b long, ovlp int"))
    want = [0] * 40
    for start, cov in ((0, rows[0][2]), (8, rows[1][2][::-1]), (16, rows[2][2])):
        for k, c in enumerate(cov):
            want[start + k] = min(93, want[start + k] + ord(c) - 33)
    row = v.first()
    assert (row.seq, [ord(c) - 33 for c in row.cov]) in ((g, want), (g[::-1].translate(RC), want[::-1]))


def linked(spark, sizes, one_way):
    vertices = spark.createDataFrame([(k, n, r, "A" * n) for k, (n, r) in enumerate(sizes)], "id long, len long, nsr long, seq string")
    return vertices, spark.createDataFrame(one_way + [(b ^ 1, a ^ 1, o) for a, b, o in one_way], "a long, b long, ovlp int")


def test_a_tip_with_the_longest_overlap_does_not_make_edges_weak(spark):
    # 0 leads to the tip 1 by 95 bases, to 2 by 64 and to 3 by 62; 2 and 3 go on.
    v, e = linked(spark, [(400, 9), (100, 1), (400, 9), (400, 9), (400, 9)], [(0, 2, 95), (0, 4, 64), (0, 6, 62), (4, 8, 70), (6, 8, 50)])
    left = {tuple(r)[:2] for r in drop_weak(v, e, 60, 0.8, Cleaning()).collect()}
    assert left == {(0, 2), (3, 1), (0, 4), (5, 1), (0, 6), (7, 1), (4, 8), (9, 5)}


def test_edges_are_not_looked_at_from_a_tip(spark):
    # The tip 0 has edges of 90 and 61 bases; from 2, which has another edge of 61, the second is fine.
    v, e = linked(spark, [(100, 1), (400, 9), (400, 9), (400, 9)], [(0, 2, 90), (0, 4, 61), (2, 6, 90), (4, 6, 61)])
    ends = Gr.tips(v, e, 300, 4).select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("end"))
    assert {tuple(r)[:2] for r in Gr.weak_edges(e, 60, 0.8, ends, oriented=True).collect()} >= {(0, 4), (5, 1), (0, 2)}


def test_tips_that_bubbles_expose_are_removed(spark):
    v, e = bubble(spark, 80, 5)
    v = v.withColumn("nsr", F.lit(3).cast("long"))
    assert clean(v, e, Cleaning(min_overlap=20, tip_len=200, tip_nsr=20, rounds=0, inner_nsr=0))[0].count() == 0


def test_smem_of_shared_runs_and_whole_strings(spark):
    g = genome(200, 11)
    queries = spark.createDataFrame([(1, g[20:90])], "query long, seq string")
    strings = spark.createDataFrame([(0, g[20:70]), (2, g[30:80]), (4, g[40:60]), (6, g[:100])], "oriented_id long, seq string")
    every = sorted(map(tuple, smem(queries, strings, 11).collect()))
    assert every == [(1, 0, 50, 1, True, True), (1, 0, 70, 1, False, False), (1, 10, 60, 1, True, True), (1, 20, 40, 1, True, True)]
    two = smem(queries, strings.where("oriented_id < 4"), 11, min_hits=2)
    assert [tuple(r) for r in two.collect()] == [(1, 10, 50, 2, True, True)]
    assert [tuple(r) for r in smem(queries, strings, 11, min_hits=4).collect()] == [(1, 20, 40, 4, True, True)]
