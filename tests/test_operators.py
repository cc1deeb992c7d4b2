"""Operators against hand-made cases and short reference models."""

import gzip
import math
import heapq
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import coverage as C
from strandloom.operators import graph as Gr
from strandloom.operators.align import align, align_batch
from strandloom.operators.components import connected_components
from strandloom.operators import correct
from strandloom.operators.correct import correct_reads, keep_good
from strandloom.operators.kmers import kmer_counts, next_base_table
from strandloom.operators.pairs import split_joined
from strandloom.operators.scaffold import student_p, truncated_mean
from strandloom.plans.fixtures import fixture
from strandloom.sources import fastx, graph_text
from strandloom.streaming import kmers as stream

SF = "/root/testdata/sf0.001"


def test_scalar_functions(spark):
    row = spark.sql("SELECT 'acgNx' AS s, 'ACGT' AS p, '5S10M2I3D4N6H' AS c").select(S.normalise(F.col("s")).alias("n"), S.revcomp(F.lit("AACGN")).alias("r"), S.palindrome_trim(F.col("p")).alias("p"), S.cigar_counts(F.col("c")).alias("c"), S.windows(F.lit("AC"), 3).alias("w")).first()
    assert (row.n, row.r, row.p, row.w) == ("ACGNN", "NCGTT", "ACG", [])
    assert tuple(row.c) == (10, 2, 3, 4, 5, 6)


def smith_waterman(q, t, match=5, mismatch=-4, o=5, e=2):
    best, rows = 0, [[(0, -99, -99)] * (len(q) + 1)]
    for x in t:
        row = [(0, -99, -99)]
        for j, y in enumerate(q):
            up, left, diag = rows[-1][j + 1], row[-1], rows[-1][j]
            gap_t, gap_q = max(up[0] - o - e, up[1] - e), max(left[0] - o - e, left[2] - e)
            h = max(0, diag[0] + (match if x == y else mismatch), gap_t, gap_q)
            best = max(best, h)
            row.append((h, gap_t, gap_q))
        rows.append(row)
    return best


def test_alignment_matches_the_model(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 25)))
    pairs = [(word(), word()) for _ in range(200)] + [("ACGTACGT", "ACGTACGT"), ("", "A")]
    got = align_batch([p[0] for p in pairs], [p[1] for p in pairs])
    assert got[:, 0].tolist() == [smith_waterman(q, t) for q, t in pairs]
    frame = align(spark.createDataFrame([(1, "ACGT", "TTACGTTT")], "id int, query string, target string"))
    assert tuple(frame.first()) == (1, "ACGT", "TTACGTTT", 20, 3, 5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in (100, 101, 102)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_correction_restores_reads(spark):
    reads = fixture(spark, SF, "E")
    solid = next_base_table(reads, 17)
    fixed = correct_reads(reads, solid, 17)
    rows = fixed.join(reads.select(F.col("rid").alias("read_id"), "s", "s0", "w"), "read_id").collect()
    inner = [r for r in rows if r.s != r.s0 and 2 <= r.w <= 13]
    assert inner and sum(r.seq.upper() == r.s0 for r in inner) >= 0.95 * len(inner)
    assert all(r.seq.upper() == r.s for r in rows if r.s == r.s0 and 2 <= r.w <= 13 and r.n_changed == 0)
    assert sum(r.n_changed > 0 for r in rows if r.s == r.s0) <= 0.02 * len(rows)
    assert keep_good(fixed).count() == sum(not r.bad for r in rows)
    assert keep_good(fixed, paired=True).groupBy(F.shiftright("read_id", 1)).count().where("count <> 2").count() == 0


def plain_search(seq, qual, solid, w, asks=None):
    """Every step by the heap, without walking over stretches that agree."""
    from strandloom.operators.correct import DIFFERENCE, GAP, MISS, NO_SEARCH, RAISED, RATIO, STATES
    start = next((i for i in range(w, len(seq) + 1) if "N" not in seq[i - w : i]), None)
    if start is None or start >= len(seq):
        return seq, qual, 0, NO_SEARCH, False
    heap, order, done, known = [(0, 0, start, seq[start - w : start], None)], 1, [], False
    while heap:
        score, _, at, context, path = heapq.heappop(heap)
        if done and score > done[0][0] + GAP:
            break
        if at == len(seq):
            done.append((score, path))
            if len(done) == 2:
                break
            continue
        base, q = seq[at], min(40, max(3, qual[at] - 33))
        steps, found = [], solid.get(context)
        if found is None:
            steps.append((base, score + MISS + 40 - q, False))
        else:
            known = True
            best, ratio, rest = found
            if best == base:
                steps.append((base, score, True))
            else:
                whole = rest * ratio if rest else ratio
                keep = max(1, min(DIFFERENCE * (whole - rest) if whole - rest >= 1 else 1, RATIO * ratio if rest else 10_000, DIFFERENCE * (7 - rest)))
                steps.append((best, score + q, True))
                if base != "N":
                    steps.append((base, score + keep, True))
                if len(heap) + len(steps) > STATES:
                    steps = [min(steps, key=lambda s: s[1])]
        for new, price, hit in steps:
            heapq.heappush(heap, (price, order, at + 1, (context + new)[-w:], (path, at, new, hit and new == base)))
            order += 1
    if not done:
        return seq, qual, 0, NO_SEARCH, known
    gap = min(GAP, done[1][0] - done[0][0]) if len(done) > 1 else GAP
    score, path = done[0]
    if not score:
        return seq, qual, 0, gap, known
    bases, quals, changed = list(seq), list(qual), 0
    while path is not None:
        path, at, new, supported = path
        if new != seq[at]:
            changed += qual[at] - 33
            bases[at] = new
        elif supported:
            quals[at] = max(quals[at], RAISED)
    return "".join(bases), quals, changed, gap, known


def haplotypes(seed=4):
    """Two haplotypes that differ in two bases, and reads with two, three and five errors within w bases."""
    rng = random.Random(seed)
    change = lambda s, places: "".join(c.translate(str.maketrans("ACGT", "CGTA")) if k in places else c for k, c in enumerate(s))
    g = "".join(rng.choice("ACGT") for _ in range(128))
    whole = [(k, g if k < 12 else change(g, {44, 50})) for k in range(16)]
    spoilt = [(100 + k, change(g[20:80], set(rng.sample(range(22, 39), (2, 3, 5)[k % 3])))) for k in range(90)]
    return whole, [*whole, *spoilt, (300, "ACGNT" * 9), (301, "ACG"), (302, None), (303, ""), (None, g[3:70])]


def test_reads_that_look_up_their_contexts_get_what_the_whole_table_gives(spark):
    whole, every = haplotypes()
    solid = next_base_table(spark.createDataFrame(whole, "rid long, s string"), 17).checkpoint()
    table = {r.kmer: (r.best, r.ratio, r.rest) for r in solid.collect()}
    want = sorted(((k, *correct.correct_one(s or "", None, table, 17, 0.3, 15)) for k, s in every), key=str)
    columns = ["read_id", "seq", "qual", "n_changed", "quality_sum", "difference", "bad"]
    got = sorted(map(tuple, correct_reads(spark.createDataFrame(every, "rid long, s string"), solid, 17).select(*columns).collect()), key=str)
    assert {2, 3, 5} <= {r[3] for r in got}
    assert got == want


def test_walking_over_what_agrees_changes_nothing():
    for seed in range(12):
        rng = random.Random(seed)
        _, every = haplotypes(seed)
        table = {}
        for _, s in every[:16]:
            for i in range(len(s) - 9):
                if rng.random() < 0.9:
                    table[s[i : i + 9]] = (s[i + 9] if rng.random() < 0.95 else rng.choice("ACGT"), rng.randrange(1, 32), rng.randrange(8))
        for _, s in every:
            if s:
                qual = [rng.randrange(35, 74) for _ in s]
                assert correct.search(s, qual, table, 9) == plain_search(s, qual, table, 9)


def test_bubbles_and_tips(spark):
    vertices = spark.createDataFrame([(0, 100, 9), (1, 80, 5), (2, 80, 2), (3, 100, 9), (4, 60, 1)], "id long, len long, nsr long")
    one_way = [(0, 2, 40), (0, 4, 40), (2, 6, 40), (4, 6, 40), (6, 8, 40)]
    edges = spark.createDataFrame(one_way + [(b ^ 1, a ^ 1, o) for a, b, o in one_way], "a long, b long, ovlp int")
    assert [tuple(r) for r in Gr.bubbles(vertices, edges).collect()] == [(2, 4, 0, 6)]
    assert [r.id for r in Gr.tips(vertices, edges, 90, 3).collect()] == [4]
    kept, left = Gr.drop_vertices(vertices, edges, vertices.where("id = 2"))
    assert kept.count() == 4 and left.count() == 6


def test_relative_reference_of_tips(spark):
    edges = spark.createDataFrame([(1, 2, 90), (1, 3, 50), (2, 1, 90), (3, 1, 50)], "a long, b long, ovlp int")
    assert Gr.weak_edges(edges, 40, 0.8).count() == 2
    assert Gr.weak_edges(edges, 40, 0.8, spark.createDataFrame([(2,)], "end long")).count() == 4


def test_breaking_keeps_contigs_without_good_positions(spark):
    contigs = spark.createDataFrame([(1, "A" * 100), (2, "C" * 100)], "contig long, seq string")
    runs = spark.createDataFrame([(1, 30, 40, 3), (1, 40, 50, 5), (1, 60, 95, 2)], "contig long, beg int, end int, cov int")
    assert sorted(map(tuple, C.break_contigs(contigs, runs, 2, 10).collect())) == [(1, 1, 30, 50), (1, 2, 60, 100), (2, 1, 0, 100)]


def test_statistics():
    assert student_p(2.0, 1) == pytest.approx(0.2951672353, abs=1e-9)
    assert student_p(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    # A link of insert t can lie in t - limit places: the mean by numeric integration.
    grid = [450 + k * 0.01 for k in range(60_000)]
    weight = [math.exp(-((t - 500) ** 2) / 5000) * (t - 450) for t in grid]
    assert truncated_mean(500, 50, 450) == pytest.approx(sum(t * w for t, w in zip(grid, weight)) / sum(weight), abs=0.01)


def test_fastx(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 first\r\nACG\r\nT\n\n>r2\nNN\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r3/1\nACGT\n+\nII@I\n@r4 x y\nAC\nGT\n+r4\n+I\nII\n@cut\nACGT\n+\nII\n")
    (tmp_path / "c.fq").write_text("")
    rows = fastx.read_fastx(spark, str(tmp_path)).orderBy("name").collect()
    assert [tuple(r)[:4] for r in rows] == [("r1", "first", "ACGT", None), ("r2", "", "NN", None), ("r3/1", "", "ACGT", "II@I"), ("r4", "x y", "ACGT", "+III")]
    out = str(tmp_path / "out")
    fastx.write_fastx(fastx.read_fastx(spark, str(tmp_path / "b.fq.gz")).coalesce(1), out)
    assert [tuple(r)[:4] for r in fastx.read_fastx(spark, out + "/*.txt").orderBy("name").collect()] == [tuple(r)[:4] for r in rows[2:]]
    assert fastx.with_quality(spark.sql("SELECT 'AC' AS seq, CAST(NULL AS STRING) AS qual")).first().qual == "55"


def test_graph_text(spark, tmp_path):
    records = "@1:2\t5\t.\t7,30;9,31;\nACGT\n+\n\"\"\"\"\n@7:8\t1\t2,30;\t.\nTTTT\n+\n####\n"
    (tmp_path / "g.mag").write_text(records)
    graph = graph_text.read_mag(spark, str(tmp_path / "g.mag"))
    assert [tuple(r) for r in graph_text.edges_of(graph).orderBy("a", "b").collect()] == [(2, 7, 30), (2, 9, 31), (7, 2, 30)]
    assert sorted(r.value for r in graph_text.mag_text(graph).collect()) == sorted(x if x[0] == "@" else "@" + x for x in records.rstrip("\n").split("\n@"))
    (tmp_path / "x.asqg").write_text("HT\tVN:i:1\nVT\tr1\tACGT\nVT\tr2\tGTAA\nED\tr1 r2 2 3 4 0 1 4 0 0\n")
    vertices, edges = graph_text.read_asqg(spark, str(tmp_path / "x.asqg"))
    assert vertices.count() == 2 and [tuple(r) for r in edges.collect()] == [("r1", "r2", 2, 1, 0)]


def test_sam_breaks(spark):
    line = lambda q, pos, cigar, flag=0: "\t".join([q, str(flag), "chr1", str(pos), "60", cigar, "*", "0", "0", "*", "*", "NM:i:0"])
    text = ["@HD", line("a", 1, "200M800S"), line("a", 210, "200S200M600S"), line("a", 9000, "600S200M200S"), line("a", 30_000, "620S180M200S"), line("b", 1, "200M"), line("c", 1, "*", 4), line("d", 1, "90M")]
    lines = spark.createDataFrame(list(enumerate(text)), "ord long, value string")
    # Of a's four parts the last lies on the third; the first two follow each other.
    got = {r.qname: tuple(r)[1:] for r in graph_text.contig_breaks(lines).collect()}
    assert got == {"a": (3, 1, 600, 2, 2, 2, 2, 0, 1, 1, 1, 1, 0), "b": (1, 0, 200, *[0] * 10)}
    assert {r.metric: r.value for r in graph_text.break_stats(graph_text.contig_breaks(lines)).collect()}["mapped"] == 800


def test_joined_records(spark):
    frame = spark.createDataFrame([("r", "ACGT-.TTT")], "name string, seq string")
    assert [tuple(r) for r in split_joined(frame).orderBy("mate").collect()] == [("r", 0, "ACGT"), ("r", 1, "TTT")]


def test_streamed_counts(spark, tmp_path):
    reads = fixture(spark, SF, "H").select("rid", "s")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.count_stream(source, str(tmp_path / "counts"), str(tmp_path / "state"), k=15).awaitTermination()
    got = stream.stream_counts(spark, str(tmp_path / "counts"))
    assert got.exceptAll(kmer_counts(reads, 15)).isEmpty() and got.count() == kmer_counts(reads, 15).count()


def test_windows_of_long_strings(spark):
    rng = random.Random(5)
    for size in (20, 21, 512, 513, 532, 533, 1500):
        text = "".join(rng.choice("ACGT") for _ in range(size))
        got = spark.createDataFrame([(text,)], "s string").select(S.windows(F.col("s"), 21).alias("w")).first().w
        assert got == [text[i : i + 21] for i in range(size - 20)]
