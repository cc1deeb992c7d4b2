"""Chains, coverage, bubbles, MAG records, sources and the whole assembly against short models."""

import itertools
import random

import pandas as pd
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import assembly as A
from strandloom.operators import cleaning as Cl
from strandloom.operators.chains import chain_positions
from strandloom.operators.ranking import running_total
from strandloom.session import Scratch
from strandloom.sources import fastx
from strandloom.sources.graph_text import mag_text, read_mag

RC = str.maketrans("ACGT", "TGCA")


def test_chains_and_cycles_of_every_length(spark):
    rng, rows, want, base = random.Random(1), [], {}, 0
    for size, cycle in [*((n, False) for n in (2, 3, 4, 9)), *((n, True) for n in (2, 3, 4, 5, 8, 13, 16))]:
        nodes = rng.sample(range(base, base + 100), size)
        steps = [rng.randrange(1, 9) for _ in nodes]
        rows += [(a, b, s) for a, b, s in zip(nodes, nodes[1:], steps)] + ([(nodes[-1], nodes[0], steps[-1])] if cycle else [])
        first = nodes.index(min(nodes)) if cycle else 0
        shift = 0
        for k in range(size):
            at = (first + k) % size
            want[nodes[at]] = (nodes[first], k, shift)
            shift += steps[at]
        base += 100
    got = {r.node: (r.chain, r.position, r.shift) for r in chain_positions(spark.createDataFrame([*rows, (base, base, 1)], "a long, b long, step int")).collect()}
    assert got == want


def test_scratch_keeps_one_table_of_a_name(spark, tmp_path):
    import os

    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    scratch = Scratch(spark, "unit")
    held = lambda: sum(n.startswith("unit-") for top in {root, os.path.dirname(root)} for n in os.listdir(top))
    one = scratch.put("x", spark.range(5))
    two = scratch.put("x", one.selectExpr("id + 1 AS id"))
    assert sorted(r.id for r in two.collect()) == [1, 2, 3, 4, 5] and len(scratch.paths) == 1 and held() <= 1
    scratch.keep_only()
    assert not scratch.paths and held() == 0


def test_coverage_adds_up(spark):
    rng = random.Random(2)
    rows = [(k % 3, rng.randrange(30), "".join(chr(33 + rng.choice([1, 1, 1, 2, 60])) for _ in range(rng.randrange(1, 25)))) for k in range(40)]
    rows += [(7, 0, "~" * 5)]
    got = {r.id: r.cov for r in Cl.summed_coverage(spark.createDataFrame(rows, "new_id long, start int, cov string")).collect()}
    for key in (0, 1, 2, 7):
        own = [(s, c) for k, s, c in rows if k == key]
        first, last = min(s for s, _ in own), max(s + len(c) for s, c in own)
        depth = [min(93, sum(ord(c[at - s]) - 33 for s, c in own if s <= at < s + len(c))) for at in range(first, last)]
        assert [ord(x) - 33 for x in got[key]] == depth


def test_best_two_ways_match_every_way():
    """Random bubbles of layers: the search keeps what the two ways of most reads use, found by listing all ways."""
    rng = random.Random(5)
    for _ in range(60):
        layers = [[0], *([10 * (k + 1) + j for j in range(rng.randrange(1, 4))] for k in range(rng.randrange(1, 4))), [90]]
        arcs, reads = set(), {v: rng.randrange(1, 10**6) for layer in layers for v in layer}
        for one, two in itertools.pairwise(layers):
            arcs |= {(rng.choice(one), v) for v in two} | {(v, rng.choice(two)) for v in one}
        out = {v: sorted(b for a, b in arcs if a == v) for v in reads}
        if len(out[0]) < 2 or any(b in (c for w in reads for c in out[w] if w != v) and False for v in reads for b in out[v]):
            continue
        ways, queue = [], [(0,)]
        while queue:
            way = queue.pop()
            if way[-1] == 90:
                ways.append((sum(reads[v] for v in way[1:-1]), way))
            queue += [(*way, b) for b in out[way[-1]]]
        n_in = {v: sum(b == v for _, b in arcs) for v in reads}
        state, ready = Cl.Ways(0, {0: [(0, 0, 0, 0)]}, {}), [0]
        while ready and state.sink is None and not state.failed:
            rows = [(2 * a, 2 * b, 5, 20, reads[a], n_in[b]) for a, b in arcs if 2 * a in ready]
            ready = Cl.settle(state, ready, pd.DataFrame(rows, columns=["a", "b", "ovlp", "len", "nsr", "n_in"]), 64, 512)
        sink = state.sink
        assert not state.failed
        if sink == 180:
            kept = {v for _, way in sorted(ways, reverse=True)[:2] for v in way}
            assert set(Cl.off_the_ways(state)) == set(reads) - kept
        else:  # the ways meet before the last layer
            assert all(sink // 2 in way for _, way in ways)


def test_bubbles_that_are_none():
    frame = lambda rows: pd.DataFrame(rows, columns=["a", "b", "ovlp", "len", "nsr", "n_in"])
    begin = lambda: Cl.Ways(0, {0: [(0, 0, 0, 0)]}, {})
    fork = frame([(0, 2, 5, 20, 1, 1), (0, 4, 5, 20, 1, 1)])
    dead, back, far = begin(), begin(), begin()
    ready = Cl.settle(dead, [0], fork, 64, 512)
    assert ready == [2, 4] and Cl.settle(dead, ready, frame([(2, 6, 5, 20, 1, 2)]), 64, 512) == [] and dead.failed  # 4 leads nowhere
    Cl.settle(back, [0], fork, 64, 512)
    Cl.settle(back, [2, 4], frame([(2, 0, 5, 20, 1, 1), (4, 6, 5, 20, 1, 1)]), 64, 512)
    assert back.failed
    Cl.settle(far, [0], fork, 64, 512)
    more = Cl.settle(far, [2, 4], frame([(2, 6, 5, 900, 1, 1), (4, 8, 5, 20, 1, 1)]), 64, 512)
    Cl.settle(far, more, frame([(6, 10, 5, 20, 1, 2), (8, 10, 5, 20, 1, 2)]), 64, 512)
    assert far.failed


def test_mag_records_of_any_ends(spark, tmp_path):
    text = ["@5:9\t3\t.\t12,4;\nACGTACGT\n+\n\"\"\"\"\"\"\"\"", "@12:7\t2\t9,4;\t40,3;\nACGTTTT\n+\n#######", "@40:41\t1\t7,3;\t77,3;\nTTTTG\n+\n\"\"\"\"\""]
    (tmp_path / "g.mag").write_text("\n".join(text) + "\n")
    vertices, edges = A.mag_graph(read_mag(spark, str(tmp_path / "g.mag")))
    assert sorted((r.id, r.nsr, r.seq) for r in vertices.collect()) == [(5, 3, "ACGTACGT"), (12, 2, "ACGTTTT"), (40, 1, "TTTTG")]
    # The right end of 5 meets the left of 12, whose right end meets the left of 40; 77 is no end of any.
    assert sorted(map(tuple, edges.collect())) == [(10, 24, 4), (24, 80, 3), (25, 11, 4), (81, 25, 3)]
    again = A.mag_graph(A.mag_records(vertices, edges).select("*"))
    assert sorted((r.a, r.b, r.ovlp) for r in again[1].collect()) == sorted((2 * a, 2 * b, o) if a % 2 == 0 else (2 * a - 1, 2 * b - 1, o) for a, b, o in map(tuple, edges.collect()))
    assert mag_text(A.mag_records(vertices, edges)).count() == 3


def test_fastq_and_fasta_from_small_splits(spark, tmp_path):
    rng = random.Random(3)
    reads = [(f"r{k}", "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 90)))) for k in range(300)]
    (tmp_path / "a.fq").write_text("".join(f"@{n} c{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads[:200]) + "@cut\nACG\n+")
    (tmp_path / "b.fq").write_text("".join(f"@{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in reads[200:]))
    wrap = lambda s, n: "\n".join(s[i : i + n] for i in range(0, len(s), n))
    (tmp_path / "c.fa").write_text("; a comment\n" + "".join(f">{n} whole\n{wrap(s, 11)}\n" for n, s in reads) + ">empty\n>last\nAC\nGT")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = fastx.read_fastq(spark, str(tmp_path / "*.fq")).collect()
        fasta = fastx.read_fasta(spark, str(tmp_path / "c.fa")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.name, r.seq) for r in got) == sorted(reads)
    assert {r.name: (r.comment, r.qual[:1], r.ord) for r in got}["r7"] == ("cr7", "I", 7) and {r.name: (r.qual[:1], r.ord) for r in got}["r203"] == ("@", 3)
    assert sorted((r.ord, r.name, r.seq) for r in fasta) == [*((k, n, s) for k, (n, s) in enumerate(reads)), (300, "empty", ""), (301, "last", "ACGT")]


def test_running_total_and_names(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(9)) for k in range(200)]
    rng.shuffle(rows)
    got = {r.k: r.total for r in running_total(spark.createDataFrame(rows, "k int, n int"), F.col("n"), "k").collect()}
    sums = list(itertools.accumulate(n for _, n in sorted(rows)))
    assert got == dict(enumerate(sums))
    named = fastx.end_offset_names(spark.createDataFrame([(2, "AC"), (1, "ACG")], "rid int, seq string"), "rid").collect()
    assert sorted((r.rid, r.name) for r in named) == [(1, "4"), (2, "7")]
    row = spark.createDataFrame([(7, "ACNN")], "id long, s string").select(S.replace_ambiguous(F.col("s"), F.col("id")).alias("s"), S.corrected_name(F.lit(7), F.lit(40), F.lit(12)).alias("n")).first()
    assert row.s[:2] == "AC" and set(row.s) <= set("ACGT") and row.n == "7_40_12"


def test_the_whole_assembly_in_one_call(spark):
    rng = random.Random(9)
    g = "".join(rng.choice("ACGT") for _ in range(300))
    reads = [g[i : i + 70] for i in range(0, 231, 3)]
    reads = [r if k % 2 else r[::-1].translate(RC) for k, r in enumerate(reads)]
    reads[30] = reads[30][:35] + reads[30][35].translate(str.maketrans("ACGT", "CGTA")) + reads[30][36:]
    frame = spark.createDataFrame(list(enumerate(reads)), "rid long, s string")
    v, e = A.assemble(frame, 35, rules=None)
    longest = max((r.seq for r in v.collect()), key=len)
    assert longest in g or longest[::-1].translate(RC) in g
    assert len(longest) >= 250
    fixed = A.correct_all(frame, 17)
    assert fixed.count() == len(reads) and sum(r.n_changed for r in fixed.collect()) >= 1
