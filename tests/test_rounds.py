"""Ordered overhangs, rounds of graph edits, pairing along contigs, contrast of all lengths and whole alignments against plain models."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from strandloom.operators import coverage as C
from strandloom.operators import graph as Gr
from strandloom.operators import overlaps as O
from strandloom.operators.align import align, align_whole_batch
from strandloom.operators.assembly import load_graph
from strandloom.operators.kmers import contrast
from strandloom.operators.scaffold import scaftigs


def genome(n, seed, letters="ACGT"):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def edge_by_edge(seqs, least):
    """Overlaps of strings of one length, without those that two others spell."""
    found = {(a, b): n for a, x in enumerate(seqs) for b, y in enumerate(seqs) if a != b for n in [next((n for n in range(len(x) - 1, least - 1, -1) if x[-n:] == y[:n]), 0)] if n}
    out, after = {}, defaultdict(list)
    for (a, b), n in found.items():
        after[a].append((b, n))
    for (a, c), n in found.items():
        if not any(o1 + o2 - len(seqs[b]) == n for b, o1 in after[a] for x, o2 in after[b] if x == c):
            out[a, c] = n
    return out


def test_irreducible_overlaps_at_depth(spark):
    g = genome(260, 1)
    alt = g[:120] + genome(140, 2)
    seqs = list(dict.fromkeys(x[i : i + 101] for x in (g, alt) for i in range(len(x) - 100)))
    frame = spark.createDataFrame(list(enumerate(seqs)), "oriented_id long, seq string")
    found = O.longest_overlaps(O.overhangs(frame, 31))
    assert found.count() > 50 * len(seqs)
    kept = O.irreducible(found)
    assert {(r.a, r.b): r.ovlp for r in kept.collect()} == edge_by_edge(seqs, 31)
    # Overlaps are dealt out once more, by their end, and never meet each other.
    plan = O.irreducible(found)._jdf.queryExecution().executedPlan().toString()
    before = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == before.count("Join") and plan.count("Exchange") <= before.count("Exchange") + 1


def one_after_the_other(edges, lens, gone, least):
    now = dict(edges)
    for v in gone:
        for side in (0, 1):
            into = [(a, o) for (a, b), o in now.items() if b == 2 * v + side]
            past = [(b, o) for (a, b), o in now.items() if a == 2 * v + side]
            for a, o1 in into:
                for b, o2 in past:
                    o = o1 + o2 - lens[v]
                    if o >= least and a != b and a // 2 != v and b // 2 != v:
                        now[a, b] = max(o, now.get((a, b), 0))
        now = {k: o for k, o in now.items() if k[0] // 2 != v and k[1] // 2 != v}
    return now


def test_neighbours_are_bridged_one_after_the_other(spark):
    rng = random.Random(4)
    for _ in range(2):
        n = 14
        lens, nsr = [rng.randint(90, 110) for _ in range(n)], [rng.randint(1, 3) for _ in range(n)]
        edges = {}
        for _ in range(26):
            a, b = rng.randrange(2 * n), rng.randrange(2 * n)
            if a // 2 != b // 2:
                edges[a, b] = edges[b ^ 1, a ^ 1] = rng.randint(60, 88)
        gone = sorted(rng.sample(range(n), 7), key=lambda v: (nsr[v], v))
        vertices = spark.createDataFrame([(v, lens[v], nsr[v]) for v in range(n)], "id long, len long, nsr long")
        frame = spark.createDataFrame([(a, b, o) for (a, b), o in edges.items()], "a long, b long, ovlp int")
        kept, left = Gr.bridge_vertices(vertices, frame, spark.createDataFrame([(v,) for v in gone], "id long"), 20)
        assert {(r.a, r.b): r.ovlp for r in left.collect()} == one_after_the_other(edges, lens, gone, 20)
        assert sorted(r.id for r in kept.collect()) == sorted(set(range(n)) - set(gone))


def along(hits, most):
    """Pairs and hits left over, as one walks along each contig."""
    pairs, alone = [], []
    by = defaultdict(list)
    for h in hits:
        by[h[0]].append(h)
    for contig, own in by.items():
        open_ = {}
        for _, read, strand, beg, end in sorted(own, key=lambda h: (h[3], h[4], h[2])):
            if strand == 0:
                open_[read] = (beg, end)
            elif (read ^ 1) in open_ and end - open_[read ^ 1][0] < most:
                pairs.append((contig, read >> 1, open_.pop(read ^ 1)[0], end))
            else:
                alone.append((contig, read, beg, end))
        alone += [(contig, read, *span) for read, span in open_.items()]
    return sorted(pairs), sorted(alone)


def test_pairs_along_contigs(spark):
    rng = random.Random(6)
    hits = list({(rng.randrange(3), rng.randrange(6), rng.randrange(2), b, b + rng.choice([30, 40])) for b in [rng.randrange(400) for _ in range(160)]})
    frame = spark.createDataFrame(hits, "contig long, read_id long, strand int, beg int, end int")
    pairs, alone = along(hits, 120)
    assert sorted(map(tuple, C.mate_pairs(frame, 120).collect())) == pairs
    assert sorted(map(tuple, C.unpaired_hits(frame, 120).collect())) == alone
    spots = {(c, b, e) for c, _, _, b, e in hits}
    assert {r.contig: r.n_supp for r in C.supporting_reads(frame).collect()} == Counter(c for c, _, _ in spots)


def test_contrast_of_all_lengths(spark):
    rng = random.Random(7)
    a = ["".join(rng.choice("AC") for _ in range(rng.randint(3, 14))) for _ in range(30)]
    b = ["".join(rng.choice("AC" if k % 3 else "ACG") for _ in range(rng.randint(3, 14))) for k in range(30)]
    subs = lambda x: [x[i:j] for i in range(len(x)) for j in range(i + 4, min(len(x), i + 9) + 1)]
    n = [Counter(s for x in own for s in subs(x)) for own in (a, b)]
    want = sorted((name, k) for name, own, mine, other in (("a", a, n[0], n[1]), ("b", b, n[1], n[0])) for k, x in enumerate(own) if any(mine[s] >= 3 and not other[s] for s in subs(x)))
    frames = [spark.createDataFrame(list(enumerate(x)), "oriented_id long, seq string") for x in (a, b)]
    assert sorted(map(tuple, contrast(*frames, 9, exact=True).collect())) == want and want


def plain(q, t, match=5, mismatch=-4, gap_open=5, gap_extend=2):
    h = np.zeros((len(t) + 1, len(q) + 1), int)
    for i in range(1, len(t) + 1):
        for j in range(1, len(q) + 1):
            gaps = [h[i - k, j] - gap_open - k * gap_extend for k in range(1, i + 1)] + [h[i, j - k] - gap_open - k * gap_extend for k in range(1, j + 1)]
            h[i, j] = max(0, h[i - 1, j - 1] + (match if q[j - 1] == t[i - 1] else mismatch), *gaps)
    rows = h.max(axis=1)[1:]
    best = int(rows.max())
    te = int(rows.argmax())
    far = [(int(s), i) for i, s in enumerate(rows) if abs(i - te) > -(-best // match)]
    second = max(far, key=lambda x: (x[0], -x[1]), default=(0, -1))
    return best, int(h[te + 1].argmax()) - 1, te, second if second[0] else (0, -1)


def test_whole_alignments(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(25):
        t = genome(rng.randint(5, 50), rng.random())
        k = rng.randrange(len(t))
        pairs.append((t[k : k + 12][: rng.randint(1, 12)] + genome(rng.randint(0, 4), rng.random()), t))
    for (q, t), (score, qe, te, qs, ts, score2, te2) in zip(pairs, align_whole_batch(*map(list, zip(*pairs, strict=True))).tolist(), strict=True):
        best, want_qe, want_te, second = plain(q, t)
        if not best:
            assert (score, qe, te, qs, ts) == (0, -1, -1, -1, -1)
            continue
        assert (score, qe, te, (score2, te2)) == (best, want_qe, want_te, second)
        # From the start on the same score is reached, and from one base later it isn't.
        assert plain(q[qs : qe + 1], t[ts : te + 1])[0] == best
        assert plain(q[qs + 1 : qe + 1], t[ts + 1 : te + 1])[0] < best if qs < qe and ts < te else True
    got = align(spark.createDataFrame([("", "ACGT"), ("ACGT", None)], "query string, target string"), whole=True).collect()
    assert [tuple(r)[2:] for r in got] == [(0, -1, -1, -1, -1, 0, -1)] * 2


def test_graphs_are_pruned_while_they_are_read(spark):
    near = "array<struct<k:bigint,ovlp:int>>"
    rows = [
        (0, 1, 9, [], [(2, 50), (4, 48), (6, 20)], "A" * 400),  # 20 is below 0.7 of 48
        (2, 3, 9, [(1, 50)], [(20, 40)], "C" * 400),  # 20 and 21 are claimed twice
        (4, 5, 9, [(1, 47)], [], "G" * 400),  # doesn't answer with 48
        (6, 7, 9, [(1, 20)], [(8, 33)], "T" * 400),
        (8, 9, 1, [(7, 33)], [], "T" * 100),  # a short record of one read
        (20, 21, 9, [(3, 40)], [], "A" * 400),
        (20, 22, 9, [], [], "C" * 400),
    ]
    records = spark.createDataFrame([(*r, None) for r in rows], f"k0 long, k1 long, nsr int, nei0 {near}, nei1 {near}, seq string, cov string")
    vertices, edges = load_graph(records)
    assert sorted(map(tuple, edges.collect())) == [(0, 4, 50), (5, 1, 50)]
    assert sorted(r.id for r in vertices.collect()) == [0, 2, 4, 6, 20, 20]
    assert (0, 8, 48) in set(map(tuple, load_graph(records, amend=False)[1].collect()))


def test_links_walked_backwards_lose_their_own_bases(spark):
    contigs = spark.createDataFrame([(5, "AAAACCCC"), (1, "CCCGGGG")], "contig long, seq string")
    links = spark.createDataFrame([(3, 10, 9, -3, -4, "")], "end_a long, end_b long, avg_dist long, l int, back int, patch string")
    got = [r.seq for r in scaftigs(contigs, links, 100).select(F.col("seq")).collect()]
    assert got == ["CCCGGGGACCCC"]
    assert len(scaftigs(contigs, links.drop("l", "back", "patch"), 100, patched_only=True).collect()) == 2
