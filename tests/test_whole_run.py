"""Reads to scaftigs in one call, broken off and taken up again."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from strandloom.operators import whole_run as W

RC = str.maketrans("ACGT", "TGCA")


def pairs():
    """Pairs of a genome of 700 bases that start at every third base, and pairs that end at every third one; those with a read at 331 to 345 are missing, so unitigs of 41 bases stop there."""
    rng = random.Random(5)
    g = "".join(rng.choice("ACGT") for _ in range(700))
    spans = [(at, at + rng.randint(190, 210)) for at in range(0, 700, 3)] + [(at - rng.randint(190, 210), at) for at in range(0, 701, 3)]
    spans = sorted({(b, e) for b, e in spans if b >= 0 and e <= 700 and not any(331 <= at <= 345 for at in (b, e - 50))})
    reads = [(g[b : b + 50], g[e - 50 : e][::-1].translate(RC)) for b, e in spans]
    return g, spans, [(2 * p + k, s) for p, both in enumerate(reads) for k, s in enumerate(both)]


def stretches(spans, least=41):
    """Where reads of 50 bases follow each other with so much overlap."""
    out = []
    for at in sorted({b for b, _ in spans} | {e - 50 for _, e in spans}):
        if out and at + least <= out[-1][1]:
            out[-1][1] = at + 50
        else:
            out.append([at, at + 50])
    return out


def test_a_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    g, spans, rows = pairs()
    reads = spark.createDataFrame(rows, "rid long, s string")
    rules = W.Rules(min_overlap=41, seed=31, correct=False, cleaning=(), skip=20)
    folder = str(tmp_path / "run")

    def lost(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(W, "patch_gaps", lost)
        first = W.Stages(spark, folder)
        with pytest.raises(RuntimeError, match="lost"):
            W.reads_to_scaftigs(reads, rules, stages=first)
        assert first.made == ["reads", "unitigs_vertices", "unitigs_edges", "contigs", "hits", "inserts", "places", "links"]
    again = W.Stages(spark, folder)
    found = W.reads_to_scaftigs(reads.repartition(3), rules, stages=again).collect()
    assert again.made == ["patches", "scaftigs", "broken"]
    (beg, _), (_, end) = stretches(spans)
    assert [(r.n_unitigs, min(r.seq, r.seq[::-1].translate(RC))) for r in found] == [(2, min(g[beg:end], g[beg:end][::-1].translate(RC)))]
    # A table without its marker is made anew, and so is what has other parameters; what does not read it stays.
    [shutil.os.remove(p) for p in (tmp_path / "run").glob("scaftigs-*/_SUCCESS")]
    third = W.Stages(spark, folder)
    W.reads_to_scaftigs(reads, W.Rules(min_overlap=41, seed=31, correct=False, cleaning=(), skip=10), stages=third)
    assert third.made == ["scaftigs", "broken"]
    other = W.Stages(spark, folder)
    monkeypatch.setattr(W, "unitig_graph", lost)
    with pytest.raises(RuntimeError, match="lost"):
        W.reads_to_scaftigs(reads.where("rid > 1"), rules, stages=other)
    assert other.made == ["reads"]


def test_reads_without_pairs_and_no_reads(spark, tmp_path):
    g, spans, rows = pairs()
    single = spark.createDataFrame([(r * 2, s) for r, s in rows[:40]], "rid long, s string")
    rules = W.Rules(min_overlap=41, correct=False, cleaning=(), min_a=None)
    found = W.reads_to_scaftigs(single, rules, folder=str(tmp_path / "single")).collect()
    assert found and all(r.seq in g or r.seq[::-1].translate(RC) in g for r in found)
    assert W.reads_to_scaftigs(single.where(F.lit(False)), rules, folder=str(tmp_path / "none")).count() == 0
