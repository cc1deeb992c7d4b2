"""Hot seeds: candidates are told apart before pairs are made, and nothing is lost."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import coverage as C
from strandloom.operators import overlaps as O
from strandloom.operators import seeds as S


def some_strings(n, seed, longest=140):
    """Strings a third of which begin with one seed of 9 bases; some end with a piece that others begin with, some lie in others, some are equal."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    hot, out = "ACACACACA", []
    for i in range(n):
        s = word(rng.randint(20, longest))
        if i % 3 == 0:
            s = hot + s
        elif i % 7 == 1 and out:
            other = rng.choice(out)
            s = s + other[: rng.randint(9, len(other))]
        elif i % 7 == 2 and out:
            other = rng.choice(out)
            at = rng.randint(0, len(other) - 12)
            s = other[at : at + rng.randint(12, len(other))]
        out.append(s)
    return [*out, *out[::11]]


@pytest.mark.parametrize("limits", [{}, {"most": 5}, {"most": 0, "table": 3}])
def test_every_way_finds_the_same(spark, limits, monkeypatch):
    strings = some_strings(150, 3)
    frame = spark.createDataFrame(list(enumerate(strings)), "oriented_id long, seq string")
    kept = {(a, b, n) for a, s in enumerate(strings) for b, t in enumerate(strings) for n in range(9, min(len(s), len(t))) if a != b and s[-n:] == t[:n]}
    candidates = S.overlap_candidates(frame, 9, **limits)
    rows = {tuple(r) for r in candidates.collect()}
    assert kept <= rows
    monkeypatch.setattr(S.hot_seeds, "__defaults__", (limits.get("most", S.HOT), limits.get("table", S.TABLE)))
    assert sorted(tuple(r) for r in O.overlaps(frame, 9).collect()) == sorted(kept)
    inside = {i for i, s in enumerate(strings) if any(s in t and (len(t) > len(s) or j < i) for j, t in enumerate(strings) if j != i)}
    got = [r.oriented_id for r in O.contained_reads(frame, 9).collect()]
    assert sorted(got) == sorted(inside)
    contigs = ["".join(random.Random(k).choice("ACGT") for _ in range(700)) for k in range(2)] + ["ACACACACA" * 90, "", "ACG"]
    contigs[0] = contigs[0][:300] + strings[0] + contigs[0][300:] + strings[3]
    reads = strings[:40] + [contigs[1][5:90], contigs[2][:60]]
    monkeypatch.setattr(C, "PIECE", 64)
    hits = C.full_length_hits(spark.createDataFrame(list(enumerate(contigs)), "contig long, seq string"), spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string"), 9)
    want = []
    for c, s in enumerate(contigs):
        for r, t in enumerate(reads):
            for strand, u in enumerate((t, t[::-1].translate(str.maketrans("ACGT", "TGCA")))):
                want += [(c, r, strand, i, i + len(u)) for i in range(len(s) - len(u) + 1) if s[i : i + len(u)] == u]
    assert sorted(tuple(r) for r in hits.collect()) == sorted(want)


def test_a_seed_on_a_third_of_the_reads_makes_no_pairs_of_its_own(spark):
    strings = some_strings(3000, 8, 60)
    frame = spark.createDataFrame(list(enumerate(strings)), "oriented_id long, seq string").repartition(4)
    hot = [s for s in strings if s.startswith("ACACACACA")]
    assert len(hot) > 1000
    begins = frame.where(F.col("seq").startswith("ACACACACA")).select(F.col("oriented_id").alias("b"))
    candidates, found = (f.join(begins, "b", "left_semi").count() for f in (S.overlap_candidates(frame, 9), O.overlaps(frame, 9)))
    assert found > 0 and candidates <= found + len(hot)
    firsts = frame.dropDuplicates(["seq"])
    pairs = S.whole_candidates(firsts, firsts.withColumnRenamed("oriented_id", "in_id"), 9, ["in_id"]).where("oriented_id <> in_id").count()
    assert pairs < len(strings) * 2
    keyed = S.hot_seeds(frame.select(F.substring("seq", 1, 9).alias("m"), F.length("seq").alias("size")), ["m"], 9)
    assert [r.m for r in keyed.collect()] == ["ACACACACA"]


def test_ladder(spark):
    rows = spark.range(9, 500).select(F.col("id").cast("int").alias("n")).select("n", S.rung(F.col("n"), 9).alias("r"), S.ladder(F.col("n"), 9).alias("all")).collect()
    for r in rows:
        want = [k for k in [*range(9, 36), 36, 72, 144, 288] if k <= r.n]
        assert sorted(r["all"]) == want and r.r == want[-1]
