import random
import re

import numpy as np
import pytest

from strandloom.llm import near_jaccard as N


def shingle_set(text, size=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    parent = {k: k for k, _ in rows if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted(((k, len(s), None if k is None else find(k)) for (k, _), s in zip(rows, sets, strict=True)), key=str)


def corpus(seed, n=90):
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    for base in range(n // 6):
        words = [word() for _ in range(rng.choice([0, 1, 3, 5, 6, 8, 12, 30, 60, 150, 400]))]
        if base % 3 == 0:
            words += passage
        for _ in range(6):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                if own:
                    own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own += [word() for _ in range(rng.randrange(12))]
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(own)))
    rows += [(None, rows[5][1]), (len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "É é A")]
    rng.shuffle(rows)
    return rows


def run(spark, rows, scheme=N.Scheme()):
    frame = spark.createDataFrame([(k, t, 3, True) for k, t in rows], "doc_id long, text string, size int, small boolean")
    return sorted((tuple(r)[:3] for r in N.near_components(frame, scheme=scheme).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_sets_short_of_segments_get_another_cut(spark):
    rows = corpus(3)
    assert run(spark, rows, N.Scheme(roomy=0.6, deleted_every=2)) == brute(rows)


def test_large_group_and_common_passage(spark):
    rng = random.Random(7)
    base, passage = [f"b{i}" for i in range(90)], " ".join(f"p{i}" for i in range(50))
    rows = []
    for k in range(120):
        own = list(base)
        own[rng.randrange(90)] = f"x{k}"
        rows.append((k, " ".join(own)))
    rows += [(k, " ".join(f"u{rng.randrange(9999)}" for _ in range(40)) + " " + passage) for k in range(120, 220)]
    rows += [(k, rows[0][1]) for k in range(220, 260)]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_repeated_ids(spark):
    assert run(spark, []) == []
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "A B C D E F G"), (3, "q  r s t u v w"), (4, "z")]
    assert [r[2] for r in run(spark, rows)] == [1, 1, 1, 1, 4]


def test_every_similar_pair_meets():
    """Without Spark: a pair that links has a unit where it meets, whichever units a set takes."""
    rng, scheme = np.random.default_rng(5), N.Scheme()
    for size in (45, 80, 200, 700):
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            gone = rng.integers(0, size // 7 + 1)
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[gone:]], rng.integers(0, 1 << 63, rng.integers(0, size // 7 + 1)).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            rows, large, sig, segment, deleted, _ = N.signatures([a, b], np.array([True, True]), scheme)
            low = 0 if len(a) <= len(b) else 1
            mine = rows == low
            exact = set(sig[(rows != low) & ~deleted].tolist())
            free = ~np.isin(sig, list(exact))
            assert (mine & ~deleted & ~large & free).sum() < scheme.units(min(len(a), len(b)))


def test_packing_is_lossless():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (0, 1, 7, 50, 300)]
    rows, large, sig, segment, deleted, _ = N.signatures(sets, np.ones(5, bool), N.Scheme())
    prints, mask = np.arange(5).astype(np.uint64), (1 << 40) - 1
    for ids in (np.arange(5) * 11, np.array([-(1 << 63), 5, -7, (1 << 63) - 1, 0])):
        got = []
        for bucket, blob in N.pack(ids, prints, rows, large, sig, segment, deleted, 7):
            s, seg, gone, doc, mark, own = N.unpack(memoryview(blob))
            got += list(zip([bucket] * len(s), s.tolist(), seg.tolist(), gone.tolist(), doc.tolist(), mark.tolist(), own.tolist(), strict=True))
        want = [(int(s % np.uint64(7)), int(s // np.uint64(7)) & mask, int(g), bool(d), int(ids[r]), int(prints[r]), bool(o)) for r, o, s, g, d in zip(rows, large, sig, segment, deleted, strict=True)]
        assert sorted(got) == sorted(want)


def test_rows_of_one_id_are_one_node(spark):
    text = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    one, two, three = text("x", 60), text("y", 60), text("z", 60)
    rows = [(5, one), (5, two), (3, two), (7, one + " x60"), (9, three), (9, ""), (8, three), (11, text("w", 60))]
    got = N.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 3), (8, 8), (9, 8), (9, 8), (11, 11)]
    same = N.near_components(spark.createDataFrame([(5, one), (5, two), (3, two)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in same) == [(3, 3), (5, 3), (5, 3)]


def test_names_of_lone_sets_stay_short():
    """With many buckets a signature mostly travels alone; a set that comes once must not add its print to each."""
    rng, buckets = np.random.default_rng(3), 3000
    sets = [np.unique(rng.integers(0, 1 << 62, 200).astype(np.uint64)) for _ in range(400)]
    rows, large, sig, segment, deleted, _ = N.signatures(sets, np.ones(len(sets), bool), N.Scheme())
    prints = np.zeros(len(sets), np.uint64)
    prints[::50] = sig[: len(prints[::50])]
    blobs = list(N.pack(np.arange(len(sets)), prints, rows, large, sig, segment, deleted, buckets, N.SIGNATURE_BYTES))
    assert sum(len(blob) for _, blob in blobs) < 10 * len(sig)
    got = [(b, *x) for b, blob in blobs for x in zip(*(c.tolist() for c in N.unpack(memoryview(blob))), strict=True)]
    low = (1 << 8 * N.SIGNATURE_BYTES) - 1
    want = [(s % buckets, s // buckets & low, g, d, r, int(prints[r]), o) for r, o, s, g, d in zip(*(c.tolist() for c in (rows, large, sig, segment, deleted)), strict=True)]
    assert sorted(got) == sorted(want)


def test_only_sets_or_ids_that_repeat_have_prints(spark):
    text = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(1, text("x", 40)), (2, text("x", 40).upper()), (3, text("y", 40)), (3, ""), (4, text("z", 40)), (5, text("z", 40) + " zz"), (6, text("w", 40)), (None, text("w", 40)), (7, text("x", 39))]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, small boolean")
    repeated = N.repeated_keys(docs, N.Scheme(), N.Scratch(spark, "near"))
    met = N.signature_meetings(docs, N.Scheme(), False, repeated).collect()
    marks = {(r.doc_id, r.size): r.sig == r["print"] for r in met if r.kind < 0 and r.doc_id is not None}
    assert {r.sig for r in met if r.kind < 0 and not marks.get((r.doc_id, r.size), True)} == {0}
    assert {k for k, marked in marks.items() if marked} == {(1, 36), (2, 36), (3, 36), (3, 0)}
    # Texts 1 and 2 stand for one, so they and 7 have two rows of each shingle that 7 shares with them.
    assert {r.doc_id for r in met if r.kind == 0} == {1, 4, 5, 7}
    assert {(r.doc_id, r["print"] == 0) for r in met if r.kind == 0} == {(1, False), (4, True), (5, True), (7, True)}
