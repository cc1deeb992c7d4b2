import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm.packing import best_fit, pack_documents


def brute(lengths, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(lengths, sources, clusters, strict=True):
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        if fits:
            left = min(fits)[0]
            out.append(left)
            k = min(fits)[1]
        else:
            out.append(None)
            bins.append({"left": capacity, "s": set(), "c": set()})
            k = len(bins) - 1
        bins[k]["left"] -= size
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.one_of(st.none(), st.integers(0, 90)), st.one_of(st.none(), st.integers(0, 200))), max_size=40))
def test_every_item_takes_the_tightest_compatible_bin(items):
    lengths = np.array([x[0] for x in items], np.int64)
    chosen, offset = best_fit(lengths, [x[1] for x in items], [x[2] for x in items], 20)
    bins = defaultdict(lambda: {"left": 20, "s": set(), "c": set()})
    for (size, s, c), b, o in zip(items, chosen, offset, strict=True):
        fits = [x["left"] for x in bins.values() if x["left"] >= size and (s is None or s not in x["s"]) and (c is None or c not in x["c"])]
        assert (bins[b]["left"] == min(fits)) if fits else b not in bins
        assert o == 20 - bins[b]["left"]
        bins[b]["left"] -= size
        bins[b]["s"].add(s)
        bins[b]["c"].add(c)
        bins[b]["s"].discard(None), bins[b]["c"].discard(None)
        assert bins[b]["left"] >= 0


def test_distinct_residuals_match_brute_force():
    rng = random.Random(4)
    items = [(rng.randrange(1, 4000), rng.choice([0, 0, 0, *range(1, 9), None]), rng.randrange(60)) for _ in range(800)]
    chosen, offset = best_fit(np.array([x[0] for x in items]), [x[1] for x in items], [x[2] for x in items], 4096)
    want = brute(*zip(*items), 4096)
    assert len(set(chosen.tolist())) == sum(x is None for x in want)


def test_all_pieces_are_placed(spark):
    rng = random.Random(2)
    rows = [(k if k % 50 else None, "x" * rng.choice([0, 1, 30, 90, 100, 101, 350]) if k % 9 else None, rng.choice(["hot", "hot", "a", "b", None]), "clash") for k in range(700)]
    rows += [(5, "same", "a", "")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, piece string")
    got = pack_documents(frame, 100, items_per_shard=200).collect()
    assert sum(r.length for r in got) == sum(len(t or "") for _, t, _, _ in rows)
    assert len(got) == sum(max(1, -(-len(t or "") // 100)) for _, t, _, _ in rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    assert all(sum(r.length for r in b) <= 100 and sorted((r.bin_offset, r.length) for r in b)[0][0] == 0 for b in bins.values())
    for b in bins.values():
        spots = sorted((r.bin_offset, r.length) for r in b)
        assert all(a[0] + a[1] == n[0] for a, n in zip(spots, spots[1:]))
    source = {k: s for k, _, s, _ in rows if k is not None}
    for b in bins.values():
        own = [source[r.doc_id] for r in b if r.doc_id is not None and source[r.doc_id] is not None]
        assert len(own) == len(set(own))
    assert pack_documents(frame.limit(0), 100).count() == 0
