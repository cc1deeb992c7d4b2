import math
import random
import zlib

import numpy as np
import pyarrow as pa

from strandloom.llm.toxicity import BITS, Rates, distinct_rows, drop_toxic, features, fit, toxicity


def corpus(n, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        bad = k % 5 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["grukk", "blarf", "snidd"]) + rng.choice(["a", "o", ""]))
        rows.append((k, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(2500)
    docs = spark.createDataFrame([(k, t, "en", "toxic") for k, t, _ in rows], "doc_id long, text string, lang string, label string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    truth = {k: y for k, _, y in rows}
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    hits = sum(r.predicted and truth[r.doc_id] for r in held)
    assert hits >= 0.9 * sum(truth[r.doc_id] for r in held) and hits >= 0.98 * sum(r.predicted for r in held)


def test_held_out_labels_change_nothing(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    flip = lambda k, y: 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y
    one, two = (spark.createDataFrame([(k, f(k, y)) for k, _, y in rows], "doc_id long, toxic int") for f in (lambda k, y: y, flip))
    key = lambda r: r.doc_id
    assert sorted(toxicity(docs, one).collect(), key=key) == sorted(toxicity(docs, two).collect(), key=key)


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "grukk"), (4, "grukk " * 20_000), (4, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity(docs, none).collect()] == [0.5] * 5
    odd = spark.createDataFrame([(1, None), (None, 1), (4, 3), (4, 1), (4, 1)], "doc_id long, toxic int")
    assert toxicity(docs, odd).count() == 5
    assert toxicity(docs.limit(0), none).count() == 0
    wide = docs.selectExpr("*", "1 AS score", "'x' AS row")
    assert sorted(map(str, drop_toxic(wide, none).collect())) == sorted(map(str, wide.collect()))


def brute_features(text):
    import re

    import xxhash

    mask, words = (1 << 64) - 1, re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))

    def spot(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return (x ^ (x >> 31)) >> (64 - BITS)

    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    found = set(map(spot, h)) | {spot(xxhash.xxh3_64_intdigest(w[:4], 1)) for w in words}
    for gap, factor in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        found |= {spot((a * 0x9E3779B97F4A7C15 + b * factor) & mask) for a, b in zip(h, h[gap:])}
    return found


def test_features_are_words_stems_pairs_and_skips():
    texts = ["One two, THREE four five", "", "é à-b 7", "x"]
    for row, size, owner, spot in features(pa.array(texts)):
        owner, spot = distinct_rows(owner, spot)
        assert row == 0 and size == 4
        for i, t in enumerate(texts):
            assert set(spot[owner == i].tolist()) == brute_features(t)


def test_l1_keeps_the_model_small():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.append(rng.integers(0, 5000, 30), np.full(int(i % 4 == 0), 9000))), int(i % 4 == 0)) for i in range(1500)]
    weights = fit(rows, Rates())
    assert weights[9000] > 1 and np.count_nonzero(weights) < 300


def brute_fit(rows, rates, bias):
    """FTRL-proximal, coordinate by coordinate, as published."""
    z, n = {}, {}

    def weight(i):
        own = z.get(i, 0.0)
        if abs(own) <= rates.l1:
            return 0.0
        return -(own - math.copysign(rates.l1, own)) / ((rates.beta + math.sqrt(n.get(i, 0.0))) / rates.alpha + rates.l2)

    for _ in range(rates.epochs):
        for spots, label in rows:
            at = [*map(int, spots), bias]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w))))) - label
            for i, own in zip(at, w, strict=True):
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / rates.alpha * own
    return {i: w for i in z if (w := weight(i))}


def test_updates_match_brute_force():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 60, 8)), int(rng.random() < 0.4)) for _ in range(200)]
    for rates in (Rates(), Rates(alpha=0.3, beta=0.5, l1=0.7, l2=0.2, epochs=3)):
        got, want = fit(rows, rates), brute_fit(rows, rates, 1 << BITS)
        assert set(np.flatnonzero(got).tolist()) == set(want)
        assert all(math.isclose(got[i], w, rel_tol=1e-9) for i, w in want.items())
