import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import suffix_dedup
from strandloom.llm.suffix_dedup import WINDOW, covered_windows, without_repeats
from strandloom.llm.suffix_order import suffix_orders


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=30), min_size=1, max_size=6))
def test_orders_are_those_of_sorting(texts):
    texts = [[*t, 0] for t in texts]
    at = np.cumsum([0, *map(len, texts)])
    got = suffix_orders(np.concatenate(texts).astype(np.int64), at)
    for k, text in enumerate(texts):
        assert list(got[at[k] : at[k + 1]] - at[k]) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows):
    """Rows (doc, text) by the definition."""
    key = lambda d: (1 << 63) - 1 if d is None else d
    first = {}
    raws = [(key(d), (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - WINDOW + 1):
            w = raw[i : i + WINDOW]
            first[w] = min(first.get(w, d), d)
    out = []
    for (doc, _), (d, raw) in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for i in range(len(raw) - WINDOW + 1):
            if first[raw[i : i + WINDOW]] < d:
                gone[i : i + WINDOW] = b"\1" * WINDOW
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, bucket int, kept string")
    found = without_repeats(docs, **options).collect()
    for r in found:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed and r.n_bytes - r.n_removed == len(r.kept)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found), key=str)


def corpus(seed, n=120):
    """Documents that share passages at every offset, with edits, periodic stretches and characters of several bytes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    stretch = lambda k: " ".join(word() for _ in range(k))
    pool = [stretch(rng.randint(8, 40)) for _ in range(12)] + ["ab" * 60, "=" * 70, stretch(9) * 4]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            text = rng.choice(pool) if rng.random() < 0.6 else stretch(rng.randint(1, 30))
            if rng.random() < 0.3 and text:
                k = rng.randrange(len(text))
                text = text[:k] + "Z" + text[k + 1 :]
            if rng.random() < 0.3:
                text = text[rng.randint(0, 20) :]
            parts.append(text)
        rows.append((rng.choice([d, d, d, None, 5]), rng.choice(["".join(parts)] * 9 + [None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_windows_just_long_enough_and_one_short(spark):
    shared = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(50))
    rows = [(1, shared), (2, shared), (3, "x" + shared + "y"), (4, shared[:-1]), (5, shared[1:]), (0, None), (7, ""), (8, shared + shared)]
    assert run(spark, rows) == brute(rows)


def test_hot_grams_go_window_by_window(spark):
    line = "a line of more than fifty bytes that very many documents hold, each before something of its own: "
    rng = random.Random(4)
    rows = [(d, line + "".join(rng.choice("abcdefgh") for _ in range(40)) + line[: rng.randint(0, len(line))]) for d in range(60)]
    assert run(spark, rows, hot=2) == brute(rows)
    assert run(spark, corpus(3), hot=1) == brute(corpus(3))


def test_a_long_text_is_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1500)
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij") for _ in range(9000))
    docs = spark.createDataFrame([(2, text), (1, text[4000:4700] + "!" + text[990:1060])], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # The functions run where the setting holds, without Spark's workers.
    import pyarrow as pa

    batch = pa.record_batch([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc", "text"])
    met = list(suffix_dedup._meet(17)(b.select(["bucket", "blob"]) for b in sorted_blobs(suffix_dedup._anchor_blobs(17)(iter([batch])))))
    asked = [b for b in met if b.column(0)[0].as_py() == suffix_dedup.ASKED]
    whole = [b for b in met if b.column(0)[0].as_py() == suffix_dedup.WHOLE]
    blocks = list(suffix_dedup._blocks(beside(asked, rows)))
    ordered = pa.Table.from_batches(blocks, suffix_dedup.BLOCK).sort_by([("key", "ascending"), ("hot", "ascending"), ("doc", "ascending")]).to_batches()
    some = list(suffix_dedup._order(17)(iter(ordered)))
    out = [r for b in suffix_dedup._without(beside(whole + some, rows)) for r in b.to_pylist()]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out), key=str)
    assert got == brute(rows)


def sorted_blobs(batches):
    import pyarrow as pa

    return pa.Table.from_batches(list(batches)).sort_by("bucket").to_batches()


def beside(blobs, rows):
    import pyarrow as pa

    found = [(k, b, x, None, None) for batch in blobs for k, b, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    found += [(suffix_dedup.TEXT, d % 17, None, d, t) for d, t in rows]
    found.sort(key=lambda r: (r[1], r[0]))
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string()]
    return iter([pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["kind", "bucket", "blob", "doc", "text"])])


def test_equal_windows_of_different_blocks():
    gram = b"GGGGGGGGGGGGGGGGGGGG"
    left, right = b"abcdefghijklmnopqrstuvwxyz1234", b"ABCDEFHIJKLMNOPQRSTUVWXYZ56789"
    one = (left + gram + right[:5] + b"q" * 25, 30, 31, 4)
    two = (left[20:] + gram + right[:20], 10, 1, 1)
    assert [list(x) for x in covered_windows([[one, two], [one]])] == [[0, 0], [0]]
    two = (left[20:] + gram + right[:5] + b"q" * 15, 10, 1, 1)
    assert [list(x) for x in covered_windows([[one, two]])] == [[1 << 20, 0]]


def test_empty_table(spark):
    assert run(spark, []) == []
