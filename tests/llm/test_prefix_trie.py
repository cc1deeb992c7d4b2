import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strandloom.llm.prefix_trie import Louds, labelled_turns, prefix_nodes, with_openings

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(c - c % 100, [])[: h[c]] + ts[h[c] :] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    kids = {p: [q for q in below[p] if len(q) == len(p) + 1] for p in members}
    out = []
    for p, ms in members.items():
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below[p])
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids[p]), sum(1 for q in below[p] if not kids[q]), saved, sha))
    return sorted(out, key=str)


def run(spark, rows, rebuild=True, **options):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, label string, depth int")
    turns = labelled_turns(frame)
    found = prefix_nodes(*(with_openings(turns) if rebuild else (turns,)), **options)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=str)


def talk(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(90, 320), n):
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "é" * 5, "", None, "ok then"])))
    return rows + rows[:4] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("heavy", [256, 3])
def test_matches_brute_force(spark, heavy):
    rows = talk(heavy)
    assert run(spark, rows, heavy=heavy) == brute(rows)


def test_a_hot_conversation_and_a_hot_opening(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1000, 1080) for t in range(4)] + [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(2000, 2080) for t in range(3)]
    assert run(spark, rows, rebuild=False, heavy=8) == brute(rows, rebuild=False)


def test_one_long_conversation(spark):
    rows = [(5, t, "user", "a" * (t % 7)) for t in range(400)]
    assert run(spark, rows, rebuild=False) == brute(rows, rebuild=False)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, 0, "user", "x")]) == []


def test_level_order_tries_find_paths():
    rng = random.Random(2)
    paths = [(rng.randrange(3), [(rng.randrange(3), 7) for _ in range(rng.randint(0, 5))]) for _ in range(40)] + [(0, []), (1, []), (2, [])]
    flat = np.array([x for _, p in paths for x in p], np.uint64).reshape(-1, 2)
    edge = np.cumsum([0, *(len(p) for _, p in paths)])
    trie, ends = Louds.build(np.array([t for t, _ in paths]), edge, flat, np.zeros(len(flat), np.int64))
    assert len({(t, tuple(p[:d])) for t, p in paths for d in range(len(p) + 1)}) == trie.levels[-1] == len(trie.parents()) == len(trie.children())
    for (tree, path), end in zip(paths, ends, strict=True):
        assert trie.find(tree, np.array(path, np.uint64).reshape(-1, 2)) == end
        for _ in path:
            end = trie.parents()[end]
        assert end == tree
    assert trie.find(0, np.array([[9, 9]], np.uint64)) == -1
