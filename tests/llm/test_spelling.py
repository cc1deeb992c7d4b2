import random
import re
import zlib
from collections import Counter

from strandloom.llm.spelling import near_words, spelling_variants

LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    by, form = {w: [v for v in words if near(w, v)] for w in words}, {}
    for w, close in by.items():
        if close:
            v = min(close, key=lambda v: (-words[v], v))
            if words[v] >= 10 * words[w]:
                form[w] = v
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(by[w]), words[form[w]] if w in form else None))
    return sorted(out)


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, word string")
    return sorted(map(tuple, spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_matches_brute_force(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeé×Z") for _ in range(rng.randint(6, 12))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "abababab", "ababababa"]
    def variant(w):
        k = rng.randrange(len(w))
        return rng.choice([w] * 20 + [w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "q" + w[k + 1 :]])
    rows = [(rng.choice([d, d, None]), " ".join(variant(rng.choice(stems)) for _ in range(60)).upper() if d % 5 == 0 else "-".join(variant(variant(rng.choice(stems))) for _ in range(60))) for d in range(80)]
    rows += [(500, None), (501, ""), (501, "1 2 3"), (502, "x" * 3000 + " " + "x" * 3000)]
    got, want = run(spark, rows), brute(rows)
    assert got == want and any(r[1] for r in got)


def test_chains_lead_to_the_last_form(spark):
    chain = [("aaaaaaabbbb", 2), ("aaaaaaacbbb", 30), ("aaaaaaaccbb", 400), ("aaaaaaacccb", 5000)]
    rows = [(k, f"{w} " * n) for k, (w, n) in enumerate(chain)]
    got, want = run(spark, rows), brute(rows)
    assert got == want


def test_every_near_pair_is_found(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("aab") for _ in range(rng.randint(7, 9))) for _ in range(300)})
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    assert sorted((r.word, r.near) for r in near_words(frame).collect()) == sorted((a, b) for a in words for b in words if near(a, b))


def test_no_words(spark):
    assert run(spark, []) == [] and run(spark, [(1, "short words only")]) == []
