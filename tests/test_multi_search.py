"""Patterns counted in several collections: as numbers where they can be, and as strings."""

import random

from strandloom.operators import packed as P
from strandloom.operators import suffixes as X


def test_counts_of_each_source(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice(["x", "y", "z", None]), "".join(rng.choice("ACGTN" if i % 4 == 0 else "AC") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    patterns = sorted({s[i : i + n] for _, s in rows[::3] for i in (0, 5) for n in (1, 4, 7, 31, 40)} | {"", "GGGGGGG", "A" * 31, "NN"})
    seen, numbers = [], P.windows_by_source
    monkeypatch.setattr(P, "windows_by_source", lambda c, lengths, *a, **b: (seen.extend(lengths), numbers(c, lengths, *a, **b))[1])
    frame = spark.createDataFrame(rows, "source string, seq string")
    found = X.occurrences_by_source(frame, spark.createDataFrame([(p,) for p in [*patterns, "A"]], "pattern string"), "source")
    count = lambda p, name: sum(s.startswith(p, i) for of, s in rows if of == name for i in range(len(s))) if p and name else 0
    want = {(name, p, count(p, name)) for p in patterns for name in ("x", "y", "z", None)}
    assert {tuple(r) for r in found.select("source", "pattern", "n").collect()} == want
    assert found.count() == len(want)
    assert {1, 4, 7, 31} <= set(seen) and max(seen) == 31
