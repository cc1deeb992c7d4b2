"""Suffix-array intervals without an order of all suffixes."""

import random

from strandloom.operators import suffixes as X


def some(spark):
    rng = random.Random(5)
    strings = ["".join(rng.choice("ACGTN" if i % 5 == 0 else "ACG") for _ in range(rng.randint(0, 30))) for i in range(60)] * 3
    patterns = sorted({s[i : i + n] for s in strings[::4] for i in (0, 3) for n in (1, 2, 5, 9, 40)} | {"TTTT", "N", "NN", "AN", "", "GATTACA" * 6})
    return strings, patterns, spark.createDataFrame(list(enumerate(strings)), "oriented_id long, seq string"), spark.createDataFrame([(p,) for p in [*patterns, None, "AC"]], "pattern string")


def test_intervals_are_those_of_a_sorted_list(spark):
    strings, patterns, collection, table = some(spark)
    key = lambda s: s.replace("N", "Z")
    suffixes = sorted(key(s[i:]) for s in strings for i in range(len(s) + 1))
    want = {(p, sum(x < key(p) for x in suffixes), sum(x.startswith(key(p)) for x in suffixes) if p else 0) for p in patterns}
    assert sorted(tuple(r) for r in X.intervals(collection, table).select("pattern", "lo", "n").collect()) == sorted(want)


def test_equal_beginnings_are_one_row_of_the_order(spark, monkeypatch):
    strings, patterns, collection, table = some(spark)
    table, ordered, totals = table.where("length(pattern) < 3"), [], X.running_totals
    monkeypatch.setattr(X, "running_totals", lambda df, *a, **b: (ordered.append(df.count()), totals(df, *a, **b))[1])
    n = X.intervals(collection, table).count()
    assert ordered == [len({s[i : i + 2] for s in strings for i in range(len(s) + 1)}) + 2 * n]
