import hashlib
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm.content_sort import drop_exact_duplicates, exact_groups


def brute(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(k)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            out.append((i, keep, len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, norm string, tag int")
    return sorted((tuple(r)[:5] for r in exact_groups(frame).collect()), key=str)


texts = st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", " ", "\n", "\t ", "\x0b", "é", " "]), max_size=4).map("".join))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), texts), min_size=1, max_size=40))
def test_matches_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_a_hot_group_spans_partitions(spark):
    lead = "long common lead " * 20
    rows = [(k, lead + ("copy" if k % 3 else f"own {k}")) for k in range(900)] + [(k, "") for k in range(900, 1000)]
    assert run(spark, rows) == brute(rows)


def test_kept_rows_keep_their_columns(spark):
    frame = spark.createDataFrame([(2, "a  b", "s1"), (1, "a b", "s2"), (3, "c", None), (3, "c", None), (None, "c", "s"), (None, "d", "s")], "doc_id long, text string, source string")
    assert sorted(map(tuple, drop_exact_duplicates(frame).collect()), key=str) == [(1, "a b", "s2"), (3, "c", None), (None, "d", "s")]
    assert drop_exact_duplicates(frame.limit(0)).count() == 0


def test_columns_of_any_name_pass_through(spark):
    rows = [(2, "a  b", 1, "x", 5), (1, "a b", 2, "y", 6), (None, "c", 3, "z", 7), (None, "c", 4, "z", 8), (3, None, 5, None, 9), (4, " ", 6, None, 9), (4, " ", 6, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha int, _keep string, row int").withColumnRenamed("_sha", "sha")
    got = drop_exact_duplicates(docs).collect()
    assert drop_exact_duplicates(docs).columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r.sha, r._keep) for r in got if r.doc_id in (1, 3, 4)) == [(1, "a b", 2, "y"), (3, None, 5, None), (4, " ", 6, None)] and len(got) == 4
    assert drop_exact_duplicates(docs.limit(0)).count() == 0
