"""Joins of the sequence queries broadcast by measured sizes: a small file of keys says nothing of the strings made of it."""

import pytest

from strandloom.plans import catalog
from strandloom.session import measured_broadcasts

SF = "/root/testdata/sf0.001"
ESTIMATED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@pytest.fixture
def usual(spark):
    """Spark's own limits for a test; the session's come back after it."""
    before = {c: spark.conf.get(c, None) for c in (ESTIMATED, MEASURED)}
    for c in before:
        spark.conf.unset(c)
    yield spark
    for c, value in before.items():
        spark.conf.unset(c) if value is None else spark.conf.set(c, value)


#: Queries over customers whose joins were broadcast by the size of the customers' file.
QUERIES = ["full_length_hits", "all_matches", "insert_stats", "links_top2", "pair_coverage", "pairs_over_repeat", "supporting_reads", "smem", "contained_reads", "contrast", "coverage", "equal_reads", "scaftigs", "unique_kmer_filter_pairs", "open_bubble", "open_bubble_pair", "bubble_complex", "bubble_ties", "clean"]


@pytest.mark.parametrize("name", QUERIES)
def test_nothing_is_broadcast_by_its_estimate(usual, name, monkeypatch):
    """Before a plan has run, it holds no broadcast join but those asked for; nor do those of the tables on the way."""
    frame, steps = type(usual.range(1)), []
    checkpoint, write = frame.checkpoint, frame.write
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **b: (steps.append(self), checkpoint(self, *a, **b))[1])
    monkeypatch.setattr(frame, "write", property(lambda self: (steps.append(self), write.fget(self))[1]))
    steps.append(catalog.QUERIES[name](usual, SF))
    plans = [step._jdf.queryExecution() for step in steps]
    assert any("Join" in plan.sparkPlan().toString() for plan in plans)
    for plan in plans:
        assert plan.sparkPlan().toString().count("BroadcastHashJoin") <= plan.optimizedPlan().toString().count("strategy=broadcast")


def test_the_sessions_own_limits(usual):
    usual.conf.set(ESTIMATED, "300k")
    measured_broadcasts(usual)
    measured_broadcasts(usual)
    assert (usual.conf.get(ESTIMATED), usual.conf.get(MEASURED)) == ("-1", "300k")
    usual.conf.set(ESTIMATED, "1m")
    usual.conf.set(MEASURED, "2m")
    measured_broadcasts(usual)
    assert (usual.conf.get(ESTIMATED), usual.conf.get(MEASURED)) == ("-1", "2m")


def test_without_broadcasts_none_comes_back(usual):
    usual.conf.set(ESTIMATED, "-1")
    measured_broadcasts(usual)
    assert usual.conf.get(MEASURED, None) is None
