"""Overlaps between reads: suffix-prefix joins, containment, transitive reduction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.seeds import overlap_candidates, whole_candidates
from strandloom.session import cut_lineage


def with_strings(rows: DataFrame, strings: DataFrame, id_col: str, name: str) -> DataFrame:
    """rows with the string of id_col as a column; strings: (oriented_id, seq). Candidates carry ids and places, and get strings only to be compared."""
    return rows.join(strings.select(F.col("oriented_id").alias(id_col), F.col("seq").alias(name)), id_col)


def contained_reads(collection: DataFrame, seed: int, group: str | None = None) -> DataFrame:
    """(oriented_id): strings that are part of a longer one, and all but the first of equal strings.

    Of equal strings the first alone is looked up: its first `seed` bases among all positions of the others, with longer pieces where many strings
    begin with them (seeds.py), then the rest is compared. Strings shorter than the seed must be looked up with a smaller one. With group, a column, only strings of one group meet.
    """
    also = [group] if group else []
    strings = collection.where(F.length("seq") >= seed)
    firsts = cut_lineage(strings.groupBy(*also, "seq").agg(F.min("oriented_id").alias("oriented_id")))
    equal = strings.select("oriented_id").join(firsts, "oriented_id", "left_anti")
    named = firsts.withColumnRenamed("oriented_id", "in_id")
    found = whole_candidates(firsts, named, seed, ["in_id"], also).where("in_size > size").select("oriented_id", "in_id", "at", "size")
    found = with_strings(found, firsts, "in_id", "in_seq").select("oriented_id", F.expr("substring(in_seq, at + 1, size)").alias("part"))
    return with_strings(found, firsts, "oriented_id", "seq").where("part = seq").select("oriented_id").distinct().unionAll(equal)


def overhangs(collection: DataFrame, min_overlap: int, group: str | None = None) -> DataFrame:
    """(a, b, ovlp, rest): a suffix of string a is a prefix of string b, shorter than either; rest is what b adds to a.

    A join on b's first min_overlap bases, with longer pieces where many strings begin with them (seeds.py), verified on the rest; all overlaps of a pair are kept. With group, a column, only strings of one group meet.
    """
    found = overlap_candidates(collection, min_overlap, [group] if group else [])
    found = with_strings(found, collection, "a", "a_seq").select("a", "b", "ovlp", F.expr("right(a_seq, ovlp)").alias("part"))
    return with_strings(found, collection, "b", "b_seq").where("part = left(b_seq, ovlp)").select("a", "b", "ovlp", F.expr("substring(b_seq, ovlp + 1)").alias("rest"))


def overlaps(collection: DataFrame, min_overlap: int, group: str | None = None) -> DataFrame:
    """(a, b, ovlp) of overhangs."""
    return overhangs(collection, min_overlap, group).drop("rest")


def longest_overlaps(found: DataFrame) -> DataFrame:
    """One overlap for each (a, b): the longest."""
    rest = [F.max_by("rest", "ovlp").alias("rest")] if "rest" in found.columns else []
    return found.groupBy("a", "b").agg(F.max("ovlp").alias("ovlp"), *rest)


def _fronts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose rest no shorter one of the same a begins. Rows come in order of a and rest, so the last row that stayed is the one to look at."""
    now, front = None, ""
    for pdf in batches:
        stays = []
        for a, rest in zip(pdf["a"], pdf["rest"], strict=True):
            within = a == now and len(rest) > len(front) and rest.startswith(front)
            if not within:
                now, front = a, rest
            stays.append(not within)
        yield pdf.loc[stays, ["a", "b", "ovlp"]]


def irreducible(found: DataFrame) -> DataFrame:
    """(a, b, ovlp): overlaps a -> c of found (a, b, ovlp, rest) that no a -> b -> c of the same spelling explains; no string may hold another.

    What a longer overlap adds to a then begins what c adds. In the order of these overhangs all that one begins follow it, so each end takes one ordered
    pass over its overlaps: they are dealt out and sorted once, edges never meet edges, and a task holds one overhang.
    """
    return found.repartition("a").sortWithinPartitions("a", "rest").mapInPandas(_fronts, "a long, b long, ovlp int")
