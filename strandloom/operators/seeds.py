"""Joins by seed in which seeds that many strings begin with are told apart by longer pieces before any pair is made.

A seed is hot where more than HOT strings begin with it. Its strings meet by a longer piece as well, of a length from a ladder: every length
below four seeds, then doublings. Up to four seeds the piece is all that has to agree, so candidates are the pairs that are found; beyond, it is more than half of it.
No seed and no pair is dropped; pieces are compared by hash, and the caller compares the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequences import windows
from strandloom.session import cut_lineage

#: Strings that begin with a seed before it counts as hot, and hot seeds that are broadcast; with more of them every seed is treated as hot, without a table.
HOT, TABLE = 64, 100_000


def rung(size: Column, seed: int) -> Column:
    """The longest length of the ladder that is no more than size (seed at least)."""
    top = 4 * seed
    doublings = F.length(F.bin(F.floor(size / top).cast("long"))) - 1
    return F.when(size < top, size).otherwise(F.call_function("shiftleft", F.lit(top), doublings)).cast("int")


def ladder(most: Column, seed: int) -> Column:
    """All lengths of the ladder from seed to most (seed at least), as an array."""
    top = 4 * seed
    doubled = F.array(*(F.lit(top << j) for j in range(31) if top << j < 1 << 31))
    return F.concat(F.sequence(F.lit(seed), F.least(most, F.lit(top - 1)).cast("int")), F.filter(doubled, lambda x: x <= most))


def _piece(seq: str, at: Column | int, size: Column) -> Column:
    """struct(step, piece): the key of a piece of seq from the 0-based place at; step 0 is no piece."""
    start = F.lit(at + 1) if isinstance(at, int) else at + 1
    return F.struct(size.alias("step"), F.when(size > 0, F.xxhash64(F.substring(seq, start, size))).otherwise(F.lit(0)).alias("piece"))


def _marked(rows: DataFrame, hot: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """rows with rungs: the lengths at which strings of the row's seed meet, null where it isn't hot."""
    if hot is None:
        return rows.withColumn("rungs", F.lit(None).cast("array<int>"))
    if "m" in hot.columns:
        return rows.join(F.broadcast(hot), list(keys), "left")
    return rows.crossJoin(F.broadcast(hot))  # one row


def hot_seeds(heads: DataFrame, keys: Sequence[str], seed: int, most: int = HOT, table: int = TABLE) -> DataFrame | None:
    """(keys, rungs): hot seeds of heads (keys, size) with the ladder's lengths that their strings have; (rungs) of all seeds alike where there are more than `table`, None where there is none."""
    groups = heads.groupBy(*keys).agg(F.count("*").alias("n"), F.collect_set(rung(F.col("size"), seed)).alias("rungs"))
    hot = cut_lineage(groups.where(F.col("n") > most).drop("n"))
    n = hot.limit(table + 1).count()
    if n > table:
        return cut_lineage(heads.agg(F.collect_set(rung(F.col("size"), seed)).alias("rungs")))  # the ladder is short
    return hot if n else None


def whole_candidates(heads: DataFrame, strings: DataFrame, seed: int, keep: Sequence[str], group: Sequence[str] = (), **limits: int) -> DataFrame:
    """(columns of heads but seq, keep, in_size, at): places of strings (keep, seq) at which a string of heads (..., seq) may lie whole.

    heads hold seed bases at least. With group, columns of both, only rows of one group meet.
    """
    keys, none = [*group, "m"], F.array(F.lit(0))
    own = heads.withColumn("size", F.length("seq")).withColumn("m", F.substring("seq", 1, seed))
    hot = hot_seeds(own, keys, seed, **limits)
    spots = strings.select(*group, *keep, "seq", F.length("seq").alias("in_size"), F.posexplode(windows(F.col("seq"), seed)).alias("at", "m"))
    if hot is None:
        return own.drop("seq").join(spots.drop("seq"), keys).where("at + size <= in_size").drop("m")
    fits = F.filter(F.coalesce("rungs", none), lambda x: F.col("at") + x <= F.col("in_size"))
    spots = _marked(spots, hot, keys).withColumn("x", F.explode(F.transform(fits, lambda x: _piece("seq", F.col("at"), x)))).select(*keys, *keep, "in_size", "at", "x.step", "x.piece")
    own = _marked(own, hot, keys).withColumn("x", _piece("seq", 0, F.when(F.col("rungs").isNull(), 0).otherwise(rung(F.col("size"), seed)))).withColumns({"step": F.col("x.step"), "piece": F.col("x.piece")})
    return own.drop("seq", "rungs", "x").join(spots, [*keys, "step", "piece"]).where("at + size <= in_size").drop("m", "step", "piece")


def overlap_candidates(strings: DataFrame, seed: int, group: Sequence[str] = (), **limits: int) -> DataFrame:
    """(a, b, ovlp): a suffix of string a of at least seed bases, shorter than either, that may be a prefix of string b; strings: (oriented_id, seq)."""
    keys, none = [*group, "m"], F.array(F.lit(0))
    heads = strings.where(F.length("seq") > seed).select(*group, F.col("oriented_id").alias("b"), "seq", F.length("seq").alias("size"), F.substring("seq", 1, seed).alias("m"))
    hot = hot_seeds(heads, keys, seed, **limits)
    spots = strings.select(*group, F.col("oriented_id").alias("a"), "seq", F.length("seq").alias("a_size"), F.posexplode(windows(F.col("seq"), seed)).alias("at", "m")).where("at > 0")
    if hot is None:
        found = spots.drop("seq").join(heads.drop("seq"), keys)
    else:
        left = F.col("a_size") - F.col("at")
        spots = _marked(spots, hot, keys).withColumn("x", _piece("seq", F.col("at"), F.when(F.col("rungs").isNull(), 0).otherwise(rung(left, seed)))).select(*keys, "a", "a_size", "at", "x.step", "x.piece")
        steps = F.when(F.col("rungs").isNull(), none).otherwise(ladder(F.col("size") - 1, seed))
        heads = _marked(heads, hot, keys).withColumn("x", F.explode(F.transform(steps, lambda x: _piece("seq", 0, x)))).select(*keys, "b", "size", "x.step", "x.piece")
        found = spots.join(heads, [*keys, "step", "piece"])
    return found.where("a <> b AND a_size - at < size").select("a", "b", (F.col("a_size") - F.col("at")).cast("int").alias("ovlp"))
