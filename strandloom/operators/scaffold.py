"""Scaffolding: evidence for links between contig ends and paths over them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.chains import chain_positions
from strandloom.session import cut_lineage


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-290
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def student_p(t: float, df: float) -> float:
    """Two-sided P-value of Student's t."""
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def truncated_mean(avg: float, std: float, limit: float) -> float:
    """The mean insert size of links over a gap that only inserts above `limit` span, each in as many places as it is longer."""
    x = (limit - avg) / std
    y = math.sqrt(math.pi / 2) * math.erfc(x / math.sqrt(2))
    return avg + std * y / (math.exp(-x * x / 2) - x * y)


@F.pandas_udf(T.DoubleType())
def student_p_column(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_p(a, b) for a, b in zip(t, df, strict=True)])


@F.pandas_udf(T.DoubleType())
def truncated_mean_column(avg: pd.Series, std: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([truncated_mean(a, s, x) for a, s, x in zip(avg, std, limit, strict=True)])


def link_p_values(distances: DataFrame, avg: float, std: float, reach: int, most_df: int = 50) -> DataFrame:
    """(end_a, end_b, n, p) of link distances (end_a, end_b, dist): how well they agree with the insert size, by a t-test; two pairs at least.

    With a column patch, the length of what lies between the two ends (less than 0 where they overlap), distances and the limit that inserts must span grow by it.
    """
    rows = distances if "patch" in distances.columns else distances.withColumn("patch", F.lit(0))
    rows = rows.groupBy("end_a", "end_b").agg(F.count("*").alias("n"), F.avg("dist").alias("mean"), F.var_pop("dist").alias("var"), F.max("patch").alias("patch")).where("n >= 2")
    expected = truncated_mean_column(F.lit(float(avg)), F.lit(float(std)), F.lit(float(2 * reach)) + F.col("patch"))
    t = (F.col("mean") + F.col("patch") - expected) / F.sqrt(F.greatest("var", F.lit(1e-9)) / (F.col("n") - 1))
    return rows.select("end_a", "end_b", "n", student_p_column(t, F.least(F.col("n") - 1, F.lit(most_df)).cast("double")).alias("p"))


def scaftigs(contigs: DataFrame, links: DataFrame, insert: int, min_a: float = 20.0, min_p: float = 1e-20, *, patched_only: bool = False) -> DataFrame:
    """(seq, n_unitigs, nsr): contigs (contig, seq) joined along links (end_a, end_b, avg_dist) between their ends.

    An end is 2 * contig for the left and 2 * contig + 1 for the right. A gap of insert - avg_dist bases is filled
    with N (one at least); of both directions of a path the one from its smaller end is kept. Where links have a P-value p or contigs an A-statistic a, links
    below min_p and contigs below min_a join nothing; links with a patch of l bases are joined by it, or lose the -l bases that overlap (walked backwards -back, where links have that); with patched_only no other link joins; nsr, the contigs' reads, adds up, or is null where contigs have none.
    """
    if "p" in links.columns:
        links = links.where(F.col("p") >= min_p)
    if "a" in contigs.columns:
        sure = contigs.where(F.col("a") >= min_a).select("contig")
        for end in ("end_a", "end_b"):
            links = links.join(sure.withColumnRenamed("contig", "sure"), F.floor(F.col(end) / 2) == F.col("sure"), "left_semi")
    contigs = contigs.select("contig", "seq", (F.col("nsr") if "nsr" in contigs.columns else F.lit(None)).cast("long").alias("nsr"))
    one = F.lit(1).cast("long")
    for name, kind in (("avg_dist", "long"), ("l", "int"), ("back", "int"), ("patch", "string")):
        if name not in links.columns:
            links = links.withColumn(name, F.lit(None).cast(kind))
    if patched_only:
        links = links.where("l IS NOT NULL")
    back = F.coalesce("back", "l").alias("l")
    both = links.select("end_a", "end_b", "avg_dist", "l", "patch").unionAll(links.select(F.col("end_b").alias("end_a"), F.col("end_a").alias("end_b"), "avg_dist", back, F.reverse(F.translate("patch", "ACGT", "TGCA"))))
    # Leaving by an end is walking the contig so that it comes last; entering by an end, so that it comes first.
    walk = both.select(F.col("end_a").bitwiseXOR(one).alias("a"), F.col("end_b").alias("b"), F.greatest(insert - F.col("avg_dist"), F.lit(1)).cast("long").alias("step"), "l", "patch")
    walk = cut_lineage(walk)
    placed = cut_lineage(chain_positions(walk))
    gaps = walk.select(F.col("b").alias("node"), F.col("step").alias("gap"), "l", "patch")
    rows = placed.join(gaps, "node", "left").join(contigs, F.floor(F.col("node") / 2) == F.col("contig"))
    turned = F.when(F.col("node") % 2 == 0, F.col("seq")).otherwise(F.reverse(F.translate("seq", "ACGT", "TGCA")))
    between = F.when(F.col("position") == 0, "").when(F.col("l").isNotNull(), F.coalesce("patch", F.lit(""))).otherwise(F.repeat(F.lit("N"), F.coalesce(F.col("gap").cast("int"), F.lit(1))))
    own = F.when((F.col("position") > 0) & (F.col("l") < 0), F.expr("substring(turned, 1 - l)")).otherwise(F.col("turned"))
    rows, part = rows.withColumn("turned", turned), F.concat(between, own)
    whole = rows.select("chain", "position", "node", "nsr", part.alias("part")).groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("position", "part"))).alias("parts"), F.max_by("node", "position").alias("last"), F.count("*").alias("n_unitigs"), F.sum("nsr").alias("nsr"))
    kept = whole.where(F.col("chain") < F.col("last").bitwiseXOR(one))
    joined = kept.select(F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("seq"), "n_unitigs", "nsr")
    used = placed.select(F.floor(F.col("node") / 2).alias("contig")).distinct()
    return joined.unionAll(contigs.join(used, "contig", "left_anti").select("seq", F.lit(1).cast("long").alias("n_unitigs"), "nsr"))
