"""Read pairs: zipping two files, splitting joined records, sharding pairs together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequences import mate_name


def collate(first: DataFrame, second: DataFrame) -> DataFrame:
    """(ord, name, mate, seq, ...) from two tables (ord, name, seq, ...): mates one after the other, both under the first's name. The shorter table ends the result."""
    names = first.select("ord", mate_name(F.col("name")).alias("pair_name"))
    ends = []
    for mate, (own, other) in enumerate(((first, second), (second, first))):
        both = own.join(other.select("ord"), "ord", "left_semi").join(names, "ord")
        ends.append(both.withColumn("mate", F.lit(mate)).withColumn("ord", F.col("ord") * 2 + mate).withColumn("name", F.col("pair_name")).drop("pair_name"))
    return ends[0].unionByName(ends[1])


def split_joined(records: DataFrame) -> DataFrame:
    """(name, mate, seq) of records that hold two mates on either side of a gap of other characters than letters."""
    mates = F.regexp_extract_all("seq", F.lit("([A-Za-z]+)"), F.lit(1))
    return records.select("name", F.posexplode(F.slice(mates, 1, 2)).alias("mate", "seq"))


def shard_pairs(reads: DataFrame, shards: int = 8, id_col: str = "rid") -> DataFrame:
    """reads with the shard that read 2p and read 2p + 1 share."""
    return reads.withColumn("shard", F.shiftright(id_col, 1) % shards)


def drop_broken_pairs(reads: DataFrame, good: str, pair_col: str = "pair") -> DataFrame:
    """Reads of pairs whose mates are all good."""
    bad = reads.where(~F.col(good)).select(pair_col).distinct()
    return reads.join(bad, pair_col, "left_anti")
