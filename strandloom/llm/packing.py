"""Conflict-constrained best-fit packing.

Bins are kept in order of what they have left, each with a bitmap of its sources and one of its
duplicate clusters. An item looks up the first bin that has room and goes on to its successors until
one is compatible: that is the tightest compatible bin. Where bitmaps overlap by hashing alone, the
bin's members decide. Shards of a bounded number of items, dealt by hash so that a hot source or
cluster is spread evenly, are packed independently.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
STEP = 1024


def best_fit(lengths: np.ndarray, sources: list, clusters: list, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in order; no bin holds two items of one source or of one cluster (None conflicts with nothing)."""
    n = len(lengths)
    codes = {s: k for k, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    exact = len(codes) <= BITS
    left, of_source, of_cluster, bins = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
    members: list[tuple[set, set]] = []
    chosen, offset, used = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for i in range(n):
        size, source, cluster = int(lengths[i]), sources[i], clusters[i]
        s = np.uint64(0 if source is None else 1 << codes[source] % BITS)
        c = np.uint64(0 if cluster is None else 1 << hash(cluster) % BITS)
        at, found = int(np.searchsorted(left[:used], size)), -1
        while at < used and found < 0:
            end = min(at + STEP, used)
            source_hit, cluster_hit = (of_source[at:end] & s) != 0, (of_cluster[at:end] & c) != 0
            for k in np.flatnonzero(~source_hit) if exact else range(end - at):
                own = members[bins[at + k]]
                if (source_hit[k] and source in own[0]) or (cluster_hit[k] and cluster in own[1]):
                    continue
                found = at + int(k)
                break
            at = end
        if found < 0:
            bin_, room, found = len(members), capacity, used
            members.append((set(), set()))
            source_bits = cluster_bits = np.uint64(0)
            used += 1
        else:
            bin_, room, source_bits, cluster_bits = int(bins[found]), int(left[found]), of_source[found], of_cluster[found]
        chosen[i], offset[i] = bin_, capacity - room
        if source is not None:
            members[bin_][0].add(source)
        if cluster is not None:
            members[bin_][1].add(cluster)
        spot = int(np.searchsorted(left[:found], room - size))
        for held, value in ((left, room - size), (of_source, source_bits | s), (of_cluster, cluster_bits | c), (bins, bin_)):
            held[spot + 1 : found + 1] = held[spot:found]
            held[spot] = value
    return chosen, offset


def pack_documents(
    docs: DataFrame,
    capacity: int = 8192,
    *,
    id_col: str = "doc_id",
    length: Column | None = None,
    source: Column | None = None,
    cluster: Column | None = None,
    items_per_shard: int = 4096,
) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset: where every part of every document lies.

    length: units of a row (default: UTF-8 bytes of text), source and cluster: what may be in a bin once
    (defaults: source, and the text itself with its white space folded). A document longer than the capacity is cut: full pieces
    have bins of their own and the rest is packed. Items go in by length, longest first, then id and piece.
    Null texts have length 0 and are placed like any item; null ids are packed, those of equal rows in any order; a null
    source, or none of that name, conflicts with nothing; rows that repeat get places of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in docs.columns else F.lit("")
    size = F.octet_length(text) if length is None else length
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(size, F.lit(0)).cast("long").alias("units"),
        (source if source is not None else F.col("source") if "source" in docs.columns else F.lit(None)).cast("string").alias("source"),
        (F.xxhash64(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if cluster is None else cluster).cast("string").alias("cluster"),
    )
    pieces = F.greatest(F.ceil(F.col("units") / capacity), F.lit(1)).cast("int")
    items = rows.select("*", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    items = items.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.col("units") - F.col("piece").cast("long") * capacity, F.lit(capacity)).alias("length"), "source", "cluster")
    total = rows.agg(F.sum(pieces)).first()[0] or 0
    shards = max(1, math.ceil(total / items_per_shard))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        bins, offsets = best_fit(table["length"].to_numpy(), table["source"].to_pylist(), table["cluster"].to_pylist(), capacity)
        shard = table["shard"][0].as_py()
        return table.select(["doc_id", "piece", "start", "length"]).append_column("bin_id", pa.array(bins + (shard << 32))).append_column("bin_offset", pa.array(offsets))

    return dealt.groupBy("shard").applyInArrow(pack, "doc_id long, piece int, start long, length long, bin_id long, bin_offset long")
