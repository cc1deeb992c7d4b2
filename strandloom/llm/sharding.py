"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has a fixed number of cells; each virtual node starts at a cell and owns the cells up to
the next one. A key belongs to the cell of its hash. Each shard first takes the keys of its own
cells, clockwise and in hash order, up to its bound; keys that overflow continue clockwise to the
next shard with room. Which ranks of a cell go where follows from the cells' counts alone: a table
whose size is the ring's, whatever the input.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 14


def ring(n_shards: int, virtual_nodes: int, cells: int = CELLS) -> list[int]:
    """The shard of each cell's virtual node; nodes of a shard don't depend on the number of shards."""
    if n_shards * virtual_nodes * 4 > cells:
        raise ValueError("too many virtual nodes for the ring")
    starts: dict[int, int] = {}
    for shard in range(n_shards):
        for node in range(virtual_nodes):
            spot = int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big") % cells
            while spot in starts:
                spot = (spot + 1) % cells
            starts[spot] = shard
    owner, held = [0] * cells, starts[max(starts)]
    for cell in range(cells):
        held = starts.get(cell, held)
        owner[cell] = held
    return owner


def bounds(n_rows: int, n_shards: int, slack: float) -> list[int]:
    """Rows that each shard may hold; without slack they add up to n_rows and differ by one at most."""
    if slack:
        return [math.ceil(n_rows * (1 + slack) / n_shards)] * n_shards
    return [n_rows // n_shards + (shard < n_rows % n_shards) for shard in range(n_shards)]


def place(counts: dict[int, int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first) from the count of keys in each cell."""
    room, used, placed, over = list(room), [0] * len(room), [], []

    def take(cell: int, first: int, end: int, shard: int) -> int:
        n = min(end - first, room[shard])
        if n:
            placed.append((cell, first, first + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return first + n

    for cell in sorted(counts):
        first = take(cell, 0, counts[cell], owner[cell])
        if first < counts[cell]:
            over.append((cell, first))
    for cell, first in over:
        spot, tried = cell, {owner[cell]}
        while first < counts[cell]:
            while owner[spot] in tried:
                spot = (spot + 1) % len(owner)
            tried.add(owner[spot])
            first = take(cell, first, counts[cell], owner[spot])
    return placed


def shard_rows(docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", virtual_nodes: int = 64, slack: float = 0.0) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32, law, shard, slot, grown_shard for every row.

    With slack 0 the law is `rows`: counts of shards are at most one apart. A larger slack bounds each
    shard at (1 + slack) times the mean and moves fewer rows when shards are added (law `bounded`); grown_shard is
    null, as the bound may move rows between old shards too. Slots count from 0 without gaps in each shard.
    A null text has size 1 and checksum 0; null ids share a cell; repeated rows get slots of their own;
    equal texts are spread like any rows; an empty table gives no rows; other columns are ignored.
    """
    spark, id_ = docs.sparkSession, F.col(id_col)
    cell = F.pmod(F.xxhash64(id_), F.lit(CELLS)).cast("int")
    counts = {r.cell: r.n for r in docs.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
    owner = ring(n_shards, virtual_nodes)
    placed = place(counts, owner, bounds(sum(counts.values()), n_shards, slack))
    cuts = spark.createDataFrame(placed, "cell int, first long, end long, shard int, slot_of_first long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_.alias("doc_id"), cell.alias("cell"), F.xxhash64(id_).alias("hash"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    in_cell = Window.partitionBy("cell").orderBy("hash", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(in_cell).cast("long") - 1)
    # At most CELLS rows and one more for each shard that fills up within a cell.
    found = ranked.join(F.broadcast(cuts), "cell").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bounded" if slack else "rows").alias("law"),
        "shard",
        (F.col("slot_of_first") + F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
