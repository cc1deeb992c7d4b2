"""Token ids as files of patched frame-of-reference blocks.

A segment holds the ids of whole consecutive documents:

    4 bytes magic, u32 number of ids, u32 number of blocks, u32 byte offset of each block, blocks

and a block of up to 1024 ids, each less the block's minimum:

    u32 minimum, u8 width, u16 number of exceptions, packed low bits, u16 positions, u32 high bits

The width is the bits that a percentile of the block's differences needs; what is larger leaves
its high bits in the exception list. Segments are rows of a Parquet folder written by Spark, so a
lost executor's files are written again and only committed ones are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import partitions, text_or_empty, tokenizer_file
from strandloom.llm.word_ids import byte_bpe

MAGIC, BLOCK, HEAD = b"PFR1", 1024, struct.Struct("<IBH")
SEGMENT_SCHEMA = "part int, segment long, first_id long, n_ids long, doc_ids array<long>, doc_tokens array<int>, data binary"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value below 2**32 needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values each to rows of `width` words."""
    words = np.zeros((len(values), width + 1), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[:, word] |= values[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= values[:, i] >> np.uint64(64 - shift)
    return words[:, :width]


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), 64), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, i] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, i] |= words[:, word + 1] << np.uint64(64 - shift)
    return out & np.uint64((1 << width) - 1)


def encode_segment(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    n_blocks = -(-len(ids) // BLOCK)
    sizes = np.full(n_blocks, BLOCK)
    if n_blocks:
        sizes[-1] = len(ids) - BLOCK * (n_blocks - 1)
    grid = np.zeros((n_blocks, BLOCK), np.uint64)
    grid.reshape(-1)[: len(ids)] = ids
    if n_blocks:
        grid[-1, sizes[-1] :] = grid[-1, : sizes[-1]].min()  # the pad packs to zeros
    low = grid.min(axis=1) if n_blocks else np.zeros(0, np.uint64)
    grid -= low[:, None]
    rank = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    widths = _bits(np.partition(grid, rank, axis=1)[:, rank]) if n_blocks else np.zeros(0, np.int64)
    blocks: list[bytes] = [b""] * n_blocks
    for width in np.unique(widths):
        width = int(width)
        which = np.flatnonzero(widths == width)
        own = grid[which]
        packed = _pack((own & np.uint64((1 << width) - 1)).reshape(-1, 64), width).reshape(len(which), -1)
        high = own >> np.uint64(width)
        row, spot = np.nonzero(high)
        over, edge = high[row, spot].astype("<u4"), np.searchsorted(row, np.arange(len(which) + 1))
        spot = spot.astype("<u2")
        for k, block in enumerate(which):
            a, b, words = edge[k], edge[k + 1], -(-int(sizes[block]) // 64) * width
            blocks[block] = HEAD.pack(int(low[block]), width, b - a) + packed[k, :words].tobytes() + spot[a:b].tobytes() + over[a:b].tobytes()
    head = 12 + 4 * n_blocks
    offsets = head + np.concatenate(([0], np.cumsum([len(b) for b in blocks])[:-1])) if n_blocks else np.zeros(0)
    return b"".join([MAGIC, struct.pack("<II", len(ids), n_blocks), offsets.astype("<u4").tobytes(), *blocks])


def decode_block(data: bytes, at: int, size: int) -> np.ndarray:
    """One block by its offset in the index."""
    low, width, n_over = HEAD.unpack_from(data, at)
    at += HEAD.size
    rows = -(-size // 64)
    values = np.zeros(rows * 64, np.uint64)
    if width:
        values = _unpack(np.frombuffer(data, "<u8", rows * width, at).reshape(rows, width), width).reshape(-1)
        at += 8 * rows * width
    spot, over = np.frombuffer(data, "<u2", n_over, at), np.frombuffer(data, "<u4", n_over, at + 2 * n_over)
    values[spot] |= over.astype(np.uint64) << np.uint64(width)
    return (values[:size] + np.uint64(low)).astype(np.uint32)


def decode_segment(data: bytes) -> np.ndarray:
    """All ids of a segment; blocks of one width are unpacked together."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token blocks")
    n_ids, n_blocks = struct.unpack_from("<II", data, 4)
    index = np.frombuffer(data, "<u4", n_blocks, 12).astype(np.int64)
    if not n_blocks:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    field = lambda at, size: sum(raw[index + at + i].astype(np.int64) << (8 * i) for i in range(size))
    low, widths, n_over = field(0, 4), field(4, 1), field(5, 2)
    out = np.zeros((n_blocks, BLOCK), np.uint64)
    full = np.full(n_blocks, BLOCK // 64)
    full[-1] = -(-(n_ids - BLOCK * (n_blocks - 1)) // 64)
    for width in np.unique(widths[:-1]):
        which = np.flatnonzero(widths[:-1] == width)
        if width := int(width):
            at = (index[which] + HEAD.size)[:, None] + np.arange(8 * width * (BLOCK // 64))
            words = np.ascontiguousarray(raw[at]).view("<u8").reshape(-1, width)
            out[which] = _unpack(words, width).reshape(len(which), BLOCK)
    starts = index + HEAD.size + 8 * widths * full
    for k in np.flatnonzero(n_over[:-1]):
        spot = np.frombuffer(data, "<u2", n_over[k], starts[k])
        out[k, spot] |= np.frombuffer(data, "<u4", n_over[k], starts[k] + 2 * n_over[k]).astype(np.uint64) << np.uint64(widths[k])
    out += low.astype(np.uint64)[:, None]
    size = n_ids - BLOCK * (n_blocks - 1)
    out[-1, :size] = decode_block(data, int(index[-1]), size)
    return out.reshape(-1)[:n_ids].astype(np.uint32)


def write_token_blocks(docs: DataFrame, tokenizer_path: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, segment_ids: int = 1 << 20) -> None:
    """Encode every text, end each document with end_id, and write segments in ascending id order.

    Null texts are empty and hold the end id alone; null ids come first; rows that repeat an id are all
    written, in an order of their texts; an empty table writes no segment; further columns are ignored. Ids
    are dealt out by range, so no task holds more than its share, and a segment is closed at segment_ids:
    only a single longer document makes a longer one.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(tokenizer_file(tokenizer_path)[0].decode("utf-8"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, segment, done = byte_bpe(definition.value), TaskContext.get().partitionId(), 0, 0
        keys: list = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal segment, done
            ids, tokens = np.concatenate(held), np.concatenate(sizes)
            row = {"part": part, "segment": segment, "first_id": done, "n_ids": len(ids), "doc_ids": list(keys), "doc_tokens": tokens, "data": encode_segment(ids)}
            segment, done = segment + 1, done + len(ids)
            keys.clear(), sizes.clear(), held.clear()
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        total = 0
        for batch in batches:
            doc_ids, row = batch.column(0).to_pylist(), 0
            for n, ids in encoder.encode(batch.column(1)):
                ends = np.cumsum(n)
                keys += doc_ids[row : row + len(n)]
                row += len(n)
                sizes.append(n + 1)
                held.append(np.insert(ids, ends, np.uint32(end_id)).astype(np.uint32))
                total += len(held[-1])
                if total >= segment_ids:
                    yield close()
                    total = 0
        if keys:
            yield close()

    # Splitters hold a hash of the text and a row number beside the id, so rows of one id, or without any, are spread too.
    text = text_or_empty(text_col)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
        .repartitionByRange(partitions(spark), "doc_id", "hash", "row")
        .sortWithinPartitions("doc_id", "hash", "text", "row")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(encode, SEGMENT_SCHEMA).write.parquet(path)


def read_token_blocks(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files, ids as little-endian u32 bytes."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # One row for each part, not for each document: a single window over them stays small.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, first, doc_ids, tokens, data = (batch.column(c)[k].as_py() for c in range(5))
                ends = np.cumsum(tokens)
                raw = decode_segment(data).astype("<u4").tobytes()
                begin = ends - tokens
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(doc_ids), pa.int32()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(first + begin, pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(begin, ends, strict=True)], pa.binary()),
                    ],
                    ["part", "doc_id", "first", "n_tokens", "ids"],
                )

    rows = segments.select("part", "first_id", "doc_ids", "doc_tokens", "data").mapInArrow(decode, "part int, doc_id long, first long, n_tokens long, ids binary")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")
