"""k-mers as whole numbers, two bits a base in the order A, C, G, T, so that they are counted, shuffled and joined as longs.

NumPy packs all windows of a chunk of strings at once by doubling, and equal ones are added up before they leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The longest k-mer that a long holds, and one less three bits for what follows it.
MOST, MOST_NEXT = 31, 30
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def shown(code: Column, k: int) -> Column:
    """The k-mer as letters."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def number(kmer: Column) -> Column:
    """The number of a k-mer of A, C, G and T."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def _strings(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, base codes, bounds) of strings of about `limit` bytes together; a longer string alone."""
    if len(column) and column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, _CODE[data[at[row] : at[stop]]], at[row : stop + 1] - at[row]
        row = stop


def _pack(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each window, and that of its reverse complement; windows with another letter hold nonsense."""
    one = code.astype(np.int64) & 3
    forward, back, size = one, 3 - one, 1
    for bit in bin(k)[3:]:
        n = max(len(forward) - size, 0)
        forward, back = (forward[:n] << (2 * size)) | forward[size : size + n], back[:n] | (back[size : size + n] << (2 * size))
        size *= 2
        if bit == "1":
            n = max(len(forward) - 1, 0)
            forward, back = (forward[:n] << 2) | one[size : size + n], back[:n] | ((3 - one[size : size + n]) << (2 * size))
            size += 1
    return forward, back


def _windows(code: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, forward, back) of the windows of A, C, G and T that lie in one string."""
    n = len(code) - k + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    odd = np.append(0, np.cumsum(code == 4))
    good = odd[k:] == odd[:n]
    edge = np.zeros(n + 1, np.int32)
    ends = at[1:-1]
    np.add.at(edge, np.clip(ends - k + 1, 0, n), 1)
    np.add.at(edge, np.clip(ends, 0, n), -1)
    start = np.flatnonzero(good & (np.cumsum(edge[:-1]) == 0))
    forward, back = _pack(code, k)
    return start, forward[start], back[start]


def packed_counts(reads: DataFrame, k: int, *, seq_col: str = "s", both: bool = True) -> DataFrame:
    """(code, n) of the k-mers of A, C, G and T; with both strands as one, the smaller number of a k-mer and its reverse complement stands for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, code, at in _strings(batch.column(0)):
                _, forward, back = _windows(code, at, k)
                found, n = np.unique(np.minimum(forward, back) if both else forward, return_counts=True)
                yield pa.record_batch([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    return reads.select(seq_col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def windows_by_source(collection: DataFrame, lengths: Sequence[int], source: str, *, seq_col: str = "seq") -> DataFrame:
    """(source, code, n): the forward windows of A, C, G and T of several lengths, added up within a chunk; a code is the window's number with a bit set above it, so lengths don't mix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            of = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for row, code, at in _strings(batch.column(1)):
                for k in lengths:
                    start, forward, _ = _windows(code, at, k)
                    owner = of[row + np.searchsorted(at, start, "right") - 1]
                    for name in np.unique(owner[owner >= 0]):
                        found, n = np.unique(forward[owner == name], return_counts=True)
                        yield pa.record_batch([names.dictionary.take(pa.array(np.full(len(found), name))), pa.array(found | (1 << 2 * k), pa.int64()), pa.array(n, pa.int64())], [source, "code", "n"])

    schema = T.StructType([collection.schema[source], T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    return collection.select(source, seq_col).mapInArrow(run, schema)


def packed_rows(reads: DataFrame, k: int, id_col: str, *, seq_col: str = "s") -> DataFrame:
    """(id_col, code): the distinct forward k-mers of each string, of A, C, G and T."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, code, at in _strings(batch.column(1)):
                start, forward, _ = _windows(code, at, k)
                owner = np.searchsorted(at, start, "right") - 1
                order = np.lexsort((forward, owner))
                owner, forward = owner[order], forward[order]
                new = np.append(True, (owner[1:] != owner[:-1]) | (forward[1:] != forward[:-1]))[: len(owner)]
                yield pa.record_batch([batch.column(0).take(pa.array(row + owner[new])), pa.array(forward[new], pa.int64())], [id_col, "code"])

    schema = T.StructType([reads.schema[id_col], T.StructField("code", T.LongType())])
    return reads.select(id_col, seq_col).mapInArrow(run, schema)


def packed_extensions(reads: DataFrame, w: int, *, seq_col: str = "s") -> DataFrame:
    """(code, next, n): how often A, C, G, T (0 to 3) or anything else, another letter or the end (4), follows a w-mer on either strand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, code, at in _strings(batch.column(0)):
                start, forward, back = _windows(code, at, w)
                owner = np.searchsorted(at, start, "right") - 1
                padded = np.append(code, 4)
                after = np.where(start + w < at[owner + 1], padded[np.minimum(start + w, len(code))], 4)
                before = np.where(start > at[owner], padded[start - 1], 4)
                before = np.where(before == 4, 4, 3 - before.astype(np.int64))
                found, n = np.unique(np.concatenate(((forward << 3) | after, (back << 3) | before)), return_counts=True)
                yield pa.record_batch([pa.array(found >> 3, pa.int64()), pa.array((found & 7).astype(np.int32)), pa.array(n, pa.int64())], ["code", "next", "n"])

    return reads.select(seq_col).mapInArrow(run, "code long, next int, n long")
