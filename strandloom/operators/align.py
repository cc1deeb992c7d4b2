"""Local alignment with affine gaps, batched over pairs with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T



def _rows(queries: list[str], targets: list[str], match: int, mismatch: int, gap_open: int, gap_extend: int) -> tuple[np.ndarray, np.ndarray]:
    """The best score that ends at each base of each target, and the first query base where it does. 0 and -1 beyond a target's end and without a positive score.

    One row of the target at a time for all pairs. A gap along the query is a running maximum, as it never pays to
    open it from another gap. N matches nothing.
    """
    n, width, rows = len(queries), max(map(len, queries), default=0), max(map(len, targets), default=0)
    q, t = np.full((n, width), 1, np.uint8), np.full((n, rows), 2, np.uint8)
    for held, values in ((q, queries), (t, targets)):
        for i, v in enumerate(values):
            held[i, : len(v)] = np.frombuffer(v.encode("ascii", "replace"), np.uint8)
    low, at = -(1 << 20), np.arange(width + 1) * gap_extend
    h, e = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), low, np.int32)
    tops, ends = np.zeros((n, rows), np.int32), np.full((n, rows), -1, np.int32)
    inside = np.arange(rows) < np.array([len(v) for v in targets])[:, None] if n else np.zeros((0, rows), bool)
    for i in range(rows):
        same = (q == t[:, i : i + 1]) & (q != ord("N"))
        e = np.maximum(e - gap_extend, h - gap_open - gap_extend)
        now = np.zeros_like(h)
        now[:, 1:] = np.maximum(h[:, :-1] + np.where(same, match, mismatch), 0)
        now = np.maximum(now, e)
        run = np.maximum.accumulate(now + at, axis=1)
        now[:, 1:] = np.maximum(now[:, 1:], run[:, :-1] - gap_open - at[1:])
        tops[:, i] = now.max(axis=1)
        ends[:, i] = now.argmax(axis=1) - 1
        h = now
    tops[~inside] = 0
    ends[tops == 0] = -1
    return tops, ends


def align_batch(queries: list[str], targets: list[str], match: int = 5, mismatch: int = -4, gap_open: int = 5, gap_extend: int = 2) -> np.ndarray:
    """Best score and 0-based ends (query, target) of each pair; a gap of l costs gap_open + l * gap_extend.

    Of equal scores the first target end, then query end, is taken; without a positive score the ends are -1.
    """
    tops, ends = _rows(queries, targets, match, mismatch, gap_open, gap_extend)
    if not tops.size:
        return np.column_stack((np.zeros(len(queries), np.int32), np.full((len(queries), 2), -1, np.int32)))
    each, at = np.arange(len(queries)), tops.argmax(axis=1)
    best = tops[each, at]
    return np.column_stack((best, ends[each, at], np.where(best > 0, at, -1).astype(np.int32)))


def align_whole_batch(queries: list[str], targets: list[str], match: int = 5, **costs: int) -> np.ndarray:
    """align_batch with the starts (query, target) and the second best: its score and target end.

    Both strings up to the best ends, reversed, have their own best ends at the starts; of equal ones the nearest to the ends. The second best
    ends farther from the best's target end than the best's score is worth in matches: 0 and -1 if there is none.
    """
    found = align_batch(queries, targets, match, **costs)
    back = align_batch([q[: k + 1][::-1] for q, k in zip(queries, found[:, 1], strict=True)], [t[: k + 1][::-1] for t, k in zip(targets, found[:, 2], strict=True)], match, **costs)
    starts = np.where(found[:, :1] > 0, found[:, 1:] - back[:, 1:], -1)
    tops, _ = _rows(queries, targets, match, costs.get("mismatch", -4), costs.get("gap_open", 5), costs.get("gap_extend", 2))
    if not tops.size:
        return np.column_stack((found, starts, np.zeros(len(queries), np.int32), np.full(len(queries), -1, np.int32)))
    near = np.abs(np.arange(tops.shape[1]) - found[:, 2:3]) <= -(-found[:, :1] // match)
    tops[near] = 0
    at = tops.argmax(axis=1)
    second = tops[np.arange(len(queries)), at]
    return np.column_stack((found, starts, second, np.where(second > 0, at, -1))).astype(np.int32)


#: What align tells of a pair, and what it tells with whole.
ENDS = ("score", "query_end", "target_end")
WHOLE = (*ENDS, "query_start", "target_start", "score2", "target_end2")


def align(pairs: DataFrame, query: str = "query", target: str = "target", *, whole: bool = False, **scores: int) -> DataFrame:
    """pairs with score, query_end and target_end; with whole also query_start, target_start, score2 and target_end2. Pairs are sorted by size within a batch, so short ones aren't padded to long ones."""
    names, each = (WHOLE, align_whole_batch) if whole else (ENDS, align_batch)
    schema = T.StructType([*pairs.schema.fields, *(T.StructField(name, T.IntegerType()) for name in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, t = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (query, target))
            order = sorted(range(len(q)), key=lambda i: len(q[i] or "") + len(t[i] or ""))
            out = np.zeros((len(q), len(names)), np.int32)
            for k in range(0, len(order), 256):
                own = order[k : k + 256]
                out[own] = each([q[i] or "" for i in own], [t[i] or "" for i in own], **scores)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, j]) for j in range(len(names)))], schema.names)

    return pairs.mapInArrow(run, schema)
