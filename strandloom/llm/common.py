"""Small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from strandloom.session import Scratch, cut_lineage, let_go, shared_path, table, written

__all__ = ["Scratch", "cut_lineage", "lean", "let_go", "partitions", "shared_path", "table", "text_or_empty", "tokenizer_file", "written"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def tokenizer_file(path: str) -> tuple[bytes, str]:
    """The definition, read once on the driver and shipped to the executors, and its version digest."""
    raw = Path(path).read_bytes()
    return raw, hashlib.sha256(raw).hexdigest()


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """function, after which a task's Python worker gives freed memory back to the system: workers are kept for later tasks, and idle ones would hold the most they ever had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run
