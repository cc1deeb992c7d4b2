"""Exact deduplication by a content sort.

Normalised texts are range-partitioned by sampled splitters and sorted externally, so equal texts
lie next to each other and neighbours are compared in full. Splitters hold a text's first bytes, a
hash and the id, so they stay small, and a text with a third of all rows is spread over as many
partitions as its share needs. Runs that touch an end of a partition are then put together by
their whole texts: two for each partition at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import lean, partitions, text_or_empty, written

#: Characters of a text that a splitter holds.
LEAD = 48
RUN_SCHEMA = "doc_id long, tag long, part int, run long, edge boolean, keep_id long, keep_tag long, group_size long, edge_text string, text_sha256 string"


def normalise(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in a sorted partition. Ids of the open run are held, its text only once."""
    part, run = TaskContext.get().partitionId(), -1
    open_text: pa.Scalar | None = None
    held: list[pa.RecordBatch] = []

    def close(last: bool) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        n, edge = rows.num_rows, run == 0 or last
        same = lambda value, kind: pa.repeat(pa.scalar(value, kind), n)
        first = lambda name: rows[name][0].as_py()
        edge_text = pa.concat_arrays([pa.array([open_text.as_py() if edge else None], pa.string()), pa.nulls(n - 1, pa.string())])
        columns = [rows["doc_id"].combine_chunks(), rows["tag"].combine_chunks(), same(part, pa.int32()), same(run, pa.int64()), same(edge, pa.bool_()), same(first("doc_id"), pa.int64()), same(first("tag"), pa.int64()), same(n, pa.int64()), edge_text, rows["sha"].combine_chunks()]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "part", "run", "edge", "keep_id", "keep_tag", "group_size", "edge_text", "text_sha256"])

    def merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    ready: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("norm")
        new = pc.not_equal(text.slice(1), text.slice(0, batch.num_rows - 1)) if batch.num_rows > 1 else pa.array([], pa.bool_())
        starts = [i + 1 for i in pc.indices_nonzero(new).to_pylist()]
        if open_text is None or not pc.equal(open_text, text[0]).as_py():
            starts.insert(0, 0)
        ids = batch.select(["doc_id", "tag", "sha"])
        if not starts or starts[0] > 0:
            held.append(ids.slice(0, starts[0] if starts else batch.num_rows))
        for k, begin in enumerate(starts):
            if held:
                ready.append(close(last=False))
            end = starts[k + 1] if k + 1 < len(starts) else batch.num_rows
            held, run, open_text = [ids.slice(begin, end - begin)], run + 1, text[begin]
        if len(ready) >= 2000:
            yield merged(ready)
            ready = []
    if held:
        ready.append(close(last=True))
    if ready:
        yield merged(ready)


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tag: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 and tag.

    Of equal normalised texts the row with the smallest doc_id stays. A null text is empty and equal to
    other empty texts; null ids sort last, so they stay only in groups without an id; of repeated rows with the
    smallest id, the one with the smallest tag stays (tag: a column that tells repeated rows apart, by default a row number
    within Spark's scan); an empty table gives no rows; other columns are ignored whatever their names.
    """
    norm = normalise(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.monotonically_increasing_id() if tag is None else tag).alias("tag"), norm.alias("norm"))
    splitter = [F.substring("norm", 1, LEAD), F.xxhash64("norm"), F.col("doc_id").asc_nulls_last(), F.col("tag")]
    order = [F.substring("norm", 1, LEAD), F.xxhash64("norm"), F.col("norm"), F.col("doc_id").asc_nulls_last(), F.col("tag")]
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), *splitter).sortWithinPartitions(*order)
    runs = written(ordered.select("doc_id", "tag", "norm", F.sha2("norm", 256).alias("sha")).mapInArrow(lean(_runs), RUN_SCHEMA), "content-sort")
    heads = runs.where("edge_text IS NOT NULL")
    whole = heads.groupBy("edge_text").agg(
        F.min(F.struct(F.col("keep_id").isNull().alias("no_id"), "keep_id", "keep_tag")).alias("keep"), F.sum("group_size").alias("size")
    )
    # Two rows for each partition at most, without their texts.
    ends = heads.join(whole, "edge_text").select("part", "run", F.col("keep.keep_id").alias("all_id"), F.col("keep.keep_tag").alias("all_tag"), "size")
    found = runs.drop("edge_text").join(F.broadcast(ends), ["part", "run"], "left")
    joined = F.col("size").isNotNull()
    found = found.select(
        "doc_id",
        F.when(joined, F.col("all_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(joined, F.col("size")).otherwise(F.col("group_size")).alias("group_size"),
        F.when(joined, F.col("all_tag")).otherwise(F.col("keep_tag")).alias("keep_tag"),
        "text_sha256",
        "tag",
    )
    return found.select("doc_id", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"), "text_sha256", "tag")


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal normalised texts, that of the smallest id, with all columns of docs.

    Nulls and ties are as in exact_groups; of rows that repeat an id and its text, any one stays. Columns of any name pass through; an empty table gives no rows.
    """
    id_ = F.col("doc_id")
    key = lambda: [id_.isNull().alias("no_id"), F.coalesce(id_, F.lit(0)).alias("id")]
    stay = exact_groups(docs, id_col=id_col, text_col=text_col).where("kept").select(*key(), F.col("text_sha256").alias("sha"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.sha2(normalise(text_or_empty(text_col)), 256).alias("sha")).select("row", *key(), "sha")
    # One shuffle of the rows serves the join and the choice among repeated rows.
    return rows.join(stay, ["no_id", "id", "sha"], "left_semi").groupBy("no_id", "id", "sha").agg(F.first("row").alias("row")).select("row.*")
