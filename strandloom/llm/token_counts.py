"""Token counts of whole texts behind a digest cache.

The cache is a Parquet folder of (content digest, tokenizer digest, count). Contents are joined
to it by both digests; only distinct contents that it lacks are encoded, and their counts are
appended, so a next run, or a run after a failure, encodes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import partitions, text_or_empty, tokenizer_file, written
from strandloom.llm.word_ids import byte_bpe

#: Up to so many digests of missing contents are broadcast to their texts; of more, all texts are grouped.
BROADCAST_DIGESTS = 200_000
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an absent folder becomes an empty cache."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def encode_misses(texts: DataFrame, definition: str) -> DataFrame:
    """(content_digest, text) to (content_digest, n_tokens)."""
    shipped = texts.sparkSession.sparkContext.broadcast(definition)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(shipped.value)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder.counts(batch.column(1)))], ["content_digest", "n_tokens"])

    return texts.mapInArrow(count, "content_digest binary, n_tokens long")


def _digests(docs: DataFrame, id_: Column, text_col: str, normalise: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, n_bytes, content_digest) of every row, as a table: all that later steps need of rows whose content is known."""
    text = normalise(text_or_empty(text_col))
    return written(docs.select(id_.alias("doc_id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("content_digest")), "token-digests")


def _fill(docs: DataFrame, rows: DataFrame, tokenizer: tuple[bytes, str], cache_path: str, text_col: str, normalise: Callable[[Column], Column]) -> None:
    """Encodes the distinct contents of rows that the cache lacks and appends their counts; texts are shuffled only where there are any."""
    spark, (raw, version) = docs.sparkSession, tokenizer
    stored = open_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).select("content_digest")
    missing = written(rows.select("content_digest").distinct().join(stored, "content_digest", "left_anti"), "token-misses")
    n = missing.count()
    if not n:
        return
    text = normalise(text_or_empty(text_col))
    keyed = docs.select(text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("content_digest"))
    if n <= BROADCAST_DIGESTS:
        keyed, missing = keyed.join(F.broadcast(missing), "content_digest", "left_semi"), None
    # A partial deduplication where the texts lie, so a text with a third of all rows costs one row for each task.
    distinct = keyed.groupBy("content_digest").agg(F.first("_text").alias("_text"))
    if missing is not None:
        distinct = distinct.join(missing, "content_digest", "left_semi")
    fresh = encode_misses(distinct.select("content_digest", "_text"), raw.decode("utf-8"))
    fresh.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache_path)


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, *, text_col: str = "text", normalise: Callable[[Column], Column] = lambda text: text) -> None:
    """Appends to the cache the counts of the contents of docs that it lacks; cases as in token_counts."""
    _fill(docs, _digests(docs, F.lit(None).cast("long"), text_col, normalise), tokenizer_file(tokenizer_path), cache_path, text_col, normalise)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty, with 0 bytes and tokens. Repeated rows each get their row, encoded once;
    null and repeated ids are kept as they are; a very long text is encoded part by part in one task; other columns are ignored whatever their names; an
    empty table gives an empty result. `normalise` may fold texts only where the tokenizer gives the folded
    forms the same counts; for byte-level BPE only the identity does.

    The cache is a folder that lives between runs: a run over known contents shuffles and encodes no text. Counts of
    contents with more than a small share of all rows, of which there are few, are broadcast to their rows.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer_file(tokenizer_path)
    rows = _digests(docs, F.col(id_col), text_col, normalise)
    _fill(docs, rows, tokenizer, cache_path, text_col, normalise)
    counts = (
        spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        .where(F.col("tokenizer_digest") == tokenizer[1])
        .groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))  # appends of two runs at once may overlap
    )
    # A content is hot with more than 1 / (4 * partitions) of the rows, so there are fewer than 4 * partitions of them.
    share = max(1, rows.count() // (4 * partitions(spark)))
    hot = written(rows.groupBy("content_digest").agg(F.count("*").alias("n")).where(F.col("n") > share).select("content_digest").join(counts, "content_digest"), "token-hot")
    cold = rows.join(F.broadcast(hot.select("content_digest")), "content_digest", "left_anti").join(counts, "content_digest")
    found = rows.join(F.broadcast(hot), "content_digest").select("doc_id", "n_bytes", "n_tokens").unionAll(cold.select("doc_id", "n_bytes", "n_tokens"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
