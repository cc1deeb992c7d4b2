"""k-mer counts of reads that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators.kmers import kmer_counts


def count_stream(reads: DataFrame, path: str, checkpoint: str, k: int = 21, seq_col: str = "s") -> StreamingQuery:
    """Adds each batch's counts to a table under path, one folder for each batch, so a batch that is run again replaces its own."""

    def add(batch: DataFrame, number: int) -> None:
        kmer_counts(batch, k, seq_col=seq_col).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, n) over all batches so far."""
    return spark.read.parquet(path).groupBy("kmer").agg(F.sum("n").alias("n"))
