"""FASTA and FASTQ as a data source, and a writer."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators.ranking import running_total
from strandloom.session import cut_lineage

SCHEMA = "name string, comment string, seq string, qual string"


def records(text: io.TextIOBase) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, seq, qual) of multi-line FASTA or FASTQ; a truncated record ends the input. qual is None for FASTA."""
    line = text.readline()
    while line and line[0] not in ">@":
        line = text.readline()
    while line:
        quality, head = line[0] == "@", line[1:].strip().split(None, 1)
        name, comment = (head + ["", ""])[:2]
        parts, line = [], text.readline()
        while line and line[0] not in ">@+":
            parts.append("".join(line.split()))
            line = text.readline()
        seq = "".join(parts)
        if not (line and line[0] == "+"):
            yield name, comment, seq, None
            continue
        got = ""
        while len(got) < len(seq):
            line = text.readline()
            if not line:
                return
            got += line.rstrip("\r\n")
        if len(got) != len(seq):
            return
        yield name, comment, seq, got if quality or got else None
        line = text.readline()
        while line and line[0] not in ">@":
            line = text.readline()


#: Bytes of a file that a task holds at once; a larger file is read line by line.
WHOLE = 16 << 20


class _Lines:
    """Lines of bytes without their ends as a text to read from."""

    def __init__(self, lines: Iterator[bytes]):
        self.lines = lines

    def readline(self) -> str:
        line = next(self.lines, None)
        return "" if line is None else line.decode("latin-1") + "\n"


def _shown(texts: Iterator[tuple[str, io.TextIOBase]]) -> Iterator:
    """Frames of the records of texts with the file and place of each."""
    import pandas as pd

    columns = ["name", "comment", "seq", "qual", "file", "ord"]
    for file, text in texts:
        held = []
        for k, record in enumerate(records(text)):
            held.append((*record, file, k))
            if len(held) == 20_000:
                yield pd.DataFrame(held, columns=columns)
                held = []
        yield pd.DataFrame(held, columns=columns)


def read_fastx(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq, qual, file, ord) of all records under a path, plain or gzipped, read by Spark's own reader; a file is a task.

    Files of more than WHOLE bytes come as sorted lines, so no task holds one; gzipped ones of that size are told by their name, .gz.
    """

    def parse(batches):
        def texts():
            for pdf in batches:
                for file, content in zip(pdf["path"], pdf["content"], strict=True):
                    raw = gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
                    yield file, io.TextIOWrapper(raw, "latin-1", newline=None)

        return _shown(texts())

    def parse_lines(batches):
        rows = (row for pdf in batches for row in zip(pdf["file"], pdf["line"], pdf["value"], strict=True))

        def texts():
            for file, own in groupby(rows, key=itemgetter(0)):
                first = next(own)
                if first[2][:2] == b"\x1f\x8b":
                    raise ValueError(f"{file} is gzipped and larger than {WHOLE} bytes, but its name doesn't end with .gz")
                yield names[file], _Lines(bytes(row[2]) for row in chain([first], own))

        return _shown(texts())

    schema, files = f"{SCHEMA}, file string, ord long", spark.read.format("binaryFile").load(path)
    large = [r.path for r in files.where(F.col("length") > WHOLE).select("path").collect()]
    small = files.where(F.col("length") <= WHOLE).select("path", "content").mapInPandas(parse, schema)
    if not large:
        return small
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = {at(p).toUri().toString(): p for p in large}  # as _metadata has them
    lines = numbered_lines(spark, large).select("file", "line", F.col("value").cast("binary").alias("value"))
    return small.unionAll(lines.repartition("file").sortWithinPartitions("file", "line").mapInPandas(parse_lines, schema))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): the lines of text files, counted from 0 in each. Files are split like any text: a split counts its own lines, and starts after those of the splits before it."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    rows = cut_lineage(spark.read.text(path).select(place.alias("p"), "value", F.monotonically_increasing_id().alias("at")).select("p.*", "value", "at"))
    own = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    starts = own.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(starts), ["file", "split"]).select("file", (F.col("base") + F.col("at") - F.col("first")).alias("line"), "value")


def _head(line: Column) -> list[Column]:
    parts = F.split(F.trim(F.substring(line, 2, 1 << 30)), r"\s+", 2)
    return [parts[0].alias("name"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("comment")]


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq, qual, file, ord) of FASTQ with four lines a record, from splits of files of any size; a truncated last record is left out."""
    lines = numbered_lines(spark, path)
    rows = lines.groupBy("file", F.floor(F.col("line") / 4).alias("ord")).agg(*(F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(f"l{k}") for k in (0, 1, 3)))
    return rows.where("l3 IS NOT NULL AND length(l1) = length(l3)").select(*_head(F.col("l0")), F.col("l1").alias("seq"), F.col("l3").alias("qual"), "file", "ord")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq, file, ord) of FASTA with sequences over any number of lines, from splits of files of any size; a record is a row, put together in one task."""
    lines = numbered_lines(spark, path)
    heads = cut_lineage(lines.where(F.col("value").startswith(">")).withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1))
    # A line belongs to the last head before it: blocks of lines hold a bounded number of heads, and a block knows the last head before it.
    size = 1 << 12
    block = F.floor(F.col("line") / size)
    marked = lines.withColumn("block", block).withColumn("head", F.col("value").startswith(">"))
    in_block = F.max(F.when(F.col("head"), F.col("line"))).over(Window.partitionBy("file", "block").orderBy("line"))
    last = marked.groupBy("file", "block").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("last"))
    earlier = last.select("file", "block", F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    placed = marked.withColumn("own", in_block).join(earlier, ["file", "block"]).select("file", "line", "value", F.coalesce("own", "earlier").alias("of")).where("line <> of")
    body = placed.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("line", F.regexp_replace("value", r"\s", "").alias("part")))).alias("ps"))
    rows = heads.join(body.withColumnRenamed("of", "line"), ["file", "line"], "left")
    return rows.select(*_head(F.col("value")), F.coalesce(F.array_join("ps.part", ""), F.lit("")).alias("seq"), "file", "ord")


def with_quality(reads: DataFrame, default: int = 20) -> DataFrame:
    """reads with a quality everywhere."""
    return reads.withColumn("qual", F.coalesce("qual", F.repeat(F.lit(chr(33 + default)), F.length("seq"))))


def fastx_line(name: Column, seq: Column, qual: Column, comment: Column | None = None) -> Column:
    head = name if comment is None else F.when(F.coalesce(F.length(comment), F.lit(0)) > 0, F.concat_ws(" ", name, comment)).otherwise(name)
    return F.when(F.coalesce(F.length(qual), F.lit(0)) > 0, F.concat(F.lit("@"), head, F.lit("\n"), seq, F.lit("\n+\n"), qual)).otherwise(F.concat(F.lit(">"), head, F.lit("\n"), seq))


def end_offset_names(reads: DataFrame, *order: Column | str, seq_col: str = "seq") -> DataFrame:
    """reads with the name that a packed buffer gives them: the offset of their end, each read one symbol longer than it is."""
    return running_total(reads, (F.length(seq_col) + 1).cast("long"), *order, name="end_offset").withColumn("name", F.col("end_offset").cast("string"))


def write_fastx(reads: DataFrame, path: str, compression: str = "none") -> None:
    reads.select(fastx_line(F.col("name"), F.col("seq"), F.col("qual"), F.col("comment") if "comment" in reads.columns else None).alias("value")).write.option("compression", compression).text(path)
