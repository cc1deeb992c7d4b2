"""FASTA and FASTQ as a registered data source: ``spark.read.format("fastx")`` and ``df.write.format("fastx")``.

A partition is a range of bytes of a file. It finds the first record of its range by itself, also where sequences and qualities go over
several lines and a quality line begins with @, and reads on past its end until its last record is whole.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from strandloom.operators.pairs import collate
from strandloom.operators.ranking import global_rank

COLUMNS = {"name": pa.string(), "comment": pa.string(), "seq": pa.string(), "qual": pa.string(), "length": pa.int32(), "file": pa.string(), "at": pa.int64()}
SCHEMA = "name string, comment string, seq string, qual string, length int, file string, at long"
AT, PLUS, GREATER = b"@+>"


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastxSource)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


class Cursor:
    """The lines of a file, each with the byte at which it begins; an empty line is the end."""

    def __init__(self, file: io.BufferedIOBase, at: int = 0, *, whole_line: bool = True):
        """whole_line: `at` begins a line. Otherwise the first line that begins at `at` or later is taken."""
        skip = not whole_line and at > 0
        if file.seekable():
            file.seek(at - 1 if skip else at)
        self.file = file
        self.next = at - 1 + len(file.readline()) if skip else at
        self.advance()

    def advance(self) -> None:
        self.at, self.line = self.next, self.file.readline()
        self.next += len(self.line)

    def skip_blank(self) -> None:
        while self.line and not self.line.strip():
            self.advance()

    def skip_to_record(self) -> None:
        while self.line and self.line[0] not in (AT, GREATER):
            self.advance()


@dataclass
class Record:
    at: int
    head: bytes
    seq: bytes
    qual: bytes | None


class Malformed(ValueError):
    pass


def fastq_record(lines: Cursor, most: int) -> Record | None:
    """The record at the cursor, which then stands on the next one. None where the file ends within it; Malformed where no record of at most `most` bytes can begin here."""
    at, head, parts = lines.at, lines.line, []
    if not head or head[0] != AT:
        raise Malformed(f"no record begins at byte {at}")
    lines.advance()
    while lines.line and lines.line[0] not in (AT, PLUS, GREATER):
        parts.append(b"".join(lines.line.split()))
        lines.advance()
        if lines.at - at > most:
            raise Malformed(f"the record at byte {at} has more than {most} bytes; raise maxRecordBytes")
    if not lines.line:
        return None
    if lines.line[0] != PLUS:
        raise Malformed(f"the record at byte {at} has no quality")
    seq, got, size = b"".join(parts), [], 0
    lines.advance()
    while size < len(seq):
        if not lines.line:
            return None
        got.append(lines.line.rstrip(b"\r\n"))
        size += len(got[-1])
        lines.advance()
        if lines.at - at > most:
            raise Malformed(f"the record at byte {at} has more than {most} bytes; raise maxRecordBytes")
    lines.skip_blank()
    if size != len(seq) or (lines.line and lines.line[0] != AT):
        raise Malformed(f"the quality of the record at byte {at} is not as long as its sequence")
    return Record(at, head, seq, b"".join(got))


def fasta_record(lines: Cursor, most: int) -> Record:
    """The record at the cursor; only > begins one, so its length has no bound."""
    at, head, parts = lines.at, lines.line, []
    lines.advance()
    while lines.line and lines.line[0] != GREATER:
        if lines.line[0] in (AT, PLUS):
            raise Malformed(f"FASTA with a line of FASTQ at byte {lines.at}")
        parts.append(b"".join(lines.line.split()))
        lines.advance()
    return Record(at, head, b"".join(parts), None)


def fastq_start(file: io.BufferedIOBase, size: int, begin: int, most: int) -> int:
    """The byte of the first record that begins at `begin` or later (`size` where there is none).

    A record has `most` bytes at most, so one begins in as many bytes before `begin`. Every line with @ there might be it: each is read on,
    record by record, until it contradicts itself or passes `begin`. The true one never contradicts itself, so where all that are left pass
    `begin` at the same byte, that is it. Where they don't, twice as many bytes are looked at, at last the file from its first record.
    """
    back = most
    while True:
        low = max(0, begin - back)
        lines = Cursor(file, low, whole_line=False)
        if low == 0:
            lines.skip_to_record()
            maybe = [lines.at]
        else:
            maybe = []
            while lines.line and lines.at < begin:
                if lines.line[0] == AT:
                    maybe.append(lines.at)
                lines.advance()
        reached: dict[int, int | None] = {}
        for at in maybe:
            chain, lines = [], Cursor(file, at)
            while True:
                if lines.at in reached or not lines.line or lines.at >= begin:
                    end = reached.get(lines.at, lines.at if lines.line else size)
                    break
                chain.append(lines.at)
                try:
                    record = fastq_record(lines, most)
                except Malformed:
                    if low == 0:
                        raise
                    end = None
                    break
                if record is None:
                    end = size
                    break
            reached.update(dict.fromkeys(chain, end))
        found = {end for end in reached.values() if end is not None}
        if len(found) == 1:
            return found.pop()
        back *= 2


def fasta_start(file: io.BufferedIOBase, size: int, begin: int, most: int) -> int:
    lines = Cursor(file, begin, whole_line=False)
    while lines.line and lines.line[0] != GREATER:
        lines.advance()
    return lines.at if lines.line else size


def range_records(file: io.BufferedIOBase, size: int | None, begin: int, end: int, most: int) -> Iterator[Record]:
    """The records that begin in [begin, end) of a file of `size` bytes; size None: the whole of a stream. A last record that the end of the file cuts off is left out."""
    lines = Cursor(file)
    lines.skip_to_record()
    if not lines.line:
        return
    fastq = lines.line[0] == AT
    if begin > lines.at:
        start = (fastq_start if fastq else fasta_start)(file, size, begin, most)
        if start >= end:
            return
        lines = Cursor(file, start)
    read = fastq_record if fastq else fasta_record
    while lines.line and lines.at < end:
        record = read(lines, most)
        if record is None:
            return
        yield record


@dataclass
class Piece(D.InputPartition):
    path: str
    begin: int
    end: int
    size: int | None


#: What can be decided before a record becomes a row: class of the filter, and the test of a value against the filter's.
TESTS: dict[type, Callable] = {
    D.EqualTo: lambda x, y: x == y, D.In: lambda x, y: x in y, D.StringStartsWith: lambda x, y: x.startswith(y), D.GreaterThan: lambda x, y: x > y,
    D.GreaterThanOrEqual: lambda x, y: x >= y, D.LessThan: lambda x, y: x < y, D.LessThanOrEqual: lambda x, y: x <= y,
}


class FastxReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        unknown = set(schema.names) - set(COLUMNS)
        if unknown:
            raise ValueError(f"fastx has no columns {sorted(unknown)}; it has {list(COLUMNS)}")
        if "path" not in options:
            raise ValueError("fastx needs a path")
        self.names, self.path = schema.names, options["path"]
        self.split, self.most = int(options.get("splitBytes", 64 << 20)), int(options.get("maxRecordBytes", 1 << 20))
        self.kept: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Filters on names and lengths are decided on the bytes; the others are Spark's."""
        for one in filters:
            if type(one) in TESTS and one.attribute in (("name",), ("length",)) and one.value is not None:
                self.kept.append((one.attribute[0], type(one), one.value))
            elif not (isinstance(one, D.IsNotNull) and one.attribute in (("name",), ("length",))):
                yield one

    def partitions(self) -> list[Piece]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in system.get_file_info(pafs.FileSelector(path, recursive=True)) if f.is_file]
        base = path.rstrip("/")
        pieces = []
        for f in sorted(files, key=lambda f: f.path):
            if not info.is_file and any(part[:1] in "._" for part in f.path[len(base) :].strip("/").split("/")):
                continue
            if f.path.endswith(".gz"):
                pieces.append(Piece(f.path, 0, 1 << 62, None))
            else:
                pieces += [Piece(f.path, at, min(at + self.split, f.size), f.size) for at in range(0, f.size, self.split)]
        return pieces

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # Spark's one partition of a folder without files
            return
        system, _ = opened(self.path)
        raw = io.BufferedReader(system.open_input_file(piece.path), 1 << 20)
        file = raw if piece.size is not None else io.BufferedReader(_Forward(gzip.open(raw)), 1 << 20)
        held, size = [], 0
        with file:
            for record in range_records(file, piece.size, piece.begin, piece.end, self.most):
                name, comment = (record.head[1:].decode("latin-1").strip().split(None, 1) + ["", ""])[:2]
                known = {"name": name, "length": len(record.seq)}
                if all(TESTS[kind](known[column], value) for column, kind, value in self.kept):
                    held.append((name, comment, record, piece.path))
                    size += 2 * len(record.seq) + len(record.head)
                if size > 4 << 20 or len(held) == 10_000:
                    yield self.batch(held)
                    held, size = [], 0
        if held:
            yield self.batch(held)

    def batch(self, held: list[tuple[str, str, Record, str]]) -> pa.RecordBatch:
        values = {
            "name": lambda h: h[0],
            "comment": lambda h: h[1],
            "seq": lambda h: h[2].seq.decode("latin-1"),
            "qual": lambda h: None if h[2].qual is None else h[2].qual.decode("latin-1"),
            "length": lambda h: len(h[2].seq),
            "file": lambda h: h[3],
            "at": lambda h: h[2].at,
        }
        return pa.record_batch([pa.array([values[n](h) for h in held], COLUMNS[n]) for n in self.names], self.names)


class _Forward(io.RawIOBase):
    """A stream that is read once, from its start."""

    def __init__(self, stream: io.BufferedIOBase):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        got = self.stream.read(len(into))
        into[: len(got)] = got
        return len(got)


@dataclass
class Done(D.WriterCommitMessage):
    staged: str | None
    name: str


def folded(text: str, width: int) -> str:
    return text if width <= 0 or not text else "\n".join(text[k : k + width] for k in range(0, len(text), width))


class FastxWriter(D.DataSourceWriter):
    """Tasks write to a folder of the job; the commit moves one file for each task to its place, so a repeated or lost attempt leaves nothing.

    With overwrite, the format's own files of earlier jobs go once the new ones are in place.
    """

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        missing = {"name", "seq"} - set(schema.names)
        if missing or "path" not in options:
            raise ValueError(f"fastx needs a path and the columns name and seq; missing: {sorted(missing) or 'path'}")
        self.path, self.job, self.overwrite = options["path"].rstrip("/"), uuid.uuid4().hex, overwrite
        self.fastq = options.get("kind", "fastq" if "qual" in schema.names else "fasta") == "fastq"
        self.width, self.zipped = int(options.get("lineWidth", 0)), options.get("compression", "none") == "gzip"
        self.default = chr(33 + int(options.get("defaultQuality", 20)))

    def text(self, row: Row) -> str:
        fields = row.asDict()
        name, comment, seq, qual = (fields.get(c) or "" for c in ("name", "comment", "seq", "qual"))
        if any(c in field for field in (name, comment, seq, qual) for c in "\r\n"):
            raise ValueError(f"a line break in the record {name!r}")
        head = f"{name} {comment}" if comment else name
        if not self.fastq:
            return f">{head}\n{folded(seq, self.width)}\n"
        qual = qual or self.default * len(seq)
        if len(qual) != len(seq):
            raise ValueError(f"{len(qual)} qualities for the {len(seq)} bases of {name!r}")
        return f"@{head}\n{folded(seq, self.width)}\n+\n{folded(qual, self.width)}\n"

    def write(self, rows: Iterator[Row]) -> Done:
        from pyspark import TaskContext

        first = next(rows, None)
        name = f"part-{TaskContext.get().partitionId():06d}-{self.job}.{'fastq' if self.fastq else 'fasta'}{'.gz' if self.zipped else ''}"
        if first is None:
            return Done(None, name)
        system, path = opened(self.path)
        folder = f"{path}/_staged-{self.job}"
        system.create_dir(folder, recursive=True)
        staged = f"{folder}/{uuid.uuid4().hex}"
        with system.open_output_stream(staged, compression=None) as raw:
            out = gzip.open(raw, "wb") if self.zipped else raw
            out.write(self.text(first).encode("latin-1"))
            for row in rows:
                out.write(self.text(row).encode("latin-1"))
            if self.zipped:
                out.close()
        return Done(staged, name)

    def commit(self, messages: list[Done | None]) -> None:
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        old = [f.path for f in system.get_file_info(pafs.FileSelector(path)) if f.is_file and f.base_name.startswith("part-")] if self.overwrite else []
        for one in messages:
            if one is not None and one.staged:
                system.move(one.staged, f"{path}/{one.name}")
        for f in old:
            system.delete_file(f)
        self.abort(messages)

    def abort(self, messages: list[Done | None]) -> None:
        system, path = opened(self.path)
        if system.get_file_info(f"{path}/_staged-{self.job}").type == pafs.FileType.Directory:
            system.delete_dir(f"{path}/_staged-{self.job}")


class FastxSource(D.DataSource):
    """Columns: name, comment, seq, qual (null in FASTA), length, file, and at, the byte where the record begins. A schema of fewer columns reads no others.

    Options to read: path (a file or folder), splitBytes (64 MB), maxRecordBytes (1 MB; a longer FASTQ record is an error, FASTA has no bound).
    Options to write: kind (fastq or fasta), lineWidth, compression (gzip), defaultQuality (20).
    A file is FASTA or FASTQ throughout; one that ends in .gz is one partition. A record cut off by the end of its file is left out, any other fault is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> FastxReader:
        return FastxReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> FastxWriter:
        return FastxWriter(schema, self.options, overwrite)


def numbered(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The records under a path with `ord`, their place from 0 in the order of files and bytes."""
    return global_rank(spark.read.format("fastx").options(**options).load(path).drop("length"), "file", "at", name="ord").drop("file", "at")


def read_mates(spark: SparkSession, first: str, second: str, **options: object) -> DataFrame:
    """(ord, name, mate, comment, seq, qual) of two files or folders whose records are mates in order; the shorter one ends the result."""
    return collate(numbered(spark, first, **options), numbered(spark, second, **options))
