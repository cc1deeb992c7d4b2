"""The registered FASTX format: ranges of bytes that find their records, pushed filters, the committing writer and mates in two files."""

import gzip
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from strandloom.sources import fastx_format as X


def made(n, seed, *, end="\n", fold=None, longest=180):
    """(records, text): qualities begin with @ and + often, also where a line is folded."""
    rng = random.Random(seed)
    rows, out = [], []
    for k in range(n):
        size = rng.choice([0, 1, 2, rng.randrange(longest)])
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        qual = "".join(rng.choice("@@@+>I5") for _ in range(size))
        width = fold or rng.choice([5, 60, 1000])
        lines = [f"@r{k} c{k}", *(seq[i : i + width] for i in range(0, size, width)), "+", *(qual[i : i + width] for i in range(0, size, width))]
        if not size:
            lines = [f"@r{k} c{k}", "", "+", ""]
        rows.append((f"r{k}", f"c{k}", seq, qual))
        out.append(end.join(lines) + end)
    return rows, "".join(out)


def by_ranges(text, step, most=1 << 12):
    raw = text.encode()
    out = []
    for begin in range(0, len(raw), step):
        file = io.BufferedReader(io.BytesIO(raw))
        out += [(r.at, r.head.decode().split()[0][1:], r.seq.decode(), None if r.qual is None else r.qual.decode()) for r in X.range_records(file, len(raw), begin, min(begin + step, len(raw)), most)]
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("fold", [None, 1, 3, 1000])
def test_ranges_find_their_records(end, fold):
    rows, text = made(60, 3, end=end, fold=fold)
    want = [(n, s, q) for n, _, s, q in rows]
    for step in (1, 7, 64, 301, 5000, 1 << 20):
        got = by_ranges(text, step)
        assert [r[1:] for r in got] == want
        assert [r[0] for r in got] == sorted({r[0] for r in got})


def test_every_size_of_the_window_gives_the_same():
    rows, text = made(40, 5, fold=2, longest=20)
    for most in (100, 130, 1000):  # the longest record has fewer than 100 bytes
        assert [r[1:] for r in by_ranges(text, 13, most)] == [(n, s, q) for n, _, s, q in rows]


def test_fasta_ranges():
    text = "junk\n>a x\nACGT\nAC\n\n>b\n>c\nG\r\nT T\r\n"
    for step in (1, 5, 100):
        assert [r[1:] for r in by_ranges(text, step)] == [("a", "ACGTAC", None), ("b", "", None), ("c", "GTT", None)]


def test_faults():
    assert by_ranges("", 5) == [] and by_ranges("no record\n", 5) == []
    assert [r[1] for r in by_ranges("@a\nAC\n+\nII\n@b\nACGT\n+\nII", 100)] == ["a"]  # cut off by the end
    for bad in ("@a\nAC\n+\nIII\n@b\nA\n+\nI\n", "@a\nAC\n@b\nA\n+\nI\n", ">a\nAC\n@b\nA\n+\nI\n"):
        with pytest.raises(X.Malformed):
            by_ranges(bad, 100)
    long_ = "@a\n" + "A" * 500 + "\n+\n" + "I" * 500 + "\n"
    with pytest.raises(X.Malformed, match="maxRecordBytes"):
        by_ranges("@s\nA\n+\nI\n" + long_ + "@t\nA\n+\nI\n", 64, most=300)


@pytest.fixture(scope="module")
def fastx(spark):
    X.register(spark)
    return lambda path, **options: spark.read.format("fastx").options(**options).load(str(path))


def test_read_in_splits(fastx, tmp_path):
    rows, text = made(1500, 7)
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "_hidden").write_text("@x\nA\n+\nI\n")
    assert len(text) > 1 << 16
    for size in (1 << 12, 1 << 16):
        frame = fastx(tmp_path, splitBytes=size)
        assert frame.rdd.getNumPartitions() == -(-len(text) // size)
        assert [tuple(r)[:4] for r in frame.orderBy("at").collect()] == rows
    with gzip.open(tmp_path / "b.fq.gz", "wt") as out:
        out.write(text)
    assert fastx(tmp_path, splitBytes=1 << 14).groupBy("name").count().where("count <> 2").count() == 0


def test_filters_are_pushed_and_columns_chosen(spark, fastx, tmp_path):
    rows, text = made(300, 9)
    (tmp_path / "a.fq").write_text(text)
    frame = fastx(tmp_path, splitBytes=4096).where("name LIKE 'r1%' AND length >= 50 AND comment <> 'c100'")
    want = {r for r in rows if r[0].startswith("r1") and len(r[2]) >= 50 and r[1] != "c100"}
    assert {tuple(r)[:4] for r in frame.collect()} == want
    plan = frame._jdf.queryExecution().executedPlan().toString()
    left = plan.split("Filter", 1)[1].split("\n")[0]
    assert "comment" in left and "length" not in left and "StartsWith" not in left
    for test in ("name IN ('r3', 'r7')", "name = 'r3'", "length < 3", "length > 100 AND length <= 150", "length IS NOT NULL", "name = NULL"):
        whole = spark.createDataFrame([(*r, len(r[2])) for r in rows], "name string, comment string, seq string, qual string, length int")
        assert sorted(r.name for r in fastx(tmp_path).where(test).collect()) == sorted(r.name for r in whole.where(test).collect())
    some = spark.read.format("fastx").schema("length int, name string").load(str(tmp_path))
    assert sorted(map(tuple, some.collect())) == sorted((len(r[2]), r[0]) for r in rows)


@pytest.mark.parametrize("compression", ["none", "gzip"])
@pytest.mark.parametrize("width", [0, 7])
def test_written_and_read_back(spark, fastx, tmp_path, compression, width):
    rows, _ = made(200, 11)
    out = str(tmp_path / "out")
    frame = spark.createDataFrame(rows, "name string, comment string, seq string, qual string").repartition(3)
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        frame.write.format("fastx").mode(mode).options(compression=compression, lineWidth=width).save(out)
        assert sorted(tuple(r)[:4] for r in fastx(out, splitBytes=1024).collect()) == sorted(rows * times)
    assert not [f for f in os.listdir(out) if not f.startswith("part-")]


def test_nothing_is_left_of_a_job_that_fails(spark, fastx, tmp_path):
    out = str(tmp_path / "out")
    spark.createDataFrame([("a", "AC", "II")], "name string, seq string, qual string").write.format("fastx").mode("append").save(out)
    bad = spark.range(0, 40, 1, 4).select(F.concat(F.lit("r"), "id").alias("name"), F.lit("AC").alias("seq"), F.when(F.col("id") == 39, "I").otherwise("II").alias("qual"))
    with pytest.raises(Exception, match="1 qualities for the 2 bases"):
        bad.write.format("fastx").mode("overwrite").save(out)
    assert [r.name for r in fastx(out).collect()] == ["a"] and len(os.listdir(out)) == 1


def test_missing_qualities_fasta_and_empty(spark, fastx, tmp_path):
    frame = spark.createDataFrame([("a", "ACGT", None), ("b", None, None), (None, "A", "I")], "name string, seq string, qual string")
    frame.write.format("fastx").mode("append").save(str(tmp_path / "q"))
    assert sorted((r.name, r.seq, r.qual) for r in fastx(tmp_path / "q").collect()) == [("", "A", "I"), ("a", "ACGT", "5555"), ("b", "", "")]
    frame.write.format("fastx").mode("append").options(kind="fasta", lineWidth=3).save(str(tmp_path / "a"))
    assert sorted((r.name, r.seq, r.qual) for r in fastx(tmp_path / "a").collect()) == [("", "A", None), ("a", "ACGT", None), ("b", "", None)]
    frame.where("name = 'none'").write.format("fastx").mode("append").save(str(tmp_path / "e"))
    assert fastx(tmp_path / "e").count() == 0


def test_mates_in_two_files(spark, fastx, tmp_path):
    for mate in (1, 2):
        (tmp_path / f"{mate}.fq").write_text("".join(f"@p{k}/{mate}\n{'ACGT'[k % 4] * (k % 5 + mate)}\n+\n{'@' * (k % 5 + mate)}\n" for k in range(50 if mate == 1 else 40)))
    got = X.read_mates(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq"), splitBytes=100).orderBy("ord").collect()
    assert [(r.ord, r.name, r.mate, r.seq) for r in got] == [(2 * k + m, f"p{k}", m, "ACGT"[k % 4] * (k % 5 + m + 1)) for k in range(40) for m in (0, 1)]
