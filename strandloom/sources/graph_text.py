"""Text formats of graphs and alignments: MAG records, ASQG, SAM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequences import cigar_counts

NEIGHBOURS = "array<struct<k:bigint,ovlp:int>>"


def _neighbours(text: Column) -> Column:
    pairs = F.regexp_extract_all(text, F.lit(r"(-?\d+,\d+);"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.split(p, ",")[0].cast("long").alias("k"), F.split(p, ",")[1].cast("int").alias("ovlp")))


def read_mag(spark: SparkSession, path: str) -> DataFrame:
    """(k0, k1, nsr, nei0, nei1, seq, cov) of four-line records; `.` stands for no neighbours."""
    rows = spark.read.option("lineSep", "\n@").text(path)
    parts = F.split(F.regexp_replace(F.regexp_replace("value", r"^@", ""), r"\n+$", ""), "\n")
    head = F.split(parts[0], "\t")
    ends = F.split(head[0], ":")
    return rows.where("length(value) > 0").select(ends[0].cast("long").alias("k0"), ends[1].cast("long").alias("k1"), head[1].cast("int").alias("nsr"), _neighbours(head[2]).alias("nei0"), _neighbours(head[3]).alias("nei1"), parts[1].alias("seq"), F.get(parts, F.lit(3)).alias("cov"))


def mag_text(unitigs: DataFrame) -> DataFrame:
    """(value): MAG records of unitigs, to be written as text."""

    def shown(column: str) -> Column:
        joined = F.array_join(F.transform(column, lambda n: F.concat(n["k"].cast("string"), F.lit(","), n["ovlp"].cast("string"), F.lit(";"))), "")
        return F.when(F.coalesce(F.size(column), F.lit(0)) > 0, joined).otherwise(".")

    head = F.concat(F.lit("@"), F.col("k0").cast("string"), F.lit(":"), F.col("k1").cast("string"))
    return unitigs.select(F.concat_ws("\n", F.concat_ws("\t", head, F.col("nsr").cast("string"), shown("nei0"), shown("nei1")), "seq", F.lit("+"), F.coalesce("cov", F.repeat(F.lit('"'), F.length("seq")))).alias("value"))


def edges_of(unitigs: DataFrame) -> DataFrame:
    """(a, b, ovlp): the neighbours of both ends as rows."""
    sides = F.array(*(F.struct(F.col(f"k{s}").alias("a"), F.coalesce(f"nei{s}", F.array().cast(NEIGHBOURS)).alias("nei")) for s in (0, 1)))
    return unitigs.select(F.explode(sides).alias("x")).select("x.a", F.explode("x.nei").alias("n")).select("a", F.col("n.k").alias("b"), F.col("n.ovlp").alias("ovlp"))


def read_asqg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of an ASQG file: (name, seq) and (a, b, ovlp, end_a, end_b) of end-to-end overlaps."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    vertices = rows.where("f[0] = 'VT'").select(F.col("f")[1].alias("name"), F.col("f")[2].alias("seq"))
    e = F.split(F.col("f")[1], " ")
    n = [e[k].cast("int") for k in range(2, 8)]
    edges = rows.where("f[0] = 'ED'").select(e[0].alias("a"), e[1].alias("b"), (n[1] - n[0] + 1).alias("ovlp"), n[0].alias("beg_a"), n[1].alias("last_a"), n[2].alias("len_a"), n[3].alias("beg_b"), n[4].alias("last_b"), n[5].alias("len_b"))
    whole = ((F.col("beg_a") == 0) | (F.col("last_a") == F.col("len_a") - 1)) & ((F.col("beg_b") == 0) | (F.col("last_b") == F.col("len_b") - 1))
    return vertices, edges.where(whole).select("a", "b", "ovlp", (F.col("beg_a") > 0).cast("int").alias("end_a"), (F.col("beg_b") > 0).cast("int").alias("end_b"))


def parse_sam(lines: DataFrame, *others: str) -> DataFrame:
    """(others, qname, flag, rname, pos, mapq, cigar, seq_len, nm, m, i, d, n, clip_left, clip_right) of SAM lines (value) of mapped reads."""
    f = [F.get(F.split("value", "\t"), F.lit(k)) for k in range(6)]
    rows = lines.where(~F.col("value").startswith("@")).select(*others, f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), f[3].cast("long").alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), F.regexp_extract("value", r"\tNM:i:(\d+)", 1).cast("long").alias("nm"))
    return rows.where((F.col("flag").bitwiseAND(F.lit(4)) == 0) & (F.col("cigar") != "*")).select("*", cigar_counts(F.col("cigar")).alias("c")).select(*others, "qname", "flag", "rname", "pos", "mapq", "cigar", "nm", "c.*").withColumn("query_len", F.col("m") + F.col("i"))


def identities(sam: DataFrame) -> DataFrame:
    """(qname, with_gaps, without_gaps): identities of mapped reads."""
    q, d, i, nm = (F.col(c) for c in ("query_len", "d", "i", "nm"))
    return sam.where("nm IS NOT NULL").select("qname", ((q + d - nm) / (q + d)).alias("with_gaps"), ((q - i - (nm - i - d)) / (q - i)).alias("without_gaps"))


def remapped_text(contigs: DataFrame, hits: DataFrame, max_dist: int) -> DataFrame:
    """(value): a FASTQ record for each contig (contig, name, seq, and the rest of its comment), with its reads counted, its depth as qualities and, as a tag, the hits without a mate nearer than max_dist."""
    from strandloom.operators.coverage import depth, read_places, supporting_reads, unpaired_hits

    runs = depth(read_places(hits), 93)
    shown = runs.groupBy("contig").agg(F.array_sort(F.collect_list(F.struct("beg", "end", "cov"))).alias("runs"))
    gaps = F.transform("runs", lambda x, i: F.concat(F.repeat(F.lit("!"), (x["beg"] - F.when(i == 0, 0).otherwise(F.get(F.col("runs"), i - 1)["end"])).cast("int")), F.repeat(F.char(x["cov"] + 33), (x["end"] - x["beg"]).cast("int"))))
    alone = unpaired_hits(hits, max_dist).groupBy("contig").agg(F.array_sort(F.collect_list(F.struct("read_id", "beg", "end"))).alias("ur"))
    rows = contigs.join(shown, "contig", "left").join(supporting_reads(hits), "contig", "left").join(alone, "contig", "left")
    qual = F.rpad(F.coalesce(F.array_join(gaps, ""), F.lit("")), F.length("seq"), "!")
    tag = F.array_join(F.transform("ur", lambda x: F.concat_ws(",", x["read_id"].cast("string"), x["beg"].cast("string"), x["end"].cast("string"))), ";")
    head = F.concat_ws("\t", F.concat(F.lit("@"), "name"), F.coalesce("n_supp", F.lit(0)).cast("string"), *(["rest"] if "rest" in contigs.columns else []), F.when(F.size("ur") > 0, F.concat(F.lit("UR:Z:"), tag, F.lit(";"))))
    return rows.select(F.concat_ws("\n", head, "seq", F.lit("+"), qual).alias("value"))


def parse_remapped(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contigs, reads) of remapped FASTQ records (name, comment, seq, qual): (name, nsr, maxo, seq) and (name, read_id, beg, end).

    Records without the tag of unpaired reads are left out. Ends that a single read covers are cut off, unless that is all, and the reads' places follow.
    """
    tagged = records.where(F.col("comment").contains("UR:Z:"))
    size = F.length("seq")
    beg = F.length("qual") - F.length(F.regexp_replace("qual", '^"+', ""))
    end = F.length(F.regexp_replace("qual", '"+$', ""))
    rows = tagged.withColumn("beg", F.when(beg >= end, 0).otherwise(beg)).withColumn("end", F.when(beg >= end, size).otherwise(end))
    fields = F.split("comment", "\t")
    overlaps = F.transform(F.regexp_extract_all(F.concat_ws("\t", F.get(fields, F.lit(1)), F.get(fields, F.lit(2))), F.lit(r"-?\d+,(\d+);"), F.lit(1)), lambda o: o.cast("long"))
    contigs = rows.select("name", fields[0].cast("long").alias("nsr"), F.coalesce(F.array_max(overlaps), F.lit(0)).alias("maxo"), F.expr("substring(seq, beg + 1, end - beg)").alias("seq"))
    each = rows.select("name", "beg", "end", F.explode(F.regexp_extract_all(F.regexp_extract("comment", r"UR:Z:([0-9,;]*)", 1), F.lit(r"(\d+,\d+,\d+)"), F.lit(1))).alias("u"))
    u = F.split("u", ",")
    reads = each.select("name", u[0].cast("long").alias("read_id"), F.greatest(u[1].cast("long") - F.col("beg"), F.lit(0)).alias("b"), F.least(u[2].cast("long") - F.col("beg"), F.col("end") - F.col("beg")).alias("e"))
    return contigs, reads.select("name", "read_id", F.col("b").alias("beg"), F.col("e").alias("end"))


CLASSES = (0, 0, 100, 200, 500)
BREAKS = "qname string, kept long, dropped long, mapped long, " + ", ".join(f"{kind}{k} long" for kind in ("b", "g") for k in range(5))


def part_breaks(parts: list[tuple], mask: float = 0.5, max_gap: int = 500, min_mapq: int = 10) -> list[int]:
    """Counts of BREAKS for the mapped parts of one contig in file order: (rname, pos, reverse, mapq, query, reference, clip_left, clip_right) each.

    A part goes where more than `mask` of it overlaps an earlier one on the contig. Breaks are parts less one: of all, then of sure ones of growing length; b before and
    g after parts that follow each other on one strand with gaps below max_gap on both sides are joined.
    """
    kept: list[list] = []
    for name, pos, reverse, mapq, query, reference, left, right in parts:
        at = right if reverse else left
        if not any(min(at + query, k[8] + k[4]) - max(at, k[8]) > query * mask for k in kept):
            kept.append([name, pos, reverse, mapq, query, reference, left, right, at])

    def counts(rows: list[list]) -> list[int]:
        held = [len(rows), *(sum(r[3] >= min_mapq and r[4] >= size for r in rows) for size in CLASSES[1:])]
        return [max(n - 1, 0) for n in held] if len(parts) > 1 else [0] * 5

    found = [len(kept), len(parts) - len(kept), sum(r[4] for r in kept), *counts(kept)]
    joined: list[list] = []
    for row in sorted((list(r) for r in kept), key=lambda r: (r[0], r[1])):
        last = joined[-1] if joined else None
        if last and (last[0], last[2]) == (row[0], row[2]) and abs(row[1] - last[1] - last[5]) < max_gap and abs(row[6] - last[6] - last[4]) < max_gap:
            row[4], row[6] = row[6] + row[4] - last[6], last[6]
            row[5], row[1] = row[1] + row[5] - last[1], last[1]
            joined.pop()
        joined.append(row)
    return [*found, *(counts(joined) if len(kept) > 1 else [0] * 5)]


def contig_breaks(lines: DataFrame, min_len: int = 150, **rules) -> DataFrame:
    """The columns of BREAKS for each contig of SAM lines (value, and ord, their order); contigs shorter than min_len, clipped ends included, are left out."""
    import pandas as pd

    sam = parse_sam(lines, "ord").where(F.col("clip_left") + F.col("clip_right") + F.col("query_len") >= min_len)
    fields = ["rname", "pos", "reverse", "mapq", "query_len", "reference_len", "clip_left", "clip_right"]
    rows = sam.select("qname", "ord", "rname", (F.col("pos") - 1).alias("pos"), (F.col("flag").bitwiseAND(F.lit(16)) > 0).alias("reverse"), "mapq", "query_len", (F.col("m") + F.col("d") + F.col("n")).alias("reference_len"), "clip_left", "clip_right")
    whole = rows.groupBy("qname").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("parts"))  # the parts of one contig

    def run(batches):
        for pdf in batches:
            out = [(q, *part_breaks([tuple(x[c] for c in fields) for x in parts], **rules)) for q, parts in zip(pdf["qname"], pdf["parts"], strict=True)]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in BREAKS.split(", ")])

    return whole.mapInPandas(run, BREAKS)


def break_stats(breaks: DataFrame) -> DataFrame:
    """(metric, value): sums over contig_breaks."""
    names = [f.split()[0] for f in BREAKS.split(", ")][1:]
    one = breaks.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("x")).select("x.*")
