"""k-mer tables: spectra, next-base evidence, the unique-k-mer filter and contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequences import canonical, revcomp, windows
from strandloom.operators import packed as P
from strandloom.session import Scratch


def kmer_counts(reads: DataFrame, k: int, *, seq_col: str = "s", both: bool = True, dna_only: bool = True) -> DataFrame:
    """(kmer, n); with both strands as one, a k-mer stands for its reverse complement too. With dna_only, k-mers of A, C, G and T alone."""
    if dna_only and k <= P.MOST:
        return P.packed_counts(reads, k, seq_col=seq_col, both=both).select(P.shown(F.col("code"), k).alias("kmer"), "n")
    kmers = reads.select(F.explode(windows(F.col(seq_col), k)).alias("kmer"))
    if dna_only:
        kmers = kmers.where(~F.col("kmer").contains("N"))
    return kmers.groupBy((canonical(F.col("kmer")) if both else F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n"))


def spectrum(counts: DataFrame) -> DataFrame:
    """(multiplicity, n)."""
    return counts.groupBy(F.col("n").alias("multiplicity")).agg(F.count("*").alias("n"))


def extensions(reads: DataFrame, w: int, *, seq_col: str = "s") -> DataFrame:
    """(kmer, a, c, g, t, n_total): how often each base follows a w-mer on either strand. n_total also counts N and read ends."""
    if w < P.MOST_NEXT:
        rows = P.packed_extensions(reads, w, seq_col=seq_col)
        tally = [F.sum(F.when(F.col("next") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate("acgt")]
        return rows.groupBy("code").agg(*tally, F.sum("n").alias("n_total")).select(P.shown(F.col("code"), w).alias("kmer"), "a", "c", "g", "t", "n_total")
    strands = reads.select(F.explode(F.array(F.col(seq_col), revcomp(F.col(seq_col)))).alias("s"))
    padded = F.concat("s", F.lit("$"))
    rows = strands.select(F.explode(windows(padded, w + 1)).alias("x")).select(F.substring("x", 1, w).alias("kmer"), F.substring("x", w + 1, 1).alias("next")).where(~F.col("kmer").contains("N"))
    tally = {c.lower(): F.count_if(F.col("next") == c).alias(c.lower()) for c in "ACGT"}
    return rows.groupBy("kmer").agg(*tally.values(), F.count("*").alias("n_total"))


def next_base_table(reads: DataFrame, w: int, min_occ: int = 3, *, seq_col: str = "s") -> DataFrame:
    """(kmer, best, best_n, rest, ratio, full_ratio): w-mers whose most frequent next base occurs min_occ times at least.

    The first of A, C, G, T wins ties. rest counts the other bases; ratio is best over rest (best alone
    without a rest), at most 31 and rounded; full_ratio is unrounded.
    """
    return next_bases(extensions(reads, w, seq_col=seq_col), min_occ)


def next_bases(ext: DataFrame, min_occ: int = 3) -> DataFrame:
    """next_base_table of a table of extensions."""
    best_n = F.greatest("a", "c", "g", "t")
    best = F.when(F.col("a") == best_n, "A").when(F.col("c") == best_n, "C").when(F.col("g") == best_n, "G").otherwise("T")
    rest = F.col("a") + F.col("c") + F.col("g") + F.col("t") - best_n
    solid = ext.select("kmer", best.alias("best"), best_n.alias("best_n"), rest.alias("all_rest")).where(F.col("best_n") >= min_occ)
    full = F.least(F.when(F.col("all_rest") > 0, F.col("best_n") / F.col("all_rest")).otherwise(F.col("best_n").cast("double")), F.lit(31.0))
    return solid.select("kmer", "best", "best_n", F.least("all_rest", F.lit(7)).alias("rest"), F.floor(full + 0.499).alias("ratio"), full.alias("full_ratio"), "all_rest")


def solid_stats(solid: DataFrame, min_occ: int = 3) -> DataFrame:
    """(informative, ambiguous): w-mers that can and can't tell the next base."""
    good = (F.col("all_rest") <= 7) & (F.col("full_ratio") >= min_occ)
    return solid.agg(F.count_if(good).alias("informative"), F.count_if(~good).alias("ambiguous"))


def unique_kmer_filter(reads: DataFrame, k: int, *, id_col: str = "rid", seq_col: str = "s", pair_col: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Reads of A, C, G and T alone whose forward k-mers all occur twice or more; with pair_col a pair stays or goes together.

    counts: (code, n) of a larger collection that holds the reads, such as a kept table; without it the reads are counted.
    """
    once = (counts if counts is not None else P.packed_counts(reads, k, seq_col=seq_col, both=False)).where("n = 1").select("code")
    bad = P.packed_rows(reads, k, id_col, seq_col=seq_col).join(once, "code", "left_semi").select(id_col).unionAll(reads.where(F.col(seq_col).rlike("[^ACGT]")).select(id_col))
    if pair_col is None:
        return reads.join(bad.distinct(), id_col, "left_anti")
    pairs = reads.join(bad.distinct(), id_col, "left_semi").select(pair_col).distinct()
    return reads.join(pairs, pair_col, "left_anti")


def _suffix_heads(collection: DataFrame, k: int, shortest: int) -> DataFrame:
    """(oriented_id, w): the first k bases from each position that has `shortest` of them at least."""
    long_ = collection.where(F.length("seq") >= shortest)
    return long_.select("oriented_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - shortest + 1), lambda i: F.substring(F.col("seq"), i, F.lit(k)))).alias("w"))


def _special_heads(a: DataFrame, b: DataFrame, k: int, min_occ: int, shortest: int) -> DataFrame:
    """(sample, w): heads (w) that begin with a string that occurs min_occ times in one sample and never in the other.

    Strings grow level by level: one of length l + 1 is counted only if its first l bases still occur in both samples, and min_occ times in one of them.
    """
    scratch = Scratch(a.sparkSession, "contrast")
    every = a.select("w", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select("w", F.lit(0), F.lit(1)))
    alive = scratch.put("alive", every.groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    out = None
    for size in range(shortest, k + 1):
        head = F.left("w", F.lit(size))
        rows = alive.where(F.length("w") >= size)
        counts = rows.groupBy(head.alias("head")).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b")).where(F.greatest("n_a", "n_b") >= min_occ)
        told = scratch.put(f"level{size}", rows.join(counts, head == F.col("head")).select("w", "a", "b", "n_a", "n_b"))
        found = told.where("n_a = 0 OR n_b = 0").select(F.when(F.col("n_b") == 0, "a").otherwise("b").alias("sample"), "w")
        out = found if out is None else out.unionAll(found)
        alive = told.where("n_a > 0 AND n_b > 0").select("w", "a", "b")
        if alive.isEmpty():
            break
    return out


def contrast(a: DataFrame, b: DataFrame, k: int, min_occ: int = 3, *, exact: bool = False, shortest: int = 4) -> DataFrame:
    """(sample, oriented_id): strings of one sample with a k-mer that occurs min_occ times there and never in the other.

    a and b are collections (oriented_id, seq) that hold both strands. With exact, any string of `shortest` to k bases counts, not those of k alone.
    """
    if exact:
        heads = [_suffix_heads(x, k, shortest) for x in (a, b)]
        special = _special_heads(*heads, k, min_occ, shortest)
        hits = [own.join(special.where(F.col("sample") == name).select("w"), "w", "left_semi").select(F.lit(name).alias("sample"), "oriented_id").distinct() for name, own in zip("ab", heads, strict=True)]
        return hits[0].unionAll(hits[1])
    if k <= P.MOST:
        counts, key = [P.packed_counts(x, k, seq_col="seq", both=False) for x in (a, b)], "code"
        rows = [P.packed_rows(x, k, "oriented_id", seq_col="seq") for x in (a, b)]
    else:
        counts, key = [kmer_counts(x, k, seq_col="seq", both=False) for x in (a, b)], "kmer"
        rows = [x.select("oriented_id", F.explode(windows(F.col("seq"), k)).alias("kmer")) for x in (a, b)]
    out = None
    for sample, own, (mine, other) in (("a", rows[0], counts), ("b", rows[1], counts[::-1])):
        special = mine.where(F.col("n") >= min_occ).join(other, key, "left_anti").select(key)
        hits = own.join(special, key, "left_semi").select(F.lit(sample).alias("sample"), "oriented_id").distinct()
        out = hits if out is None else out.unionAll(hits)
    return out
