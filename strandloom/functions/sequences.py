"""Column functions over DNA strings. None of them runs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(seq: Column) -> Column:
    """Upper case, and N for all that is not A, C, G or T."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


#: Nucleotide codes that aren't their own complement (fixed values).
CODES, PARTNERS = "ACGTRYKMBVDH", "TGCAYRMKVBHD"


def complement(seq: Column) -> Column:
    """The complement of every code in its own case; S, W, N and all else stay."""
    return F.translate(seq, CODES + CODES.lower(), PARTNERS + PARTNERS.lower())


def revcomp(seq: Column) -> Column:
    return F.reverse(complement(seq))


def sort_key(seq: Column) -> Column:
    """Orders as end < A < C < G < T < N under plain string order."""
    return F.translate(seq, "N", "Z")


def canonical(seq: Column) -> Column:
    return F.least(seq, revcomp(seq))


def windows(seq: Column, k: int, block: int = 256) -> Column:
    """All substrings of length k as an array; none where seq is shorter.

    A substring is found by walking from the start of its string, so long strings are cut into overlapping blocks first.
    """

    def short(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(seq) - k) / block).cast("int")), lambda j: F.substring(seq, j * block + 1, F.lit(block + k - 1)))
    found = F.when(F.length(seq) <= 2 * block, short(seq)).otherwise(F.flatten(F.transform(blocks, short)))
    return F.when(F.length(seq) >= k, found).otherwise(F.array().cast("array<string>"))


def palindrome_trim(seq: Column) -> Column:
    """A read of even length that equals its reverse complement loses its last base."""
    return F.when((F.length(seq) % 2 == 0) & (F.length(seq) > 0) & (seq == revcomp(seq)), F.substring(seq, F.lit(1), F.length(seq) - 1)).otherwise(seq)


def quality_span(qual: Column, floor: int) -> Column:
    """struct(first, last): the 1-based part that stays after trimming the 3' end and then the 5' end.

    From an end, floor minus quality is summed until the sum falls below 0; the cut is where the sum is largest (first
    such place), if it is above 0. last < first means that nothing stays.
    """

    def cut(chars: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("best"), F.lit(0).alias("cut"), F.lit(0).alias("at"), F.lit(False).alias("over"))

        def step(s: Column, c: Column) -> Column:
            total = s["sum"] + floor - (F.ascii(c) - 33)
            over = s["over"] | (total < 0)
            better = ~over & (total > s["best"])
            return F.struct(
                F.when(over, s["sum"]).otherwise(total).alias("sum"),
                F.when(better, total).otherwise(s["best"]).alias("best"),
                F.when(better, s["at"] + 1).otherwise(s["cut"]).alias("cut"),
                (s["at"] + 1).alias("at"),
                over.alias("over"),
            )

        return F.aggregate(chars, start, step, lambda s: s["cut"])

    chars = F.filter(F.split(qual, ""), lambda c: c != "")
    last = F.length(qual) - cut(F.reverse(chars))
    first = cut(F.slice(chars, F.lit(1), last)) + 1
    return F.struct(first.alias("first"), last.alias("last"))


def coverage_quality(cov: Column, factor: int = 17) -> Column:
    """Coverage characters to qualities: min(126, factor * (c - 33) + 33)."""
    codes = F.transform(F.filter(F.split(cov, ""), lambda c: c != ""), lambda c: F.char(F.least(F.lit(126), factor * (F.ascii(c) - 33) + 33).cast("bigint")))
    return F.array_join(codes, "")


def mate_name(name: Column) -> Column:
    """A read's name without its mate number."""
    return F.regexp_replace(name, "/[0-9]$", "")


def cigar_counts(cigar: Column) -> Column:
    """struct(m, i, d, n, clip_left, clip_right) of a CIGAR string."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1))
    kinds = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    pairs = F.zip_with(ops, kinds, lambda n, k: F.struct(n.cast("long").alias("n"), k.alias("k")))

    def total(which: str) -> Column:
        return F.aggregate(F.filter(pairs, lambda p: p["k"] == which), F.lit(0).cast("long"), lambda s, p: s + p["n"])

    def clip(at: int) -> Column:
        edge = F.element_at(pairs, at)
        return F.when((F.size(pairs) > 0) & edge["k"].isin("S", "H"), edge["n"]).otherwise(F.lit(0).cast("long"))

    return F.struct(total("M").alias("m"), total("I").alias("i"), total("D").alias("d"), total("N").alias("n"), clip(1).alias("clip_left"), clip(-1).alias("clip_right"))


def auto_k(size: Column, shift: float, low: int, high: int) -> Column:
    """A k-mer length for an input of a given size: int(log4(size) + shift), bounded."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.log(size.cast("double")) / F.log(F.lit(4.0)) + shift).cast("int")))


def replace_ambiguous(seq: Column, key: Column) -> Column:
    """seq with each N as a base that depends on the key and its place alone, so every run gives the same; the reference draws at random."""
    place = lambda i: F.substring(F.md5(F.concat(key.cast("string"), F.lit(":"), (i + 1).cast("string"))), 1, 1)
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.array_join(F.transform(letters, lambda c, i: F.when(c == "N", F.translate(place(i), "0123456789abcdef", "ACGT" * 4)).otherwise(c)), "")


def corrected_name(read_id: Column, quality_sum: Column, difference: Column, separator: str = "_") -> Column:
    """The name of a corrected read: its id, the quality sum of its changes and its score difference."""
    return F.concat_ws(separator, read_id.cast("string"), quality_sum.cast("string"), difference.cast("string"))
