"""Suffix operators of a read collection: order, Burrows-Wheeler rows, ranks and exact counts.

A collection is a table (oriented_id, seq): string 2r is read r, string 2r + 1 its reverse complement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import revcomp, sort_key, windows
from strandloom.operators import packed as P
from strandloom.operators.ranking import global_rank, running_totals
from strandloom.session import cut_lineage

SYMBOLS = "$ACGTN"


def both_strands(reads: DataFrame, id_col: str = "rid", seq_col: str = "s", *others: str) -> DataFrame:
    both = F.array(F.struct(F.lit(0).alias("strand"), F.col(seq_col).alias("seq")), F.struct(F.lit(1).alias("strand"), revcomp(F.col(seq_col)).alias("seq")))
    return reads.select(F.col(id_col).alias("read_id"), *others, F.explode(both).alias("x")).select((F.col("read_id") * 2 + F.col("x.strand")).alias("oriented_id"), "x.seq", *others)


def suffixes(collection: DataFrame) -> DataFrame:
    """(oriented_id, at, suffix, before): every suffix, the empty one included, and the symbol before it."""
    rows = collection.select("oriented_id", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") + 1)).alias("at"))
    before = F.when(F.col("at") > 1, F.substring("seq", F.col("at") - 1, F.lit(1))).otherwise("$")
    return rows.select("oriented_id", "at", sort_key(F.substring("seq", F.col("at"), F.length("seq"))).alias("suffix"), before.alias("sym"))


def bwt(collection: DataFrame) -> DataFrame:
    """(row, sym): the transform of all strings, ends ordered by string id."""
    return global_rank(suffixes(collection), "suffix", "oriented_id", name="row", keep=["sym"])


def _joined(pieces: DataFrame, size: int | None) -> DataFrame:
    """Pieces (start, sym, len) that follow each other with the same symbol as one, within blocks of `size` rows; edge marks a block's first and last."""
    pieces = pieces.withColumn("block", F.floor(F.col("start") / size) if size else F.lit(0))
    own = Window.partitionBy("block").orderBy("start") if size else Window.orderBy("start")
    goes_on = (F.lag("sym").over(own) == F.col("sym")) & (F.lag(F.col("start") + F.col("len")).over(own) == F.col("start"))
    runs = pieces.withColumn("head", ~F.coalesce(goes_on, F.lit(False))).withColumn("run", F.sum(F.col("head").cast("int")).over(own))
    found = runs.groupBy("block", "run", "sym").agg(F.min("start").alias("start"), F.sum("len").alias("len"))
    return found.withColumn("edge", (F.col("run") == 1) | (F.col("run") == F.max("run").over(Window.partitionBy("block"))))


def bwt_runs(rows: DataFrame) -> DataFrame:
    """(start, sym, len): runs of equal symbols.

    Runs are found within blocks of rows; only the first and last run of a block can go on beyond it, so these alone
    are looked at again in blocks of blocks, and the window at the end goes over two rows for each 2**32.
    """
    pieces, out = rows.select(F.col("row").alias("start"), "sym", F.lit(1).cast("long").alias("len")), []
    for size in (1 << 16, 1 << 32):
        found = cut_lineage(_joined(pieces, size).select("start", "sym", "len", "edge"))
        out.append(found.where("NOT edge"))
        pieces = found.where("edge").drop("edge")
    out.append(_joined(pieces, None))
    return out[0].select("start", "sym", "len").unionAll(out[1].select("start", "sym", "len")).unionAll(out[2].select("start", "sym", "len"))


def symbol_counts(collection: DataFrame) -> DataFrame:
    """(sym, n, cum): how often each symbol occurs, string ends included, and how many symbols are smaller."""
    bases = [F.struct(F.lit(b).alias("sym"), (F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).cast("long").alias("n")) for b in SYMBOLS[1:]]
    each = collection.select(F.explode(F.array(F.struct(F.lit("$").alias("sym"), F.lit(1).cast("long").alias("n")), *bases)).alias("x")).groupBy("x.sym").agg(F.sum("x.n").alias("n"))
    order = Window.orderBy(F.translate("sym", "$N", " Z")).rowsBetween(Window.unboundedPreceding, -1)  # six rows
    return each.select("sym", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("cum"))


def rank_errors(rows: DataFrame, marginal: DataFrame) -> DataFrame:
    """(sym, n, expected): the index check: symbols in the transform against those in the strings."""
    return rows.groupBy("sym").agg(F.count("*").alias("n")).join(F.broadcast(marginal.select("sym", F.col("n").alias("expected"))), "sym", "full_outer")


def occurrences(collection: DataFrame, patterns: DataFrame, key: str = "pattern") -> DataFrame:
    """(pattern, n): how often each pattern occurs: one equi-join with the strings' windows of all lengths among the patterns, one row for each of which is collected."""
    lengths = sorted(r.k for r in patterns.select(F.length(key).alias("k")).distinct().collect() if r.k)
    if not lengths:
        return patterns.select(key, F.lit(0).cast("long").alias("n")).distinct()
    own = patterns.select(key).distinct()
    cuts = F.concat(*(windows(F.col("seq"), k) for k in lengths)) if len(lengths) > 1 else windows(F.col("seq"), lengths[0])
    hits = collection.select(F.explode(cuts).alias(key)).join(own, key, "left_semi").groupBy(key).agg(F.count("*").alias("hits"))
    return own.join(hits, key, "left").select(key, F.coalesce("hits", F.lit(0)).cast("long").alias("n"))


def occurrences_by_source(collection: DataFrame, patterns: DataFrame, source: str, key: str = "pattern") -> DataFrame:
    """(source, pattern, n): occurrences of each pattern in each of several collections kept in one table, zeros included.

    Patterns of up to 31 of A, C, G and T meet the strings' windows as numbers, equal ones of a chunk added up before they are shuffled; others meet them as strings.
    """
    plain = F.length(key).between(1, P.MOST) & ~F.col(key).rlike("[^ACGT]")
    kinds = patterns.select(F.length(key).alias("k"), plain.alias("plain")).distinct().collect()
    short, lengths = (sorted(r.k for r in kinds if r.k and r.plain == x) for x in (True, False))
    own, sources = patterns.select(key).distinct(), collection.select(source).distinct()
    every = own.join(F.broadcast(sources))  # one row for each collection
    found = []
    if short:
        code = P.number(F.col(key)) + F.call_function("shiftleft", F.lit(1).cast("long"), (2 * F.length(key)).cast("int"))
        hits = P.windows_by_source(collection, short, source).join(own.where(plain).select(key, code.alias("code")), "code")
        found.append(hits.groupBy(source, key).agg(F.sum("n").alias("hits")))
    if lengths:
        cuts = F.concat(*(windows(F.col("seq"), k) for k in lengths)) if len(lengths) > 1 else windows(F.col("seq"), lengths[0])
        found.append(collection.select(source, F.explode(cuts).alias(key)).join(own.where(~plain), key, "left_semi").groupBy(source, key).agg(F.count("*").alias("hits")))
    if not found:
        return every.select(source, key, F.lit(0).cast("long").alias("n"))
    hits = found[0] if len(found) == 1 else found[0].unionAll(found[1])
    return every.join(hits, [source, key], "left").select(source, key, F.coalesce("hits", F.lit(0)).cast("long").alias("n"))


def _head_counts(collection: DataFrame, size: int) -> DataFrame:
    """(head, n): how often suffixes begin with the same `size` bases, or are the same shorter ones. Heads of A, C, G and T are counted as numbers."""
    packed = 0 < size <= P.MOST
    odd, tail = F.col("seq").rlike("[^ACGT]"), F.greatest(F.lit(1), F.length("seq") - size + 2)
    first = F.when(odd, 1).otherwise(tail) if packed else F.lit(1)
    rest = collection.select(F.explode(F.transform(F.sequence(first, F.length("seq") + 1), lambda i: F.substring("seq", i, F.lit(size)))).alias("head"))
    if packed:
        rest = rest.where((F.length("head") < size) | F.col("head").rlike("[^ACGT]"))
    counts = rest.groupBy("head").agg(F.count("*").alias("n"))
    return counts.unionAll(P.packed_counts(collection, size, seq_col="seq", both=False).select(P.shown(F.col("code"), size), "n")) if packed else counts


def intervals(collection: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, lo, n): the suffix-array interval of each pattern.

    Suffixes are counted by their first bases, as many as the longest pattern has, so equal ones are one row of the order. A pattern's interval lies between
    two marks in it: one before all that the pattern begins, one after.
    """
    own = patterns.select("pattern").where("pattern IS NOT NULL").distinct()
    longest = own.agg(F.max(F.length("pattern"))).first()[0] or 0
    counts = _head_counts(collection, longest).select(sort_key("head").alias("key"), F.lit(0).alias("kind"), "n", F.lit(None).cast("string").alias("pattern"))
    key, none = sort_key("pattern"), F.lit(0).cast("long")
    marks = [own.select(place.alias("key"), F.lit(kind).alias("kind"), none.alias("n"), "pattern") for kind, place in ((-1, key), (1, F.concat(key, F.lit("~"))))]
    sums = running_totals(counts.unionAll(marks[0]).unionAll(marks[1]), ["n"], "key", "kind", "pattern", keep=["pattern"]).where("pattern IS NOT NULL")
    found = F.when(F.length("pattern") > 0, F.max("n") - F.min("n")).otherwise(0)
    return sums.groupBy("pattern").agg(F.min("n").alias("lo"), found.alias("n"))


def rank_tallies(ranked: DataFrame) -> DataFrame:
    """(n, n_contained, n_dup) of a sequence_rank with its flags."""
    return ranked.agg(F.count("*").alias("n"), F.count_if("contained").alias("n_contained"), F.count_if("dup").alias("n_dup"))


def sequence_rank(collection: DataFrame, contained: DataFrame | None = None) -> DataFrame:
    """(rank, oriented_id, contained, dup): strings in lexicographic order; of equal strings all but the first are dup."""
    ranked = global_rank(collection.withColumn("key", sort_key("seq")), "key", "oriented_id")
    first = ranked.groupBy("key").agg(F.min("rank").alias("first"))
    out = ranked.join(first, "key").select("rank", "oriented_id", (F.col("rank") > F.col("first")).alias("dup"))
    if contained is None:
        return out
    flags = contained.select("oriented_id", F.lit(True).alias("contained")).distinct()
    return out.join(flags, "oriented_id", "left").select("rank", "oriented_id", F.coalesce("contained", F.lit(False)).alias("contained"), "dup")


def length_quantile(reads: DataFrame, quantile: float, seq_col: str = "s") -> DataFrame:
    """(q, len): the length at position int(n * q) of the sorted lengths, from the counts of each length."""
    counts = reads.groupBy(F.length(seq_col).alias("len")).agg(F.count("*").alias("n"))
    order = Window.orderBy("len")  # one row for each length
    placed = counts.select("len", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return placed.where(F.col("upto") > F.floor(F.col("total") * quantile)).groupBy().agg(F.min("len").cast("long").alias("len")).select(F.lit(quantile).alias("q"), "len")
