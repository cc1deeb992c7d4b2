"""Reads placed on contigs: full-length hits, coverage, insert sizes, breaking, mate links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import revcomp
from strandloom.operators.seeds import whole_candidates
from strandloom.session import cut_lineage

#: Bases of a contig's piece.
PIECE = 4096


def full_length_hits(contigs: DataFrame, reads: DataFrame, seed: int) -> DataFrame:
    """(contig, read_id, strand, beg, end): reads (read_id, seq) found whole in contigs (contig, seq), 0-based half-open.

    A join on a read's first `seed` bases, with longer pieces where many reads begin with them (seeds.py), verified on the rest, for both strands. Contigs are
    cut into pieces that overlap by the longest read, so candidates of a long contig meet a piece of it and no key holds it whole.
    """
    strands = reads.select("read_id", F.posexplode(F.array("seq", revcomp(F.col("seq")))).alias("strand", "seq")).where(F.length("seq") >= seed)
    longest = reads.agg(F.max(F.length("seq"))).first()[0] or 0
    step = max(PIECE, longest)
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / step).cast("int")), lambda j: F.struct((j * step).alias("from"), F.substring("seq", j * step + 1, F.lit(step + longest - 1)).alias("seq")))
    pieces = cut_lineage(contigs.where("length(seq) > 0").select("contig", F.explode(cuts).alias("x")).select("contig", "x.from", "x.seq"))
    found = whole_candidates(strands, pieces, seed, ["contig", "from"]).where(F.col("at") < step).select("contig", "from", "read_id", "strand", "at", "size")
    found = found.join(pieces.withColumnRenamed("seq", "piece"), ["contig", "from"]).select("contig", "read_id", "strand", (F.col("from") + F.col("at")).alias("beg"), "size", F.expr("substring(piece, at + 1, size)").alias("part"))
    turned = F.when(F.col("strand") == 0, F.col("seq")).otherwise(revcomp(F.col("seq")))
    return found.join(reads.select("read_id", "seq"), "read_id").where(F.col("part") == turned).select("contig", "read_id", "strand", "beg", (F.col("beg") + F.col("size")).alias("end"))


def read_places(hits: DataFrame) -> DataFrame:
    """(contig, beg, end) where reads lie whole: equal reads in one place are one, and so are a read and the reverse complement of another."""
    return hits.select("contig", "beg", "end").distinct()


def supporting_reads(hits: DataFrame) -> DataFrame:
    """(contig, n_supp): distinct reads in distinct places of a contig."""
    return read_places(hits).groupBy("contig").agg(F.count("*").alias("n_supp"))


def _paired_hits(hits: DataFrame, max_dist: int) -> DataFrame:
    """hits with pair, the forward read the hit is about (own or mate's), opened: where that one was last found before it, and paired.

    Along a contig, a forward hit opens and replaces what its read had open; a reverse hit nearer than max_dist to what its mate has open closes it. So of the reverse hits
    after one forward hit and before the next, the first near enough makes a pair.
    """
    forward = F.col("strand") == 0
    about = F.when(forward, F.col("read_id")).otherwise(F.col("read_id").bitwiseXOR(F.lit(1).cast("long")))
    rows = hits.withColumn("about", about).withColumn("reverse", ~forward)
    order = Window.partitionBy("contig", "about").orderBy("beg", "end", "reverse")
    rows = rows.withColumn("turn", F.count_if(forward).over(order)).withColumn("opened", F.last(F.when(forward, F.col("beg")), ignorenulls=True).over(order))
    near = F.coalesce(F.col("reverse") & (F.col("end") - F.col("opened") < max_dist), F.lit(False))
    rows = rows.withColumn("near", near)
    within = Window.partitionBy("contig", "about", "turn", "near").orderBy("beg", "end", "reverse")
    return rows.withColumn("paired", F.col("near") & (F.row_number().over(within) == 1))


def mate_pairs(hits: DataFrame, max_dist: int) -> DataFrame:
    """(contig, pair, beg, end): a forward hit and its mate's reverse hit after it, nearer than max_dist. Mates are reads 2p and 2p + 1; a hit is in one pair at most."""
    rows = _paired_hits(hits, max_dist).where("paired")
    return rows.select("contig", F.shiftright("read_id", 1).alias("pair"), F.col("opened").alias("beg"), "end")


def unpaired_hits(hits: DataFrame, max_dist: int) -> DataFrame:
    """(contig, read_id, beg, end): reverse hits that closed no pair, and of each read the last forward hit, if none closed it."""
    rows = _paired_hits(hits, max_dist)
    whole = Window.partitionBy("contig", "about")
    rows = rows.withColumn("closed", F.max("paired").over(Window.partitionBy("contig", "about", "turn"))).withColumn("turns", F.max("turn").over(whole))
    open_ = ~F.col("reverse") & (F.col("turn") == F.col("turns")) & ~F.col("closed")
    return rows.where(open_ | (F.col("reverse") & ~F.col("paired"))).select("contig", "read_id", "beg", "end")


def insert_stats(pairs: DataFrame) -> DataFrame:
    """(n, avg, std, cap): insert sizes; cap is int(avg + 2 std + 1.499). Without pairs all but n are null."""
    size = F.col("end") - F.col("beg")
    rows = pairs.agg(F.count("*").alias("n"), F.avg(size).alias("avg"), F.stddev_pop(size).alias("std"))
    return rows.withColumn("cap", F.floor(F.col("avg") + 2 * F.col("std") + 1.499))


def depth(spans: DataFrame, limit: int = 255) -> DataFrame:
    """(contig, beg, end, cov): runs of equal coverage above 0 of spans (contig, beg, end).

    Coverage is the running sum of starts less ends, so a deep position costs two rows for each span and nothing by length.
    """
    events = spans.where("end > beg").select("contig", F.explode(F.array(F.struct(F.col("beg").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy("contig", F.col("e.pos").alias("beg")).agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy("contig").orderBy("beg")
    rows = steps.select("contig", "beg", F.lead("beg").over(order).alias("end"), F.sum("d").over(order).alias("cov"))
    return rows.where("cov > 0").select("contig", "beg", "end", F.least("cov", F.lit(limit)).alias("cov"))


def paired_spans(pairs: DataFrame, skip: int) -> DataFrame:
    """The part of each pair that counts as paired coverage: without `skip` bases at both ends, turned around where they cross."""
    lo, hi = F.col("beg") + skip, F.col("end") - skip
    return pairs.select("contig", F.greatest(F.least(lo, hi), F.lit(0)).alias("beg"), F.greatest(lo, hi).alias("end"))


def break_contigs(contigs: DataFrame, runs: DataFrame, min_cov: int, skip: int) -> DataFrame:
    """(contig, part, beg, end): what is left of contigs (contig, seq) once positions of low paired coverage are cut out.

    A flank outside the first or last good position is cut only from 2 * skip bases on; a contig without a good position stays whole.
    """
    size = contigs.select("contig", F.length("seq").alias("len"))
    good = runs.where(F.col("cov") >= min_cov)
    order = Window.partitionBy("contig").orderBy("beg")
    joined = good.withColumn("new", F.coalesce(F.lag("end").over(order) != F.col("beg"), F.lit(True))).withColumn("grp", F.sum(F.col("new").cast("int")).over(order))
    parts = joined.groupBy("contig", "grp").agg(F.min("beg").alias("beg"), F.max("end").alias("end"))
    rows = size.join(parts, "contig", "left")
    whole = Window.partitionBy("contig")
    rows = rows.withColumn("first", F.min("beg").over(whole)).withColumn("last", F.max("end").over(whole))
    beg = F.when(F.col("beg").isNull(), 0).when((F.col("beg") == F.col("first")) & (F.col("first") < 2 * skip), 0).otherwise(F.col("beg"))
    end = F.when(F.col("end").isNull(), F.col("len")).when((F.col("end") == F.col("last")) & (F.col("len") - F.col("last") < 2 * skip), F.col("len")).otherwise(F.least("end", "len"))
    return rows.select("contig", beg.alias("beg"), end.alias("end")).select("contig", F.row_number().over(order).alias("part"), "beg", "end")


def end_reads(places: DataFrame, max_dist: int) -> DataFrame:
    """(read_id, end_id, dist) of reads that point at a contig end.

    places: (contig, len, read_id, strand, beg, end) of reads whose mates aren't on the same contig. A forward read
    points at the right end (2 * contig + 1) from len - beg away, a reverse one at the left end (2 * contig) from end away. Reads
    placed twice and reads farther than max_dist are left out.
    """
    once = places.withColumn("n", F.count("*").over(Window.partitionBy("read_id"))).where("n = 1")
    spot = F.when(F.col("strand") == 0, F.col("contig") * 2 + 1).otherwise(F.col("contig") * 2)
    away = F.when(F.col("strand") == 0, F.col("len") - F.col("beg")).otherwise(F.col("end"))
    return once.select(F.col("read_id"), spot.alias("end_id"), away.cast("long").alias("dist")).where(F.col("dist") <= max_dist)


def mate_links(places: DataFrame, max_dist: int) -> DataFrame:
    """(end_a, end_b, n, total): read pairs that tie two contig ends; places are those of end_reads."""
    ends = end_reads(places, max_dist)
    mate = ends.select(F.col("read_id").bitwiseXOR(F.lit(1).cast("long")).alias("read_id"), F.col("end_id").alias("end_b"), F.col("dist").alias("dist_b"))
    links = ends.join(mate, "read_id").where(F.floor(F.col("end_id") / 2) != F.floor(F.col("end_b") / 2))
    return links.groupBy(F.col("end_id").alias("end_a"), "end_b").agg(F.count("*").alias("n"), F.sum(F.col("dist") + F.col("dist_b")).alias("total"))


def best_links(links: DataFrame, keep: int = 2) -> DataFrame:
    """The best `keep` partners of each end by number and then distance, with rank and mean distance."""
    order = Window.partitionBy("end_a").orderBy(F.desc("n"), F.desc("total"), "end_b")
    rows = links.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return rows.select("end_a", "end_b", "n", F.floor(F.col("total") / F.col("n") + 0.499).alias("avg_dist"), "rank")


def reciprocal_best(best: DataFrame, min_n: int = 5) -> DataFrame:
    """(end_a, end_b, n, avg_dist): ends that are each other's best, with min_n pairs; second bests have fewer than min_n and a fifth at most."""
    first = best.where("rank = 1")
    back = first.select(F.col("end_a").alias("end_b"), F.col("end_b").alias("end_a"))
    second = best.where("rank = 2").select(F.col("end_a").alias("end"), F.col("n").alias("n2"))
    rows = first.join(back, ["end_a", "end_b"]).where((F.col("end_a") < F.col("end_b")) & (F.col("n") >= min_n))
    for side in ("end_a", "end_b"):
        own = second.withColumnRenamed("end", side).withColumnRenamed("n2", f"n2_{side}")
        rows = rows.join(own, side, "left")
        n2 = F.coalesce(f"n2_{side}", F.lit(0))
        rows = rows.where((n2 < min_n) & (n2 / F.col("n") < 0.2))
    return rows.select("end_a", "end_b", "n", "avg_dist")


def resolve_contained(best: DataFrame, contigs: DataFrame, avg: float, std: float) -> DataFrame:
    """best_links without those that a contig between their ends explains.

    A contig (contig, len) with one partner on each end lies between these two ends where they also have each other as first or second partner, each has
    a second one, and the gap between them, avg less their mean distance, is that over the contig within std. Their link goes and the other one of each is its best.
    """
    only = best.withColumn("n_partners", F.count("*").over(Window.partitionBy("end_a"))).where("n_partners = 1")
    left, right = (only.where(F.col("end_a") % 2 == s).select(F.floor(F.col("end_a") / 2).alias("contig"), F.col("end_b").alias(f"e{s}"), F.col("avg_dist").alias(f"d{s}")) for s in (0, 1))
    between = left.join(right, "contig").join(contigs.select("contig", "len"), "contig")
    links = best.select(F.col("end_a").alias("e0"), F.col("end_b").alias("e1"), F.col("avg_dist").alias("over"))
    found = between.join(links, ["e0", "e1"]).join(links.select(F.col("e0").alias("e1"), F.col("e1").alias("e0")), ["e0", "e1"], "left_semi")
    two = best.where("rank = 2").select(F.col("end_a").alias("end"))
    for end in ("e0", "e1"):
        found = found.join(two.withColumnRenamed("end", end), end, "left_semi")
    whole = lambda x: x.cast("long")
    long_, short = whole(avg - F.col("over") + 0.499), whole(2 * avg - F.col("d0") - F.col("d1") + F.col("len") + 0.499)
    gone = found.where(F.abs(long_ - short) < std).select("e0", "e1")
    gone = gone.unionAll(gone.select(F.col("e1").alias("e0"), F.col("e0").alias("e1"))).distinct().select(F.col("e0").alias("end_a"), F.col("e1").alias("end_b"))
    kept = best.join(gone, ["end_a", "end_b"], "left_anti")
    freed = gone.select("end_a", F.lit(True).alias("freed")).distinct()
    return kept.join(freed, "end_a", "left").select("end_a", "end_b", "n", "avg_dist", F.when(F.col("freed"), 1).otherwise(F.col("rank")).alias("rank"))


def length_stats(lengths: DataFrame, column: str = "len") -> DataFrame:
    """(n, total, n50). Running sums go over one row for each length."""
    groups = lengths.groupBy(F.col(column).alias("len")).agg(F.count("*").alias("k"))
    order = Window.orderBy(F.desc("len"))
    upto = groups.select("len", F.sum(F.col("len") * F.col("k")).over(order).alias("upto"))
    total = groups.agg(F.sum("k").alias("n"), F.sum(F.col("len") * F.col("k")).alias("total"))
    return upto.crossJoin(F.broadcast(total)).where(F.col("upto") * 2 >= F.col("total")).groupBy("n", "total").agg(F.max("len").alias("n50"))
