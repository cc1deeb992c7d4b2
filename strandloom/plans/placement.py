"""Queries over placed reads, links, correction, statistics and text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import coverage as C
from strandloom.operators import scaffold as S
from strandloom.operators.correct import correct_reads
from strandloom.operators.kmers import next_base_table
from strandloom.plans.fixtures import duck, fixture
from strandloom.sources import graph_text as X

QUERIES, ORACLES = {}, {}
G, HP, E, VERTICES = (duck(n) for n in ("G", "HP", "E", "VERTICES"))
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _reads(spark, d):
    ends = F.array(F.struct(F.lit(0).alias("e"), F.col("r1").alias("seq")), F.struct(F.lit(1).alias("e"), F.col("r2").alias("seq")))
    return fixture(spark, d, "HP").select("pid", F.explode(ends).alias("x")).select((F.col("pid") * 2 + F.col("x.e")).alias("read_id"), "x.seq")


def _contigs(spark, d):
    return fixture(spark, d, "G").select(F.col("id").alias("contig"), F.col("s").alias("seq"))


def _hits(spark, d):
    return C.full_length_hits(_contigs(spark, d), _reads(spark, d), 31)


@query("full_length_hits", f"SELECT id AS contig, pid * 2 AS read_id, 0 AS strand, 4 * w AS beg, 4 * w + 40 AS stop FROM ({HP}) p UNION ALL SELECT id, pid * 2 + 1, 1, 60 + 4 * w, 100 + 4 * w FROM ({HP}) p2")
def full_length_hits(spark, d):
    return _hits(spark, d).select("contig", "read_id", "strand", F.col("beg").cast("long").alias("beg"), F.col("end").cast("long").alias("stop"))


@query("insert_stats", f"SELECT count(*) AS n, 100.0::DOUBLE AS avg, 0.0::DOUBLE AS std, 101::BIGINT AS cap FROM ({HP}) p")
def insert_stats(spark, d):
    return C.insert_stats(C.mate_pairs(_hits(spark, d), 1000))


def _positions(runs):
    return runs.select("contig", F.explode(F.sequence(F.col("beg").cast("long"), F.col("end").cast("long") - 1)).alias("pos"), "cov")


@query("coverage", f"SELECT id AS contig, pos, count(*) AS cov FROM (SELECT id, unnest(generate_series(4 * w, 4 * w + 39)) AS pos FROM ({HP}) p UNION ALL SELECT id, unnest(generate_series(60 + 4 * w, 99 + 4 * w)) FROM ({HP}) p2) x GROUP BY 1, 2")
def coverage(spark, d):
    return _positions(C.depth(C.read_places(_hits(spark, d))))


@query("pair_coverage", f"SELECT id AS contig, pos, count(*) AS cov FROM (SELECT id, unnest(generate_series(4 * w + 10, 4 * w + 89)) AS pos FROM ({HP}) p) x GROUP BY 1, 2")
def pair_coverage(spark, d):
    return _positions(C.depth(C.paired_spans(C.mate_pairs(_hits(spark, d), 1000), 10)))


@query("break_contigs", f"SELECT id AS contig, 1 AS part, 0 AS beg, 102 AS stop FROM ({G}) g")
def break_contigs(spark, d):
    runs = C.depth(C.paired_spans(C.mate_pairs(_hits(spark, d), 1000), 10))
    return C.break_contigs(_contigs(spark, d), runs, 2, 10).withColumnRenamed("end", "stop")


@query(
    "equal_reads",
    f"SELECT id AS contig, pos, cov, n_supp FROM (SELECT id, pos, count(*) AS cov FROM (SELECT id, unnest(generate_series(4 * w, 4 * w + 39)) AS pos FROM ({HP}) p UNION ALL SELECT id, unnest(generate_series(60 + 4 * w, 99 + 4 * w)) FROM ({HP}) p2) x GROUP BY 1, 2) c JOIN (SELECT id, 2 * count(*) AS n_supp FROM ({HP}) p3 GROUP BY 1) n USING (id)",
)
def equal_reads(spark, d):
    """Depth and support of contigs where each read comes three times, once as its reverse complement: as much as of one copy."""
    from strandloom.session import cut_lineage

    reads = _reads(spark, d)
    turned = F.reverse(F.translate("seq", "ACGT", "TGCA"))
    copies = F.array(*(F.struct((F.col("read_id") * 3 + k).alias("read_id"), seq.alias("seq")) for k, seq in enumerate((F.col("seq"), F.col("seq"), turned))))
    three = reads.select(F.explode(copies).alias("x")).select("x.*")
    hits = cut_lineage(C.full_length_hits(_contigs(spark, d), three, 31))
    return _positions(C.depth(C.read_places(hits))).join(C.supporting_reads(hits), "contig")


#: Contigs with a stretch twice: what comes first again at the end, or at the start once more.
TWICE = "SELECT id AS contig, CASE WHEN id % 2 = 0 THEN concat(s, substr(s, 1, 100)) ELSE concat(substr(s, 1, 60), s) END AS seq FROM {g}"


@query(
    "pairs_over_repeat",
    f"SELECT id AS contig, pid AS pair, CASE WHEN id % 2 = 0 THEN 4 * w ELSE 60 + 4 * w END AS beg, CASE WHEN id % 2 = 0 THEN 100 + 4 * w ELSE 160 + 4 * w END AS stop FROM ({HP}) p UNION ALL SELECT id, pid, 128, 228 FROM ({HP}) p2 WHERE id % 2 = 0 AND w = 0",
)
def pairs_over_repeat(spark, d):
    """Pairs on contigs where one or both mates lie twice: a reverse hit takes the last forward hit before it, and each once."""
    contigs = spark.sql(TWICE, g=fixture(spark, d, "G"))
    return C.mate_pairs(C.full_length_hits(contigs, _reads(spark, d), 31), 1000).withColumnRenamed("end", "stop")


def _halves(spark, d):
    parts = F.array(F.struct(F.lit(0).alias("h"), F.substring("s", 1, 58).alias("seq")), F.struct(F.lit(1).alias("h"), F.substring("s", 61, 68).alias("seq")))
    return fixture(spark, d, "G").select("id", F.explode(parts).alias("x")).select((F.col("id") * 2 + F.col("x.h")).alias("contig"), "x.seq")


def _links(spark, d):
    halves = _halves(spark, d)
    places = C.full_length_hits(halves, _reads(spark, d), 31).join(halves.select("contig", F.length("seq").alias("len")), "contig")
    return C.best_links(C.mate_links(places, 1000))


LINK = f"SELECT id * 4 + 1 AS x, id * 4 + 2 AS y FROM ({G}) g"


@query("links_top2", f"SELECT x AS end_a, y AS end_b, 5::BIGINT AS n, 98::BIGINT AS avg_dist, 1 AS rank FROM ({LINK}) l UNION ALL SELECT y, x, 5::BIGINT, 98::BIGINT, 1 FROM ({LINK}) l2")
def links_top2(spark, d):
    return _links(spark, d)


@query("reciprocal_best", f"SELECT x AS end_a, y AS end_b, 5::BIGINT AS n, 98::BIGINT AS avg_dist FROM ({LINK}) l")
def reciprocal_best(spark, d):
    return C.reciprocal_best(_links(spark, d))


@query("scaftigs", f"SELECT concat(substr(s, 1, 58), 'NN', substr(s, 61, 68)) AS seq, 2::BIGINT AS n_unitigs FROM ({G}) g")
def scaftigs(spark, d):
    return S.scaftigs(_halves(spark, d), C.reciprocal_best(_links(spark, d)), 100).select("seq", "n_unitigs")


@query("patched_scaftigs", f"SELECT least(s, {RC.format('s')}) AS seq, 2::BIGINT AS n_unitigs FROM ({G}) g")
def patched_scaftigs(spark, d):
    """Half genomes joined through the bases that neither holds, which the reads around the gap give."""
    from strandloom.operators.patching import patch_gaps
    from strandloom.session import cut_lineage

    halves = cut_lineage(_halves(spark, d))
    ends = F.array(F.struct(F.lit(0).alias("e"), F.col("r1").alias("seq")), F.struct(F.lit(1).alias("e"), F.col("r2").alias("seq")))
    reads = cut_lineage(fixture(spark, d, "DP").select("pid", F.explode(ends).alias("x")).select((F.col("pid") * 2 + F.col("x.e")).alias("read_id"), "x.seq"))
    places = cut_lineage(C.full_length_hits(halves, reads, 31).join(halves.select("contig", F.length("seq").alias("len")), "contig"))
    links = cut_lineage(C.reciprocal_best(C.best_links(C.mate_links(places, 1000))))
    patches = patch_gaps(links, halves, C.end_reads(places, 1000), reads, 92.0, 10.0, 58, 40)
    found = S.scaftigs(halves, links.join(patches.drop("p"), ["end_a", "end_b"], "left"), 100)
    return found.select(F.least("seq", F.reverse(F.translate("seq", "ACGT", "TGCA"))).alias("seq"), "n_unitigs")


@query(
    "overlap_scaftigs",
    f"SELECT CASE WHEN id % 3 = 0 THEN concat(substr(s, 1, 74), translate(substr(s, 75, 1), 'ACGT', 'CGTA'), substr(s, 76)) ELSE s END AS seq, 2::BIGINT AS n_unitigs FROM ({G}) g WHERE id % 3 < 2 UNION ALL SELECT substr(s, 1, 75), 1::BIGINT FROM ({G}) g2 WHERE id % 3 = 2 UNION ALL SELECT reverse(substr(s, 56, 73)), 1::BIGINT FROM ({G}) g3 WHERE id % 3 = 2",
)
def overlap_scaftigs(spark, d):
    """Two parts of each genome that overlap by twenty bases but for the left one's last, or the right one's first, or not at all, by turns; no read lies between them."""
    from strandloom.operators.patching import overlap_patches

    turn = F.col("id") % 3
    other = lambda at: F.translate(F.substring("s", at, 1), "ACGT", "CGTA")
    left = F.when(turn == 0, F.concat(F.substring("s", 1, 74), other(75))).otherwise(F.substring("s", 1, 75))
    right = F.when(turn == 1, F.concat(other(56), F.substring("s", 57, 72))).when(turn == 2, F.reverse(F.substring("s", 56, 73))).otherwise(F.substring("s", 56, 73))
    g = fixture(spark, d, "G")
    contigs = g.select(F.explode(F.array(*(F.struct((F.col("id") * 2 + k).alias("contig"), s.alias("seq")) for k, s in enumerate((left, right))))).alias("x")).select("x.*")
    links = g.select((F.col("id") * 4 + 1).alias("end_a"), (F.col("id") * 4 + 2).alias("end_b"), F.lit(120).cast("long").alias("avg_dist"))
    distances = links.select("end_a", "end_b", F.explode(F.array(F.lit(116), F.lit(120), F.lit(124))).alias("dist"))
    patches = overlap_patches(links, contigs, distances, 100.0, 10.0, 58, 40)
    return S.scaftigs(contigs, links.join(patches.drop("p"), ["end_a", "end_b"], "left"), 100, patched_only=True).select("seq", "n_unitigs")


@query("reads_to_scaftigs", f"SELECT least(x, {RC.format('x')}) AS seq, 2::BIGINT AS n_unitigs, 30::BIGINT AS nsr FROM (SELECT substr(s, 1, 123) AS x FROM ({G}) g) h")
def reads_to_scaftigs(spark, d):
    """Pairs in one call to scaftigs: the first and the second mates of a genome give a contig each, and both overlap by fewer bases than unitigs ask for."""
    from strandloom.operators.whole_run import Rules, reads_to_scaftigs

    ends = F.array(F.struct(F.lit(0).alias("e"), F.col("r1").alias("s")), F.struct(F.lit(1).alias("e"), F.col("r2").alias("s")))
    reads = fixture(spark, d, "DP").select("pid", F.explode(ends).alias("x")).select((F.col("pid") * 2 + F.col("x.e")).alias("rid"), "x.s")
    rules = Rules(min_overlap=31, correct=False, cleaning=(), insert=(92.0, 10.0), min_a=None, skip=5)
    found = reads_to_scaftigs(reads, rules)
    return found.select(F.least("seq", F.reverse(F.translate("seq", "ACGT", "TGCA"))).alias("seq"), "n_unitigs", "nsr")


SURE = f"SELECT id * 2 + h AS contig, CASE WHEN (id + h) % 5 = 0 THEN 19.5 ELSE 25.0 END AS a, 3 + id % 4 + h AS nsr, id FROM ({G}) g, (SELECT unnest([0, 1]) AS h) u"


@query(
    "scaftigs_sure",
    f"WITH c AS ({SURE}), joined AS (SELECT id FROM c GROUP BY id HAVING min(a) >= 20 AND id % 7 <> 3) SELECT concat(substr(s, 1, 58), 'NN', substr(s, 61, 68)) AS seq, 2::BIGINT AS n_unitigs, (SELECT CAST(sum(nsr) AS BIGINT) FROM c WHERE c.id = g.id) AS nsr FROM ({G}) g WHERE id IN (SELECT id FROM joined) "
    f"UNION ALL SELECT CASE WHEN contig % 2 = 0 THEN substr(s, 1, 58) ELSE substr(s, 61, 68) END, 1::BIGINT, CAST(nsr AS BIGINT) FROM c JOIN ({G}) g USING (id) WHERE id NOT IN (SELECT id FROM joined)",
)
def scaftigs_sure(spark, d):
    """Joined only where both contigs are surely there once and the link agrees with the insert size."""
    halves = _halves(spark, d)
    i, h = F.floor(F.col("contig") / 2), F.col("contig") % 2
    contigs = halves.withColumn("a", F.when((i + h) % 5 == 0, 19.5).otherwise(25.0)).withColumn("nsr", 3 + i % 4 + h)
    links = C.reciprocal_best(_links(spark, d)).withColumn("p", F.when(F.floor(F.col("end_a") / 4) % 7 == 3, 1e-21).otherwise(0.5))
    return S.scaftigs(contigs, links, 100)


@query("supporting_reads", f"SELECT id AS contig, 2 * count(*) AS n_supp FROM ({HP}) p GROUP BY 1")
def supporting_reads(spark, d):
    return C.supporting_reads(_hits(spark, d))


#: The mean of a normal insert size (500, 50), each size weighted by how much it exceeds a limit, by Simpson's rule up to ten deviations.
MEANS = """SELECT lim, sum(w * x * (x - lim) * exp(-power((x - 500) / 50, 2) / 2)) / sum(w * (x - lim) * exp(-power((x - 500) / 50, 2) / 2)) AS mean FROM (
  SELECT lim, lim + i * (1000 - lim) / 4000 AS x, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM (SELECT DISTINCT CAST(lim AS DOUBLE) AS lim FROM limits) l, (SELECT unnest(generate_series(0, 4000)) AS i) k) z GROUP BY lim"""
LINKS_SQL = "SELECT l_orderkey AS end_a, l_linenumber % 2 AS end_b, CAST(l_quantity * 8 AS BIGINT) AS dist, CAST(l_orderkey % 5 AS BIGINT) * 6 - 12 AS patch FROM {lineitem}"


@query(
    "link_p_values",
    f"WITH d AS ({LINKS_SQL.format(lineitem='lineitem')}), limits AS (SELECT DISTINCT 300 + patch AS lim FROM d), m AS ({MEANS}), g AS (SELECT end_a, end_b, count(*) AS n, avg(dist) AS mean, var_pop(dist) AS var, max(patch) AS patch FROM d GROUP BY 1, 2 HAVING count(*) >= 2), "
    "t AS (SELECT end_a, end_b, n, abs(g.mean + patch - m.mean) / sqrt(greatest(var, 1e-9) / (n - 1)) AS t FROM g JOIN m ON m.lim = 300 + patch), "
    "u AS (SELECT *, n - 1 AS df, t / sqrt(n - 1 + t * t) AS s, sqrt((n - 1) / (n - 1 + t * t)) AS c, atan(t / sqrt(n - 1)) AS h FROM t) "
    "SELECT end_a, end_b, n, round(1 - CASE df WHEN 1 THEN 2 / pi() * h WHEN 2 THEN s WHEN 3 THEN 2 / pi() * (h + s * c) WHEN 4 THEN s * (1 + c * c / 2) WHEN 5 THEN 2 / pi() * (h + s * (c + 2 * c ** 3 / 3)) "
    "WHEN 6 THEN s * (1 + c * c / 2 + 3 * c ** 4 / 8) WHEN 7 THEN 2 / pi() * (h + s * (c + 2 * c ** 3 / 3 + 8 * c ** 5 / 15)) WHEN 8 THEN s * (1 + c * c / 2 + 3 * c ** 4 / 8 + 5 * c ** 6 / 16) "
    "WHEN 9 THEN 2 / pi() * (h + s * (c + 2 * c ** 3 / 3 + 8 * c ** 5 / 15 + 16 * c ** 7 / 35)) WHEN 10 THEN s * (1 + c * c / 2 + 3 * c ** 4 / 8 + 5 * c ** 6 / 16 + 35 * c ** 8 / 128) "
    "WHEN 11 THEN 2 / pi() * (h + s * (c + 2 * c ** 3 / 3 + 8 * c ** 5 / 15 + 16 * c ** 7 / 35 + 128 * c ** 9 / 315)) WHEN 12 THEN s * (1 + c * c / 2 + 3 * c ** 4 / 8 + 5 * c ** 6 / 16 + 35 * c ** 8 / 128 + 63 * c ** 10 / 256) END, 6) AS p FROM u",
)
def link_p_values(spark, d):
    """Links of a few pairs, for which Student's distribution has a closed form."""
    from strandloom.session import table

    rows = spark.sql(LINKS_SQL, lineitem=table(spark, d, "lineitem"))
    return S.link_p_values(rows, 500.0, 50.0, 150).select("end_a", "end_b", "n", F.round("p", 6).alias("p"))


@query("n50", f"SELECT n, total, n50 FROM (SELECT count(*) AS n, CAST(sum(len) AS BIGINT) AS total FROM ({VERTICES}) v) a, (SELECT max(len) AS n50 FROM (SELECT len, sum(len) OVER (ORDER BY len DESC) AS upto, sum(len) OVER () AS t FROM ({VERTICES}) v) w WHERE upto * 2 >= t) b")
def n50(spark, d):
    return C.length_stats(fixture(spark, d, "VERTICES"))


@query("beta_pvalue", "SELECT p_partkey AS x, round(2 * atan(1.0 / (p_size / 10.0)) / pi(), 6) AS p FROM part")
def beta_pvalue(spark, d):
    """With one degree of freedom, Student's t is Cauchy's distribution, whose P-value is an arc tangent."""
    from strandloom.session import table

    return table(spark, d, "part").select(F.col("p_partkey").alias("x"), F.round(S.student_p_column(F.col("p_size") / 10.0, F.lit(1.0)), 6).alias("p"))


@query("mean_correct", f"WITH v AS ({VERTICES}), limits AS (SELECT maxo * 10 AS lim FROM v), m AS ({MEANS}) SELECT id, round(mean, 6) AS mean FROM v JOIN m ON m.lim = v.maxo * 10")
def mean_correct(spark, d):
    return fixture(spark, d, "VERTICES").select("id", F.round(S.truncated_mean_column(F.lit(500.0), F.lit(50.0), F.col("maxo").cast("double") * 10), 6).alias("mean"))


@query("correct_reads")
def correct(spark, d):
    """Dense reads against their own 17-mers; tests hold the result against the error-free reads."""
    reads = fixture(spark, d, "E")
    return correct_reads(reads, next_base_table(reads, 17), 17).select("read_id", "seq", "n_changed", "difference", "bad")


SAM = "SELECT o_orderkey AS k, o_custkey % 40 AS i, o_orderkey % 7 AS dl FROM {o}"
CIGAR = "concat(cast(5 + i AS varchar(9)), 'S100M', cast(1 + i AS varchar(9)), 'I80M', cast(1 + dl AS varchar(9)), 'D20M')"


@query("sam_identity", f"SELECT concat('q', CAST(k AS VARCHAR)) AS qname, round((q + d - nm) / (q + d), 6) AS with_gaps, round((q - ins - (nm - ins - d)) / (q - ins), 6) AS without_gaps FROM (SELECT k, CAST(200 + 1 + i AS DOUBLE) AS q, 1 + i AS ins, 1 + dl AS d, 1 + i + 1 + dl + 3 AS nm FROM ({SAM.format(o='orders')}) s) x")
def sam_identity(spark, d):
    from strandloom.session import table

    rows = spark.sql(SAM, o=table(spark, d, "orders"))
    fields = ["concat('q', k)", "'0'", "'chr1'", "'100'", "'60'", CIGAR, "'*'", "'0'", "'0'", "'*'", "'*'", "concat('NM:i:', 1 + i + 1 + dl + 3)"]
    lines = rows.select(F.concat_ws("\t", *(F.expr(f) for f in fields)).alias("value"))
    return X.identities(X.parse_sam(lines)).select("qname", F.round("with_gaps", 6).alias("with_gaps"), F.round("without_gaps", 6).alias("without_gaps"))


#: Two mapped parts of each order as a contig: (k, part, chromosome, place, strand, mapping quality, clip, length).
PARTS = """SELECT o_orderkey AS k, e AS part, (o_orderkey + e * (o_orderkey % 3)) % 2 AS chr, 1000 + o_custkey * 10 + e * (200 + (o_orderkey * 7) % 900) AS pos, CASE WHEN o_orderkey % 11 = e THEN 16 ELSE 0 END AS flag,
  5 + (o_orderkey * (3 + e)) % 40 AS mapq, e * (60 + (o_orderkey * 5) % 500) AS clip, 90 + (o_orderkey * (2 + e)) % 600 AS len FROM (SELECT o_orderkey, o_custkey, [U]([SEQ](0, 1)) AS e FROM {o}) x"""
BREAK_SQL = """WITH p AS ({parts}), c AS (SELECT *, CASE WHEN flag = 16 THEN 7 ELSE clip END AS beg FROM p WHERE clip + 7 + len >= 150), n AS (SELECT k, count(*) AS n FROM c GROUP BY 1),
  a AS (SELECT k, max(CASE WHEN part = 0 THEN c END) AS x, max(CASE WHEN part = 1 THEN c END) AS y FROM (SELECT k, part, c FROM c) z GROUP BY 1),
  d AS (SELECT a.k, n.n, x, y, n.n = 2 AND least(x.beg + x.len, y.beg + y.len) - greatest(x.beg, y.beg) > y.len * 0.5 AS lost FROM a JOIN n USING (k)),
  kept AS (SELECT k, n, unnest(CASE WHEN n = 1 THEN [coalesce(x, y)] WHEN lost THEN [x] ELSE [x, y] END) AS r, lost FROM d),
  b AS (SELECT k, n, bool_or(lost) AS lost, count(*) AS c0, count(*) FILTER (r.mapq >= 10) AS c1, count(*) FILTER (r.mapq >= 10 AND r.len >= 100) AS c2, count(*) FILTER (r.mapq >= 10 AND r.len >= 200) AS c3, count(*) FILTER (r.mapq >= 10 AND r.len >= 500) AS c4, sum(r.len) AS mapped FROM kept GROUP BY 1, 2),
  o AS (SELECT k, CASE WHEN swap THEN y ELSE x END AS f, CASE WHEN swap THEN x ELSE y END AS g FROM (SELECT *, y.chr < x.chr OR (y.chr = x.chr AND y.pos < x.pos) AS swap FROM d WHERE n = 2 AND NOT lost) s),
  j AS (SELECT k, f.chr = g.chr AND f.flag = g.flag AND abs(g.pos - f.pos - f.len) < 500 AND abs(g.clip - f.clip - f.len) < 500 AS joined, g.clip + g.len - f.clip AS len, g.mapq AS mapq FROM o)
SELECT concat('q', CAST(k AS VARCHAR)) AS qname, c0 AS kept, CAST(lost AS BIGINT) AS dropped, CAST(mapped AS BIGINT) AS mapped, {b}, {g} FROM b LEFT JOIN j USING (k)"""
_B = ", ".join(f"CASE WHEN n = 2 THEN greatest(c{i} - 1, 0) ELSE 0 END AS b{i}" for i in range(5))
_G = ", ".join(f"CASE WHEN coalesce(joined, false) OR c0 < 2 THEN 0 ELSE greatest(c{i} - 1, 0) END AS g{i}" for i in range(5))


@query("contig_breaks", BREAK_SQL.format(parts=PARTS.format(o="orders").replace("[U]", "unnest").replace("[SEQ]", "generate_series"), b=_B, g=_G))
def contig_breaks(spark, d):
    from strandloom.session import table

    rows = spark.sql(PARTS.replace("[U]", "explode").replace("[SEQ]", "sequence"), o=table(spark, d, "orders"))
    cigar = F.concat(F.when(F.col("clip") > 0, F.concat(F.col("clip").cast("string"), F.lit("S"))).otherwise(""), F.col("len").cast("string"), F.lit("M7S"))
    line = F.concat_ws("\t", F.concat(F.lit("q"), "k"), F.col("flag").cast("string"), F.concat(F.lit("chr"), "chr"), F.col("pos").cast("string"), F.col("mapq").cast("string"), cigar, F.lit("*\t0\t0\t*\t*"))
    return X.contig_breaks(rows.select((F.col("k") * 2 + F.col("part")).alias("ord"), line.alias("value")))


@query("remap_roundtrip", f"SELECT concat(CAST(4 * id + 2 * h AS VARCHAR), ':', CAST(4 * id + 2 * h + 1 AS VARCHAR)) AS name, 2 * pid + h AS read_id, greatest(4 * w - 4, 0) AS beg, 4 * w + 36 AS stop FROM ({HP}) p, (SELECT unnest([0, 1]) AS h) u")
def remap_roundtrip(spark, d):
    """Hits on half genomes written as remapped FASTQ to the shared folder and read back: places of reads whose mates lie elsewhere, once the ends that one read covers are cut off."""
    from strandloom.session import shared_path
    from strandloom.sources.fastx import read_fastq

    halves, path = _halves(spark, d), shared_path(spark, "remapped")
    hits = C.full_length_hits(halves, _reads(spark, d), 31)
    contigs = halves.select("contig", F.concat((F.col("contig") * 2).cast("string"), F.lit(":"), (F.col("contig") * 2 + 1).cast("string")).alias("name"), "seq", F.lit(".\t.").alias("rest"))
    X.remapped_text(contigs, hits, 1000).write.text(path)
    return X.parse_remapped(read_fastq(spark, path))[1].withColumnRenamed("end", "stop")


#: Three contigs of each genome, A - P - B, with links A-P, P-B and A-B whose distances may or may not agree: (end, partner, pairs, mean distance, rank).
TRIPLES = """SELECT id, 6 * id + 1 AS a, 6 * id + 2 AS p0, 6 * id + 3 AS p1, 6 * id + 4 AS b, 60 + id % 40 AS len, 200 + (id * 7) % 150 AS d1, 220 + (id * 11) % 130 AS d2, 100 + (id * 13) % 300 AS d3, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS r FROM {g}"""
LINK_ROWS = " UNION ALL ".join(
    f"SELECT {x} AS end_a, {y} AS end_b, CAST({n} AS BIGINT) AS n, CAST({dist} AS BIGINT) AS avg_dist, {rank} AS rank FROM t"
    for x, y, n, dist, rank in (("p0", "a", 9, "d1", "1"), ("p1", "b", 9, "d2", "1"), ("a", "p0", 9, "d1", "3 - r"), ("b", "p1", 9, "d2", "3 - r"), ("a", "b", "12 - 5 * (r - 1)", "d3", "r"), ("b", "a", "12 - 5 * (r - 1)", "d3", "r"))
)


@query(
    "resolve_contained",
    f"WITH t AS ({TRIPLES.format(g=f'({G}) g')}), links AS ({LINK_ROWS}), hit AS (SELECT * FROM t WHERE abs(CAST(trunc(500 - d3 + 0.499) AS BIGINT) - CAST(trunc(1000 - d1 - d2 + len + 0.499) AS BIGINT)) < 50) "
    "SELECT end_a, end_b, links.n, avg_dist, CASE WHEN end_a IN (SELECT a FROM hit UNION ALL SELECT b FROM hit) THEN 1 ELSE rank END AS rank FROM links WHERE NOT ((end_a, end_b) IN (SELECT (a, b) FROM hit) OR (end_b, end_a) IN (SELECT (a, b) FROM hit))",
)
def resolve_contained(spark, d):
    g = spark.sql(TRIPLES, g=fixture(spark, d, "G"))
    links = spark.sql(LINK_ROWS.replace("FROM t", "FROM {t}"), t=g)
    return C.resolve_contained(links, g.select(F.floor(F.col("p0") / 2).alias("contig"), "len"), 500.0, 50.0)
