"""Queries over overlaps, graphs, alignments, coverage and scaffolds."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import graph as Gr
from strandloom.operators import overlaps as O
from strandloom.operators.align import align
from strandloom.operators import assembly as A
from strandloom.operators.cleaning import Cleaning, clean, merge_graph, pop_bubbles, pop_open, simplify_bubbles
from strandloom.operators.matches import all_matches, smem
from strandloom.operators.suffixes import both_strands
from strandloom.plans.fixtures import duck, fixture
from strandloom.session import cut_lineage, shared_path
from strandloom.sources.graph_text import mag_text, read_asqg, read_mag

QUERIES, ORACLES = {}, {}
H, G, EDGES, VERTICES, R = (duck(n) for n in ("H", "G", "EDGES", "VERTICES", "R"))
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


BOTH = f"(SELECT rid * 2 AS oid, s AS seq FROM ({H}) h1 UNION ALL SELECT rid * 2 + 1, {RC.format('s')} FROM ({H}) h2)"
OVL = f"""SELECT a, b, CAST(60 - pos + 1 AS INT) AS ovlp FROM (SELECT oid AS a, seq AS sa, unnest(generate_series(2, 30)) AS pos FROM {BOTH} x) p
  JOIN (SELECT oid AS b, seq AS sb FROM {BOTH} y) q ON substr(sa, CAST(pos AS BIGINT), 31) = substr(sb, 1, 31) WHERE a <> b AND substr(sa, CAST(pos AS BIGINT)) = substr(sb, 1, CAST(61 - pos AS BIGINT))"""


def _overlaps(spark, d):
    both = both_strands(fixture(spark, d, "H"))
    return both, O.overlaps(both, 31)


@query("overlaps", OVL)
def overlaps(spark, d):
    return _overlaps(spark, d)[1]


SUBREADS = f"SELECT rid, CASE WHEN rid % 5 = 2 THEN substr(s, 7, 40) ELSE s END AS s FROM ({H}) h"


@query(
    "contained_reads",
    f"WITH r AS ({SUBREADS}), t AS (SELECT rid * 2 AS oid, s AS seq FROM r UNION ALL SELECT rid * 2 + 1, {RC.format('s')} FROM r), w AS (SELECT oid AS w_id, seq AS w_seq, pos, substr(seq, CAST(pos AS BIGINT), 31) AS m FROM (SELECT oid, seq, unnest(generate_series(1, length(seq) - 30)) AS pos FROM t) x) SELECT DISTINCT oid AS oriented_id FROM t JOIN w ON substr(seq, 1, 31) = m WHERE (length(w_seq) > length(seq) OR (length(w_seq) = length(seq) AND w_id < oid)) AND substr(w_seq, CAST(pos AS BIGINT), length(seq)) = seq",
)
def contained_reads(spark, d):
    reads = fixture(spark, d, "H").select("rid", F.when(F.col("rid") % 5 == 2, F.substring("s", 7, 40)).otherwise(F.col("s")).alias("s"))
    return O.contained_reads(both_strands(reads), 31)


@query("irreducible_edges", f"WITH e AS ({OVL}) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e x JOIN e y ON x.b = y.a WHERE x.a = e.a AND y.b = e.b AND x.ovlp + y.ovlp - 60 = e.ovlp)")
def irreducible_edges(spark, d):
    return O.irreducible(O.overhangs(both_strands(fixture(spark, d, "H")), 31))


#: Unitigs of the reads of R, walked step by step: overlaps, irreducible ones, unambiguous ones, paths from their heads, cycles from their smallest node.
WALKED = f"""WITH RECURSIVE rd AS ({R}), two AS (SELECT rid * 2 AS oid, s AS seq FROM rd UNION ALL SELECT rid * 2 + 1, {RC.format('s')} FROM rd),
  dup AS (SELECT DISTINCT oid // 2 AS r FROM (SELECT oid, row_number() OVER (PARTITION BY seq ORDER BY oid) AS k FROM two) x WHERE k > 1),
  own AS MATERIALIZED (SELECT oid, seq FROM two WHERE oid // 2 NOT IN (SELECT r FROM dup)),
  ov AS MATERIALIZED (SELECT a, b, max(60 - pos + 1) AS ovlp FROM (SELECT oid AS a, seq AS sa, unnest(generate_series(2, 30)) AS pos FROM own) p JOIN (SELECT oid AS b, seq AS sb FROM own) q
    ON substr(sa, pos, 31) = substr(sb, 1, 31) WHERE a <> b AND substr(sa, pos) = substr(sb, 1, 61 - pos) GROUP BY 1, 2),
  irr AS MATERIALIZED (SELECT ov.* FROM ov ANTI JOIN (SELECT DISTINCT x.a, y.b, x.ovlp + y.ovlp - 60 AS ovlp FROM ov x JOIN ov y ON x.b = y.a WHERE x.ovlp + y.ovlp > 60) t ON t.a = ov.a AND t.b = ov.b AND t.ovlp = ov.ovlp),
  una AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM irr WHERE a // 2 <> b // 2) x WHERE na = 1 AND nb = 1),
  heads AS (SELECT oid FROM own ANTI JOIN una ON una.b = own.oid),
  reached AS (SELECT oid AS node FROM heads UNION ALL SELECT una.b FROM reached JOIN una ON una.a = reached.node),
  ring AS MATERIALIZED (SELECT oid FROM own ANTI JOIN reached ON reached.node = own.oid),
  around AS (SELECT oid AS start, oid AS node FROM ring UNION SELECT around.start, una.b FROM around JOIN una ON una.a = around.node),
  first AS MATERIALIZED (SELECT oid FROM heads UNION ALL SELECT start FROM around GROUP BY 1 HAVING min(node) = start),
  steps AS MATERIALIZED (SELECT una.* FROM una ANTI JOIN first ON first.oid = una.b),
  walk AS (SELECT own.oid AS head, own.oid AS node, 1 AS n, own.seq AS seq FROM own SEMI JOIN first ON first.oid = own.oid
    UNION ALL SELECT head, steps.b, n + 1, walk.seq || substr(own.seq, steps.ovlp + 1) FROM walk JOIN steps ON steps.a = walk.node JOIN own ON own.oid = steps.b),
  path AS (SELECT head, max(n) AS n, arg_max(node, n) AS last, arg_max(seq, n) AS seq FROM walk GROUP BY 1),
  stands AS (SELECT * FROM path WHERE CASE WHEN xor(head, 1) IN (SELECT head FROM path) THEN head % 2 = 0 ELSE head <= xor(last, 1) END),
  nei AS (SELECT head, (SELECT count(*) FROM irr WHERE irr.a = stands.last) + (SELECT count(*) FROM irr WHERE irr.b = stands.head) AS nei FROM stands)
"""


@query("unitigs", f"{WALKED} SELECT least(seq, {RC.format('seq')}) AS seq, CAST(length(seq) AS BIGINT) AS len, CAST(n AS BIGINT) AS nsr, nei FROM stands JOIN nei USING (head)")
def unitig_query(spark, d):
    """Sequences, lengths, reads and neighbours of the unitigs of genomes with branches, circles and repeats."""
    vertices, edges = A.unitig_graph(fixture(spark, d, "R"), 31)
    near = edges.groupBy(F.shiftright("a", 1).alias("id")).agg(F.count("*").alias("nei"))
    return vertices.join(near, "id", "left").select(F.least("seq", F.reverse(F.translate("seq", "ACGT", "TGCA"))).alias("seq"), "len", "nsr", F.coalesce("nei", F.lit(0)).alias("nei"))


@query("mag_roundtrip", f"{WALKED} SELECT CAST(2 * (head // 2) AS BIGINT) AS k0, CAST(n AS BIGINT) AS nsr, CAST(length(seq) AS BIGINT) AS len, nei, CAST(60 * n AS BIGINT) AS depth FROM stands JOIN nei USING (head)")
def mag_roundtrip(spark, d):
    """The unitigs written as MAG text to the shared folder, read back, turned into a graph again: neighbours and depth, summed over bases, of each."""
    path = shared_path(spark, "mag")
    mag_text(A.mag_records(*A.unitig_graph(fixture(spark, d, "R"), 31))).write.text(path)
    vertices, edges = A.mag_graph(read_mag(spark, path))
    near = edges.groupBy(F.shiftright("a", 1).alias("id")).agg(F.count("*").alias("nei"))
    depth = F.aggregate(F.transform(F.filter(F.split("cov", ""), lambda c: c != ""), lambda c: F.ascii(c) - 33), F.lit(0), lambda x, y: x + y).cast("long")
    return vertices.select("id", F.col("id").alias("k0"), "nsr", "len", depth.alias("depth")).join(near, "id", "left").select("k0", "nsr", "len", F.coalesce("nei", F.lit(0)).alias("nei"), "depth")


def _edges(spark, d):
    return fixture(spark, d, "EDGES")


@query("edge_dedupe", f"SELECT a, b, max(ovlp) AS ovlp FROM ({EDGES}) e GROUP BY a, b")
def edge_dedupe(spark, d):
    return Gr.dedupe_edges(_edges(spark, d))


TWO_WAY = f"SELECT a, b, ovlp FROM ({EDGES}) e1 UNION ALL SELECT b, a, CASE WHEN (a + b) % 3 = 0 THEN ovlp + 1 ELSE ovlp END FROM ({EDGES}) e2"
ENDS = "SELECT DISTINCT o_orderkey AS e FROM orders WHERE o_orderkey % 10 <> 3"


@query("amend_edges", f"WITH e AS ({TWO_WAY}) SELECT e.* FROM e SEMI JOIN ({ENDS}) n ON n.e = e.b SEMI JOIN (SELECT DISTINCT b AS a, a AS b, ovlp FROM e) x ON x.a = e.a AND x.b = e.b AND x.ovlp = e.ovlp")
def amend_edges(spark, d):
    from strandloom.session import table

    edges = _edges(spark, d)
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.when((F.col("a") + F.col("b")) % 3 == 0, F.col("ovlp") + 1).otherwise(F.col("ovlp")).alias("ovlp"))
    ends = table(spark, d, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("end"))
    return Gr.amend_edges(edges.unionAll(back), ends)


@query("ambiguous_ends", f"SELECT a AS end_id FROM ({EDGES}) e GROUP BY 1 HAVING count(*) > 1")
def ambiguous_ends(spark, d):
    """Order keys as ends that vertices, the order's lines, claim."""
    return Gr.ambiguous_ends(_edges(spark, d).select(F.col("a").alias("end"))).select(F.col("end").alias("end_id"))


GONE = "SELECT id * 2 + h AS v FROM (SELECT p_partkey AS id FROM part WHERE p_partkey % 7 = 3) p, (SELECT unnest([0, 1]) AS h) u"


@query("vertex_delete", f"SELECT a, b, ovlp FROM ({EDGES}) e WHERE a NOT IN ({GONE}) AND b NOT IN ({GONE})")
def vertex_delete(spark, d):
    vertices = fixture(spark, d, "VERTICES")
    return Gr.drop_vertices(vertices, _edges(spark, d), vertices.where("id % 7 = 3").select("id"))[1]


@query("asqg_edges", f"SELECT concat('v', CAST(a AS VARCHAR)) AS a, concat('v', CAST(b AS VARCHAR)) AS b, ovlp, CASE WHEN a % 2 = 0 THEN 1 ELSE 0 END AS end_a, CASE WHEN b % 3 = 0 THEN 1 ELSE 0 END AS end_b FROM ({EDGES}) e WHERE (a + b) % 5 <> 4")
def asqg_edges(spark, d):
    """Edges as lines of an ASQG file in the shared folder, read back; overlaps inside a sequence are no edges."""
    path = shared_path(spark, "asqg")
    place = lambda at_end, n, size: F.concat_ws(" ", *(F.when(at_end, x).otherwise(y).cast("string") for x, y in ((size - n, F.lit(0)), (size - 1, n - 1))), size.cast("string"))
    inside = F.concat_ws(" ", F.lit("5"), (F.col("ovlp") + 4).cast("string"), F.lit("200"))
    first = F.when((F.col("a") + F.col("b")) % 5 == 4, inside).otherwise(place(F.col("a") % 2 == 0, F.col("ovlp"), F.lit(200)))
    line = F.concat(F.lit("ED\t"), F.concat_ws(" ", F.concat(F.lit("v"), "a"), F.concat(F.lit("v"), "b"), first, place(F.col("b") % 3 == 0, F.col("ovlp"), F.lit(300)), F.lit("0 0")))
    _edges(spark, d).select(line.alias("value")).write.text(path)
    return read_asqg(spark, path)[1]


@query("neighbor_cap", f"SELECT a, b, ovlp FROM (SELECT *, (SELECT 1) AS one, nth_value(ovlp, 4) OVER (PARTITION BY a ORDER BY ovlp DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t FROM ({EDGES}) e) x WHERE t IS NULL OR ovlp > t")
def neighbor_cap(spark, d):
    return Gr.neighbor_cap(_edges(spark, d), 3)


@query("relative_edges", f"SELECT a, b, ovlp FROM (SELECT *, nth_value(ovlp, 2) OVER (PARTITION BY a ORDER BY ovlp DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t FROM ({EDGES}) e) x WHERE ovlp >= CAST(floor(0.7 * coalesce(t, ovlp) + 0.499) AS INT)")
def relative_edges(spark, d):
    return Gr.relative_edges(_edges(spark, d), 0.7)


@query("weak_edges", f"WITH e AS (SELECT a, b, ovlp FROM ({EDGES}) x UNION ALL SELECT b, a, ovlp FROM ({EDGES}) y), m AS (SELECT a, greatest(10, max(ovlp)) AS m FROM e GROUP BY a), w AS (SELECT e.a, e.b FROM e JOIN m USING (a) WHERE ovlp < 10 OR ovlp / m < 0.8) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM w WHERE (w.a = e.a AND w.b = e.b) OR (w.a = e.b AND w.b = e.a))".replace("NOT EXISTS (SELECT 1 FROM w WHERE (w.a = e.a AND w.b = e.b) OR (w.a = e.b AND w.b = e.a))", "(a, b) NOT IN (SELECT (a, b) FROM w UNION SELECT (b, a) FROM w)"))
def weak_edges(spark, d):
    edges = _edges(spark, d)
    return Gr.weak_edges(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "ovlp")), 10, 0.8)


@query("tips", f"SELECT id FROM ({VERTICES}) v LEFT JOIN (SELECT a // 2 AS i, count(DISTINCT a % 2) AS n FROM ({EDGES}) e GROUP BY 1) s ON s.i = v.id WHERE len < 900 AND nsr < 20 AND coalesce(n, 0) < 2")
def tips(spark, d):
    return Gr.tips(fixture(spark, d, "VERTICES"), _edges(spark, d), 900, 20).select("id")


TIPPED = f"""WITH e AS (SELECT a, b, ovlp FROM ({EDGES}) x UNION ALL SELECT b, a, ovlp FROM ({EDGES}) y),
  t AS (SELECT id * 2 + unnest([0, 1]) AS node FROM ({VERTICES}) v LEFT JOIN (SELECT a // 2 AS i, count(DISTINCT a % 2) AS n FROM e GROUP BY 1) s ON s.i = v.id WHERE len < 2100 AND nsr < 37 AND coalesce(n, 0) < 2),
  m AS (SELECT a, CASE WHEN b IN (SELECT node FROM t) THEN 10 ELSE greatest(10, ovlp) END AS m FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY ovlp DESC, b) AS k FROM e) r WHERE k = 1),
  w AS (SELECT e.a, e.b FROM e JOIN m USING (a) WHERE (ovlp < 10 OR ovlp / m < 0.8) AND a NOT IN (SELECT node FROM t))
  SELECT * FROM e WHERE (a, b) NOT IN (SELECT (a, b) FROM w UNION SELECT (b, a) FROM w)"""


@query("weak_edges_tips", TIPPED)
def weak_edges_tips(spark, d):
    """weak_edges by the tip rule."""
    edges = _edges(spark, d)
    edges = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "ovlp"))
    ends = Gr.tips(fixture(spark, d, "VERTICES"), edges, 2100, 37).select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("end"))
    return Gr.weak_edges(edges, 10, 0.8, ends)


def _rdist_sql() -> str:
    one = "SELECT sum(own) / sum(nsr) AS rdist FROM (SELECT own, nsr, coalesce(sum(nsr) OVER (ORDER BY nsr DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {src}) w WHERE before < 0.5 * (SELECT sum(nsr) FROM v)"
    return f"v AS (SELECT *, len - maxo AS own FROM ({VERTICES}) x), r1 AS ({one.format(src='v')}), v2 AS (SELECT v.* FROM v, r1 WHERE own / rdist - nsr * 0.6931471805599453 >= 20), r2 AS ({one.format(src='v2')})"


@query("read_distance", f"WITH {_rdist_sql()} SELECT round(rdist, 6) AS rdist FROM r2")
def read_distance(spark, d):
    return Gr.read_distance(fixture(spark, d, "VERTICES")).select(F.round("rdist", 6).alias("rdist"))


@query("genome_size", f"WITH {_rdist_sql()} SELECT CAST(floor(rdist * (SELECT sum(nsr) FROM v) + 0.5) AS BIGINT) AS size FROM r2")
def genome_size(spark, d):
    return Gr.genome_size(fixture(spark, d, "VERTICES"))


@query("a_statistic", f"WITH {_rdist_sql()} SELECT id, round(own / rdist - nsr * 0.6931471805599453, 6) AS a FROM v, r2")
def a_statistic(spark, d):
    return Gr.a_statistic(fixture(spark, d, "VERTICES")).select("id", F.round("a", 6).alias("a"))


@query("unique_unitigs", f"WITH {_rdist_sql()} SELECT id FROM v, r2 WHERE own / rdist - nsr * 0.6931471805599453 >= 0")
def unique_unitigs(spark, d):
    """Vertices whose A-statistic is 0 at least: the usual 20 asks for deeper vertices than these."""
    return Gr.likely_unique(fixture(spark, d, "VERTICES"), 0.0).select("id")


def _line(spark, d):
    """A path of oriented vertices for each genome: six vertices of 60 bases with overlaps of 48."""
    lines = cut_lineage(O.irreducible(O.overhangs(both_strands(fixture(spark, d, "H")), 31)))
    vertices = fixture(spark, d, "H").select(F.col("rid").alias("id"), F.lit(60).cast("long").alias("len"), F.lit(1).cast("long").alias("nsr"))
    return vertices, lines


@query("merge_unambiguous", f"{WALKED} SELECT CAST(head // 2 AS BIGINT) AS id, CAST(length(seq) AS BIGINT) AS len, CAST(n AS BIGINT) AS nsr FROM stands")
def merge_unambiguous(spark, d):
    return merge_graph(*A.read_graph(fixture(spark, d, "R"), 31))[0].select("id", "len", "nsr")


@query(
    "bridge_delete",
    f"SELECT a * 2 + CAST(o AS BIGINT) AS a, CAST(CASE WHEN o = 0 THEN a * 2 + 2 * (1 + (a % 6 = 1)::INT) ELSE a * 2 + 1 - 2 * (1 + (a % 6 = 3)::INT) END AS BIGINT) AS b, CAST(CASE WHEN (o = 0 AND a % 6 = 1) OR (o = 1 AND a % 6 = 3) THEN 36 ELSE 48 END AS INT) AS ovlp FROM (SELECT rid AS a, unnest([0, 1]) AS o FROM ({H}) h) x WHERE a % 6 <> 2 AND ((o = 0 AND a % 6 < 5) OR (o = 1 AND a % 6 > 0))",
)
def bridge_delete(spark, d):
    vertices, edges = _line(spark, d)
    return Gr.bridge_vertices(vertices, edges, vertices.where("id % 6 = 2").select("id"), 30)[1]


@query(
    "bridge_adjacent",
    f"SELECT a * 2 AS a, (a + step) * 2 AS b, CAST(60 - 12 * step AS INT) AS ovlp FROM (SELECT rid AS a, CASE rid % 6 WHEN 1 THEN 3 ELSE 1 END AS step FROM ({H}) h WHERE rid % 6 IN (0, 1, 4)) x UNION ALL SELECT (a + step) * 2 + 1, a * 2 + 1, CAST(60 - 12 * step AS INT) FROM (SELECT rid AS a, CASE rid % 6 WHEN 1 THEN 3 ELSE 1 END AS step FROM ({H}) h WHERE rid % 6 IN (0, 1, 4)) y",
)
def bridge_adjacent(spark, d):
    """The third and fourth of six vertices in a row go: the second leads to the fifth."""
    vertices, edges = _line(spark, d)
    return Gr.bridge_vertices(vertices, edges, vertices.where("id % 6 IN (2, 3)").select("id"), 20)[1]


@query("sw_align", f"SELECT id, CAST(CASE WHEN id % 2 = 0 THEN 5 * 59 - 4 ELSE 5 * 59 - 7 END AS INT) AS score, 59 AS query_end, CASE WHEN id % 2 = 0 THEN 59 ELSE 58 END AS target_end FROM ({G}) g")
def sw_align(spark, d):
    """Each genome's first 60 bases against themselves with one substitution, or with base 30 left out."""
    base = F.substring("s", 30, 1)
    changed = F.concat(F.substring("s", 1, 29), F.translate(base, "ACGT", "CGTA"), F.substring("s", 31, 30))
    gapped = F.concat(F.substring("s", 1, 29), F.substring("s", 31, 30))
    pairs = fixture(spark, d, "G").select("id", F.substring("s", 1, 60).alias("query"), F.when(F.col("id") % 2 == 0, changed).otherwise(gapped).alias("target"))
    return align(pairs).select("id", "score", "query_end", "target_end")


@query("sw_align_whole", f"SELECT id, 300 AS score, 59 AS query_end, 20 + 59 AS target_end, 0 AS query_start, 20 AS target_start, 200 AS score2, 20 + 128 + 39 AS target_end2 FROM ({G}) g")
def sw_align_whole(spark, d):
    """Each genome's first 60 bases against a target that holds them after twenty Ns, and the first 40 of them again at its end: starts, ends and the second best."""
    target = F.concat(F.repeat(F.lit("N"), F.lit(20)), F.substring("s", 1, 60), F.repeat(F.lit("N"), F.lit(68)), F.substring("s", 1, 40))
    pairs = fixture(spark, d, "G").select("id", F.substring("s", 1, 60).alias("query"), target.alias("target"))
    return align(pairs, whole=True).drop("query", "target")


@query("smem", f"SELECT rid AS query, 0 AS beg, 29 AS stop, 1::BIGINT AS n, w = 0 AS left_end, false AS right_end FROM ({H}) h UNION ALL SELECT rid, 30, 60, 1::BIGINT, false, false FROM ({H}) h2")
def smem_query(spark, d):
    """Reads with base 30 changed against their genomes: a match on either side of it."""
    changed = F.concat(F.substring("s", 1, 29), F.translate(F.substring("s", 30, 1), "ACGT", "CGTA"), F.substring("s", 31, 30))
    queries = fixture(spark, d, "H").select(F.col("rid").alias("query"), changed.alias("seq"))
    strings = both_strands(fixture(spark, d, "G"), "id")
    return smem(queries, strings, 19).select("query", "beg", F.col("end").alias("stop"), "n", "left_end", "right_end")


_SHORT = f"""WITH c AS (SELECT substr(s, 1, 24) AS s FROM ({G}) g UNION ALL SELECT substr(s, 60, 6) FROM ({G}) g2 WHERE id % 5 = 0),
q AS (SELECT id AS query, concat(substr(s, 9, 10), substr(s, 41, 14), substr(s, 12, 9)) AS s FROM ({G}) g3),
w AS (SELECT substr(s, i, l) AS m, count(*) AS n, bool_or(i = 1) AS left_end, bool_or(i + l - 1 = length(s)) AS right_end, count(*) FILTER (WHERE i = 1 AND l = length(s)) AS whole
  FROM (SELECT s, i, unnest(generate_series(1, length(s) - i + 1)) AS l FROM (SELECT s, unnest(generate_series(1, length(s))) AS i FROM c) x) y GROUP BY 1),
f AS (SELECT query, i - 1 AS beg, i + l - 1 AS stop, w.* FROM (SELECT query, s, i, unnest(generate_series(1, least(24, length(s) - i + 1))) AS l FROM (SELECT query, s, unnest(generate_series(1, length(s))) AS i FROM q) x) y JOIN w ON m = substr(s, i, l)),
r AS (SELECT *, coalesce(stop > max(stop) OVER (PARTITION BY query ORDER BY beg, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS maximal FROM f)
SELECT query, beg, stop, CASE WHEN maximal THEN n ELSE whole END AS n, NOT maximal OR left_end AS left_end, NOT maximal OR right_end AS right_end FROM r WHERE maximal OR whole > 0"""


@query("all_matches", _SHORT)
def all_matches_query(spark, d):
    """Patched pieces of each genome against the beginnings of all genomes and some short strings: matches of every length, with seeds from 9 bases on."""
    g = fixture(spark, d, "G")
    queries = g.select(F.col("id").alias("query"), F.concat(F.substring("s", 9, 10), F.substring("s", 41, 14), F.substring("s", 12, 9)).alias("seq"))
    strings = g.select((F.col("id") * 2).alias("oriented_id"), F.substring("s", 1, 24).alias("seq")).unionAll(g.where("id % 5 = 0").select(F.col("id") * 2 + 1, F.substring("s", 60, 6)))
    found = all_matches(queries, strings, 9)
    return found.select("query", F.col("beg").cast("long").alias("beg"), F.col("end").cast("long").alias("stop"), "n", "left_end", "right_end")


@query("bubble_simple", f"SELECT id * 10 + 2 AS id FROM ({G}) g")
def bubble_simple(spark, d):
    """Two haplotypes of each genome that differ in a base: the arm with fewer reads goes."""
    g = fixture(spark, d, "G")
    arm = lambda at: F.substring("s", at[0], at[1])
    changed = F.concat(F.substring("s", 31, 33), F.translate(F.substring("s", 64, 1), "ACGT", "CGTA"), F.substring("s", 65, 34))
    parts = [(0, arm((1, 60)), 9), (1, arm((31, 68)), 9), (2, changed, 1), (3, arm((69, 60)), 9)]
    rows = F.array(*(F.struct((F.col("id") * 10 + k).alias("id"), s.alias("seq"), F.lit(n).cast("long").alias("nsr")) for k, s, n in parts))
    vertices = g.select(F.explode(rows).alias("v")).select("v.*").withColumn("len", F.length("seq").cast("long")).withColumn("cov", F.expr("repeat(char(33 + nsr), length(seq))"))
    ties = F.array(*(F.struct((F.col("id") * 20 + a).alias("a"), (F.col("id") * 20 + b).alias("b"), F.lit(30).alias("ovlp")) for a, b in ((0, 2), (0, 4), (2, 6), (4, 6), (3, 1), (5, 1), (7, 3), (7, 5))))
    edges = g.select(F.explode(ties).alias("e")).select("e.*")
    kept, _ = pop_bubbles(vertices, edges)
    return vertices.select("id").join(kept.select("id"), "id", "left_anti")


def _graph(g, parts, ties):
    """Vertices (k, sequence, reads) and one-way edges (from, to, overlap) of each genome of g as a graph; ids are 16 * id + k."""
    rows = F.array(*(F.struct((F.col("id") * 16 + k).alias("id"), s.alias("seq"), n.cast("long").alias("nsr")) for k, s, n in parts))
    vertices = g.select(F.explode(rows).alias("v")).select("v.*").withColumn("len", F.length("seq").cast("long")).withColumn("cov", F.expr("repeat(char(33 + least(nsr, 93)), length(seq))"))
    both = [t for a, b, o in ties for t in ((2 * a, 2 * b, o), (2 * b + 1, 2 * a + 1, o))]
    edges = g.select(F.explode(F.array(*(F.struct((F.col("id") * 32 + a).alias("a"), (F.col("id") * 32 + b).alias("b"), F.lit(o).alias("ovlp")) for a, b, o in both))).alias("e")).select("e.*")
    return vertices, edges


#: Reads of the inner vertices of a bubble of four ways: 0 -> 1 -> (2 | 3) -> 5, 0 -> 4 -> 5 and 0 -> 6 -> 5, then 7. Of equal ways the one over the smaller last vertex is better.
WAYS = """SELECT id, r1 + r2 AS n, [1, 2] AS way FROM b UNION ALL SELECT id, r1 + r3, [1, 3] FROM b UNION ALL SELECT id, r4, [4] FROM b UNION ALL SELECT id, r6, [6] FROM b"""
READS = {k: f"(2 + (id * {m}) % {p})" for k, m, p in ((1, 7, 11), (2, 5, 13), (3, 3, 17), (4, 11, 23), (6, 13, 29))}


def _ways_graph(spark, d, reads):
    spot = lambda a, n: F.substring("s", a, n)
    seqs = {0: spot(1, 40), 1: spot(11, 40), 2: spot(21, 50), 3: spot(22, 50), 4: spot(12, 60), 5: spot(41, 40), 6: spot(13, 60), 7: spot(61, 40)}
    return _graph(fixture(spark, d, "G"), [(k, s, reads.get(k, F.lit(50))) for k, s in seqs.items()], [(0, 1, 30), (1, 2, 30), (1, 3, 30), (2, 5, 30), (3, 5, 30), (0, 4, 30), (4, 5, 30), (0, 6, 30), (6, 5, 30), (5, 7, 20)])


def _off_the_ways_sql(reads: dict) -> str:
    return (
        f"WITH b AS (SELECT id, {', '.join(f'{v} AS r{k}' for k, v in reads.items())} FROM ({G}) g), w AS ({WAYS}), best AS (SELECT id, unnest(way) AS k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, way[-1]) AS place FROM w) x WHERE place <= 2) "
        "SELECT id * 16 + k AS id FROM (SELECT id, unnest([1, 2, 3, 4, 6]) AS k FROM b) a WHERE (id, k) NOT IN (SELECT (id, k) FROM best)"
    )


@query("bubble_complex", _off_the_ways_sql(READS))
def bubble_complex(spark, d):
    """What the two ways of most reads through a bubble leave over."""
    vertices, edges = _ways_graph(spark, d, {k: F.expr(v) for k, v in READS.items()})
    return vertices.select("id").join(simplify_bubbles(vertices, edges)[0].select("id"), "id", "left_anti")


FEW = {k: f"(1 + (id // {m}) % 2)" for k, m in ((1, 1), (2, 2), (3, 4), (4, 8), (6, 16))}


@query("bubble_ties", _off_the_ways_sql(FEW))
def bubble_ties(spark, d):
    """Bubbles whose ways have few reads, so that many are equal."""
    vertices, edges = _ways_graph(spark, d, {k: F.expr(v.replace("//", "div")) for k, v in FEW.items()})
    return vertices.select("id").join(simplify_bubbles(vertices, edges)[0].select("id"), "id", "left_anti")


#: A bubble of three arms inside one of two: 0 -> 1 -> (2 | 3 | 4) -> 5 -> 7 and 0 -> 6 -> 7, then 8.
NESTED = {k: f"(2 + (id * {m}) % {p})" for k, m, p in ((1, 3, 7), (2, 5, 11), (3, 7, 13), (4, 11, 17), (6, 13, 43))}


@query(
    "bubble_nested",
    f"WITH b AS (SELECT id, {', '.join(f'{v} AS r{k}' for k, v in NESTED.items())} FROM ({G}) g), arms AS (SELECT id, k, r1 + 9 + r AS n, row_number() OVER (PARTITION BY id ORDER BY r DESC, k) AS place, r6 FROM (SELECT *, unnest([2, 3, 4]) AS k, unnest([r2, r3, r4]) AS r FROM b) x), "
    "outer_ AS (SELECT id, 5 AS last, k, n, place AS which FROM arms WHERE place <= 2 UNION ALL SELECT id, 6, 6, r6, 1 FROM b), best AS (SELECT id, k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, last, which) AS place FROM outer_) y WHERE place <= 2) "
    "SELECT id * 16 + k AS id FROM (SELECT id, unnest([2, 3, 4, 6]) AS k FROM b) z WHERE (id, k) NOT IN (SELECT (id, k) FROM best)",
)
def bubble_nested(spark, d):
    """The inner bubble is decided first, then the outer one with what it left."""
    spot = lambda a, n: F.substring("s", a, n)
    seqs = {0: spot(1, 40), 1: spot(11, 40), 2: spot(21, 50), 3: spot(22, 50), 4: spot(23, 50), 5: spot(41, 40), 6: spot(13, 80), 7: spot(51, 40), 8: spot(71, 40)}
    reads = {k: F.expr(v) for k, v in NESTED.items()} | {5: F.lit(9)}
    vertices, edges = _graph(fixture(spark, d, "G"), [(k, s, reads.get(k, F.lit(50))) for k, s in seqs.items()], [(0, 1, 30), (1, 2, 30), (1, 3, 30), (1, 4, 30), (2, 5, 30), (3, 5, 30), (4, 5, 30), (5, 7, 30), (0, 6, 30), (6, 7, 30), (7, 8, 20)])
    return vertices.select("id").join(simplify_bubbles(vertices, edges)[0].select("id"), "id", "left_anti")


@query("open_bubble_pair", f"SELECT id * 16 + CASE WHEN id % 3 = 1 THEN 1 ELSE 2 END AS id FROM ({G}) g UNION ALL SELECT id * 16 + 3 FROM ({G}) g2 WHERE id % 2 = 0")
def open_bubble_pair(spark, d):
    """Dead ends that are like each other and have no other sibling: two, or three, of which the one of most reads, or of the largest id, stays."""
    g = fixture(spark, d, "G")
    changed = lambda at: F.concat(F.expr(f"substring(s, 31, {at - 31})"), F.translate(F.substring("s", at, 1), "ACGT", "CGTA"), F.expr(f"substring(s, {at + 1}, {100 - at})"))
    third = F.when(F.col("id") % 2 == 0, F.concat(changed(81))).otherwise(F.concat(F.substring("s", 31, 30), F.reverse(F.substring("s", 61, 40))))
    parts = [(0, F.substring("s", 1, 60), F.lit(9)), (1, F.substring("s", 31, 70), F.when(F.col("id") % 3 == 0, 9).when(F.col("id") % 3 == 1, 2).otherwise(5)), (2, changed(91), F.when(F.col("id") % 3 == 0, 2).when(F.col("id") % 3 == 1, 9).otherwise(4)), (3, third, F.lit(1))]
    vertices, edges = _graph(g, parts, [(0, 1, 30), (0, 2, 30), (0, 3, 30)])
    return vertices.select("id").join(pop_open(vertices, edges, 98)[0].select("id"), "id", "left_anti")


@query("open_bubble", f"SELECT id * 16 + 2 AS id FROM ({G}) g WHERE id % 3 < 2")
def open_bubble(spark, d):
    """A dead end beside its sibling: the same but for a base, the same but for a base left out, or another sequence, by turns."""
    g = fixture(spark, d, "G")
    like = F.when(F.col("id") % 3 == 0, F.concat(F.substring("s", 31, 60), F.translate(F.substring("s", 91, 1), "ACGT", "CGTA"), F.substring("s", 92, 9)))
    like = like.when(F.col("id") % 3 == 1, F.concat(F.substring("s", 31, 40), F.substring("s", 72, 29))).otherwise(F.concat(F.substring("s", 31, 30), F.reverse(F.substring("s", 61, 40))))
    parts = [(0, F.substring("s", 1, 60), F.lit(9)), (1, F.substring("s", 31, 98), F.lit(9)), (2, like, F.lit(1))]
    vertices, edges = _graph(g, parts, [(0, 1, 30), (0, 2, 30)])
    kept, _ = pop_open(vertices, edges, 98)
    return vertices.select("id").join(kept.select("id"), "id", "left_anti")


@query("clean", f"SELECT least(s, {RC.format('s')}) AS seq, 128::BIGINT AS len FROM ({G}) g")
def clean_query(spark, d):
    """Each genome in four pieces, with a tip, a bubble of one differing base and a weak edge from the tip: the schedule leaves one vertex."""
    g = fixture(spark, d, "G")
    changed = F.concat(F.substring("s", 31, 33), F.translate(F.substring("s", 64, 1), "ACGT", "CGTA"), F.substring("s", 65, 34))
    tip = F.concat(F.substring("s", 60, 37), F.reverse(F.substring("s", 1, 20)))
    parts = [(0, F.substring("s", 1, 60), F.lit(20)), (1, F.substring("s", 31, 68), F.lit(20)), (2, changed, F.lit(1)), (3, F.substring("s", 69, 60), F.lit(20)), (4, tip, F.lit(1))]
    vertices, edges = _graph(g, parts, [(0, 1, 30), (0, 2, 30), (1, 3, 30), (2, 3, 30), (1, 4, 37)])
    kept, _ = clean(vertices, edges, Cleaning(rounds=2, tip_len=60, min_overlap=20, tip_nsr=3, inner_nsr=2))
    return kept.select(F.least("seq", F.reverse(F.translate("seq", "ACGT", "TGCA"))).alias("seq"), "len")
