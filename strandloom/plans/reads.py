"""Queries over reads: scans, scalar functions, filters, pairs, k-mers, suffixes and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import kmers as K
from strandloom.operators import suffixes as X
from strandloom.operators.kmer_store import NEXT, KmerStore
from strandloom.operators.packed import packed_counts
from strandloom.plans.fixtures import duck, fixture
from strandloom.session import shared_path
from strandloom.sources import fastx, fastx_format

QUERIES, ORACLES = {}, {}
H, HQ, HP, E, T, TN, G = (duck(n) for n in ("H", "HQ", "HP", "E", "T", "TN", "G"))
DUPS_EARLY = f"SELECT rid, substr(s, 1, 20 + rid % 41) AS s FROM ({H}) h0"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("reads_scan", f"SELECT rid AS read_id, regexp_replace(upper(s), '[^ACGT]', 'N', 'g') AS seq FROM ({H}) h")
def reads_scan(spark, d):
    return fixture(spark, d, "H").select(F.col("rid").alias("read_id"), S.normalise(F.col("s")).alias("seq"))


@query("splitfa_shards", f"SELECT (rid // 2) % 8 AS shard, count(*) AS n FROM ({H}) h GROUP BY 1")
def splitfa_shards(spark, d):
    return fixture(spark, d, "H").groupBy((F.shiftright("rid", 1) % 8).alias("shard")).agg(F.count("*").alias("n"))


@query("revcomp", f"SELECT rid AS read_id, {RC.format('s')} AS out FROM ({H}) h")
def revcomp(spark, d):
    return fixture(spark, d, "H").select(F.col("rid").alias("read_id"), S.revcomp(F.col("s")).alias("out"))


@query("reverse", f"SELECT rid AS read_id, reverse(s) AS out FROM ({H}) h")
def reverse(spark, d):
    return fixture(spark, d, "H").select(F.col("rid").alias("read_id"), F.reverse("s").alias("out"))


@query("complement", f"SELECT rid AS read_id, translate(s, 'ACGT', 'TGCA') AS out FROM ({H}) h")
def complement(spark, d):
    return fixture(spark, d, "H").select(F.col("rid").alias("read_id"), S.complement(F.col("s")).alias("out"))


@query("replace_ambiguous", f"SELECT doc_id AS read_id, array_to_string(list_transform(generate_series(1, length(s)), lambda i: CASE WHEN substr(s, i, 1) = 'N' THEN translate(substr(md5(concat(CAST(doc_id AS VARCHAR), ':', CAST(i AS VARCHAR))), 1, 1), '0123456789abcdef', 'ACGTACGTACGTACGT') ELSE substr(s, i, 1) END), '') AS seq FROM ({TN}) t")
def replace_ambiguous(spark, d):
    return fixture(spark, d, "TN").select(F.col("doc_id").alias("read_id"), S.replace_ambiguous(F.col("s"), F.col("doc_id")).alias("seq"))


@query("fastq_scan", f"SELECT concat('r', CAST(rid AS VARCHAR)) AS name, s AS seq, q AS qual FROM ({HQ}) h")
def fastq_scan(spark, d):
    """Reads written as FASTQ files to the shared folder and read back from their splits."""
    path = shared_path(spark, "fastq")
    fastx.write_fastx(fixture(spark, d, "HQ").select(F.concat(F.lit("r"), F.col("rid").cast("string")).alias("name"), F.col("s").alias("seq"), F.col("q").alias("qual")), path)
    return fastx.read_fastq(spark, path).select("name", "seq", "qual")


@query("fasta_scan", f"SELECT concat('d', CAST(doc_id AS VARCHAR)) AS name, 'whole text' AS comment, s AS seq FROM ({T}) t")
def fasta_scan(spark, d):
    """Documents as FASTA records of lines of 70 bases, written to the shared folder and read back from splits."""
    path = shared_path(spark, "fasta")
    rows = fixture(spark, d, "T").select(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" whole text\n"), F.regexp_replace("s", "(.{70})(?=.)", "$1\n")).alias("value"))
    rows.write.text(path)
    return fastx.read_fasta(spark, path).select("name", "comment", "seq")


CUT = ["substring(s, 1, cast(rid % 61 AS int)) AS seq", "substring(q, 1, cast(rid % 61 AS int)) AS qual"]


@query("fastx_format", f"SELECT concat('r', CAST(rid AS VARCHAR)) AS name, concat('w', CAST(rid % 7 AS VARCHAR)) AS comment, {', '.join(CUT)}, CAST(rid % 61 AS INT) AS length FROM ({HQ}) h")
def fastx_format_(spark, d):
    """Reads of 0 to 60 bases written as FASTQ of lines of 23 bases by the format's writer, and read back from ranges of 64 KB."""
    fastx_format.register(spark)
    path = shared_path(spark, "fastx")
    rows = fixture(spark, d, "HQ").selectExpr("concat('r', rid) AS name", "concat('w', rid % 7) AS comment", *CUT)
    rows.write.format("fastx").mode("append").option("lineWidth", 23).save(path)
    return spark.read.format("fastx").option("splitBytes", 1 << 16).load(path).select("name", "comment", "seq", "qual", "length")


@query("mate_files", f"SELECT (row_number() OVER (PARTITION BY mate ORDER BY pid) - 1) * 2 + mate AS ord, concat('p', CAST(pid AS VARCHAR)) AS name, mate, CASE mate WHEN 0 THEN r1 ELSE r2 END AS seq FROM ({HP}) h, (VALUES (0), (1)) m(mate)")
def mate_files(spark, d):
    """Pairs written as two folders of FASTA, mates in one order, and put together again by their places."""
    fastx_format.register(spark)
    pairs, paths = fixture(spark, d, "HP"), [shared_path(spark, f"mates{k}") for k in (1, 2)]
    for k, path in enumerate(paths, 1):
        mates = pairs.orderBy("pid").selectExpr(f"concat('p', pid, '/{k}') AS name", f"r{k} AS seq")
        mates.write.format("fastx").mode("append").save(path)
    return fastx_format.read_mates(spark, *paths, splitBytes=1 << 16).select("ord", "name", "mate", "seq")


@query("end_offset_names", f"SELECT CAST(sum(length(s) + 1) OVER (ORDER BY rid) AS VARCHAR) AS name, s AS seq FROM ({DUPS_EARLY}) h")
def end_offset_names(spark, d):
    rows = fixture(spark, d, "H").select("rid", F.expr("substring(s, 1, cast(20 + rid % 41 AS int))").alias("seq"))
    return fastx.end_offset_names(rows, "rid").select("name", "seq")


CODED = "SELECT rid, concat(translate(s, 'ACGT', 'RKBD'), lower(s), translate(s, 'ACGT', 'YMVH'), 'NSWnsw') AS s FROM {h} h"


@query("complement_codes", f"SELECT rid AS read_id, translate(s, 'RKBDYMVHacgt', 'YMVHRKBDtgca') AS out FROM ({CODED.format(h=f'({H})')}) h")
def complement_codes(spark, d):
    """Sequences of ambiguity codes in both cases."""
    return spark.sql(CODED.replace("{h} h", "{h}"), h=fixture(spark, d, "H")).select(F.col("rid").alias("read_id"), S.complement(F.col("s")).alias("out"))


@query("default_quality", f"SELECT concat('r', CAST(rid AS VARCHAR)) AS name, CASE WHEN rid % 2 = 0 THEN q ELSE repeat('5', 60) END AS qual FROM ({HQ}) h")
def default_quality(spark, d):
    """Records with and without qualities through text, and 20 for every base that has none."""
    path = shared_path(spark, "fastx")
    rows = fixture(spark, d, "HQ").select(F.concat(F.lit("r"), F.col("rid").cast("string")).alias("name"), F.col("s").alias("seq"), F.when(F.col("rid") % 2 == 0, F.col("q")).alias("qual"))
    fastx.write_fastx(rows, path)
    return fastx.with_quality(fastx.read_fastx(spark, path)).select("name", "qual")


PAL = "SELECT rid, CASE WHEN rid % 3 = 0 THEN concat(s, reverse(translate(s, 'ACGT', 'TGCA'))) ELSE s END AS s FROM ({}) h"


@query("palindrome_trim", f"SELECT rid AS read_id, CASE WHEN length(s) % 2 = 0 AND s = {RC.format('s')} THEN substr(s, 1, length(s) - 1) ELSE s END AS seq FROM ({PAL.format(H)}) p")
def palindrome_trim(spark, d):
    rows = spark.sql(PAL.format("SELECT * FROM {h}"), h=fixture(spark, d, "H"))
    return rows.select(F.col("rid").alias("read_id"), S.palindrome_trim(F.col("s")).alias("seq"))


@query("length_trim", f"SELECT rid AS read_id, substr(s, 1, 50) AS seq FROM ({H}) h")
def length_trim(spark, d):
    return fixture(spark, d, "H").select(F.col("rid").alias("read_id"), F.substring("s", 1, 50).alias("seq"))


@query(
    "cut_ambiguous",
    f"SELECT doc_id AS read_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS part, seq FROM (SELECT doc_id, unnest(p) AS seq, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, string_split_regex(s, 'N+') AS p FROM ({TN}) t) x) y WHERE seq <> ''",
)
def cut_ambiguous(spark, d):
    rows = fixture(spark, d, "TN").select("doc_id", F.posexplode(F.filter(F.split("s", "N+"), lambda x: x != "")).alias("part", "seq"))
    return rows.select(F.col("doc_id").alias("read_id"), (F.col("part") + 1).cast("long").alias("part"), "seq")


def _trim_sql(floor: int) -> str:
    side = """SELECT rid, coalesce(min(CASE WHEN s = best AND best > 0 THEN i END), 0) AS cut FROM (
      SELECT *, max(CASE WHEN i < stop THEN s END) OVER (PARTITION BY rid) AS best FROM (
        SELECT *, coalesce(min(CASE WHEN s < 0 THEN i END) OVER (PARTITION BY rid), 1000000) AS stop FROM (
          SELECT rid, i, sum({floor} - (ascii(c) - 33)) OVER (PARTITION BY rid ORDER BY i) AS s FROM ({chars}) c1) a) b) c2 WHERE i < stop OR stop = 1 GROUP BY rid"""
    tail = "SELECT rid, i, substr(q, length(q) - i + 1, 1) AS c FROM (SELECT rid, q, unnest(generate_series(1, length(q))) AS i FROM hq) z"
    head = "SELECT rid, i, substr(q, i, 1) AS c FROM (SELECT hq.rid, q, unnest(generate_series(1, length(q) - cut)) AS i FROM hq JOIN tails USING (rid)) z"
    return f"""WITH hq AS ({HQ}), tails AS ({side.format(floor=floor, chars=tail)}), heads AS ({side.format(floor=floor, chars=head)})
    SELECT rid AS read_id, CAST(coalesce(heads.cut, 0) + 1 AS BIGINT) AS first, CAST(length(q) - tails.cut AS BIGINT) AS last,
      length(q) - tails.cut - coalesce(heads.cut, 0) >= 20 AND NOT regexp_matches(substr(s, CAST(coalesce(heads.cut, 0) + 1 AS BIGINT), CAST(length(q) - tails.cut - coalesce(heads.cut, 0) AS BIGINT)), '[^ACGT]') AS kept
    FROM hq JOIN tails USING (rid) LEFT JOIN heads USING (rid)"""


@query("quality_trim", _trim_sql(20))
def quality_trim(spark, d):
    rows = fixture(spark, d, "HQ").withColumn("span", S.quality_span(F.col("q"), 20))
    size = F.col("span.last") - F.col("span.first") + 1
    kept = (size >= 20) & ~F.substring("s", F.col("span.first"), size).rlike("[^ACGT]")
    return rows.select(F.col("rid").alias("read_id"), F.col("span.first").cast("long").alias("first"), F.col("span.last").cast("long").alias("last"), kept.alias("kept"))


@query(
    "cnt2qual",
    f"SELECT rid AS read_id, (SELECT string_agg(chr(CAST(least(126, 17 * (ascii(substr(q, CAST(i AS BIGINT), 1)) - 33) + 33) AS INT)), '' ORDER BY i) FROM (SELECT unnest(generate_series(1, length(q))) AS i) k) AS qual FROM ({HQ}) h",
)
def cnt2qual(spark, d):
    return fixture(spark, d, "HQ").select(F.col("rid").alias("read_id"), S.coverage_quality(F.col("q")).alias("qual"))


@query("collate_pairs", f"SELECT pid * 2 + e AS ord, concat('p', CAST(pid AS VARCHAR)) AS name, e AS mate, CASE WHEN e = 0 THEN r1 ELSE r2 END AS seq FROM (SELECT pid, r1, r2, unnest([0, 1]) AS e FROM ({HP}) p) x")
def collate_pairs(spark, d):
    from strandloom.operators.pairs import collate

    pairs = fixture(spark, d, "HP")
    ends = [pairs.select(F.col("pid").alias("ord"), F.concat(F.lit("p"), F.col("pid").cast("string"), F.lit(f"/{k + 1}")).alias("name"), F.col(f"r{k + 1}").alias("seq")) for k in (0, 1)]
    return collate(*ends).select("ord", "name", "mate", "seq")


BAD = "SELECT DISTINCT rid FROM (SELECT rid, substr(s, CAST(i AS BIGINT), 17) AS m FROM (SELECT rid, s, unnest(generate_series(1, length(s) - 16)) AS i FROM e) a) b WHERE m IN (SELECT m FROM (SELECT substr(s, CAST(i AS BIGINT), 17) AS m FROM (SELECT s, unnest(generate_series(1, length(s) - 16)) AS i FROM e) a2) c GROUP BY m HAVING count(*) = 1)"


@query("unique_kmer_filter", f"WITH e AS ({E}) SELECT rid AS read_id FROM e WHERE NOT regexp_matches(s, '[^ACGT]') AND rid NOT IN ({BAD})")
def unique_kmer_filter(spark, d):
    return K.unique_kmer_filter(fixture(spark, d, "E"), 17).select(F.col("rid").alias("read_id"))


@query("unique_kmer_filter_pairs", f"WITH e AS ({E}), lost AS (SELECT rid // 2 AS p FROM e WHERE regexp_matches(s, '[^ACGT]') OR rid IN ({BAD})) SELECT rid AS read_id FROM e WHERE rid // 2 NOT IN (SELECT p FROM lost)")
def unique_kmer_filter_pairs(spark, d):
    rows = fixture(spark, d, "E").withColumn("pair", F.floor(F.col("rid") / 2))
    return K.unique_kmer_filter(rows, 17, pair_col="pair").select(F.col("rid").alias("read_id"))


def _kmers_sql(fix: str, k: int) -> str:
    return f"SELECT least(m, {RC.format('m')}) AS kmer, count(*) AS n FROM (SELECT substr(s, CAST(i AS BIGINT), {k}) AS m FROM (SELECT s, unnest(generate_series(1, length(s) - {k - 1})) AS i FROM ({fix}) f WHERE length(s) >= {k}) a) b GROUP BY 1"


@query("kmer_spectrum", f"SELECT n AS multiplicity, count(*) AS n FROM ({_kmers_sql(T, 21)}) c GROUP BY 1")
def kmer_spectrum(spark, d):
    return K.spectrum(packed_counts(fixture(spark, d, "T"), 21))


@query("kmer_counts", _kmers_sql(H, 15))
def kmer_counts(spark, d):
    return K.kmer_counts(fixture(spark, d, "H"), 15)


def _in_batches(store: KmerStore, reads) -> KmerStore:
    """All reads in three batches, the first of them twice, as after a run that was cut off."""
    for k in (0, 1, 2, 0):
        store.add(reads.where(F.col("rid") % 3 == k), f"b{k}")
    return store


@query("kmer_store", _kmers_sql(E, 21))
def kmer_store(spark, d):
    """Counts of three batches of reads, kept in buckets and merged into a second store."""
    store = _in_batches(KmerStore(spark, shared_path(spark, "kmers"), 21), fixture(spark, d, "E"))
    return store.merged_into(shared_path(spark, "kmers")).shown()


EXT = f"""SELECT kmer, count(*) FILTER (nx = 'A') AS a, count(*) FILTER (nx = 'C') AS c, count(*) FILTER (nx = 'G') AS g, count(*) FILTER (nx = 'T') AS t, count(*) AS n_total
  FROM (SELECT substr(s, CAST(i AS BIGINT), 17) AS kmer, substr(s, CAST(i + 17 AS BIGINT), 1) AS nx FROM (SELECT concat(s, '$') AS s, unnest(generate_series(1, length(s) - 16)) AS i FROM (SELECT s FROM ({E}) e1 UNION ALL SELECT {RC.format('s')} FROM ({E}) e2) u) a) b GROUP BY 1"""
SOLID = f"""SELECT kmer, CASE WHEN a = m THEN 'A' WHEN c = m THEN 'C' WHEN g = m THEN 'G' ELSE 'T' END AS best, m AS best_n, a + c + g + t - m AS all_rest,
  least(31.0, CASE WHEN a + c + g + t - m > 0 THEN CAST(m AS DOUBLE) / (a + c + g + t - m) ELSE m END) AS r FROM (SELECT *, greatest(a, c, g, t) AS m FROM ({EXT}) x) y WHERE m >= 3"""


@query("extensions", EXT)
def extensions(spark, d):
    return K.extensions(fixture(spark, d, "E"), 17)


@query("next_base_table", f"SELECT kmer, best, best_n, least(all_rest, 7) AS rest, CAST(floor(r + 0.499) AS BIGINT) AS ratio FROM ({SOLID}) z")
def next_base_table(spark, d):
    return K.next_base_table(fixture(spark, d, "E"), 17).select("kmer", "best", "best_n", "rest", "ratio")


@query("next_base_store", ORACLES["next_base_table"])
def next_base_store(spark, d):
    """The table of next bases from three kept batches."""
    store = _in_batches(KmerStore(spark, shared_path(spark, "kmers"), 17, kind=NEXT), fixture(spark, d, "E"))
    return store.next_base_table().select("kmer", "best", "best_n", "rest", "ratio")


@query("unique_filter_store", ORACLES["unique_kmer_filter"])
def unique_filter_store(spark, d):
    """Reads whose k-mers all occur twice in three kept batches."""
    reads = fixture(spark, d, "E")
    store = _in_batches(KmerStore(spark, shared_path(spark, "kmers"), 17, both=False), reads)
    return store.unique_filter(reads).select(F.col("rid").alias("read_id"))


@query("solid_stats", f"SELECT count(*) FILTER (all_rest <= 7 AND r >= 3) AS informative, count(*) FILTER (NOT (all_rest <= 7 AND r >= 3)) AS ambiguous FROM ({SOLID}) z")
def solid_stats(spark, d):
    return K.solid_stats(K.next_base_table(fixture(spark, d, "E"), 17))


BOTH = f"(SELECT rid * 2 AS oid, s AS seq FROM ({H}) h1 UNION ALL SELECT rid * 2 + 1, {RC.format('s')} FROM ({H}) h2)"
SUF = f"SELECT oid, translate(substr(seq, CAST(pos AS BIGINT)), 'N', 'Z') AS suffix, CASE WHEN pos > 1 THEN substr(seq, CAST(pos - 1 AS BIGINT), 1) ELSE '$' END AS sym FROM (SELECT oid, seq, unnest(generate_series(1, length(seq) + 1)) AS pos FROM {BOTH} b) c"
ROWS = f"SELECT row_number() OVER (ORDER BY suffix, oid) - 1 AS row, sym FROM ({SUF}) s"


def _both(spark, d):
    return X.both_strands(fixture(spark, d, "H"))


@query("symbol_counts", f"SELECT sym, n, coalesce(sum(n) OVER (ORDER BY CASE sym WHEN '$' THEN ' ' WHEN 'N' THEN 'Z' ELSE sym END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum FROM (SELECT x.s AS sym, count(b.sym) AS n FROM (VALUES ('$'), ('A'), ('C'), ('G'), ('T'), ('N')) x(s) LEFT JOIN ({SUF}) b ON b.sym = x.s GROUP BY 1) q")
def symbol_counts(spark, d):
    return X.symbol_counts(_both(spark, d))


@query("bwt_rows", ROWS)
def bwt_rows(spark, d):
    return X.bwt(_both(spark, d))


@query("bwt_runs", f'SELECT min("row") AS start, sym, count(*) AS len FROM (SELECT *, sum(h) OVER (ORDER BY "row") AS g FROM (SELECT *, CASE WHEN lag(sym) OVER (ORDER BY "row") = sym THEN 0 ELSE 1 END AS h FROM ({ROWS}) r) a) b GROUP BY g, sym')
def bwt_runs(spark, d):
    return X.bwt_runs(X.bwt(_both(spark, d)))


@query("rank_check", f"SELECT sym, count(*) AS n, count(*) AS expected FROM ({SUF}) s GROUP BY 1 UNION ALL SELECT 'N', NULL, 0")
def rank_check(spark, d):
    both = _both(spark, d)
    return X.rank_errors(X.bwt(both), X.symbol_counts(both))


PAT = f"SELECT DISTINCT substr(s, 9, 12) AS pattern FROM ({H}) h"


@query("backward_search", f"WITH suf AS ({SUF}), pat AS ({PAT}), ranked AS (SELECT pattern, row_number() OVER (ORDER BY k, oid) AS r FROM (SELECT suffix AS k, oid, NULL AS pattern FROM suf UNION ALL SELECT pattern, -1, pattern FROM pat) u), lows AS (SELECT pattern, r - row_number() OVER (ORDER BY r) AS lo FROM ranked WHERE pattern IS NOT NULL) SELECT pattern, lo, count(m) AS n FROM lows LEFT JOIN (SELECT substr(suffix, 1, 12) AS m FROM suf) x ON m = pattern GROUP BY 1, 2")
def backward_search(spark, d):
    reads = fixture(spark, d, "H")
    return X.intervals(X.both_strands(reads), reads.select(F.substring("s", 9, 12).alias("pattern")).distinct())


@query(
    "multi_search",
    f"WITH suf AS (SELECT (rid // 6) % 3 AS source, s AS seq FROM ({H}) h1 UNION ALL SELECT (rid // 6) % 3, {RC.format('s')} FROM ({H}) h2), pat AS ({PAT} UNION SELECT DISTINCT substr(s, 20, 17) FROM ({H}) h3), w AS (SELECT source, substr(seq, pos, k) AS pattern FROM (SELECT source, seq, k, unnest(generate_series(1, 61 - k)) AS pos FROM suf, (SELECT unnest([12, 17]) AS k) l) x), "
    "hits AS (SELECT source, pattern, count(*) AS n FROM w WHERE pattern IN (SELECT pattern FROM pat) GROUP BY 1, 2) SELECT s.source, pat.pattern, coalesce(n, 0) AS n FROM pat CROSS JOIN (SELECT unnest([0, 1, 2]) AS source) s LEFT JOIN hits ON hits.source = s.source AND hits.pattern = pat.pattern",
)
def multi_search(spark, d):
    """Patterns of two lengths counted in each of three collections."""
    reads = fixture(spark, d, "H").withColumn("source", (F.floor(F.col("rid") / 6) % 3).cast("int"))
    patterns = reads.select(F.explode(F.array(F.substring("s", 9, 12), F.substring("s", 20, 17))).alias("pattern")).distinct()
    return X.occurrences_by_source(X.both_strands(reads, "rid", "s", "source"), patterns, "source")


DUPS = f"SELECT rid, substr(s, 1, CASE WHEN rid % 7 = 1 THEN 0 ELSE 60 END) || CASE WHEN rid % 7 = 1 THEN p ELSE '' END AS s FROM (SELECT a.rid, a.s, coalesce(b.s, a.s) AS p FROM ({H}) a LEFT JOIN ({H}) b ON b.rid = a.rid - 1) j"


@query("seq_rank", f"SELECT row_number() OVER (ORDER BY translate(seq, 'N', 'Z'), oid) - 1 AS rank, oid AS oriented_id, row_number() OVER (PARTITION BY seq ORDER BY oid) > 1 AS dup FROM (SELECT rid * 2 AS oid, s AS seq FROM ({DUPS}) h1 UNION ALL SELECT rid * 2 + 1, {RC.format('s')} FROM ({DUPS}) h2) b")
def seq_rank(spark, d):
    reads = fixture(spark, d, "H")
    before = reads.select((F.col("rid") + 1).alias("rid"), F.col("s").alias("p"))
    rows = reads.join(before, "rid", "left").select("rid", F.when(F.col("rid") % 7 == 1, F.coalesce("p", "s")).otherwise(F.col("s")).alias("s"))
    return X.sequence_rank(X.both_strands(rows))


@query("seq_rank_tallies", f"WITH b AS (SELECT rid * 2 AS oid, s AS seq FROM ({DUPS}) h1 UNION ALL SELECT rid * 2 + 1, {RC.format('s')} FROM ({DUPS}) h2) SELECT count(*) AS n, count(*) FILTER (oid % 9 = 4) AS n_contained, count(*) - count(DISTINCT seq) AS n_dup FROM b")
def seq_rank_tallies(spark, d):
    reads = fixture(spark, d, "H")
    before = reads.select((F.col("rid") + 1).alias("rid"), F.col("s").alias("p"))
    rows = reads.join(before, "rid", "left").select("rid", F.when(F.col("rid") % 7 == 1, F.coalesce("p", "s")).otherwise(F.col("s")).alias("s"))
    both = X.both_strands(rows)
    return X.rank_tallies(X.sequence_rank(both, both.where("oriented_id % 9 = 4").select("oriented_id")))


@query("length_quantile", f"SELECT 0.25::DOUBLE AS q, CAST(len AS BIGINT) AS len FROM (SELECT length(s) AS len, row_number() OVER (ORDER BY length(s)) - 1 AS i, count(*) OVER () AS n FROM ({T}) t) x WHERE i = floor(n * 0.25)")
def length_quantile(spark, d):
    return X.length_quantile(fixture(spark, d, "T"), 0.25)


SAMPLES = f"SELECT oid, seq, (oid // 2) // 6 AS id FROM {BOTH} b"


@query("merge_collections", f"SELECT oid AS oriented_id FROM {BOTH} b UNION ALL SELECT oid FROM {BOTH} c WHERE (oid // 12) % 2 = 0")
def merge_collections(spark, d):
    both = _both(spark, d)
    return both.select("oriented_id").unionAll(both.where(F.floor(F.col("oriented_id") / 12) % 2 == 0).select("oriented_id"))


def _selections(both):
    return [both.where(F.col("oriented_id").bitwiseAND(F.lit(bit)) == 0).select("oriented_id") for bit in (4, 8)]


@query("bitand", f"SELECT oid AS oriented_id FROM {BOTH} b WHERE (oid // 4) % 2 = 0 AND (oid // 8) % 2 = 0")
def bitand(spark, d):
    a, b = _selections(_both(spark, d))
    return a.intersect(b)


@query("sub", f"SELECT oid AS oriented_id, seq FROM {BOTH} b WHERE (oid // 4) % 2 = 0")
def sub(spark, d):
    both = _both(spark, d)
    return both.join(_selections(both)[0], "oriented_id", "left_semi")


@query("sub_complement", f"SELECT oid AS oriented_id, seq FROM {BOTH} b WHERE (oid // 4) % 2 = 1")
def sub_complement(spark, d):
    both = _both(spark, d)
    return both.join(_selections(both)[0], "oriented_id", "left_anti")


def _contrast_sql(sizes: str = "SELECT 31 AS l") -> str:
    km = f"SELECT g, oid, substr(seq, CAST(i AS BIGINT), l) AS m FROM (SELECT CASE WHEN id % 3 < 2 THEN 'a' ELSE 'b' END AS g, oid, seq, l, unnest(generate_series(1, length(seq) - l + 1)) AS i FROM s, ({sizes}) z) x"
    shared = "SELECT oid, seq, id FROM base UNION ALL SELECT oid + 1000000000, seq, id + 1 FROM base WHERE id % 3 = 1"
    return f"WITH base AS ({SAMPLES}), s AS ({shared}), km AS ({km}), c AS (SELECT m, count(*) FILTER (g = 'a') AS na, count(*) FILTER (g = 'b') AS nb FROM km GROUP BY 1) SELECT DISTINCT g AS sample, oid AS oriented_id FROM km JOIN c USING (m) WHERE (g = 'a' AND na >= 3 AND nb = 0) OR (g = 'b' AND nb >= 3 AND na = 0)"


def _samples(spark, d):
    both = _both(spark, d).withColumn("id", F.floor(F.col("oriented_id") / 12))
    a = both.where("id % 3 < 2").select("oriented_id", "seq")
    shared = both.where("id % 3 = 1").select((F.col("oriented_id") + 1000000000).alias("oriented_id"), "seq")
    return a, both.where("id % 3 = 2").select("oriented_id", "seq").unionAll(shared)


@query("contrast", _contrast_sql())
def contrast(spark, d):
    return K.contrast(*_samples(spark, d), 31)


@query("contrast_exact", _contrast_sql("SELECT unnest(generate_series(4, 14)) AS l"))
def contrast_exact(spark, d):
    """Strings with any string of 4 to 14 bases that is special to their sample."""
    return K.contrast(*_samples(spark, d), 14, exact=True)
