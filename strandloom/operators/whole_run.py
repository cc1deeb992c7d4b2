"""From read pairs to broken scaftigs in one call, as stages that are kept: a second run takes up where the first one ended."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequences import auto_k
from strandloom.operators import coverage as C
from strandloom.operators.assembly import correct_all, unitig_graph
from strandloom.operators.cleaning import Cleaning, clean
from strandloom.operators.correct import keep_good
from strandloom.operators.graph import a_statistic
from strandloom.operators.kmers import unique_kmer_filter
from strandloom.operators.patching import patch_gaps
from strandloom.operators.scaffold import scaftigs
from strandloom.session import shared_path


@dataclass(frozen=True)
class Rules:
    """What a run goes by. insert, (mean, deviation), is measured where it is None; without min_a, contigs join whatever their A-statistic is."""

    min_overlap: int = 50
    seed: int = 31
    correct: bool = True
    cleaning: tuple[Cleaning, ...] = (Cleaning(), Cleaning(aggressive=True))
    insert: tuple[float, float] | None = None
    max_insert: int = 1000
    min_links: int = 5
    min_a: float | None = 20.0
    min_p: float = 1e-20
    skip: int = 50
    min_cov: int = 2


class Stages:
    """Tables of stages in a folder that all executors share.

    A table's key is made of its stage's name, its parameters and the keys of the tables it reads, so it is found again by a run that would make the same one, and
    by no other. Spark writes the marker _SUCCESS once all tasks are committed; a folder without it is what is left of a lost run and is written anew. made names the stages that this run made.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.made, self.keys = spark, root.rstrip("/"), [], {}

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def given(self, name: str, key: object) -> None:
        """An input that isn't made here, known by key."""
        self.keys[name] = hashlib.sha256(json.dumps([name, key]).encode()).hexdigest()

    def table(self, name: str, reads: tuple[str, ...], parameters: object, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, made by make() unless it is there."""
        key = hashlib.sha256(json.dumps([name, parameters, [self.keys[r] for r in reads]], sort_keys=True).encode()).hexdigest()
        self.keys[name], path = key, f"{self.root}/{name}-{key[:32]}"
        if not self._exists(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)


def digest(reads: DataFrame) -> list:
    """Count and sums over (rid, s) that tell tables of other reads apart, in whatever order their rows are."""
    h = F.xxhash64("rid", "s")
    return list(reads.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit((1 << 31) - 1))), F.sum(F.length("s"))).first())


def _kept(reads: DataFrame, correct: bool) -> DataFrame:
    reads = reads.select("rid", F.upper("s").alias("s"))
    if not correct:
        return reads
    total = reads.agg(F.coalesce(F.sum(F.length("s")), F.lit(0)).alias("n"))
    w, k = total.select(auto_k(F.greatest("n", F.lit(1)), 8.499, 1, 27), auto_k(F.greatest("n", F.lit(1)), 1.499, 15, 18)).first()
    good = keep_good(correct_all(reads, w), paired=True).select(F.col("read_id").alias("rid"), F.upper("seq").alias("s"))
    return unique_kmer_filter(good.withColumn("pair", F.shiftright("rid", 1)), k, pair_col="pair").select("rid", "s")


def _broken(parts: DataFrame, reads: DataFrame, rules: Rules, most: int) -> DataFrame:
    """(id, seq, n_unitigs, nsr) of scaftigs (contig, seq, ...) cut where fewer than min_cov pairs lie across."""
    hits = C.full_length_hits(parts, reads, rules.seed)
    runs = C.depth(C.paired_spans(C.mate_pairs(hits, most), rules.skip))
    cuts = C.break_contigs(parts.select("contig", "seq"), runs, rules.min_cov, rules.skip)
    rows = cuts.join(parts, "contig").where("end > beg")
    return rows.select(F.concat_ws("_", "contig", "part").alias("id"), F.expr("substring(seq, beg + 1, end - beg)").alias("seq"), "n_unitigs", "nsr")


def reads_to_scaftigs(reads: DataFrame, rules: Rules = Rules(), *, folder: str | None = None, source: str | None = None, stages: Stages | None = None) -> DataFrame:
    """(id, seq, n_unitigs, nsr): scaftigs of read pairs (rid, s), mates being 2p and 2p + 1, cut where no pairs hold them together.

    Correction and the filter of rare k-mers, unitigs, cleaning, reads placed on contigs, insert sizes (a table of one row), links between contig ends without those that a contig in
    between explains, patches, paths through patches, and breaks. Every stage is a table in folder (a new one below spark.checkpoint.dir if it isn't given); a run on the same
    reads takes what is there and goes on from the first stage that is missing or has other parameters. source names the reads; without it their digest does, at the cost of reading them once.

    Pairs too far apart or on no contig make no inserts; without inserts the contigs are returned as they are, each as a scaftig of its own. Reads shorter than the seed are placed nowhere. No reads give no rows.
    """
    spark = reads.sparkSession
    stages = stages or Stages(spark, folder or shared_path(spark, "run"))
    stages.given("raw", source or digest(reads))
    raw = stages.table("reads", ("raw",), rules.correct, lambda: _kept(reads, rules.correct))
    names = {"vertices": 0, "edges": 1}
    made: dict[str, tuple[DataFrame, DataFrame]] = {}

    def graph(name: str, make: Callable[[], tuple[DataFrame, DataFrame]], before: tuple[str, ...], parameters: object) -> tuple[DataFrame, DataFrame]:
        def part(k: int) -> DataFrame:
            if name not in made:
                made[name] = make()
            return made[name][k]

        return tuple(stages.table(f"{name}_{side}", before, parameters, lambda k=k: part(k)) for side, k in names.items())  # type: ignore[return-value]

    v, e = graph("unitigs", lambda: unitig_graph(raw, rules.min_overlap), ("reads",), rules.min_overlap)
    last = "unitigs"
    for n, cleaning in enumerate(rules.cleaning):
        now = (v, e)
        v, e = graph(f"clean{n}", lambda now=now, cleaning=cleaning: clean(*now, cleaning), (f"{last}_vertices", f"{last}_edges"), asdict(cleaning))
        last = f"clean{n}"

    def known() -> DataFrame:
        most = e.groupBy(F.shiftright("a", 1).alias("id")).agg(F.max("ovlp").alias("maxo"))
        rows = v.select("id", "len", "nsr", "seq").join(most, "id", "left").withColumn("maxo", F.coalesce("maxo", F.lit(0)).cast("long"))
        sure = a_statistic(rows.select("id", "len", "nsr", "maxo"))
        return rows.join(sure, "id", "left").select(F.col("id").alias("contig"), "seq", "len", "nsr", "a")

    contigs = stages.table("contigs", (f"{last}_vertices", f"{last}_edges"), None, known)
    placed = raw.select(F.col("rid").alias("read_id"), F.col("s").alias("seq"))
    hits = stages.table("hits", ("contigs", "reads"), rules.seed, lambda: C.full_length_hits(contigs.select("contig", "seq"), placed, rules.seed))
    inserts = stages.table("inserts", ("hits",), rules.max_insert, lambda: C.insert_stats(C.mate_pairs(hits, rules.max_insert)))
    if rules.insert:
        avg, std = map(float, rules.insert)
    else:
        found = inserts.first()
        if not found.n:
            return contigs.select(F.concat_ws("_", "contig", F.lit(1)).alias("id"), "seq", F.lit(1).cast("long").alias("n_unitigs"), "nsr")
        avg, std = found.avg, found.std
    reach, most = int(avg + 2 * std + 0.499), int(avg + 2 * std + 1.499)
    sized = [avg, std]

    def ends() -> DataFrame:
        sure = contigs if rules.min_a is None else contigs.where(F.col("a") >= rules.min_a)
        open_ = hits.join(C.unpaired_hits(hits, rules.max_insert), ["contig", "read_id", "beg", "end"], "left_semi")
        return open_.join(sure.select("contig", "len"), "contig")

    places = stages.table("places", ("hits", "contigs"), [rules.max_insert, rules.min_a], ends)

    def tied() -> DataFrame:
        best = C.resolve_contained(C.best_links(C.mate_links(places, reach)), contigs, avg, std)
        return C.reciprocal_best(best, rules.min_links)

    links = stages.table("links", ("places", "contigs", "inserts"), [*sized, rules.min_links], tied)

    def closed() -> DataFrame:
        read_len = int(raw.agg(F.coalesce(F.avg(F.length("s")), F.lit(0))).first()[0] + 0.5)
        return patch_gaps(links, contigs.select("contig", "seq"), C.end_reads(places, reach), placed, avg, std, reach, read_len)

    patches = stages.table("patches", ("links", "places", "contigs", "reads"), sized, closed)

    def joined() -> DataFrame:
        own = contigs.select("contig", "seq", "nsr", *(["a"] if rules.min_a is not None else []))
        found = scaftigs(own, links.join(patches, ["end_a", "end_b"]), int(avg + 0.5), rules.min_a or 0.0, rules.min_p, patched_only=True)
        return found.select(F.monotonically_increasing_id().alias("contig"), "seq", "n_unitigs", "nsr")

    parts = stages.table("scaftigs", ("contigs", "links", "patches"), [*sized, rules.min_a, rules.min_p], joined)
    return stages.table("broken", ("scaftigs", "reads", "inserts"), [*sized, rules.seed, rules.skip, rules.min_cov], lambda: _broken(parts, placed, rules, most))
