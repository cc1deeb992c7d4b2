"""Read correction against a table of solid k-mers: a best-first search in both directions."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequences import revcomp, windows
from strandloom.operators import packed as P
from strandloom.session import Scratch

#: Penalties of the search (fixed values): per unit of difference, for a ratio, for a context that isn't known; states held; score gap.
DIFFERENCE, RATIO, MISS, STATES, GAP = 13, 10, 10, 256, 60
#: The score difference of a read that can't be searched.
NO_SEARCH = 0
RAISED, CHANGED = 37, 36
FLIP = str.maketrans("ACGTacgt", "TGCAtgca")


def search(seq: str, qual: list[int], solid: dict, w: int, asks: dict | None = None) -> tuple[str, list[int], int, int, bool]:
    """One pass from left to right: (sequence, qualities, quality sum of changes, score difference, any context known).

    The context is the w bases before a position. A context's most frequent next base is free, keeping another base
    or going on without a known context has a price, and the cheapest way through the read wins.

    With asks, solid holds only some contexts (None for one that isn't solid). Others that the search meets are put into asks, with those that
    follow them along the read, and priced as a miss for now; the result holds where asks stays empty.
    """
    start = next((i for i in range(w, len(seq) + 1) if "N" not in seq[i - w : i]), None)
    if start is None or start >= len(seq):
        return seq, qual, 0, NO_SEARCH, False
    heap, order, done, known = [(0, 0, start, seq[start - w : start], None)], 1, [], False
    while heap:
        score, _, at, context, path = heapq.heappop(heap)
        if done and score > done[0][0] + GAP:
            break
        if at == len(seq):
            done.append((score, path))
            if len(done) == 2:
                break
            continue
        if not heap:
            # One way is left: go on as long as the table agrees with the read, which is free.
            begin = at
            while at < len(seq) and (found := solid.get(context)) is not None and found[0] == seq[at]:
                context = context[1:] + seq[at]
                at += 1
            if at > begin:
                known, path = True, (path, begin, at)
            if at == len(seq):
                done.append((score, path))
                break
        base, q = seq[at], min(40, max(3, qual[at] - 33))
        steps, found = [], solid.get(context)
        if asks is not None and found is None and context not in solid and context not in asks:
            ahead = context + seq[at : len(seq) - 1]
            asks.update((c, None) for i in range(len(ahead) - w + 1) if (c := ahead[i : i + w]) not in solid)
        if found is None:
            steps.append((base, score + MISS + 40 - q, False))
        else:
            known = True
            best, ratio, rest = found
            if best == base:
                steps.append((base, score, True))
            else:
                whole = rest * ratio if rest else ratio
                keep = max(1, min(DIFFERENCE * (whole - rest) if whole - rest >= 1 else 1, RATIO * ratio if rest else 10_000, DIFFERENCE * (7 - rest)))
                steps.append((best, score + q, True))
                if base != "N":
                    steps.append((base, score + keep, True))
                if len(heap) + len(steps) > STATES:
                    steps = [min(steps, key=lambda s: s[1])]
        for new, price, hit in steps:
            heapq.heappush(heap, (price, order, at + 1, (context + new)[-w:], (path, at, new, hit and new == base)))
            order += 1
    if not done:
        return seq, qual, 0, NO_SEARCH, known
    gap = min(GAP, done[1][0] - done[0][0]) if len(done) > 1 else GAP
    score, path = done[0]
    if not score:
        return seq, qual, 0, gap, known
    bases, quals, changed = list(seq), list(qual), 0
    while path is not None:
        if len(path) == 3:
            path, begin, end = path
            for at in range(begin, end):
                quals[at] = max(quals[at], RAISED)
            continue
        path, at, new, supported = path
        if new != seq[at]:
            changed += qual[at] - 33
            bases[at] = new
        elif supported:
            quals[at] = max(quals[at], RAISED)
    return "".join(bases), quals, changed, gap, known


def correct_one(seq: str, qual: str | None, solid: dict, w: int, max_changed: float, default: int, asks: dict | None = None) -> tuple[str, str, int, int, int, bool]:
    """(sequence with changed bases in lower case, qualities, bases changed, quality sum, score difference, bad)."""
    seq = seq.upper()
    quals = [ord(c) for c in qual] if qual else [default + 33] * len(seq)
    back, quals_back, sum1, gap1, known1 = search(seq[::-1].translate(FLIP), quals[::-1], solid, w, asks)
    new, quals_new, sum2, gap2, known2 = search(back[::-1].translate(FLIP), quals_back[::-1], solid, w, asks)
    differs = [a != b for a, b in zip(seq, new, strict=True)]
    n = sum(differs)
    bad = not seq or n / len(seq) > max_changed or min(gap1, gap2) <= 10 or not (known1 or known2)
    shown = "".join(b.lower() if d else b for b, d in zip(new, differs, strict=True))
    return shown, "".join(chr(CHANGED if d else min(q, 126)) for q, d in zip(quals_new, differs, strict=True)), n, sum1 + sum2, min(gap1, gap2), bad


def correct_reads(reads: DataFrame, solid: DataFrame, w: int, *, id_col: str = "rid", seq_col: str = "s", qual_col: str | None = None, max_changed: float = 0.3, default_quality: int = 15) -> DataFrame:
    """(read_id, seq, qual, n_changed, quality_sum, difference, bad) of every read.

    solid: (kmer, best, ratio, rest). The table stays where it is, whatever its size. A read whose every base is the best one after its context, on
    both strands, stays as it is, which one join of packed pieces tells. The contexts of the others are joined to the table, and the read is searched
    with what was found. A read whose search meets a context that it has not looked up, because of a changed base, asks for it and is searched again,
    until no read asks. A read without a sequence is bad.
    """
    out = "read_id long, seq string, qual string, n_changed int, quality_sum int, difference int, bad boolean"
    scratch, names = Scratch(reads.sparkSession, "correct"), [f.split()[0] for f in out.split(", ")]
    held = "array<struct<kmer: string, best: string, ratio: int, rest: int>>"
    packed = w < P.MOST
    key = F.when(F.col("kmer").rlike(f"^[ACGT]{{{w}}}$"), P.number(F.col("kmer"))) if packed else F.col("kmer")
    rows = reads.select(F.col(id_col).cast("long").alias("read_id"), F.col(seq_col).alias("seq"), (F.col(qual_col) if qual_col else F.lit(None).cast("string")).alias("qual"))
    rows = scratch.put("rows", rows.select(F.monotonically_increasing_id().alias("row"), "*"))
    table = scratch.put("table", solid.select(key.alias("key"), "kmer", "best", F.col("ratio").cast("int").alias("ratio"), F.col("rest").cast("int").alias("rest")))
    upper = F.upper(F.coalesce("seq", F.lit("")))

    def strands(some: DataFrame) -> DataFrame:
        return some.select("row", F.explode(F.array(upper, revcomp(upper))).alias("s"))

    def contexts(some: DataFrame) -> DataFrame:
        """(row, key): the contexts of reads, on both strands."""
        if packed:
            return P.packed_rows(strands(some), w, "row").withColumnRenamed("code", "key")
        return strands(some).select("row", F.explode(F.array_distinct(windows(F.col("s"), w))).alias("key")).where(~F.col("key").contains("N"))

    settled_rows = None
    if packed:
        best = table.select((F.col("key") * 4 + F.instr(F.lit("ACGT"), F.col("best")) - 1).alias("code"))
        odd = P.packed_rows(strands(rows), w + 1, "row").join(best, "code", "left_anti").select("row").distinct()
        plain = upper.rlike("^[ACGT]+$") & (F.length("seq") > w)
        plain &= (F.coalesce(F.length("qual"), F.lit(0)) == 0) | ((F.length("qual") == F.length("seq")) & F.col("qual").rlike(r"^[\x00-\x7e]*$"))
        told = scratch.put("told", rows.join(odd.withColumn("odd", F.lit(True)), "row", "left").withColumn("odd", F.coalesce("odd", F.lit(False)) | ~F.coalesce(plain, F.lit(False))))
        own_quality = F.coalesce(F.when(F.length("qual") > 0, F.col("qual")), F.repeat(F.lit(chr(default_quality + 33)), F.length("seq")))
        unchanged = [F.lit(0).alias("n_changed"), F.lit(0).alias("quality_sum"), F.lit(GAP).alias("difference"), F.lit(max_changed < 0).alias("bad")]
        settled_rows = told.where("NOT odd").select("read_id", upper.alias("seq"), own_quality.alias("qual"), *unchanged)
        rows = told.where("odd").drop("odd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, found, asked = [c.to_pylist() for c in batch.columns[2:]], [], []
            for s, q, known in zip(*columns, strict=True):
                s, asks = (s or "").upper(), {}
                both = (s, s[::-1].translate(FLIP))
                here = {x[i : i + w]: None for x in both for i in range(len(s) - w + 1)}  # looked up, and not solid unless it was found
                here.update((e["kmer"], None if e["best"] is None else (e["best"], e["ratio"], e["rest"])) for e in known or ())
                found.append(correct_one(s, q, here, w, max_changed, default_quality, asks))
                asked.append(list(asks))
            fixed = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))]
            again = pa.array([k if asks else None for k, asks in enumerate(asked)], pa.int32())  # what reads that ask are searched with next time
            yield pa.RecordBatch.from_arrays([batch.column(1), *fixed, batch.column(0), pa.array(asked, pa.list_(pa.string())), *(c.take(again) for c in batch.columns[2:])], [*names, "row", "asks", "own_seq", "own_qual", "known"])

    shown = F.collect_list(F.struct("kmer", "best", "ratio", "rest")).cast(held)

    known = contexts(rows).join(table, "key").groupBy("row").agg(shown.alias("known"))
    open_reads, done, turn = rows.join(known, "row", "left"), settled_rows, 0
    while True:
        tried = scratch.put(f"tried{turn}", open_reads.mapInArrow(run, f"{out}, row long, asks array<string>, own_seq string, own_qual string, known {held}"))
        settled = tried.where(F.size("asks") == 0).select(*names)
        done = settled if done is None else done.unionAll(settled)
        asking = tried.where(F.size("asks") > 0)
        if asking.isEmpty():
            scratch.drop("rows", "table")
            return done
        asks = asking.select("row", F.explode("asks").alias("kmer"))
        # The table is on the side that a few asks are broadcast to, where Spark finds them small; what it doesn't hold is kept as looked up.
        answers = table.drop("key").join(asks.select("kmer").distinct(), "kmer")
        more = asks.join(answers, "kmer", "left").groupBy("row").agg(shown.alias("more"))
        before = asking.select("row", "read_id", F.col("own_seq").alias("seq"), F.col("own_qual").alias("qual"), F.coalesce("known", F.array().cast(held)).alias("known"))
        open_reads = before.join(more, "row").select("row", "read_id", "seq", "qual", F.concat("known", "more").alias("known"))
        turn += 1


def keep_good(corrected: DataFrame, paired: bool = False) -> DataFrame:
    """Corrected reads that aren't bad; of pairs (2p, 2p + 1) both or none."""
    if not paired:
        return corrected.where("NOT bad")
    from strandloom.operators.pairs import drop_broken_pairs

    marked = corrected.withColumn("good", ~F.col("bad")).withColumn("pair", F.shiftright("read_id", 1))
    return drop_broken_pairs(marked, "good").drop("good", "pair")
