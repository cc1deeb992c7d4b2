"""Merging and cleaning of assembly graphs in synchronous rounds.

vertices: (id, len, nsr, seq) and cov, if known: a character of 33 + depth for each base, as in MAG records; edges: (a, b, ovlp) between oriented vertices 2 * id + strand, in both directions.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators import graph as Gr
from strandloom.operators.align import align
from strandloom.operators.chains import chain_positions, unambiguous
from strandloom.session import Scratch, cut_lineage

#: The deepest that a coverage character tells.
MOST_DEEP = 93


@dataclass(frozen=True)
class Cleaning:
    """Defaults of the schedule."""

    rounds: int = 3
    tip_len: int = 300
    min_overlap: int = 60
    tip_nsr: int = 4
    inner_nsr: int = 3
    bubble_vertices: int = 64
    bubble_dist: int = 512
    simplify: bool = True
    reference_ramp: bool = False
    ratio: float = 0.8
    bubble_cov: float = 10.0
    bubble_share: float = 0.15
    aggressive: bool = False


def with_coverage(vertices: DataFrame) -> DataFrame:
    """Vertices with cov; bases of a vertex without one are one read deep, as the reference reads records without qualities."""
    known = F.col("cov") if "cov" in vertices.columns else F.lit(None).cast("string")
    return vertices.withColumn("cov", F.coalesce(known, F.repeat(F.lit('"'), F.length("seq"))))


def depths(cov: Column) -> Column:
    return F.transform(F.filter(F.split(cov, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def summed_coverage(placed: DataFrame) -> DataFrame:
    """(id, cov) of coverage strings placed at a start (new_id, start, cov): depths add up base by base, up to MOST_DEEP.

    Runs of one depth are two changes each, so an even string of any length is two rows; a running sum gives the depth between changes.
    """
    each, none = depths(F.col("cov")), F.array(F.lit(0))
    changes = F.zip_with(F.concat(each, none), F.concat(none, each), lambda now, before: now - before)
    steps = placed.where(F.length("cov") > 0).select("new_id", "start", F.posexplode(changes).alias("at", "step")).where("step <> 0")
    events = steps.groupBy("new_id", (F.col("start") + F.col("at")).alias("at")).agg(F.sum("step").alias("step"))
    order = Window.partitionBy("new_id").orderBy("at")
    runs = events.select("new_id", "at", F.sum("step").over(order).alias("depth"), (F.lead("at").over(order) - F.col("at")).alias("n")).where("n IS NOT NULL")
    shown = F.expr(f"repeat(char(33 + least(depth, {MOST_DEEP})), cast(n AS int))")
    joined = runs.groupBy(F.col("new_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("at", shown.alias("part")))).alias("ps"))
    return joined.select("id", F.array_join("ps.part", "").alias("cov"))


def merge_graph(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every maximal unambiguous path as one vertex, named by its first; nsr and, base by base, cov (up to MOST_DEEP) add up, sequences are joined over their overlaps."""
    vertices = with_coverage(vertices)
    one = F.lit(1).cast("long")
    steps = cut_lineage(unambiguous(edges.where("floor(a / 2) <> floor(b / 2)")).select("a", "b", F.col("ovlp").alias("step")))
    if steps.isEmpty():
        return vertices.select("id", "len", "nsr", "seq", "cov"), cut_lineage(Gr.dedupe_edges(edges))
    placed = chain_positions(steps).select("node", "chain", "position")
    every = vertices.select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("node"))
    alone = every.join(placed, "node", "left_anti").select("node", F.col("node").alias("chain"), F.lit(0).cast("long").alias("position"))
    placed = cut_lineage(placed.unionAll(alone))
    ends = placed.groupBy("chain").agg(F.max_by("node", "position").alias("last"))
    # Both strands of a path are chains, as are both of a cycle, which start at one vertex's strands: one stands for both.
    mates = ends.select(F.col("chain").bitwiseXOR(one).alias("chain"), F.lit(True).alias("same_vertex"))
    stands = F.when(F.col("same_vertex"), F.col("chain") % 2 == 0).otherwise(F.col("chain") <= F.col("last").bitwiseXOR(one))
    kept = cut_lineage(ends.join(mates, "chain", "left").where(stands).select("chain", "last", F.floor(F.col("chain") / 2).alias("id")))
    own = placed.join(kept.select("chain", F.col("id").alias("new_id")), "chain").join(steps.select(F.col("b").alias("node"), F.col("step").alias("ovlp")), "node", "left")
    own = own.join(vertices, F.floor(F.col("node") / 2) == F.col("id"))
    over = F.when(F.col("position") == 0, 0).otherwise(F.coalesce("ovlp", F.lit(0)))
    shown = F.when(F.col("node") % 2 == 0, F.col("seq")).otherwise(F.reverse(F.translate("seq", "ACGT", "TGCA")))
    parts = own.select("new_id", "nsr", (F.col("len") - over).alias("len"), F.struct("position", F.substring(shown, over + 1, F.length("seq")).alias("part")).alias("p"))
    merged = parts.groupBy(F.col("new_id").alias("id")).agg(F.sum("len").alias("len"), F.sum("nsr").alias("nsr"), F.array_sort(F.collect_list("p")).alias("ps"))
    merged = merged.select("id", "len", "nsr", F.array_join(F.transform("ps", lambda p: p["part"]), "").alias("seq"))
    new = F.col("id") * 2
    reach = F.sum(F.col("len") - over).over(Window.partitionBy("new_id").orderBy("position"))
    turned = F.when(F.col("node") % 2 == 0, F.col("cov")).otherwise(F.reverse("cov"))
    starts = own.select("new_id", (reach - F.col("len")).alias("start"), turned.alias("cov"))
    merged = merged.join(summed_coverage(starts), "id", "left")
    sources = kept.select(F.explode(F.array(F.struct(F.col("last").alias("old"), new.alias("new")), F.struct(F.col("chain").bitwiseXOR(one).alias("old"), (new + 1).alias("new")))).alias("x")).select("x.*").distinct()
    targets = kept.select(F.explode(F.array(F.struct(F.col("chain").alias("old"), new.alias("new")), F.struct(F.col("last").bitwiseXOR(one).alias("old"), (new + 1).alias("new")))).alias("x")).select("x.*").distinct()
    left = edges.join(sources.withColumnRenamed("old", "a").withColumnRenamed("new", "na"), "a").join(targets.withColumnRenamed("old", "b").withColumnRenamed("new", "nb"), "b")
    # The edges within kept paths, in both directions; a cycle's last edge isn't among them and stays, as an edge of the vertex to itself.
    used = steps.join(placed.where("position > 0").join(kept.select("chain"), "chain", "left_semi").select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    inner = used.unionAll(used.select(F.col("b").bitwiseXOR(one).alias("a"), F.col("a").bitwiseXOR(one).alias("b"))).distinct()
    left = left.join(inner, ["a", "b"], "left_anti").select(F.col("na").alias("a"), F.col("nb").alias("b"), "ovlp")
    return cut_lineage(merged), cut_lineage(Gr.dedupe_edges(left))


def remove_tips(vertices: DataFrame, edges: DataFrame, max_len: int, max_nsr: int) -> tuple[DataFrame, DataFrame]:
    gone = cut_lineage(Gr.tips(vertices, edges, max_len, max_nsr).select("id"))
    return (vertices, edges) if gone.isEmpty() else tuple(map(cut_lineage, Gr.drop_vertices(vertices, edges, gone)))


def pop_bubbles(vertices: DataFrame, edges: DataFrame, rules: Cleaning = Cleaning()) -> tuple[DataFrame, DataFrame]:
    """Of two similar arms between the same ends, the one whose own part is less deep goes; of equal ones the second.

    Similar: (5 * shorter - score) / 9 below 2.01 (4.02 if aggressive) or below a tenth of the mean length of the arms' own parts. Unless
    aggressive, its mean depth must also be below bubble_cov and below bubble_share of both. The own part lies between an arm's overlaps; where
    these meet or cross, it is what both cover.
    """
    vertices = with_coverage(vertices)
    arms = cut_lineage(Gr.bubbles(vertices, edges))
    if arms.isEmpty():
        return vertices, edges
    shown = vertices.select("id", "len", "seq", "cov")
    into, past = edges.select(F.col("a").alias("source"), F.col("b").alias("arm"), F.col("ovlp").alias("o_in")), edges.select(F.col("a").alias("arm"), F.col("b").alias("sink"), F.col("ovlp").alias("o_out"))

    def side(k: int) -> DataFrame:
        rows = arms.select(F.col(f"arm{k}").alias("arm"), "source", "sink", "arm1").join(into, ["source", "arm"]).join(past, ["arm", "sink"]).join(shown, F.floor(F.col("arm") / 2) == F.col("id"))
        turned = F.when(F.col("arm") % 2 == 0, F.col("seq")).otherwise(F.reverse(F.translate("seq", "ACGT", "TGCA")))
        size = F.col("len") - F.col("o_in") - F.col("o_out")
        inner = F.when(size > 0, F.substring(turned, F.col("o_in") + 1, size.cast("int"))).otherwise("")
        first, last = (F.when(F.col("arm") % 2 == 0, F.col(x)).otherwise(F.col(y)) for x, y in (("o_in", "o_out"), ("o_out", "o_in")))
        part = depths(F.substring("cov", (F.least(first, F.col("len") - last) + 1).cast("int"), F.greatest(F.abs(size), F.lit(1)).cast("int")))
        depth = F.aggregate(part, F.lit(0).cast("double"), lambda s, x: s + x) / F.greatest(F.size(part), F.lit(1))
        return rows.select("source", "sink", "arm1", F.col("id").alias(f"id{k}"), size.alias(f"size{k}"), depth.alias(f"cov{k}"), inner.alias(f"inner{k}"))

    both = align(side(1).join(side(2), ["source", "sink", "arm1"]), "inner1", "inner2", match=5, mismatch=-4, gap_open=5, gap_extend=2)
    whole = (F.col("size1") > 0) & (F.col("size2") > 0)
    n = F.when(whole, (5 * F.least("size1", "size2") - F.col("score")) / 9).otherwise(0.2 * F.abs(F.col("size1") - F.col("size2")))
    r = F.when(whole, n * 2 / (F.col("size1") + F.col("size2"))).otherwise(1.0)
    similar = (n < (4.02 if rules.aggressive else 2.01)) | (r < 0.1)
    second = F.col("cov2") <= F.col("cov1")
    low, total = F.least("cov1", "cov2"), F.col("cov1") + F.col("cov2")
    weak = F.lit(True) if rules.aggressive else (low < rules.bubble_cov) & (low / total < rules.bubble_share)
    gone = both.where(similar & weak).select(F.when(second, F.col("id2")).otherwise(F.col("id1")).alias("id"))
    return tuple(map(cut_lineage, Gr.drop_vertices(vertices, edges, gone)))


def turned(node: Column, seq: Column) -> Column:
    return F.when(node % 2 == 0, seq).otherwise(F.reverse(F.translate(seq, "ACGT", "TGCA")))


def _like_sibling(vertices: DataFrame, edges: DataFrame, short: DataFrame) -> DataFrame:
    """(id, hub): of short (id), vertices with one edge in all that look like another neighbour of its hub, the oriented vertex it leaves."""
    alone = edges.groupBy(F.shiftright("a", 1).alias("id")).agg(F.count("*").alias("n")).where("n = 1").select("id").join(short.select("id"), "id", "left_semi")
    # Seen from the neighbour: hub -> arm, the dead end, and hub -> sibling.
    arms = edges.select(F.col("a").alias("hub"), F.col("b").alias("arm"), F.col("ovlp").alias("o_arm"), F.shiftright("b", 1).alias("id")).join(alone, "id", "left_semi").where(F.shiftright("hub", 1) != F.col("id"))
    pairs = arms.join(edges.select(F.col("a").alias("hub"), F.col("b").alias("sibling"), F.col("ovlp").alias("o_sibling")), "hub").where("sibling <> arm")
    shown = vertices.select("id", "seq")
    rows = pairs.join(shown, "id").withColumn("query", turned(F.col("arm"), F.col("seq"))).withColumn("query", F.expr("substring(query, o_arm + 1)")).drop("seq")
    rows = rows.withColumn("l", F.length("query")).where("l > 0").join(shown.withColumnRenamed("id", "sibling_id"), F.shiftright("sibling", 1) == F.col("sibling_id"))
    rows = rows.withColumn("target", turned(F.col("sibling"), F.col("seq"))).withColumn("target", F.expr("substring(target, o_sibling + 1, 2 * l)"))
    n = (5 * F.col("l") - F.col("score")) / 9
    like = (F.col("score") >= F.floor(5 * F.col("l") / 2)) & ((n < 2.01) | (n / F.col("l") < 0.1))
    return align(rows.select("id", "hub", "l", "query", "target"), match=5, mismatch=-4, gap_open=5, gap_extend=2).where(like).select("id", "hub").distinct()


def pop_open(vertices: DataFrame, edges: DataFrame, max_len: int) -> tuple[DataFrame, DataFrame]:
    """Without short dead ends that look like a sibling.

    A vertex shorter than max_len with one edge in all, whose neighbour has others on that side, goes where its l bases beyond the overlap align to
    the first 2 * l beyond the overlap of one of these: a score of 5 * l // 2 at least, and (5 * l - score) / 9 below 2.01 or below l / 10. Dead ends of one
    neighbour may be like each other: a round takes the first of each by (nsr, id), and the others are compared again with what is left.
    """
    scratch = Scratch(vertices.sparkSession, "open")
    waiting = vertices.where(F.col("len") < max_len).select("id", "nsr")
    while True:
        like = scratch.put("like", _like_sibling(vertices, edges, waiting).join(vertices.select("id", "nsr"), "id"))
        if like.isEmpty():
            return vertices, edges
        gone = scratch.put("gone", like.groupBy("hub").agg(F.min_by("id", F.struct("nsr", "id")).alias("id")).select("id"))
        vertices, edges = map(cut_lineage, Gr.drop_vertices(vertices, edges, gone))
        waiting = scratch.put("waiting", like.join(gone, "id", "left_anti").select("id", "nsr"))


@dataclass
class Ways:
    """What a bubble's search knows: for each oriented vertex its best two ways from the start as (reads, distance, vertex before, its way), and how many predecessors came."""

    start: int
    ways: dict
    came: dict
    waiting: int = 0
    sink: int | None = None
    failed: bool = False


def settle(state: Ways, ready: list[int], arcs: pd.DataFrame, max_vertices: int, max_dist: int) -> list[int]:
    """Passes the ways of the ready vertices on along their arcs (a, b, ovlp, len, nsr, n_in); the vertices that are ready now."""
    now = []
    if len({v >> 1 for v in state.ways}) > max_vertices or any(w[1] > max_dist for v in ready for w in state.ways[v]) or set(ready) - set(arcs["a"]):
        state.failed = True  # too many, too far, or a dead end
        return now
    for a, b, ovlp, size, reads, n_in in sorted(arcs.itertuples(index=False)):
        if b >> 1 == state.start >> 1:
            state.failed = True
            return []
        own = [(0, -ovlp, a, 0)] if a == state.start else [(n + reads, d + size - ovlp, a, k) for k, (n, d, _, _) in enumerate(state.ways[a])]
        if b not in state.ways:
            state.ways[b], state.came[b] = [], 0
            state.waiting += 1
        state.ways[b] = sorted([*state.ways[b], *own], key=lambda w: (-w[0], w[2], w[3]))[:2]  # of equal reads, by the vertex before
        state.came[b] += 1
        if state.came[b] == n_in:
            now.append(b)
            state.waiting -= 1
    if len(now) == 1 and not state.waiting:
        state.sink = now[0]
        return []
    return now


def off_the_ways(state: Ways) -> list[int]:
    """Vertices of a bubble that are on neither of its two best ways."""
    kept = {state.start >> 1, state.sink >> 1}
    for reads, dist, node, which in state.ways[state.sink]:
        while node != state.start:
            kept.add(node >> 1)
            _, _, node, which = state.ways[node][which]
    return sorted({v >> 1 for v in state.ways} - kept)


def find_bubbles(vertices: DataFrame, edges: DataFrame, starts: DataFrame, max_vertices: int, max_dist: int) -> DataFrame:
    """(start, seen, gone) of the bubbles from starts (start) that their smaller end finds: all their vertices, and those off their two best ways."""
    scratch = Scratch(vertices.sparkSession, "bubbles")
    size = vertices.select(F.col("id").alias("of"), "len", "nsr")
    # More than 2 * max_vertices arcs lead to more than max_vertices vertices: such a vertex is as good as a dead end, and its arcs are never fetched.
    hubs = edges.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > 2 * max_vertices).select("a")
    arcs = edges.join(edges.groupBy("b").agg(F.count("*").alias("n_in")), "b").join(hubs, "a", "left_anti").join(size, F.shiftright("a", 1) == F.col("of"))
    arcs = scratch.put("arcs", arcs.select("a", "b", F.col("ovlp").cast("long").alias("ovlp"), F.col("len").cast("long").alias("len"), F.col("nsr").cast("long").alias("nsr"), F.col("n_in").cast("long").alias("n_in")))
    none = F.array().cast("array<long>")
    now = scratch.put("states", starts.select("start", F.lit(None).cast("binary").alias("state"), F.array("start").alias("ready"), none.alias("seen"), none.alias("gone")))
    arc = ["a", "b", "ovlp", "len", "nsr", "n_in"]

    def step(batches):
        for pdf in batches:
            out = []
            for start, state, ready, found in zip(pdf["start"], pdf["state"], pdf["ready"], pdf["arcs"], strict=True):
                own = pickle.loads(state) if state is not None else Ways(int(start), {int(start): [(0, 0, int(start), 0)]}, {})
                rows = pd.DataFrame([tuple(int(x[c]) for c in arc) for x in (found if found is not None else [])], columns=arc)
                after = settle(own, [int(x) for x in ready], rows, max_vertices, max_dist)
                bubble = own.sink is not None and own.start < own.sink ^ 1
                seen = sorted({v >> 1 for v in own.ways}) if bubble else []
                out.append((start, pickle.dumps(own), [] if own.failed else after, seen, off_the_ways(own) if bubble else []))
            yield pd.DataFrame(out, columns=["start", "state", "ready", "seen", "gone"])

    turn, found = 0, None
    while not now.isEmpty():
        front = now.select("start", F.explode("ready").alias("a")).join(arcs, "a").groupBy("start").agg(F.collect_list(F.struct(*arc)).alias("arcs"))
        rows = now.select("start", "state", "ready").join(front, "start", "left")
        after = scratch.put(f"after{turn}", rows.mapInPandas(step, "start long, state binary, ready array<long>, seen array<long>, gone array<long>"))
        ended = after.where(F.size("gone") > 0).select("start", "seen", "gone")
        found = ended if found is None else found.unionAll(ended)
        now = scratch.put("states", after.where(F.size("ready") > 0))
        turn += 1
    return found if found is not None else now.select("start", "seen", "gone")


def simplify_bubbles(vertices: DataFrame, edges: DataFrame, max_vertices: int = 64, max_dist: int = 512) -> tuple[DataFrame, DataFrame]:
    """Without what lies off the two ways of most reads through a bubble of any shape.

    From an end with two edges or more, vertices are settled once all their predecessors are, each with its best and second-best
    number of reads, distance and way back; of ways with equal reads that over the smaller vertex before is better. A bubble ends where one settled vertex is
    left and nothing waits; a dead end, a way back to the start, more than max_vertices or a way longer than max_dist is none. All starts take a step
    at once: a join fetches the arcs of the vertices that are ready, and each start's state, of max_vertices vertices at most, moves on. A bubble is found
    from both its ends; the smaller one decides. Bubbles that hold a vertex that one of them would take conflict: of those the one of the fewest vertices, then of the
    smallest start, goes first, and the others are searched again in what is left.
    """
    scratch = Scratch(vertices.sparkSession, "simplify")
    starts = scratch.put("starts", edges.groupBy("a").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= 2 * max_vertices)).select(F.col("a").alias("start")))
    while not starts.isEmpty():
        found = scratch.put("found", find_bubbles(vertices, edges, starts, max_vertices, max_dist))
        if found.isEmpty():
            break
        turn = F.struct(F.size("seen").alias("n"), F.col("start"))
        held = found.select("start", turn.alias("turn"), F.explode("seen").alias("id"), "gone").withColumn("taken", F.array_contains("gone", F.col("id"))).drop("gone")
        first = held.groupBy("id").agg(F.min("turn").alias("first"), F.max("taken").alias("wanted")).where("wanted")
        behind = scratch.put("behind", held.join(first, "id").where("turn <> first").select("start").distinct())
        gone = found.join(behind, "start", "left_anti").select(F.explode("gone").alias("id")).distinct()
        vertices, edges = map(cut_lineage, Gr.drop_vertices(vertices, edges, gone))
        starts = behind
    return vertices, edges


def drop_weak(vertices: DataFrame, edges: DataFrame, min_overlap: int, ratio: float, rules: Cleaning) -> DataFrame:
    """Edges without the weak ones, by the tips of the graph as it is."""
    tips = Gr.tips(vertices, edges, rules.tip_len, rules.tip_nsr)
    ends = tips.select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("end"))
    return cut_lineage(Gr.weak_edges(edges, min_overlap, ratio, ends, oriented=True))


def clean(vertices: DataFrame, edges: DataFrame, rules: Cleaning = Cleaning()) -> tuple[DataFrame, DataFrame]:
    """The schedule: tips, ramped rounds of weak edges, tips and merging, more rounds of tips and merging, open bubbles if aggressive, bubbles of any shape and
    simple ones, weak inner vertices, and at last open bubbles again if aggressive, else tips and merging.

    With reference_ramp, the reads a tip may have in a ramped round follow the reference, where a slip makes them 1 once four times the ramp is above two, else 2.

    Each step looks at the whole graph at once, so the result does not depend on an order of vertices.
    """
    v, e = remove_tips(vertices, edges, rules.tip_len, min(rules.tip_nsr, 3))
    for k in range(rules.rounds):
        ramp = 0.5 + 0.5 * k / (rules.rounds - 1) if rules.rounds > 1 else 1.0
        e = drop_weak(v, e, int(rules.min_overlap * ramp), rules.ratio * ramp, rules)
        reads = (1 if rules.tip_nsr * ramp > 2 else 2) if rules.reference_ramp else max(2, int(rules.tip_nsr * ramp))
        v, e = remove_tips(v, e, int(rules.tip_len * ramp), reads)
        v, e = merge_graph(v, e)
    for _ in range(rules.rounds):
        without = remove_tips(v, e, rules.tip_len, rules.tip_nsr)
        if without[0] is v:  # nothing to remove, and what could be merged was
            break
        v, e = merge_graph(*without)
    if rules.aggressive:
        v, e = merge_graph(*pop_open(v, e, rules.tip_len))
    if rules.simplify:
        v, e = merge_graph(*simplify_bubbles(v, e, rules.bubble_vertices, rules.bubble_dist))
    v, e = merge_graph(*pop_bubbles(v, e, rules))
    if rules.inner_nsr >= 2:
        weak = v.where((F.col("len") < rules.tip_len) & (F.col("nsr") < rules.inner_nsr))
        v, e = map(cut_lineage, Gr.bridge_vertices(v, e, weak, rules.min_overlap))
        e = drop_weak(v, e, rules.min_overlap, rules.ratio, rules)
        v, e = merge_graph(*remove_tips(v, e, rules.tip_len, rules.tip_nsr))
    if rules.aggressive:
        v, e = merge_graph(*pop_open(v, e, rules.tip_len))
    else:
        v, e = merge_graph(*remove_tips(v, e, rules.tip_len, rules.tip_nsr))
    return v, e
