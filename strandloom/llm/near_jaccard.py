"""Exact Jaccard similarity classes of word n-grams by universe-partition pigeonhole.

The hash range of shingles is cut into m segments for each band of set sizes. Two sets that are
similar enough differ in at most H shingles, so wherever a set allots H + 1 units over its
segments, a similar set shows up: one unit on a segment finds sets with the same subset there, two
units also find those that differ by one shingle (one-deletion neighbourhoods, kept for every
16th segment). Every set's subsets are hashed to signatures, which meet in a shuffle by signature.
The units go first to segments whose subset nothing else has, which cost nothing; a set that needs
no others has no partner. The rest go to the segments with the fewest partners. What meets there
is verified on whole shingle sets.

Verified links are used at once: of a signature's documents some are pivots in each round, and only
documents that aren't yet in one component are compared, so a large group of near copies takes about
as many comparisons as it has members. What all members of a signature have to know of each other
is aggregated before the shuffle, and the join with its pivots can be split, so none needs one task.

Signatures are packed in NumPy arrays, one for each reducer and chunk of texts. A signature keeps 32
bits beside its bucket: a clash costs a comparison and changes no result. With many buckets nearly every
signature of a set goes to a bucket of its own and takes the set's name along, so names are kept short: a
first pass finds which sets and ids come more than once, and only those name their set beside the id. Shingles are compared as
64-bit hashes of their words, so a pair of s distinct shingles is misjudged with a probability below
s * s / 2**64; equal sets are told by their size and 128 bits of their hashes' sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, lean, let_go, partitions, text_or_empty
from strandloom.llm.word_ids import chunks
from strandloom.llm.words import BLANK, Words, mix
from strandloom.operators.components import connected_components

#: Up to this size every shingle is a segment of its own.
SINGLE = 400
WIDE = 1 << 32
ODD = np.uint64(0x9E3779B97F4A7C15)
MET = "kind int, doc_id long, print long, print2 long, size int, spare int, sig long, seg long, large boolean, n_exact int, n_deleted int"
FIELDS = [f.split()[0] for f in MET.split(", ")]
#: Up to so many ids are broadcast to pick their documents; beyond, the documents are shuffled.
BROADCAST_IDS = 200_000
#: Bytes of a signature beside its bucket.
SIGNATURE_BYTES = 4
#: Bits of the filter for each set or id that comes more than once, and the most it has: a fuller one lets more sets be named than need it.
FILTER_BITS, FILTER_MOST = 32, 1 << 26
#: Bits of one of Spark's bitmaps.
BITMAP = 1 << 15
#: Words of 64 bits in a set's sketch.
SKETCH = 8
#: And so many bytes of shingle sets are broadcast to verify their pairs.
BROADCAST_BYTES = 8 << 20
#: Pivots of a signature in each round, the last for all further ones: Spark limits so few before its shuffle.
PIVOTS = (1, 4, 32, 256, 900)


@dataclass(frozen=True)
class Scheme:
    """words: of a shingle; percent: 100 * intersection >= percent * union links; roomy: segments for each unit of the largest set; deleted_every: which segments have one-deletion neighbourhoods."""

    words: int = 5
    percent: int = 75
    roomy: float = 1.6
    deleted_every: int = 16

    def largest_partner(self, size: int) -> int:
        return 100 * size // self.percent

    def units(self, size: int) -> int:
        """H + 1 for a set and any partner that is not smaller."""
        return (size + self.largest_partner(size)) * (100 - self.percent) // (100 + self.percent) + 1

    @cache  # noqa: B019
    def bands(self, top: int) -> list[tuple[int, int]]:
        """(largest size, segments) of each band, up to one that holds `top`; a partner is in the same or the next band."""
        found, low, step = [], 1, max(1.3, (100 / self.percent) ** 2)
        while not found or found[-1][0] < top:
            high = max(low, int(low * step))
            found.append((high, WIDE if high <= SINGLE else int(self.units(high) * self.roomy) + 1))
            low = high + 1
        return found


def shingles(words: Words, row: int, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; `words.joined` holds the hash of each run of `size` words."""
    a, b = int(words.edge[row]), int(words.edge[row + 1])
    if b - a >= size:
        return np.unique(words.joined[a : b - size + 1])
    if a == b:
        return np.zeros(0, np.uint64)
    run = np.full(1, b - a, np.uint64)
    for k in range(a, b):
        run = run * ODD + words.hash[k : k + 1]
    return mix(run)


def word_runs(texts: pa.Array, size: int) -> Words:
    words = Words(texts, BLANK)
    words.hash = mix(words.hashes())[words.code] if len(words.code) else np.zeros(0, np.uint64)
    n = max(0, len(words.hash) - size + 1)
    run = np.full(n, size, np.uint64)
    for k in range(size):
        run = run * ODD + words.hash[k : k + n]
    words.joined = mix(run)
    return words


def _low_bytes(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_low_bytes(data: memoryview, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, width * n, at).reshape(n, width)
    return out.reshape(-1).view("<u8")


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned integers by the fewest whole bytes that hold the largest, after their number of bytes."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(values.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _from_narrow(data: memoryview, n: int, at: int) -> tuple[np.ndarray, int]:
    width = data[at]
    return np.frombuffer(data, f"<u{width}", n, at + 1).astype(np.uint64), at + 1 + width * n


def signatures(sets: list[np.ndarray], small: np.ndarray, scheme: Scheme, finest: bool = False):
    """Signature rows of sets: (set, only as the larger of a pair?, signature, segment or -1, deleted?) as arrays, and each set's spare units.

    A set has rows for its own band, as the smaller or larger of a pair, and for the band below where a
    partner may be, as the larger. Segment -1 marks rows without a neighbourhood. finest: every shingle is a segment.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    bands = scheme.bands(1 << int(sizes.max(initial=1)).bit_length())
    tops = np.array([b[0] for b in bands])
    own = np.searchsorted(tops, sizes)
    below = np.maximum(own - 1, 0)
    also = (own > 0) & (sizes > 0) & (sizes <= np.array([scheme.largest_partner(int(t)) for t in tops])[below])
    entry = np.concatenate((np.flatnonzero(sizes), np.flatnonzero(also)))
    band = np.concatenate((own[sizes > 0], below[also]))
    as_small = np.concatenate((small[sizes > 0], np.zeros(int(also.sum()), bool)))
    hashes = np.concatenate([sets[i] for i in entry]) if len(entry) else np.zeros(0, np.uint64)
    n = sizes[entry]
    of = np.repeat(np.arange(len(entry)), n)
    cells = np.array([WIDE if finest else b[1] for b in bands], np.uint64)[band][of]
    seg = (hashes >> np.uint64(32)) * cells >> np.uint64(32)
    first = np.ones(len(seg), bool)
    first[1:] = (seg[1:] != seg[:-1]) | (of[1:] != of[:-1])
    start = np.flatnonzero(first)
    value = mix(hashes)
    total = np.add.reduceat(value, start) if len(start) else np.zeros(0, np.uint64)
    held = np.diff(np.append(start, len(seg)))
    place = mix(seg[start] * ODD + band[of[start]].astype(np.uint64) + np.uint64(1))
    near = (held >= 2) & (seg[start] % np.uint64(scheme.deleted_every) == 0) & (cells[start] < WIDE)
    part = np.repeat(np.arange(len(start)), held)
    gone = np.flatnonzero(near[part])
    rows = np.concatenate((of[start], of[gone]))
    sig = np.concatenate((mix(total + place), mix(total[part[gone]] - value[gone] + place[part[gone]])))
    segment = np.concatenate((np.where(near, seg[start].astype(np.int64), -1), seg[gone].astype(np.int64)))
    deleted = np.concatenate((np.zeros(len(start), bool), np.ones(len(gone), bool)))
    units = np.array([scheme.units(int(s)) for s in sizes], np.int64)
    spare = np.bincount(of[start], minlength=len(entry)) + np.bincount(of[start][near], minlength=len(entry)) - units[entry]
    of_set = np.zeros(len(sets), np.int64)
    of_set[entry[: int((sizes > 0).sum())]] = spare[: int((sizes > 0).sum())]
    return entry[rows], ~as_small[rows], sig, segment, deleted, of_set


def _from_bits(data: memoryview, n: int, at: int) -> tuple[np.ndarray, int]:
    size = -(-n // 8)
    return np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n).astype(bool), at + size


def pack(ids, prints, rows, large, sig, segment, deleted, buckets: int, width: int = 5) -> Iterator[tuple[int, bytes]]:
    """Rows of a chunk by bucket: heads (a set in one role, with or without neighbourhoods) and `width` bytes for each signature, more for those with a neighbourhood.

    Ids are stored less the smallest of the blob, by as few bytes as they need, and prints of 0 not at all, so a blob stays small when buckets are many.
    """
    bucket = (sig % np.uint64(buckets)).astype(np.int64)
    plain = segment < 0
    key = 4 * bucket + 2 * ~plain + large
    order = np.argsort(key.astype(np.uint16) if 4 * buckets < 1 << 16 else key, kind="stable")
    bucket, plain, rows, large, sig, segment, deleted = (x[order] for x in (bucket, plain, rows, large, sig // np.uint64(buckets), segment, deleted))
    change = np.ones(len(rows), bool)
    change[1:] = (rows[1:] != rows[:-1]) | (large[1:] != large[:-1]) | (plain[1:] != plain[:-1]) | (bucket[1:] != bucket[:-1])
    heads = np.flatnonzero(change)
    counts = np.diff(np.append(heads, len(rows)))
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    at = np.searchsorted(heads, edges)
    for b in np.flatnonzero(np.diff(edges)):
        own, head, n = slice(edges[b], edges[b + 1]), heads[at[b] : at[b + 1]], counts[at[b] : at[b + 1]]
        n_plain, doc = int(plain[own].sum()), rows[head]
        low, named = int(ids[doc].min()), prints[doc] != 0
        yield int(b), b"".join([
            np.array([len(head), n_plain, edges[b + 1] - edges[b] - n_plain], "<u4").tobytes(), np.array([low], "<i8").tobytes(), bytes([width]),
            _narrow(ids[doc].view(np.uint64) - np.array([low]).view(np.uint64)), _narrow(n.astype(np.uint64)), np.packbits(named).tobytes(), prints[doc][named].astype("<u8").tobytes(), np.packbits(large[head]).tobytes(),
            _low_bytes(sig[own], width), _narrow(segment[own][n_plain:].astype(np.uint64)), np.packbits(deleted[own][n_plain:]).tobytes(),
        ])


def unpack(data: memoryview) -> list[np.ndarray]:
    """Signature, segment, deleted?, id, print and large? of each row of a blob."""
    docs, n_plain, n_near = (int(x) for x in np.frombuffer(data, "<u4", 3))
    low = np.frombuffer(data, "<i8", 1, 12)
    width = data[20]
    ids, at = _from_narrow(data, docs, 21)
    counts, at = _from_narrow(data, docs, at)
    named, at = _from_bits(data, docs, at)
    prints = np.zeros(docs, np.uint64)
    prints[named] = np.frombuffer(data, "<u8", int(named.sum()), at)
    large, at = _from_bits(data, docs, at + 8 * int(named.sum()))
    n, which = n_plain + n_near, np.repeat(np.arange(docs), counts.astype(np.int64))
    sig = _from_low_bytes(data, n, width, at)
    near, at = _from_narrow(data, n_near, at + width * n)
    segment = np.concatenate((np.full(n_plain, -1, np.int64), near.astype(np.int64)))
    deleted = np.concatenate((np.zeros(n_plain, bool), _from_bits(data, n_near, at)[0]))
    return [sig, segment, deleted, (ids + low.view(np.uint64)).view(np.int64)[which], prints[which], large[which]]


def meetings(bucket: int, blobs: list[memoryview], buckets: int) -> pa.RecordBatch | None:
    """MET rows of the signatures of a bucket that documents with different sets share. Equal sets with a print stand for one: the smallest id."""
    sig, segment, deleted, ids, prints, large = (np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True))
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    same = sig[1:] == sig[:-1]
    keep = np.zeros(len(sig), bool)
    keep[1:] |= same
    keep[:-1] |= same
    order, sig = order[keep], sig[keep]
    segment, deleted, ids, prints, large = (x[order] for x in (segment, deleted, ids, prints, large))
    order = np.lexsort((ids, deleted, prints, sig))
    sig, segment, deleted, ids, prints, large = (x[order] for x in (sig, segment, deleted, ids, prints, large))
    first = np.ones(len(sig), bool)
    first[1:] = (sig[1:] != sig[:-1]) | (prints[1:] != prints[:-1]) | (deleted[1:] != deleted[:-1]) | (prints[1:] == 0) & (ids[1:] != ids[:-1])
    sig, segment, deleted, ids, prints, large = (x[first] for x in (sig, segment, deleted, ids, prints, large))
    if not len(sig):
        return None
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    n = np.diff(np.append(start, len(sig)))
    exact = np.add.reduceat((~deleted).astype(np.int64), start)
    live = (n > 1) & (exact > 0) & np.logical_or.reduceat(~large, start)
    keep = np.repeat(live, n)
    if not keep.any():
        return None
    n_exact, n_deleted = np.repeat(exact, n)[keep], np.repeat(n - exact, n)[keep]
    whole, none = (sig[keep] * np.uint64(buckets) + np.uint64(bucket)).view(np.int64), int(keep.sum())
    columns = [pa.array(deleted[keep].astype(np.int32)), pa.array(ids[keep]), pa.array(prints[keep].view(np.int64)), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int32()), pa.array(whole), pa.array(segment[keep]), pa.array(large[keep]), pa.array(n_exact.astype(np.int32)), pa.array(n_deleted.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, FIELDS)


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for row, part in chunks(texts, 2 << 20):
        words = word_runs(part, size)
        yield row, [shingles(words, i, size) for i in range(len(part))]


def _prints(sets: list[np.ndarray], of=lambda s: s) -> np.ndarray:
    """A number for each set that equal sets share."""
    return mix(np.fromiter((of(s).sum(dtype=np.uint64) for s in sets), np.uint64, len(sets)) + np.fromiter(map(len, sets), np.uint64, len(sets)))


def _id_keys(ids: np.ndarray) -> np.ndarray:
    return mix(ids.view(np.uint64) ^ ODD)


def repeated_keys(docs: DataFrame, scheme: Scheme, scratch: Scratch) -> np.ndarray:
    """A bitmap of the prints and id keys, by their low bits, that more than one row of (doc_id, text) has."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            for row, sets in _sets(batch.column(1), scheme.words):
                held = np.fromiter(map(len, sets), np.int64, len(sets)) > 0
                keys = np.concatenate((_prints(sets)[held], _id_keys(number[row : row + len(sets)])))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    keys = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(lean(emit), "key long")
    found = scratch.put("repeated", keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    bits = min(FILTER_MOST, max(BITMAP, 1 << (FILTER_BITS * found.count()).bit_length()))
    spot = found.select((F.col("key").bitwiseAND(F.lit(bits - 1)) + 1).alias("spot"))
    parts = spot.groupBy(F.bitmap_bucket_number("spot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect()
    out = np.zeros((bits // BITMAP, BITMAP // 8), np.uint8)
    for r in parts:
        out[r.part - 1] = np.frombuffer(r.bits, np.uint8)
    scratch.drop("repeated")
    return out.reshape(-1)


def _in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = keys & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def signature_meetings(docs: DataFrame, scheme: Scheme, finest: bool, repeated: np.ndarray) -> DataFrame:
    """(doc_id, text, small) to MET rows: kind -1 for each input row, 0 or 1 for its exact or deleted signatures that others share.

    Signatures have a print where the set or its id may come again by `repeated`, else 0, as the id tells the set; rows of kind -1 have it as sig.
    """
    buckets = partitions(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "data", "doc_id", "print", "print2", "size", "spare", "mark"]
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy()
            small = batch.column(2).to_numpy(zero_copy_only=False)
            for row, sets in _sets(batch.column(1), scheme.words):
                part = slice(row, row + len(sets))
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                prints, second = _prints(sets), _prints(sets, lambda s: mix(s ^ ODD))
                marks = np.where(_in_bitmap(repeated, prints) | _in_bitmap(repeated, _id_keys(number[part])), prints, np.uint64(0))
                linked = [s if known[row + i] else s[:0] for i, s in enumerate(sets)]
                rows, large, sig, segment, deleted, of_set = signatures(linked, small[part], scheme, finest)
                where = (mix(number[part].view(np.uint64) + prints) % np.uint64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.nulls(len(sets), pa.binary()), ids.slice(row, len(sets)), pa.array(prints.view(np.int64)), pa.array(second.view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(of_set.astype(np.int32)), pa.array(marks.view(np.int64))], names)
                blobs = list(pack(number[part], marks, rows, large, sig, segment, deleted, buckets, SIGNATURE_BYTES))
                if blobs:
                    empty = [pa.nulls(len(blobs), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blobs], pa.int32()), pa.array([d for _, d in blobs], pa.binary()), *empty], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[memoryview]] = {}
        for batch in batches:
            data = batch.column(1)
            rows = batch.filter(data.is_null())
            if n := rows.num_rows:
                none = [pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(-1, pa.int32()), n), *(rows.column(k) for k in range(2, 8)), *none], FIELDS)
            packed = batch.filter(data.is_valid())
            for bucket, blob in zip(packed.column(0).to_pylist(), packed.column(1), strict=True):
                held.setdefault(bucket, []).append(memoryview(blob.as_buffer()))
        for bucket in list(held):
            found = meetings(bucket, held.pop(bucket), buckets)
            if found is not None:
                yield found

    dealt = docs.mapInArrow(lean(emit), "bucket int, data binary, doc_id long, print long, print2 long, size int, spare int, mark long").repartition(buckets, "bucket")
    return dealt.mapInArrow(lean(meet), MET)


def _units(kind, of, size, spare, sig, seg, large, n_exact, n_deleted) -> tuple[np.ndarray, np.ndarray]:
    """For signature rows of the sets `of` (ascending): how many shingles of the set no partner has, at least, and which rows must be verified.

    size and spare are those of each set. A set takes its cheapest units beyond its spare ones; units that cost
    nothing have no row here. A second unit of a segment costs no less than the first, so the first is always taken with it.
    """
    shared = np.zeros((len(size), 2), np.int64)
    np.add.at(shared, (of[kind == 0], large[kind == 0].astype(np.int64)), 1)
    lone = np.maximum(size[of] - shared[of, large.astype(np.int64)], 0)
    probe = np.zeros(len(of), bool)
    one = np.flatnonzero(~large & (kind == 0) & (n_exact > 1))
    near = np.flatnonzero(~large & (seg >= 0))
    near = near[np.lexsort((seg[near], of[near]))]
    start = np.ones(len(near), bool)
    start[1:] = (of[near][1:] != of[near][:-1]) | (seg[near][1:] != seg[near][:-1])
    group, heads = np.cumsum(start) - 1, near[start]
    cost = np.bincount(group, np.where(kind[near] == 0, n_exact[near] - 1 + n_deleted[near], n_exact[near]), len(heads)).astype(np.int64) if len(near) else np.zeros(0, np.int64)
    two = np.flatnonzero(cost > 0)
    owner = np.concatenate((of[one], of[heads[two]]))
    price = np.concatenate((n_exact[one].astype(np.int64) - 1, cost[two]))
    level = np.repeat([1, 2], [len(one), len(two)])
    spot = np.concatenate((seg[one], seg[heads[two]]))
    tie = np.concatenate((np.where(seg[one] < 0, sig[one], 0), np.zeros(len(two), np.int64)))
    order = np.lexsort((tie, spot, level, price, owner))
    owned = owner[order]
    rank = np.arange(len(order)) - np.searchsorted(owned, owned)
    taken = np.zeros(len(order), bool)
    taken[order] = rank < (np.bincount(owner, minlength=len(size)) - np.maximum(spare, 0))[owned]
    probe[one[taken[: len(one)]]] = True
    wide = np.zeros(len(heads), bool)
    wide[two[taken[len(one) :]]] = True
    probe[near[wide[group]]] = True
    return lone, probe


def candidates(met: DataFrame) -> DataFrame:
    """(sig, doc_id, size, lone, probe): members of signatures; a pair has to be verified where one of the two is a probe.

    The rows of a document lie together, and each document's units are chosen by itself.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            doc, mark, kind = (rows[c].to_numpy() for c in ("doc_id", "print", "kind"))
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
            of, meta = np.cumsum(new) - 1, kind < 0
            size, spare = np.zeros(int(new.sum()), np.int64), np.zeros(int(new.sum()), np.int64)
            size[of[meta]], spare[of[meta]] = (rows[c].to_numpy()[meta] for c in ("size", "spare"))
            own = np.flatnonzero(~meta)
            if not len(own):
                return
            part = rows.take(pa.array(own)).combine_chunks()
            sig, seg, large, n_exact, n_deleted = (part[c].to_numpy() for c in ("sig", "seg", "large", "n_exact", "n_deleted"))
            lone, probe = _units(kind[own], of[own], size, spare, sig, seg, large, n_exact, n_deleted)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(doc[own]), pa.array(size[of[own]].astype(np.int32)), pa.array(lone.astype(np.int32)), pa.array(probe)], ["sig", "doc_id", "size", "lone", "probe"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(batch.schema.names.index("doc_id")).to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))  # the last document may go on in the next batch
            if held and (cut or held[0].column(held[0].schema.names.index("doc_id"))[0].as_py() != ids[0]):
                yield from done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from done(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from done(pa.Table.from_batches(held))

    mark = F.when(F.col("kind") < 0, F.col("sig")).otherwise(F.col("print"))
    rows = met.where("doc_id IS NOT NULL").drop("print2").withColumn("print", mark).repartition(partitions(met.sparkSession), "doc_id").sortWithinPartitions("doc_id", "print", "kind")
    return rows.mapInArrow(lean(choose), "sig long, doc_id long, size int, lone int, probe boolean")


def picked(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs of the ids in the one column of ids."""
    name = ids.columns[0]
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col] == ids[name], "left_semi")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets link.

    Sets of documents in no pair stay where they are. Many pairs share a pivot, so the pivots' sets are
    broadcast where their total size, which is checked, allows it.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[spot] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (picked(sets, pairs.select(F.col(k).alias("wanted_id")).distinct(), "doc_id").select(F.col("doc_id").alias(k), F.col("data").alias(f"set_{k}")) for k in "ab")
    if (left.agg(F.sum(F.octet_length("set_a"))).first()[0] or 0) <= BROADCAST_BYTES:
        left = F.broadcast(left)
    return pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(lean(verify), "a long, b long").distinct()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of how many hashes fall on each of 64 * SKETCH bits: two sets differ in as many shingles as bits, at least."""
    odd = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, data, k0, k1, ...): sorted shingle hashes and their sketch."""
    bits = [f"k{i}" for i in range(SKETCH)]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in _sets(batch.column(1), size):
                marks = np.array([sketch(s) for s in sets]).reshape(len(sets), SKETCH)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), *(pa.array(np.ascontiguousarray(marks[:, i])) for i in range(SKETCH))], ["doc_id", "data", *bits])

    return docs.mapInArrow(lean(build), "doc_id long, data binary, " + ", ".join(f"{b} long" for b in bits))


def linked_components(members: DataFrame, docs: DataFrame, scheme: Scheme, scratch: Scratch) -> DataFrame | None:
    """(node, component) from members (sig, doc_id, size, lone, probe) of signatures, verifying pairs until none is open.

    Each round compares some pivots of a signature, in later rounds more, with those of its members that are in other
    components, and then takes the pivots out. Probes of the fewest lone shingles come first: of
    near copies they are the closest to the others. Pairs of sizes too far apart, pairs of which neither is a probe, and
    pairs whose lone shingles or sketches alone show more differences than a link allows need no look.
    """
    percent, single = scheme.percent, max((top for top, cells in scheme.bands(SINGLE) if cells == WIDE), default=0)
    allowed = lambda total: F.floor(total * (100 - percent) / (100 + percent))
    bits = [f"k{i}" for i in range(SKETCH)]

    def still_open(rows: DataFrame) -> DataFrame:
        """Members of signatures that span components and hold a probe, less those that even the partner of the fewest lone shingles can't link with."""
        lows = rows.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("probe").alias("any"), F.min("lone").alias("fewest"), F.min(F.when(F.col("probe"), F.col("lone"))).alias("fewest_probe"))
        sigs = scratch.put("open", lows.where("low <> high AND any").select("sig", "fewest", "fewest_probe"))
        partner = F.when(F.col("probe"), F.col("fewest")).otherwise(F.col("fewest_probe"))
        reach = F.col("size") + F.floor(100 * F.col("size") / percent)
        return rows.join(sigs, "sig").where((F.col("size") > single) | (F.col("lone") + partner <= allowed(reach))).drop("fewest", "fewest_probe")

    # Most signatures have no probe at all and are gone before anything is aggregated.
    probed = scratch.put("probed", members.where("probe").select("sig").distinct())
    members = scratch.put("members", members.join(probed, "sig", "left_semi").withColumn("comp", F.col("doc_id")))
    scratch.drop("candidates", "both", "probed")
    members = scratch.put("members", still_open(members))
    if members.isEmpty():
        return None
    sets = scratch.put("sets", shingle_sets(picked(docs, members.select(F.col("doc_id").alias("wanted_id")).distinct(), "doc_id"), scheme.words))
    marks = sets.select("doc_id", *bits).distinct()
    turn, labels, tested = 0, None, None
    while not members.isEmpty():
        order = Window.partitionBy("sig").orderBy(F.desc("probe"), "lone", "doc_id")
        pivots = scratch.put("pivots", members.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= PIVOTS[min(turn, len(PIVOTS) - 1)]).drop("rank"))
        # Sketches come to the members for this join alone, so that all others move narrow rows.
        a, b = (t.join(marks, "doc_id").select("sig", *(F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "size", "lone", "probe", "comp", *bits))) for t, k in ((pivots, "a"), (members, "b")))
        open_ = (F.col("doc_id_a") != F.col("doc_id_b")) & (F.col("comp_a") != F.col("comp_b")) & (F.col("probe_a") | F.col("probe_b"))
        near = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
        few = (F.least("size_a", "size_b") > single) | (F.col("lone_a") + F.col("lone_b") <= allowed(F.col("size_a") + F.col("size_b")))
        apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in bits), F.lit(0))
        pairs = b.join(a, "sig").where(open_ & near & few & (apart <= allowed(F.col("size_a") + F.col("size_b")))).select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.put(f"pairs{turn}", pairs)
        tested = pairs if tested is None else tested.unionAll(pairs)
        if not turn:
            let_go(scratch.spark)  # the first round's joins and its verification are the largest
        links = scratch.put("links", similar(pairs, sets, percent))
        if not links.isEmpty():
            known = links if labels is None else links.unionAll(labels.select("node", "component"))
            labels = scratch.put("labels", connected_components(known, scratch=scratch))
            scratch.drop("stars")
        left = members.join(pivots.select("sig", "doc_id"), ["sig", "doc_id"], "left_anti")
        if labels is not None:
            left = left.drop("comp").join(labels.select(F.col("node").alias("doc_id"), F.col("component").alias("comp")), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
        members = scratch.put("members", still_open(scratch.put("left", left)))
        scratch.drop("left", "pivots", "links")
        turn += 1
    return labels


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = Scheme()) -> DataFrame:
    """doc_id, n_shingles, component_id, representative of every input row.

    component_id is the smallest id that links reach; representative the smallest id with an equal set.
    Empty and null texts have no shingles and are alone; rows with a null id get a null component and link with nothing;
    rows that repeat an id are one node with all their sets; a very long text is one chunk of its task and has as many
    signatures as its band has segments; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    repeated = repeated_keys(own, scheme, scratch)
    met = scratch.put("met", signature_meetings(own.withColumn("small", F.lit(True)), scheme, finest=False, repeated=repeated))
    let_go(scratch.spark)
    meta = scratch.put("meta", met.where("kind < 0").select("doc_id", "print", "print2", "size", "spare"))
    members = scratch.put("candidates", candidates(met))
    scratch.drop("met")
    # Where the segments that hold a set's shingles can't take all its units, a cut into single shingles can.
    short = meta.where("spare < 0 AND doc_id IS NOT NULL")
    if not short.isEmpty():
        # Only sets within reach of a short one's size are cut again; sizes fall into few classes, a factor of two wide.
        of_size = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
        sizes = short.select(of_size.alias("class")).distinct().select(F.explode(F.array(*(F.col("class") + k for k in (-1, 0, 1)))).alias("class")).distinct()
        again = meta.where("size > 0 AND doc_id IS NOT NULL").withColumn("class", of_size).join(F.broadcast(sizes), "class", "left_semi")
        again = again.groupBy(F.col("doc_id").alias("again_id")).agg(F.max(F.col("spare") < 0).alias("small"))
        marked = own.join(again, own.doc_id == again.again_id).select("doc_id", "text", "small")
        met = scratch.put("met", signature_meetings(marked, scheme, finest=True, repeated=repeated))
        members = scratch.put("both", members.unionAll(candidates(met)))
        scratch.drop("met", "candidates")
    labels = linked_components(members, own, scheme, scratch)
    equal = meta.where("size > 0 AND doc_id IS NOT NULL").groupBy("print", "print2", "size").agg(F.min("doc_id").alias("representative"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = meta.select("doc_id", "size", *(F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("print", "print2")))
    rows = rows.join(scratch.put("equal", equal), ["print", "print2", "size"], "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("representative", "doc_id").alias("representative"))
    # An id of several rows ties the sets of all of them together.
    repeated = meta.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    ties = scratch.put("ties", rows.join(repeated, "doc_id", "left_semi").where("doc_id <> representative").select(F.col("doc_id").alias("a"), F.col("representative").alias("b")).distinct())
    if not ties.isEmpty():
        links = ties if labels is None else ties.unionAll(labels.select("node", "component"))
        labels = scratch.put("labels", connected_components(links, scratch=scratch))
    scratch.keep_only("meta", "equal", "labels")
    if labels is None:
        return rows.select("doc_id", "n_shingles", F.col("representative").alias("component_id"), "representative")
    return rows.join(labels, rows.representative == labels.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "representative").alias("component_id"), "representative")
