"""Repeated passages across documents, by the suffix order of what they may share.

Every string of WINDOW bytes has an anchor: the least of its strings of GRAM bytes by a hash, the last of equal ones. Strings that
are equal have equal anchors at equal offsets, so only texts around equal anchors are ordered. An anchor's block is what the
windows it stands for cover, and blocks are what Spark deals out:

1. Anchors, as (gram, block digest, document), meet by gram in hash buckets. Of equal blocks all documents but the smallest are covered at once.
   Where a gram has several blocks, the smallest document of each is asked for its bytes.
2. Those blocks meet by gram. Their texts, with the gram as one symbol, get a suffix order (suffix_order), equal windows are neighbours in it, and each
   is covered in all documents but the smallest. Grams of more than HOT blocks are dealt out window by window instead, so that no task holds them together.
3. Documents meet what was found for them; covered bytes go.

What is dealt out is packed into blobs by bucket, so shuffles move few rows. Grams, digests and addresses are hashes of 64 bits, and blocks that are compared byte by
byte are first told apart by them: two given blocks are mistaken for equal with a probability of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, let_go, partitions, shared_path, text_or_empty
from strandloom.llm.suffix_order import spans, suffix_orders
from strandloom.llm.word_ids import chunks, utf8

#: Bytes of a repeat and of the grams in it.
WINDOW, GRAM = 50, 20
REACH = WINDOW - GRAM + 1
#: Blocks of a gram that are ordered in one task.
HOT = 512
#: Bytes of a long text that are looked at together, and of short ones.
PIECE, CHUNK = 4 << 20, 1 << 18
#: Hash buckets for each shuffle partition.
BUCKETS = 6
#: The key of rows without an id.
LAST = (1 << 63) - 1
FLUSH = 1_500_000

_PLACE = np.uint64((1 << 23) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BYTE = np.arange(1, 257, dtype=np.uint64) * _A
_BYTE = (_BYTE ^ (_BYTE >> np.uint64(31))) * _B


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * _A
    z += y
    z ^= z >> np.uint64(32)
    z *= _B
    return z


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    h = _BYTE[data]
    h = _pair(h[:-1], h[1:])
    four = _pair(h[:-2], h[2:])
    h = _pair(four[:-4], four[4:])
    h = _pair(h[:-8], h[8:])
    n = len(data) - GRAM + 1
    return _pair(h[:n], four[16 : 16 + n])


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor, first, last, gram, digest) of the blocks of texts data[at[k] : at[k + 1]], which together hold fewer than 2**23 bytes.

    The windows from first to last have their anchor there; digest tells the block, with the gram's place in it.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = gram_hashes(data)
    low, size = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64)), 1
    while size < REACH:
        step = min(size, REACH - size)
        low, size = np.minimum(low[:-step], low[step:]), size + step
    anchor = (_PLACE - (low & _PLACE)).astype(np.int64)
    mark, ends = np.zeros(n + 1, np.int32), at[1:-1]
    np.add.at(mark, np.clip(ends - WINDOW + 1, 0, n), 1)
    np.add.at(mark, np.clip(ends, 0, n), -1)
    across = np.cumsum(mark[:-1]) > 0
    cut = np.ones(n, bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (across[1:] != across[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], n) - 1
    own = ~across[first]
    first, last = first[own], last[own]
    anchor = anchor[first]
    end = last + WINDOW
    shape = ((last - first) * 64 + anchor - first).astype(np.uint64)
    gram = h[anchor]
    digest = _pair(_pair(_pair(h[first], h[first + GRAM]), _pair(h[end - 2 * GRAM], h[end - GRAM])), _pair(gram, shape))
    return np.searchsorted(at, first, "right") - 1, anchor, first, last, gram, digest


def pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, bytes, text bounds): all at once, or a long text in pieces that share WINDOW - 1 bytes."""
    if len(data) <= PIECE + WINDOW:
        yield 0, data, at
        return
    for begin in range(0, len(data) - WINDOW + 1, PIECE):
        part = data[begin : begin + PIECE + WINDOW - 1]
        yield begin, part, np.array([0, len(part)])


def address(doc: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """A key of 64 bits for a block of a document."""
    return _pair(digest, doc.astype(np.uint64) * _B)


BLOB = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
BLOB_SQL = "kind int, bucket int, blob binary"


def packed(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket with the columns' values, column by column."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    stops = np.append(edges[1:], len(bucket))[: len(edges)]
    blobs = [b"".join(c[s:e].tobytes() for c in columns) for s, e in zip(edges, stops, strict=True)]
    return pa.record_batch([pa.array(np.full(len(edges), kind, np.int32)), pa.array(bucket[edges].astype(np.int32)), pa.array(blobs, pa.binary())], schema=BLOB)


def unpacked(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    found: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for blob in blobs:
        n, place = len(blob) // sum(sizes), 0
        for column, kind, size in zip(found, kinds, sizes, strict=True):
            column.append(np.frombuffer(blob, kind, n, place))
            place += n * size
    return [np.concatenate(c) for c in found]


def gram_bucket(gram: np.ndarray, n: int) -> np.ndarray:
    return ((gram >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def doc_keys(docs: pa.Array) -> np.ndarray:
    return docs.fill_null(LAST).to_numpy(zero_copy_only=False)


def _anchor_blobs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            gram, digest, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, digest, gram))
            gram, digest, doc = gram[order], digest[order], doc[order]
            new = np.append(True, (digest[1:] != digest[:-1]) | (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, bool)
            gram, digest, doc = gram[new], digest[new], doc[new]
            return packed(0, gram_bucket(gram, buckets), gram, digest, doc)

        for batch in batches:
            keys, texts = doc_keys(batch.column(0)), batch.column(1)
            for row, part in chunks(texts, CHUNK):
                data, at = utf8(part)
                for _, bytes_, bounds in pieces(data, at):
                    text, _, _, _, gram, digest = anchors(bytes_, bounds)
                    held.append((gram, digest, keys[row + text]))
                    count += len(gram)
                if count > FLUSH:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return run


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of each bucket; rows are in order of buckets."""
    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now:
                if held:
                    yield held
                now, held = bucket, []
            held.append(blob)
    if held:
        yield held


#: Kinds of blobs: blocks that are covered whole, blocks that are asked for, blocks of which some windows are covered.
WHOLE, ASKED, SOME = range(3)


def _meet(buckets: int, most: int = HOT):
    """What follows from equal blocks, and which blocks must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple[np.ndarray, ...]] = []
        asked: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, rows in ((WHOLE, whole), (ASKED, asked)):
                if rows:
                    columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
                    yield packed(kind, columns[0] % buckets, *columns)

        for blobs in grouped(batches):
            gram, digest, doc = unpacked(blobs, "u8", "u8", "i8")
            order = np.lexsort((doc, digest, gram))
            gram, digest, doc = gram[order], digest[order], doc[order]
            head = np.append(True, gram[1:] != gram[:-1])
            block = head | np.append(True, digest[1:] != digest[:-1])
            group, run_ = np.cumsum(head) - 1, np.cumsum(block) - 1
            heads, blocks = np.flatnonzero(head), np.flatnonzero(block)
            shared = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
            least = doc[blocks]
            covered = doc > least[run_]
            whole.append((doc[covered], digest[covered]))
            many = np.bincount(group[blocks], minlength=len(heads))
            of = group[blocks]
            ask = shared[of] & (many[of] > 1)
            asked.append((least[ask], digest[blocks][ask], (many[of][ask] > most).astype(np.uint8)))
            count += int(covered.sum()) + int(ask.sum())
            if count > FLUSH:
                yield from flush()
                whole, asked, count = [], [], 0
        yield from flush()

    return run


def addressed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[int, list[bytes]], pa.Array, pa.Array]]:
    """(blobs by kind, ids, texts) for rows of one bucket at a time: kind, bucket, blob, doc, text in order of bucket and kind, texts last."""
    now, blobs = None, {}
    for batch in batches:
        kind, bucket = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (bucket[1:] != bucket[:-1]))) if len(kind) else []
        for s, e in zip(edges, [*edges[1:], len(kind)], strict=True):
            if bucket[s] != now:
                now, blobs = bucket[s], {}
            if kind[s] == TEXT:
                yield blobs, batch.column(3).slice(s, e - s), batch.column(4).slice(s, e - s)
            else:
                blobs.setdefault(int(kind[s]), []).extend(batch.column(2).slice(s, e - s).to_pylist())


TEXT = 9
BLOCK = pa.schema([("key", pa.int64()), ("hot", pa.bool_()), ("block", pa.binary()), ("lead", pa.int32()), ("starts", pa.int32()), ("doc", pa.int64()), ("digest", pa.int64())])
BLOCK_SQL = "key long, hot boolean, block binary, lead int, starts int, doc long, digest long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks that are asked for: under their gram, or of hot grams each window under its own hash, with `starts` as its place in the block."""
    for blobs, docs, texts in addressed(batches):
        if ASKED not in blobs:
            continue
        doc, digest, hot = unpacked(blobs[ASKED], "i8", "u8", "u1")
        wanted = address(doc, digest)
        order = np.argsort(wanted)
        wanted, hot = wanted[order], hot[order]
        keys, rows = doc_keys(docs), []
        for row, part in chunks(texts, CHUNK):
            for _, data, at in pieces(*utf8(part)):
                text, anchor, first, last, gram, digest = anchors(data, at)
                own = address(keys[row + text], digest)
                spot = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                hits = np.flatnonzero(wanted[spot] == own)
                hits = hits[np.unique(own[hits], return_index=True)[1]]
                raw = data.tobytes()
                for k in hits:
                    block, id_, tag = raw[first[k] : last[k] + WINDOW], int(keys[row + text[k]]), int(digest[k].astype(np.int64))
                    if hot[spot[k]]:
                        for i in range(last[k] - first[k] + 1):
                            window = block[i : i + WINDOW]
                            rows.append((xxhash.xxh3_64_intdigest(window) - (1 << 63), True, window, 0, i, id_, tag))
                    else:
                        rows.append((int(gram[k].astype(np.int64)), False, block, int(anchor[k] - first[k]), int(last[k] - first[k] + 1), id_, tag))
                if len(rows) > 20_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), BLOCK.types, strict=True)], schema=BLOCK)
                    rows = []
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), BLOCK.types, strict=True)], schema=BLOCK)


def covered_windows(groups: list[list[tuple[bytes, int, int, int]]]) -> list[np.ndarray]:
    """For each block (bytes, gram's place, windows, doc) of each group, a bit for each window that a smaller doc of the group has too."""
    blocks = [b for g in groups for b in g]
    sizes = np.array([len(b[0]) for b in blocks])
    lead, starts, doc = (np.array([b[i] for b in blocks], np.int64) for i in (1, 2, 3))
    many = np.array([len(g) for g in groups])
    of, m = np.repeat(np.arange(len(groups)), many), np.repeat(many, many)
    data = np.frombuffer(b"".join(b[0] for b in blocks), np.uint8).astype(np.int64)
    which = np.repeat(np.arange(len(blocks)), sizes)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # A text is its blocks, each closed by a symbol of its own that falls from block to block; the gram is one symbol.
    shown = (inside <= lead[which]) | (inside >= lead[which] + GRAM)
    symbol = np.where(inside == lead[which], m[which], data + m[which] + 1)[shown]
    width = sizes - GRAM + 2
    begin = np.cumsum(width) - width
    symbols = np.empty(int(width.sum()), np.int64)
    symbols[spans(begin, width - 1)] = symbol
    heads = np.cumsum(many) - many
    symbols[begin + width - 1] = m - 1 - (np.arange(len(blocks)) - heads[of])
    at = np.append(begin[heads], len(symbols))
    order = suffix_orders(symbols, at)
    place = spans(begin, starts)
    owner = np.full(len(symbols), -1)
    owner[place] = np.repeat(np.arange(len(blocks)), starts)
    order = order[owner[order] >= 0]
    own = owner[order]
    strings = symbols[order[:, None] + np.arange(REACH)]
    new = np.append(True, (of[own][1:] != of[own][:-1]) | (strings[1:] != strings[:-1]).any(axis=1))
    runs = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(doc[own], runs), np.diff(np.append(runs, len(own))))
    hit = doc[own] > least
    bits = np.zeros(len(blocks), np.int64)
    np.add.at(bits, own[hit], np.int64(1) << (order[hit] - begin[own[hit]]))
    return np.split(bits, np.cumsum(many)[:-1])


def _order(buckets: int, limit: int = 400_000):
    """Rows of BLOCK in order of key and doc; blobs of (doc, digest, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple]] = []
        found: list[tuple[int, int, int]] = []
        waiting = 0

        def compare() -> None:
            groups.sort(key=lambda g: sum(len(b[0]) for b in g))
            several, total = [], 0
            for k, group in enumerate(groups):
                several.append(group)
                total += sum(len(b[0]) for b in group)
                if total > limit or k + 1 == len(groups):
                    for own, bits in zip(several, covered_windows(several), strict=True):
                        found.extend((b[3], b[4], int(x)) for b, x in zip(own, bits, strict=True) if x)
                    several, total = [], 0

        def flush() -> pa.RecordBatch:
            doc, digest, bits = (np.array(x, np.int64) for x in zip(*found, strict=True))
            return packed(SOME, doc % buckets, doc, digest.astype(np.uint64), bits.astype(np.uint32))

        now, least = None, {}
        for batch in batches:
            for key, hot, block, lead, starts, doc, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, hot) != now:
                    now, least = (key, hot), {}
                    if waiting > 8 * limit:
                        compare()
                        groups, waiting = [], 0
                    if not hot:
                        groups.append([])
                if hot:
                    if doc > least.setdefault(block, doc):  # the first is the smallest
                        found.append((doc, digest, 1 << starts))
                else:
                    groups[-1].append((block, lead, starts, doc, digest))
                    waiting += len(block)
            if len(found) > FLUSH:
                yield flush()
                found = []
        if groups:
            compare()
        if found:
            yield flush()

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
RESULT_SQL = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary"


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes that their blocks' covered windows hold."""
    parsed: tuple[dict, np.ndarray, np.ndarray] | None = None
    for blobs, docs, texts in addressed(batches):
        if parsed is None or parsed[0] is not blobs:
            doc, digest = unpacked(blobs.get(WHOLE, []), "i8", "u8")
            doc2, digest2, bits = unpacked(blobs.get(SOME, []), "i8", "u8", "u4")
            keys = np.concatenate((address(doc, digest), address(doc2, digest2)))
            bits = np.concatenate((np.full(len(doc), (1 << REACH) - 1, np.uint32), bits))
            order = np.argsort(keys)
            keys, bits = keys[order], bits[order]
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
            parsed = blobs, keys[heads] if len(keys) else keys, np.bitwise_or.reduceat(bits, heads) if len(keys) else bits
        _, found, bits = parsed
        ids = doc_keys(docs)
        for row, part in chunks(texts, CHUNK):
            data, at = utf8(part)
            start = np.zeros(len(data), np.int32)
            if len(found):
                for offset, bytes_, bounds in pieces(data, at):
                    text, _, first, last, _, digest = anchors(bytes_, bounds)
                    own = address(ids[row + text], digest)
                    spot = np.minimum(np.searchsorted(found, own), len(found) - 1)
                    hits = np.flatnonzero(found[spot] == own)
                    size = last[hits] - first[hits] + 1
                    which = np.repeat(np.arange(len(hits)), size)
                    window = spans(np.zeros(len(hits), np.int64), size)
                    on = (bits[spot[hits]][which] >> window.astype(np.uint32)) & np.uint32(1) > 0
                    start[offset + (first[hits][which] + window)[on]] = 1
            total = np.cumsum(start)
            total[WINDOW:] -= total[:-WINDOW].copy()
            gone = total > 0
            sums = np.append(0, np.cumsum(gone))
            removed = sums[at[1:]] - sums[at[:-1]]
            edge = np.zeros(len(data) + 1, bool)
            edge[at[:-1]] = True
            apart = ~gone[:-1] | edge[1:-1]
            rise = np.flatnonzero(gone & np.append(True, apart)[: len(gone)])
            fall = np.flatnonzero(gone & np.append(~gone[1:] | edge[1:-1], True)[: len(gone)]) + 1
            base = at[np.searchsorted(at, rise, "right") - 1]
            parts = pa.StructArray.from_arrays([pa.array(rise - base), pa.array(fall - base)], ["start", "stop"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rise, at).astype(np.int32)), parts)
            kept, size = np.ascontiguousarray(data[~gone]), np.diff(at)
            offsets = np.append(0, np.cumsum(size - removed)).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
            yield pa.record_batch([docs.slice(row, len(part)), pa.array(size.astype(np.int64)), pa.array(removed.astype(np.int64)), lists, binary], schema=RESULT)


def _bucket_count(n: int) -> int:
    """A prime of about BUCKETS for each partition, so that ids in steps spread too."""
    n = max(BUCKETS * n, 17)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for each row: its text's bytes without those covered by a string of WINDOW bytes that also starts in a row of a smaller id.

    spans are the maximal removed runs, kept the bytes that are left, which may begin or end within a character. Null texts are empty; rows without an id count as
    larger than all others; rows that repeat an id don't cover each other; very long texts are read in pieces; an empty table gives none; other columns are ignored. hot: the blocks of a gram from which its windows are dealt out one by one.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    buckets, scratch = _bucket_count(n), Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    bucket = F.pmod(F.coalesce("doc", F.lit(LAST)), F.lit(buckets)).cast("int")
    none: Column = F.lit(None)
    texts = rows.select(F.lit(TEXT).alias("kind"), bucket.alias("bucket"), none.cast("binary").alias("blob"), "doc", "text")
    met = shared_path(spark, "repeats-met")

    def of_kind(kind: int) -> DataFrame:
        return spark.read.schema("bucket int, blob binary, kind int").parquet(met).where(F.col("kind") == kind).select("kind", "bucket", "blob")

    def beside_texts(found: DataFrame) -> DataFrame:
        both = found.select("*", none.cast("long").alias("doc"), none.cast("string").alias("text")).unionAll(texts)
        return both.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")

    # No frame of a finished step is held, so that its shuffle can be let go.
    def meet() -> None:
        blobs = rows.mapInArrow(_anchor_blobs(buckets), BLOB_SQL).select("bucket", "blob").repartition(n, "bucket").sortWithinPartitions("bucket")
        blobs.mapInArrow(_meet(buckets, hot), BLOB_SQL).write.partitionBy("kind").parquet(met)

    def compare() -> DataFrame:
        blocks = beside_texts(of_kind(ASKED)).mapInArrow(_blocks, BLOCK_SQL)
        ordered = blocks.repartition(n, "key").sortWithinPartitions("key", "hot", "doc")
        return scratch.put("some", ordered.mapInArrow(_order(buckets), BLOB_SQL))

    meet()
    let_go(spark)
    some = compare()
    let_go(spark)
    return beside_texts(of_kind(WHOLE).unionAll(some)).mapInArrow(_without, RESULT_SQL)
