"""The prefix trie of conversations, built as succinct level-order tries.

Conversations that are equal turn by turn become one sequence first. Nodes with more than HEAVY sequences below them are the upper levels: they are found level
by level with aggregates, which also sum what lies below them, so no task holds a heavy node's sequences. Each subtree below them lies in one shard, and a task
builds the tries of many subtrees together: level by level NumPy tells the distinct (node, turn) apart, which gives LOUDS bits and label arrays in breadth-first
order, and sums go up in reverse order with add.at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, partitions, text_or_empty

#: Sequences below a node from which it belongs to the upper levels, and turns of the subtrees that are built together.
HEAVY, TOGETHER = 256, 200_000
#: Ids that are joined into one string before they are digested together.
SPAN = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()


@dataclass
class Louds:
    """Tries side by side in breadth-first order: `bits` has a 1 for each child and a 0 after the last, the tries' roots first; `label` and `value` are of each node's turn."""

    bits: np.ndarray
    label: np.ndarray
    value: np.ndarray
    levels: np.ndarray

    @classmethod
    def build(cls, tree: np.ndarray, edge: np.ndarray, label: np.ndarray, value: np.ndarray) -> tuple[Louds, np.ndarray]:
        """Of sequences label[edge[k] : edge[k + 1]] (rows of two integers), each in the trie `tree` says; and the node where each ends."""
        trees, size = int(tree.max()) + 1 if len(tree) else 0, np.diff(edge)
        node, ends = tree.copy(), tree.copy()
        of, labels, values, levels = [], [np.zeros((trees, 2), label.dtype)], [np.zeros(trees, np.int64)], [0, trees]
        at = 0
        while len(going := np.flatnonzero(size > at)):
            spot = edge[going] + at
            order = np.lexsort((label[spot, 1], label[spot, 0], node[going]))
            going, spot = going[order], spot[order]
            new = np.ones(len(going), bool)
            new[1:] = (node[going][1:] != node[going][:-1]) | (label[spot][1:] != label[spot][:-1]).any(axis=1)
            heads = spot[new]
            of.append(node[going][new])
            labels.append(label[heads])
            values.append(value[heads])
            node[going] = levels[-1] + np.cumsum(new) - 1
            ends[going] = node[going]
            levels.append(levels[-1] + len(heads))
            at += 1
        children = np.bincount(np.concatenate(of), minlength=levels[-1]) if of else np.zeros(levels[-1], np.int64)
        counts = np.append(trees, children)
        bits = np.ones(int(counts.sum()) + len(counts), bool)
        bits[np.cumsum(counts + 1) - 1] = False
        return cls(bits, np.concatenate(labels), np.concatenate(values), np.array(levels)), ends

    def parents(self) -> np.ndarray:
        """Each node's parent, -1 of roots: the zeros before its one, less the roots' own."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def children(self) -> np.ndarray:
        """How many children each node has."""
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros) - 1

    def find(self, root: int, path: np.ndarray) -> int:
        """The node of a path of labels below a root, or -1."""
        zeros = np.flatnonzero(~self.bits)
        for label in path:
            first, last = zeros[root] - root, zeros[root + 1] - root - 1
            hit = np.flatnonzero((self.label[first:last] == label).all(axis=1))
            if not len(hit):
                return -1
            root = int(first + hit[0])
        return root


def labelled_turns(turns: DataFrame, *, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, label, chars): each turn's place from 0 in its conversation (null turns first, ties by role and text), a digest of role and text, and the text's code points.

    Null roles and texts are empty; rows without an id belong to no conversation and are left out.
    """
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(order_col).alias("turn"), text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    label = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))
    return rows.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("row")).select("conv_id", (F.col("row") - 1).alias("pos"), label.alias("label"), F.char_length("text").alias("chars"))


def with_openings(turns: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that open like the first of their family, as (turns, ids).

    Of labelled turns, conversation c gets the first h of c - c % family, then its own after its first h; h = crc32(decimal c) % most.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = turns.select("conv_id").distinct()
    opening = turns.where(F.col("pos") < most - 1).select(F.col("conv_id").alias("first"), "pos", "label", "chars")
    opened = ids.withColumn("first", F.col("conv_id") - F.col("conv_id") % family).join(opening.where(F.col("first") % family == 0), "first").where(F.col("pos") < h)
    return opened.select("conv_id", "pos", "label", "chars").unionAll(turns.where(F.col("pos") >= h)), ids


SEQUENCE_SQL = "seq binary, labels array<binary>, chars array<int>, n long, first long, ends_sha256 string"


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence, from rows with the ids of a span, in order of sequence and span; ids are digested as they pass."""
    now, digest, rows = None, None, []
    names = ["seq", "labels", "chars", "n", "first", "ends_sha256"]
    kinds = [pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]

    def show() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for seq, _, ids, n, first, labels, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and seq == now[0]:
                digest.update(b"," + ids.encode())
                now[3] += n
                continue
            if now is not None:
                rows.append((*now, digest.hexdigest()))
            now, digest = [seq, labels, chars, n, first], hashlib.sha256(ids.encode())
            if len(rows) >= 5000:
                yield show()
                rows = []
    if now is not None:
        rows.append((*now, digest.hexdigest()))
        yield show()


def sequences(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct sequences of labels, with n conversations, the smallest of them and the digest of all their ids. A conversation's labels are held together."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "label", "chars")))
    whole = turns.groupBy("conv_id").agg(ordered.alias("t"))
    whole = ids.join(whole, "conv_id", "left").select("conv_id", F.coalesce("t.label", F.array().cast("array<binary>")).alias("labels"), F.coalesce("t.chars", F.array().cast("array<int>")).alias("chars"))
    keyed = whole.select(F.unhex(F.md5(F.array_join(F.transform("labels", F.hex), ""))).alias("seq"), F.shiftright("conv_id", SPAN).alias("span"), "conv_id", "labels", "chars")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    parts = keyed.groupBy("seq", "span").agg(joined.alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("first"), F.first("labels").alias("labels"), F.first("chars").alias("chars"))
    dealt = parts.repartition(partitions(turns.sparkSession), "seq").sortWithinPartitions("seq", "span")
    return dealt.mapInArrow(_digest_ends, SEQUENCE_SQL)


NODE = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("above", pa.binary())]
)
NODE_SQL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, above binary"


def _pairs(binary: pa.Array) -> np.ndarray:
    """16-byte values as rows of two integers."""
    raw = b"".join(binary.to_pylist())
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


def shard_nodes(rows: pa.Table) -> pa.RecordBatch:
    """The nodes of the subtrees of rows (key, above, above_conv, depth, labels, chars, n, first, ends_sha256), which are in order of key; labels and chars are those below the subtree's root, `at_root` its own turn's code points."""
    rows = rows.combine_chunks()
    column = lambda name: rows[name].combine_chunks()
    keys = column("key").to_pylist()
    head = np.array([k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))])
    tree, heads = np.cumsum(head) - 1, np.flatnonzero(head)
    lists, chars = column("labels"), column("chars")
    edge = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
    louds, ends = Louds.build(tree, edge, _pairs(lists.flatten()), chars.flatten().to_numpy().astype(np.int64))
    parent, children, levels = louds.parents(), louds.children(), louds.levels
    total = levels[-1]
    value = louds.value.copy()
    value[: len(heads)] = column("at_root").to_numpy()[heads]
    convs, first = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
    np.add.at(convs, ends, column("n").to_numpy())
    np.minimum.at(first, ends, column("first").to_numpy())
    each = [slice(levels[k], levels[k + 1]) for k in range(len(levels) - 1)]
    for part in reversed(each[1:]):
        np.add.at(convs, parent[part], convs[part])
        np.minimum.at(first, parent[part], first[part])
    leaves, saved = (children == 0).astype(np.int64), (convs - 1) * value
    for part in reversed(each[1:]):
        np.add.at(leaves, parent[part], leaves[part])
        np.add.at(saved, parent[part], saved[part])
    digest = np.full(total, NO_ENDS, object)
    digest[ends] = np.array(column("ends_sha256").to_pylist(), object)
    depth, root = np.repeat(np.arange(len(each)), np.diff(levels)), np.arange(total)
    for part in each[1:]:
        root[part] = root[parent[part]]
    depth = depth + column("depth").to_numpy()[heads][root]
    above_conv, above = column("above_conv").to_pylist(), column("above").to_pylist()
    up = [above_conv[k] for k in heads] + first[parent[len(heads) :]].tolist()
    over = [above[k] for k in heads] + [None] * (total - len(heads))
    return pa.record_batch([pa.array(c, t) for c, t in zip((first, depth, up, convs, children, leaves, saved, digest, over), NODE.types, strict=True)], schema=NODE)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds the subtrees of a partition, which is in order of key, TOGETHER turns at a time; a subtree is never cut."""
    held: list[pa.RecordBatch] = []
    turns, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_pylist()
        begin = 0
        sizes = batch.column(4).value_lengths().to_numpy()
        for k, key in enumerate(keys):
            if key != last and turns > TOGETHER:
                held.append(batch.slice(begin, k - begin))
                yield shard_nodes(pa.Table.from_batches(held))
                held, turns, begin = [], 0, k
            turns, last = turns + int(sizes[k]) + 1, key
        held.append(batch.slice(begin))
    if held:
        yield shard_nodes(pa.Table.from_batches(held))


def prefix_nodes(turns: DataFrame, ids: DataFrame | None = None, *, heavy: int = HEAVY) -> DataFrame:
    """Every distinct prefix of the conversations of labelled turns (conv_id, pos, label, chars), from the empty one.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest conversation with the prefix, its turns, the
    smallest one of its parent (null above the root), conversations with it, prefixes one turn longer, longest ones below it, what its subtree's (n_convs - 1) times
    code points of the last text add up to, and the digest of the ids that end there in ascending order. ids: all conversations, for those without turns. Repeated and
    null turns have been given places by labelled_turns; an empty table gives no rows.
    """
    spark, n = turns.sparkSession, partitions(turns.sparkSession)
    scratch = Scratch(spark, "trie")
    ids = turns.select("conv_id").distinct() if ids is None else ids
    root = F.unhex(F.md5(F.lit("")))
    start = sequences(turns, ids).select(
        root.alias("key"), F.lit(None).cast("binary").alias("above"), F.lit(None).cast("long").alias("above_conv"), F.lit(0).cast("long").alias("depth"), "labels", "chars", "n", "first", "ends_sha256", F.lit(0).cast("long").alias("at_root")
    )
    now = scratch.put("level0", start)
    light, upper = [], []
    while True:
        stats = now.groupBy("key").agg(
            F.count("*").alias("below"), F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"), F.first("above").alias("above"), F.first("above_conv").alias("parent_conv_id"), F.first("at_root").alias("last"), F.first("depth").alias("depth"),
            F.max(F.when(F.size("labels") == 0, F.col("ends_sha256"))).alias("ends_sha256"),
        )
        nodes = scratch.put(f"upper{len(upper)}", stats.where(F.col("below") > heavy))
        if nodes.isEmpty():
            light.append(now)
            break
        light.append(now.join(nodes.select("key"), "key", "left_anti"))
        upper.append(nodes)
        inside = now.where(F.size("labels") > 0).join(nodes.select("key", F.col("conv_id").alias("up")), "key")
        below = inside.select(
            F.unhex(F.md5(F.concat("key", F.col("labels")[0]))).alias("key"), F.col("key").alias("above"), F.col("up").alias("above_conv"), (F.col("depth") + 1).alias("depth"),
            F.slice("labels", 2, F.size("labels")).alias("labels"), F.slice("chars", 2, F.size("chars")).alias("chars"), "n", "first", "ends_sha256", F.col("chars")[0].cast("long").alias("at_root"),
        )
        now = scratch.put(f"level{len(upper)}", below)
    rows = light[0]
    for more in light[1:]:
        rows = rows.unionAll(more)
    dealt = rows.select("key", "above", "above_conv", "depth", "labels", "chars", "n", "first", "ends_sha256", "at_root").repartition(n, "key").sortWithinPartitions("key")
    small = scratch.put("nodes", dealt.mapInArrow(_shards, NODE_SQL))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out, tops = small.select(*shown), small.where("above IS NOT NULL").groupBy("above").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
    for nodes in reversed(upper):
        own = nodes.join(tops.withColumnRenamed("above", "key"), "key")
        own = own.select("*", (F.col("saved") + (F.col("n_convs") - 1) * F.col("last")).alias("saved_tokens")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
        own = scratch.put(f"summed{upper.index(nodes)}", own.select(*shown, "above"))
        out = out.unionAll(own.select(*shown))
        rolled = own.where("above IS NOT NULL").select("above", F.lit(1).cast("long").alias("n_children"), "n_leaves", F.col("saved_tokens").alias("saved"))
        tops = tops.unionAll(rolled).groupBy("above").agg(F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    return out
