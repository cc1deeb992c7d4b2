"""Toxicity by logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Features of a text are the distinct hashes of its words, their stems (first bytes), pairs of
neighbours and pairs that skip a word. Each coordinate has its own learning rate, and L1 keeps
most weights at zero, so the model is a short list that is broadcast to score any number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import lean, text_or_empty
from strandloom.llm.word_ids import chunks
from strandloom.llm.words import NOT_LETTER, Words, mix

BITS = 20
STEM = 4
#: Odd multipliers that tell the kinds of features apart.
FIRST, NEXT, SKIP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class Rates:
    """Per-coordinate rates and penalties of FTRL-proximal."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.01
    epochs: int = 5


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each chunk: (first row, rows, row of each feature, its coordinate); a text's features may repeat."""
    for row, part in chunks(texts, 2 << 20):
        words = Words(part, NOT_LETTER)
        code, n = words.code, np.diff(words.edge)
        word, owner = words.hashes()[code], np.repeat(np.arange(len(part)), n)
        found = [(owner, word), (owner, words.hashes(STEM)[code])]
        for gap, factor in ((1, NEXT), (2, SKIP)):
            same = owner[gap:] == owner[:-gap]
            found.append((owner[gap:][same], word[:-gap][same] * FIRST + word[gap:][same] * factor))
        yield row, len(part), np.concatenate([a for a, _ in found]), (mix(np.concatenate([b for _, b in found])) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct_rows(owner: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(owner * (1 << BITS) + spot)
    return key >> BITS, key & ((1 << BITS) - 1)


def fit(examples: list[tuple[np.ndarray, int]], rates: Rates) -> np.ndarray:
    """Weights of one shard, the last of which is the bias, one example at a time."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        own = z[at]
        w = -(own - np.sign(own) * rates.l1) / ((rates.beta + np.sqrt(n[at])) / rates.alpha + rates.l2)
        return np.where(np.abs(own) <= rates.l1, 0.0, w)

    for _ in range(rates.epochs):
        for spot, label in examples:
            at = np.append(spot, 1 << BITS)
            w = weights(at)
            slope = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            own = n[at]
            z[at] += slope - (np.sqrt(own + slope * slope) - np.sqrt(own)) / rates.alpha * w
            n[at] = own + slope * slope
    return weights(np.arange((1 << BITS) + 1))


def train(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", sample_rows: int = 40_000, shards: int = 2, rates: Rates = Rates()) -> list[tuple[int, float]]:
    """The non-zero weights (coordinate, weight) from labelled rows.

    docs: doc_id and the text column; labels: doc_id, label 0 or 1 (rows with nulls are left out). About sample_rows
    labelled ids at most are used, those of the smallest hashes: a bounded table that is broadcast to
    the documents. They are dealt by the hash of the id to a fixed number of shards, each fitted
    alone, from the coordinates of its texts, which are hashed where the texts lie; the weights are averaged. No labelled
    row at all gives no weights.
    """
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)").groupBy("_id").agg(F.max("_label").alias("_label"))
    n = usable.count()
    if not n:
        return []
    share = min(1.0, sample_rows / n)
    spread = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30))
    sampled = usable.where(spread < int(share * (1 << 30)))  # sample_rows expected: its size is bounded, so it is broadcast
    known = docs.select("doc_id", text_or_empty(text_col).alias("text")).join(F.broadcast(sampled), F.col("doc_id") == F.col("_id"))
    dealt = known.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "_label", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, size, owner, spot in features(batch.column(3)):
                owner, spot = distinct_rows(owner, spot)
                edge, raw = np.searchsorted(owner, np.arange(size + 1)), spot.astype("<i4").tobytes()
                at = pa.array([raw[4 * a : 4 * b] for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, size) for k in range(3)), at], ["shard", "doc_id", "_label", "at"])

    def fit_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("at", "ascending")]).combine_chunks()
        examples = [(np.frombuffer(at.as_buffer(), "<i4"), label) for at, label in zip(table["at"], table["_label"].to_pylist(), strict=True)]
        order = np.random.default_rng(0).permutation(len(examples))
        w = fit([examples[i] for i in order], rates)
        at = np.flatnonzero(w)
        return pa.table({"coordinate": pa.array(at, pa.int64()), "weight": pa.array(w[at])})

    dealt = dealt.mapInArrow(lean(hashed), "shard int, doc_id long, _label int, at binary")
    found = dealt.groupBy("shard").applyInArrow(fit_shard, "coordinate long, weight double")
    mean = found.groupBy("coordinate").agg((F.sum("weight") / shards).alias("weight"))
    return [(r.coordinate, r.weight) for r in mean.collect()]  # 2**BITS + 1 rows at most, and few after L1


def score(docs: DataFrame, model: list[tuple[int, float]], *, text_col: str = "text") -> DataFrame:
    """(row, score): every row of docs as a struct and its score; null and empty texts get the bias's score."""
    shipped = docs.sparkSession.sparkContext.broadcast((np.array([m[0] for m in model], np.int64), np.array([m[1] for m in model])))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((1 << BITS) + 1)
        weights[shipped.value[0]] = shipped.value[1]
        for batch in batches:
            out = np.full(batch.num_rows, weights[-1])
            texts = pc.struct_field(batch.column(0), at)
            for row, size, owner, spot in features(texts.fill_null("") if texts.null_count else texts):
                live = weights[spot] != 0
                owner, spot = distinct_rows(owner[live], spot[live])
                out[row : row + size] += np.bincount(owner, weights[spot], size)
            value = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], ["row", "score"])

    at = docs.columns.index(text_col)  # texts are read within the rows, so that a batch holds them once
    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(lean(apply), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def known_labels(labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    return labels.select("doc_id", F.col(label_col).alias("label")).where(~held_out())


def toxicity(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", threshold: float = 0.7, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Only labels of rows that aren't held out are learned; labels, ids and all columns but text are no inputs
    of a score. A null text is empty. Null ids are scored and not learned from; repeated rows are scored
    each; without labels every score is one half. An empty table gives no rows.
    """
    model = train(docs, known_labels(labels, label_col), **settings)
    scored = score(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", threshold: float = 0.7, **settings) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns; cases as in toxicity."""
    model = train(docs, known_labels(labels, label_col), **settings)
    return score(docs, model).where(F.col("score") < threshold).select("row.*")
