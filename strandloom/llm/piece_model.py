"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here and rebuilt from the library's parts: normaliser, metaspace
marker, unigram scores or the merges that BPE scores stand for, and byte fallback. Where no piece
has a marker after another character, a text's ids are those of its words, so only the distinct words
of a chunk are encoded, in multithreaded batches, and each newly seen word is verified against the
sentencepiece library.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from strandloom.llm.common import text_or_empty, tokenizer_file
from strandloom.llm.word_ids import Gather, chunks, utf8

MARK = "▁"
#: Fixed values of the format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7)
        if size is None:
            if tag & 7 != 2:
                raise ValueError("unknown wire type")
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What the protobuf says, with the format's defaults."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_space: bool = False
    charsmap: bytes = b""
    prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                model.pieces.append(own.get(1, b"").decode())
                model.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                model.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(fields(value))
                model.kind, model.byte_fallback, model.suffix_space = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
            elif number == 3:
                own = dict(fields(value))
                model.charsmap = own.get(2, b"")
                model.prefix, model.squeeze, model.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        if model.kind not in (UNIGRAM, BPE) or model.suffix_space or not model.escape or model.pieces.count("") > 1:
            raise ValueError("only unigram and BPE models with leading markers can be rebuilt")
        return model

    @property
    def by_words(self) -> bool:
        """No piece goes over a word's end, and nothing is normalised."""
        return not self.charsmap and not self.squeeze and self.prefix and USER not in self.kinds and not any(MARK in p.lstrip(MARK) for p in self.pieces)

    def tokenizer(self, prefix: bool) -> Tokenizer:
        unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else None
        live = {p: k for k, p in enumerate(self.pieces) if self.kinds[k] in (NORMAL, USER)}
        if self.kind == UNIGRAM:
            built = Tokenizer(models.Unigram(list(zip(self.pieces, self.scores, strict=True)), unknown, self.byte_fallback))
        else:
            merges = []
            for piece, k in live.items():
                cuts = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in live and piece[i:] in live]
                merges += [(-self.scores[k], k, live[a], live[b], a, b) for a, b in cuts]
            vocabulary = {p: k for k, p in enumerate(self.pieces)}
            built = Tokenizer(models.BPE(vocabulary, [m[-2:] for m in sorted(merges)], unk_token=self.pieces[unknown] if unknown is not None else None, fuse_unk=True, byte_fallback=self.byte_fallback))
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        steps += [normalizers.Replace(" ", MARK)] + [normalizers.Prepend(MARK)] * (prefix and self.prefix)
        built.normalizer = normalizers.Sequence(steps)
        built.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return built

#: Of so many texts of a chunk, one is compared with the library whole.
WHOLE_EVERY = 64


class PieceEncoder:
    """Ids of whole texts, texts of ids, and whether words agreed with the sentencepiece library."""

    def __init__(self, definition: bytes, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.threads, self.model = threads, Model.parse(definition)
        self.whole, self.word = self.model.tokenizer(True), self.model.tokenizer(False)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=definition)
        self.words = Gather(self._encode_words)
        self.by_words = self.model.by_words
        plain = [b"" if k in (CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.model.pieces, self.model.kinds, strict=True)]
        self.flat = np.frombuffer(b"".join(plain), np.uint8)
        self.size = np.fromiter(map(len, plain), np.int64, len(plain))
        self.first = np.cumsum(self.size) - self.size

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Words start with a space. One extra id at the front tells whether both libraries agree."""
        found: list[list[int]] = []
        for at in range(0, len(words), 8192):
            part = [w.decode() for w in words[at : at + 8192]]
            own = [e.ids for e in self.word.encode_batch(part, add_special_tokens=False)]
            other = self.library.encode([w[1:] for w in part], num_threads=self.threads)
            # The library adds the marker of its own accord, but to no empty text.
            found += [[int(a == b or w == " "), *a] for w, a, b in zip(part, own, other, strict=True)]
        return found

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each chunk of strings without nulls: number of ids, parity and, in one array, the ids of its texts."""
        for _, part in chunks(texts):
            if self.by_words:
                yield self._by_words(part)
            else:
                listed = part.to_pylist()
                own = [e.ids for e in self.whole.encode_batch(listed, add_special_tokens=False)]
                same = [a == b for a, b in zip(own, self.library.encode(listed, num_threads=self.threads), strict=True)]
                yield np.fromiter(map(len, own), np.int64, len(own)), np.array(same, bool), np.fromiter((i for x in own for i in x), np.uint32)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marked = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False)
        empty = pc.equal(pc.binary_length(texts), 0)
        joined = pc.if_else(pc.or_(empty, pa.array(marked)), "", pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
        data, at = utf8(joined)
        start = data == 32
        start[1:] &= data[:-1] != 32
        start[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(start)
        slots = self.words.look_up(data, starts) if len(starts) else np.zeros(0, np.int64)
        size = self.words.first[slots + 1] - self.words.first[slots]
        ids, head = self.words.ids(slots), np.cumsum(size) - size
        edge = np.searchsorted(starts, at)
        total = np.concatenate(([0], np.cumsum(size - 1)))
        n = total[edge[1:]] - total[edge[:-1]]
        wrong = np.concatenate(([0], np.cumsum(ids[head] == 0)))
        same = wrong[edge[1:]] == wrong[edge[:-1]]
        keep = np.ones(len(ids), bool)
        keep[head] = False
        ids = ids[keep]
        ends = np.cumsum(n)
        for i in range(0, len(texts), WHOLE_EVERY):  # a share of the texts is compared whole, beside all distinct words
            if not marked[i]:
                same[i] = same[i] and ids[ends[i] - n[i] : ends[i]].tolist() == self.library.encode(texts[i].as_py())
        if marked.any():  # a marker in the text itself: such texts are encoded whole
            ends, pieces = np.cumsum(n), []
            for i in range(len(texts)):
                own = ids[ends[i] - n[i] : ends[i]]
                if marked[i]:
                    text = texts[i].as_py()
                    own = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
                    same[i] = own.tolist() == self.library.encode(text)
                pieces.append(own)
            n, ids = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.concatenate(pieces)
        return n, same, ids

    def decode(self, n: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts of chunks of n ids each; bytes that are no character become U+FFFD, as in the library."""
        size = self.size[ids]
        ends = np.cumsum(size)
        data = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[ids] - ends + size, size)].tobytes()
        total = np.concatenate(([0], ends))
        last = np.cumsum(n)
        out = []
        for a, b in zip(total[last - n], total[last], strict=True):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if self.model.prefix and text.startswith(" ") else text)
        return out


_KNOWN: dict[int, PieceEncoder] = {}


def piece_encoder(definition: bytes) -> PieceEncoder:
    key = hash(definition)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = PieceEncoder(definition)
    return _KNOWN[key]


def encode_pieces(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, parity (agrees with the sentencepiece library) and ids (little-endian u32 bytes) of every row.

    A null text is empty and has no ids; null and repeated ids are kept; other columns are ignored; an
    empty table gives no rows. Rows stay where they are read: nothing is shuffled.
    """
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_file(model_path)[0])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(definition.value)
        for batch in batches:
            row = 0
            for n, same, ids in encoder.encode(batch.column(1)):
                ends, raw = np.cumsum(n), ids.astype("<u4").tobytes()
                data = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(n), pa.array(same), pa.array(data, pa.binary())], ["doc_id", "n_tokens", "parity", "ids"])
                row += len(n)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, parity boolean, ids binary")


def decode_pieces(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, ...) with the column text in place of ids; null ids give an empty text."""
    definition = rows.sparkSession.sparkContext.broadcast(tokenizer_file(model_path)[0])
    others = [c for c in rows.columns if c != "ids"]
    schema = rows.select(*others).schema.add("text", "string")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(definition.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.frombuffer(x or b"", "<u4") for x in part.column(len(others)).to_pylist()]
                texts = encoder.decode(np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*others, "text"])

    return rows.select(*others, "ids").mapInArrow(decode, schema)
