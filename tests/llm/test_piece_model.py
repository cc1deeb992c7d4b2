import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import piece_model as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
RAW = open(PATH, "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = P.PieceEncoder(RAW)
PARTS = ["a", "the", " ", "  ", "\n", "\t", "é", "漢", "🙂", "▁", "<s>", "<0x41>", ".", "1", "ing", "A", "̀", "\x00"]


def encoded(encoder, texts):
    out = []
    for n, same, ids in encoder.encode(pa.array(texts, pa.string())):
        ends = np.cumsum(n)
        out += [(ids[e - k : e].tolist(), bool(s)) for e, k, s in zip(ends, n, same, strict=True)]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=10).map("".join), min_size=1, max_size=6))
def test_parity_and_decoding(texts):
    got = encoded(ENCODER, texts)
    assert [g[0] for g in got] == [LIBRARY.encode(t) for t in texts] and all(g[1] for g in got)
    n = np.array([len(g[0]) for g in got])
    assert ENCODER.decode(n, np.array([i for g in got for i in g[0]], np.int64)) == [LIBRARY.decode(g[0]) for g in got]


def message(number, value):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram():
    pieces = [("<unk>", 0.0, P.UNKNOWN), ("<s>", 0.0, P.CONTROL), ("</s>", 0.0, P.CONTROL)]
    pieces += [(f"<0x{b:02X}>", 0.0, P.BYTE) for b in range(256)]
    pieces += [(p, s, P.NORMAL) for p, s in (("▁", -3.0), ("▁a", -2.5), ("a", -4.0), ("b", -4.5), ("ab", -5.25), ("▁ab", -6.5), ("ba", -6.0), ("abab", -8.0))]
    out = b"".join(message(1, message(1, p.encode()) + message(2, s) + message(3, k)) for p, s, k in pieces)
    trainer = message(3, P.UNIGRAM) + message(35, 1)
    return out + message(2, trainer) + message(3, message(1, b"identity") + message(4, 0))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab c", max_size=12), min_size=1, max_size=5))
def test_unigram_models(texts):
    raw = unigram()
    library, encoder = sentencepiece.SentencePieceProcessor(model_proto=raw), P.PieceEncoder(raw)
    assert encoder.by_words
    for (ids, _), text in zip(encoded(encoder, texts), texts, strict=True):
        score = lambda x: sum(library.get_score(i) for i in x if not library.is_byte(i))
        want = library.encode(text)
        assert library.decode(ids) == text and (ids == want or abs(score(ids) - score(want)) < 1e-5)


def test_unknown_formats_are_refused():
    with pytest.raises(ValueError):
        P.Model.parse(message(1, message(1, b"x")) + message(2, message(3, 4)))


def test_columns(spark):
    rows = [(1, "one  two\nthree"), (2, None), (3, ""), (None, "x"), (3, "word " * 20_000)]
    frame = spark.createDataFrame([(k, t, "i") for k, t in rows], "doc_id long, text string, ids string")
    got = P.encode_pieces(frame, PATH)
    back = P.decode_pieces(got, PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((k, t or "") for k, t in rows), key=str)
    assert all(r.parity for r in back)
    assert P.encode_pieces(frame.limit(0), PATH).count() == 0
