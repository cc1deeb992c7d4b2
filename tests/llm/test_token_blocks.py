import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandloom.llm.token_blocks import BLOCK, decode_block, decode_segment, encode_segment, read_token_blocks, write_token_blocks

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK + 77])
@pytest.mark.parametrize("top", [1, 2, 50_257, 2**32])
def test_round_trip(size, top):
    rng = np.random.default_rng(size + top)
    ids = np.where(rng.random(size) < 0.03, rng.integers(0, top, size), rng.integers(0, min(top, 900), size)).astype(np.uint32)
    data = encode_segment(ids)
    assert (decode_segment(data) == ids).all()
    index = np.frombuffer(data, "<u4", -(-size // BLOCK), 12)
    for k, at in enumerate(index):
        own = ids[k * BLOCK : (k + 1) * BLOCK]
        assert (decode_block(data, int(at), len(own)) == own).all()


def test_outliers_stay_out_of_the_width():
    ids = np.zeros(BLOCK, np.uint32)
    ids[7] = 50_000
    assert len(encode_segment(ids)) < 40


def test_files_hold_the_library_ids(spark, tmp_path):
    texts = [(3, "a b  c\n"), (1, None), (2, ""), (9, "naïve — 漢字 <|endoftext|> x"), (None, "no id"), (3, "a b  c\n"), (5, "word " * 30_000)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts], "doc_id long, text string, part int")
    path = str(tmp_path / "blocks")
    write_token_blocks(docs, PATH, path, segment_ids=1000)
    got = sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in read_token_blocks(spark, path).collect())
    tokenizer, want, start = Tokenizer.from_file(PATH), [], 0
    for key, text in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((start, key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    write_token_blocks(spark.createDataFrame([], "doc_id long, text string"), PATH, path)
    assert read_token_blocks(spark, path).count() == 0
