import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandloom.llm import token_counts as C
from strandloom.llm.token_counts import fill_cache, open_cache, token_counts
from strandloom.llm.word_ids import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = ByteBpe(open(PATH, encoding="utf-8").read())
PIECES = ["a", "Zb", "é", "ß", "×", " ", "   ", "\n", "\t", "\r\n", "\x0b", "\x1c", "'", "'s", "'re", "'LL", "don't", "1", "23", ".", "!?", "—", "漢", "<|endoftext|>", "<|", "_"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=8))
def test_words_give_the_library_ids(texts):
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert ENCODER.counts(pa.array(texts, pa.string())).tolist() == [len(x) for x in want]
    got = [i for _, ids in ENCODER.encode(pa.array(texts, pa.string())) for i in ids.tolist()]
    assert got == [i for x in want for i in x]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), st.integers(1, 6))
def test_parts_of_a_long_text_give_the_library_ids(text, size):
    parts = list(ENCODER._parts(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in LIBRARY.encode(p, add_special_tokens=False).ids] == LIBRARY.encode(text, add_special_tokens=False).ids


def test_table_of_words_stays_bounded():
    small = ByteBpe(open(PATH, encoding="utf-8").read())
    small.words.limit, small.words.limit_bytes = 50, 1 << 12
    texts = pa.array([" ".join(f"w{i}{k}" for i in range(40)) for k in range(30)] + ["x" * 9000, "y"])
    for k in range(0, 32, 2):
        assert small.counts(texts[k : k + 2]).tolist() == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts[k : k + 2].to_pylist()]
        assert len(small.words.slot) <= 50 + 2 * 81


def test_cache_encodes_only_misses(spark, tmp_path):
    rows = [(1, "one two"), (2, None), (3, "one two"), (3, "one two"), (None, "x" * 5000), (5, "")]
    docs = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, n_tokens int")
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = sorted(token_counts(docs, PATH, cache, limit=1).collect(), key=str)
        want = [(k, len((t or "").encode()), n := len(LIBRARY.encode(t or "").ids), n > 1) for k, t in rows]
        assert got == sorted(want, key=str) or sorted(map(tuple, got), key=str) == sorted(want, key=str)
        assert open_cache(spark, cache).count() == 3  # distinct contents, also after the second run
    token_counts(docs.limit(0), PATH, cache).count()
    assert token_counts(docs.limit(0), PATH, str(tmp_path / "new")).count() == 0


def test_other_tokenizers_are_other_versions(spark, tmp_path):
    docs, cache = spark.createDataFrame([(1, "Some WORDS here")], "doc_id long, text string"), str(tmp_path / "cache")
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        assert token_counts(docs, path, cache).first().n_tokens == len(Tokenizer.from_file(path).encode("Some WORDS here", add_special_tokens=False).ids)
    assert open_cache(spark, cache).count() == 2


def test_hot_contents_and_few_misses(spark, tmp_path, monkeypatch):
    rows = [(k, "the same text" if k % 3 else f"text {k}") for k in range(300)]
    docs, cache = spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "cache")
    want = sorted((k, len(t), len(LIBRARY.encode(t).ids), False) for k, t in rows)
    monkeypatch.setattr(C, "BROADCAST_DIGESTS", 10)  # contents are grouped first, then met with the misses
    fill_cache(docs.where("doc_id < 200"), PATH, cache)
    before = open_cache(spark, cache).count()
    monkeypatch.undo()
    assert sorted(map(tuple, token_counts(docs, PATH, cache).collect())) == want
    after = open_cache(spark, cache).count()
    assert (before, after) == (68, 101)
    assert sorted(map(tuple, token_counts(docs, PATH, cache).collect())) == want and open_cache(spark, cache).count() == after
