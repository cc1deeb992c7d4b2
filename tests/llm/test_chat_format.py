import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm.chat_format import chat_examples, digest_examples, escape, parse_turns, unescape
from pyspark.sql import functions as F

HARD = ["\\", "<", ">", "</turn>\n", "<turn user>", "\\l", "\\b", "a", " ", "\n", "é", "𝄞"]


def test_escaping_is_reversible(spark):
    texts = ["".join(p) for p in zip(HARD, HARD[1:] + HARD[:1])] + ["\\\\l\\<", "\\### Assistant: </turn> ok", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).select("t", "e", unescape(F.col("e")).alias("back"))
    for row in frame.collect():
        assert row.back == row.t and "<" not in row.e and ">" not in row.e


def model(rows):
    """Brute force of one conversation's digest."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
    code = lambda t: "".join({"\\": "\\b", "<": "\\l", ">": "\\g"}.get(c, c) for c in t)
    text, chars = "", 0
    for k, (_, role, body) in enumerate(rows):
        text += f"<turn {code(role or '')}>{code(body or '')}</turn>\n"
        if role == "assistant" or k == len(rows) - 1:
            chars += len(text)
    loss = "".join(b or "" for _, r, b in rows if r == "assistant")
    turns = "".join(f"{r or ''}\n{b or ''}\n" for _, r, b in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(rows), sha(turns), len(loss), sha(loss), chars


turn = st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.sampled_from(["user", "assistant", "system", None, "a>b\n"]), st.one_of(st.none(), st.lists(st.sampled_from(HARD), max_size=5).map("".join)))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(turn, min_size=1, max_size=7), min_size=1, max_size=6))
def test_digests_match_brute_force(spark, conversations):
    rows = [(k if k else None, *t, "x") for k, c in enumerate(conversations) for t in c]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in digest_examples(chat_examples(frame)).collect()}
    assert got == {k if k else None: model(c) for k, c in enumerate(conversations)}


def test_each_reply_is_the_only_trainable_part(spark):
    frame = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "r<1"), (1, 2, "user", "q2"), (1, 3, "assistant", "r2"), (1, 4, "user", "z")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat_examples(frame).collect(), key=lambda r: r.example)
    assert [(r.kind, r.n_turns) for r in rows] == [("reply", 2), ("reply", 4), ("tail", 5)]
    assert [r.text[r.loss_start : r.loss_start + r.loss_chars] for r in rows] == ["r\\l1", "r2", ""]
    assert rows[2].text.startswith(rows[1].text) and rows[1].text.startswith(rows[0].text)
    assert chat_examples(frame.limit(0)).count() == 0


def test_long_conversation(spark):
    frame = spark.range(1500).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("word ").alias("text"))
    row = digest_examples(chat_examples(frame)).first()
    assert (row.n_turns, row.loss_chars) == (1500, 750 * 5)
