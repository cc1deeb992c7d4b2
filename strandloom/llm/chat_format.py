"""Chat formatting with prefix-target expansion, in DataFrame functions only.

A turn is rendered as ``<turn ROLE>TEXT</turn>\\n``. Inside roles and texts the backslash and the
angle brackets become two-letter codes, so no control string can occur there and reading back is
exact. Every assistant turn becomes an example: the conversation up to that turn, of which only
the reply is trainable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import text_or_empty

OPEN, SHUT, CLOSE = "<turn ", ">", "</turn>\n"
#: Codes of the characters that control strings hold; the backslash is the first to be coded and the last to be read.
CODES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def chat_examples(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row for each reply, and one for what follows a conversation's last reply.

    Columns: conv_id, example (from 0), kind (`reply`, or `tail` for turns that no reply follows; nothing
    in a tail is trainable), n_turns (in text), text, loss_start, loss_chars (code points of text).
    Turns are ordered by turn, then role and text; repeated rows are turns of their own; null roles and
    texts are empty; a null id is a conversation like any other; null turns come first; an empty table
    gives no rows; other columns are ignored. A conversation is put together once and cut at each reply,
    so its turns are not joined with each other; as one value, a conversation is bounded by Spark's 2 GB.
    """
    own = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    body = escape(F.col("text"))
    pieces = (
        own.withColumn("body_chars", F.length(body))
        .withColumn("piece", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SHUT), body, F.lit(CLOSE)))
        .select(
            "conv_id",
            "piece",
            "body_chars",
            (F.col("role") == target_role).alias("is_reply"),
            F.row_number().over(order).alias("n"),
            F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
        )
    )
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "end", "is_reply", "body_chars", "piece"))).alias("turns"))
    cuts = F.filter("turns", lambda t: t.is_reply | (t.n == F.size("turns")))
    cuts = F.transform(cuts, lambda t: F.struct(t.n.alias("n"), t.end.alias("end"), t.is_reply.alias("is_reply"), t.body_chars.alias("body_chars")))
    rows = whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t.piece), "").alias("whole"), F.posexplode(cuts).alias("example", "cut"))
    return rows.select(
        "conv_id",
        "example",
        F.when(F.col("cut.is_reply"), "reply").otherwise("tail").alias("kind"),
        F.col("cut.n").alias("n_turns"),
        F.substring("whole", F.lit(1), F.col("cut.end").cast("int")).alias("text"),
        F.when(F.col("cut.is_reply"), F.col("cut.end") - len(CLOSE) - F.col("cut.body_chars")).otherwise(F.col("cut.end")).alias("loss_start"),
        F.when(F.col("cut.is_reply"), F.col("cut.body_chars")).otherwise(0).cast("long").alias("loss_chars"),
    )


def loss_text(text: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, read from the formatted text."""
    return unescape(F.substring(text, (start + 1).cast("int"), chars.cast("int")))


def parse_turns(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    marked = F.filter(F.split(text, CLOSE), lambda piece: piece != "")
    return F.transform(
        marked,
        lambda piece: F.struct(
            unescape(F.substring(piece, F.lit(len(OPEN) + 1), F.locate(SHUT, piece) - (len(OPEN) + 1))).alias("role"),
            unescape(F.substring(piece, F.locate(SHUT, piece) + 1, F.length(piece))).alias("text"),
        ),
    )


def digest_examples(examples: DataFrame) -> DataFrame:
    """What the formatted rows of each conversation hold when read back."""
    last = Window.partitionBy("conv_id").orderBy("example")
    read = examples.select(
        "conv_id",
        "example",
        F.length("text").cast("long").alias("chars"),
        F.when(F.lead("example").over(last).isNull(), F.col("text")).alias("longest"),
        F.when(F.col("kind") == "reply", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_chars"))).alias("loss"),
    )
    each = read.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.element_at(F.collect_list("longest"), 1).alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", F.coalesce("loss", F.lit("")).alias("loss")))), lambda x: x.loss), "").alias("loss"),
    )
    each = each.withColumn("turns", parse_turns(F.col("longest")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return each.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
