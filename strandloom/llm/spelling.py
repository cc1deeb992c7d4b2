"""Spelling variants: words one edit apart, by a rare-first prefix filter over positional bigrams.

Bigrams of all distinct words are ordered by frequency. An edit destroys two of a word's bigrams at most, so of two near words' three rarest
ones (and those as rare as the third) at least one is common, at the same place or, where one word is longer, one further. Only these
are joined, by bigram, length, place and the half of the word that an edit on the bigram's left or right leaves whole, and what meets is compared. Corpus texts are
read once, words are counted before they are shuffled, and the order holds a row for each pair of letters.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, let_go, text_or_empty

#: Letters of words: maximal runs of these.
LETTERS = "A-Za-zÀ-ÿ"
#: Code points and occurrences of a word, the share of spoilt runs, and how many times more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, SPOILT, TIMES = 7, 2, 31, 10
#: Bigrams that an edit can destroy, and one more.
RAREST = 3


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of runs of letters, A-Z lower-cased, of `length` code points and `least` occurrences at least.

    Runs lose a code point where the checksum h of `<doc_id>:<run>` is divisible by SPOILT: that at h modulo their length.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(text_or_empty(text_col), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))).alias("_run"))
    runs = runs.select("_id", lower_ascii(F.col("_run")).alias("_run"))
    hashed = runs.select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    spoilt = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    words = hashed.select(F.when(F.col("_h") % SPOILT == 0, spoilt).otherwise(F.col("_run")).alias("word")).where(F.char_length("word") >= length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """(word, n, size, gram, at): of each word, the RAREST rarest bigrams of all words' and those equal to the last of them."""
    size = F.char_length("word")
    grams = words.select("word", "n", size.alias("size"), F.posexplode(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("at", "gram"))
    # A row for each pair of letters: 90 * 90 at most.
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = grams.join(F.broadcast(often), "gram").groupBy("word", "n", "size").agg(F.array_sort(F.collect_list(F.struct("often", "gram", "at"))).alias("grams"))
    last = F.col("grams")[RAREST - 1]
    kept = F.filter("grams", lambda g: (g["often"] < last["often"]) | ((g["often"] == last["often"]) & (g["gram"] <= last["gram"])))
    return ranked.select("word", "n", "size", F.explode(kept).alias("g")).select("word", "n", "size", "g.gram", "g.at")


def _halves(kind: int, size: Column, at: Column) -> list[Column]:
    """Keys of a word that keeps a bigram at `at` of the shorter word of a pair, which has `size` letters, while an edit is right of it (kind 0) or left of it (kind 1).

    What lies on the other side is equal, and of the edit's own side so is the half before or the half after the edit.
    """
    word = F.col("word")
    if kind == 0:
        half = F.floor((size - at - 2) / 2).cast("int")
        return [F.xxhash64(F.lit(0), size, at, F.left(word, at + 2 + half)), F.xxhash64(F.lit(1), size, at, F.left(word, at + 2), F.right(word, size - at - 2 - half))]
    half = F.floor(at / 2).cast("int")
    return [F.xxhash64(F.lit(2), size, at, F.left(word, half), F.right(word, size - at)), F.xxhash64(F.lit(3), size, at, F.right(word, size - half))]


def near_words(words: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(word, n, near, near_n): words (word, n) that differ by exactly one inserted, deleted or replaced code point, in both directions.

    Rarest bigrams meet at places that an edit allows, together with the half of the word that the edit left whole.
    """
    scratch = scratch or Scratch(words.sparkSession, "near")
    prefix = scratch.put("rarest", rarest_bigrams(words))
    size, at = F.col("size"), F.col("at")
    alike = F.concat(*(F.array(*_halves(kind, size, at)) for kind in (0, 1)))
    # As the longer word of a pair: the bigram is one further where the edit is left of it.
    right = F.when(at + 2 < size, F.array(*_halves(0, size - 1, at))).otherwise(F.array().cast("array<long>"))
    left = F.when(at > 0, F.array(*_halves(1, size - 1, at - 1))).otherwise(F.array().cast("array<long>"))
    short = prefix.select(F.explode(alike).alias("key"), "word", "n")
    long = prefix.select(F.explode(F.concat(right, left)).alias("key"), F.col("word").alias("near"), F.col("n").alias("near_n"), F.lit(True).alias("longer"))
    other = long.unionAll(short.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), F.lit(False)))
    met = short.join(other, (short["key"] == other["key"]) & (F.col("longer") | (F.col("word") < F.col("near"))) & (F.levenshtein("word", "near", 1) == 1))
    pairs = met.select("word", "n", "near", "near_n").distinct()
    return pairs.unionAll(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def last_forms(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form), following forms to the last.

    A form is TIMES as frequent as its word, so chains are short, without cycles, and every round halves what is left of them.
    """
    roots = scratch.put("roots", links.select("word", F.col("form").alias("root")))
    while True:
        far = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = roots.join(far, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        moved = scratch.put("moved", moved)
        if moved.where("moved").isEmpty():
            return roots
        roots = scratch.put("roots", moved.select("word", "root"))


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LEAST_LENGTH, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts.

    form is the most frequent near word (of ties the smallest), if it is `times` as frequent; root the last of the forms that follow from a word. Null and empty texts
    have no words; a null id counts as an empty string in the checksum; repeated rows count each; a long run is a word like any; an empty table gives none; other
    columns are ignored.
    """
    if length < RAREST + 1:
        raise ValueError("shorter words have too few bigrams")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.put("words", word_counts(docs, id_col, text_col, length, least))
    let_go(docs.sparkSession)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near")))
    near = near_words(words, scratch).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left").withColumn("near_n", -F.col("best.order"))
    likely = F.col("near_n") >= times * F.col("n")
    formed = scratch.put("forms", joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("best.near")).alias("form"), F.when(likely, F.col("near_n")).alias("form_n")))
    roots = last_forms(formed.where("form IS NOT NULL"), scratch)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
