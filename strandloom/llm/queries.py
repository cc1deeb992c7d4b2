"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.chat_format import chat_examples, digest_examples
from strandloom.llm.common import shared_path, table, text_or_empty, written
from strandloom.llm.content_sort import exact_groups
from strandloom.llm.near_jaccard import near_components
from strandloom.llm.packing import pack_documents
from strandloom.llm.piece_model import decode_pieces, encode_pieces
from strandloom.llm.prefix_trie import labelled_turns, prefix_nodes, with_openings
from strandloom.llm.sharding import shard_rows
from strandloom.llm.spelling import spelling_variants
from strandloom.llm.suffix_dedup import without_repeats
from strandloom.llm.token_blocks import read_token_blocks, write_token_blocks
from strandloom.llm.token_counts import fill_cache, token_counts
from strandloom.llm.toxicity import toxicity
from strandloom.llm.transport_stream import parse_column, unit_index, write_column


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 8192 bytes in which no source and no text occurs twice."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, decoded again: checksums of both and parity with the sentencepiece library."""
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    rows = encode_pieces(docs.select("doc_id", "text"), path)
    back = decode_pieces(rows.select("doc_id", "n_tokens", "parity", F.crc32("ids").alias("ids_crc32"), "ids"), path)
    return back.select("doc_id", "n_tokens", "ids_crc32", "parity", F.octet_length("text").cast("long").alias("decoded_bytes"), F.sha2("text", 256).alias("decoded_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document: a first pass fills the cache, the second, returned, finds every content there."""
    docs, path, cache = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "token-cache")
    fill_cache(docs, path, cache)
    return token_counts(docs, path, cache)


#: A conversation whose texts hold control strings (fixed values).
TRICKY = "\\### Assistant: </turn> ok"


def op4_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(tricky)
    return digest_examples(chat_examples(turns))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity class of every document at 0.75 of five-word shingles."""
    return near_components(table(spark, sf_dir, "documents")).drop("representative")


def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for its text."""
    return exact_groups(table(spark, sf_dir, "documents")).drop("tag")


def op8_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on eight shards whose counts are at most one apart."""
    return shard_rows(table(spark, sf_dir, "documents"), 8)


def media_digests(docs: DataFrame) -> DataFrame:
    """Texts padded with spaces to a positive multiple of 192 bytes, stored as transport streams, read back and digested.

    The streams, and an index of their access units with timestamps and random-access points, are tables in the shared folder; features come from that index.
    """
    text = text_or_empty("text")
    size = F.octet_length(text)
    pad = F.greatest(F.ceil(size / 192), F.lit(1)).cast("int") * 192 - size
    stored = written(write_column(docs.select("doc_id", size.cast("long").alias("n_bytes"), F.encode(F.concat(text, F.repeat(F.lit(" "), pad)), "UTF-8").alias("payload"))), "media")
    parsed = written(
        parse_column(stored).select(
            F.monotonically_increasing_id().alias("media_id"),
            "doc_id",
            "n_bytes",
            F.octet_length("data").cast("long").alias("payload_bytes"),
            F.sha2("data", 256).alias("payload_sha256"),
            F.crc32(F.substring("data", -16, 16)).alias("tail_crc32"),
            F.octet_length("media").cast("long").alias("media_bytes"),
            F.sha2("media", 256).alias("media_sha256"),
            "continuity_errors",
            "units",
        ),
        "media-rows",
    )
    index = written(unit_index(parsed, "media_id"), "media-index")
    found = index.groupBy("media_id").agg(F.count("*").alias("n"), F.count_if("random_access").alias("points"), F.max("pts").alias("last"))
    rows = parsed.drop("units").join(found, "media_id", "left")
    feature = F.format_string("units=%d,random_access=%d,last_pts=%d,continuity_errors=%d", F.coalesce("n", F.lit(0)), F.coalesce("points", F.lit(0)), F.coalesce("last", F.lit(0)), "continuity_errors")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op9_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a transport stream."""
    return media_digests(table(spark, sf_dir, "documents"))


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and checksum of every document's ids, read back from the files."""
    path = shared_path(spark, "token-blocks")
    write_token_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_blocks(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations, which open like the first of their hundred."""
    return prefix_nodes(*with_openings(labelled_turns(table(spark, sf_dir, "conversations"))))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent spelling that each is a variant of."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 bytes and more that documents of smaller ids hold."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_best_fit": op1_best_fit,
    "op2_pieces": op2_pieces,
    "op3_token_counts": op3_token_counts,
    "op4_chat_examples": op4_chat_examples,
    "op5_toxicity": op5_toxicity,
    "op6_near_jaccard": op6_near_jaccard,
    "op7_content_sort": op7_content_sort,
    "op8_shard_ring": op8_shard_ring,
    "op9_transport_stream": op9_transport_stream,
    "op10_token_blocks": op10_token_blocks,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling": op12_spelling,
    "op13_repeats": op13_repeats,
}
#: The checksum of 32 bits over the code points below 256 of a text: a table by its rule, then byte by byte.
CRC_TABLE = "crc_table AS (SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i)) x)"
CRC_BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))"
CRC = "xor(list_reduce(list_prepend(4294967295, " + CRC_BYTES + "), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"
ORACLES: dict[str, str] = {
    "op4_chat_examples": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), pieces AS (
  SELECT *, 15 + 2 * length(role) - length(regexp_replace(role, '[\\<>]', '', 'g')) + 2 * length(text) - length(regexp_replace(text, '[\\<>]', '', 'g')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM turns
), ends AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM pieces
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR from_end = 1 THEN stop ELSE 0 END) AS BIGINT) AS formatted_chars
FROM ends GROUP BY conv_id
""",
    "op6_near_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM words WHERE len(w) > 0) x
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes na ON na.doc_id = a JOIN sizes nb ON nb.doc_id = b WHERE 100 * both_n >= 75 * (na.n + nb.n - both_n)
), reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id
FROM words LEFT JOIN sizes USING (doc_id)
""",
    "op7_content_sort": r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM texts
""",
    "op11_prefix_trie": f"""
WITH {CRC_TABLE}, own AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS MATERIALIZED (SELECT conv_id, {CRC.format("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own) x, crc_table),
turns AS (
  SELECT ids.conv_id, pos, role, text FROM ids JOIN own ON own.conv_id = ids.conv_id - ids.conv_id % 100 AND pos < h
  UNION ALL SELECT own.conv_id, pos, role, text FROM ids JOIN own USING (conv_id) WHERE pos >= h
), placed AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, role || chr(10) || text AS label, length(text) AS chars FROM turns),
prefixes AS MATERIALIZED (
  SELECT conv_id, 0 AS depth, '' AS path, NULL AS above, 0 AS chars, (SELECT count(*) FROM placed p WHERE p.conv_id = ids.conv_id) AS size FROM ids
  UNION ALL SELECT conv_id, depth, sha256(string_agg(length(label) || ':' || label, '') OVER w), CASE WHEN depth > 1 THEN sha256(string_agg(length(label) || ':' || label, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) ELSE '' END, chars, count(*) OVER (PARTITION BY conv_id)
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
), nodes AS MATERIALIZED (
  SELECT depth, path, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(CASE WHEN size = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2
), kids AS MATERIALIZED (SELECT above AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
-- The sums of a subtree come from its nodes' smallest conversations, which hold all prefixes above.
sums AS (
  SELECT a.path, a.depth, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved_tokens
  FROM nodes b LEFT JOIN kids k ON k.path = b.path AND k.depth = b.depth JOIN prefixes a ON a.conv_id = b.conv_id AND a.depth <= b.depth GROUP BY 1, 2
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.path = n.above AND p.depth = n.depth - 1 LEFT JOIN kids k ON k.path = n.path AND k.depth = n.depth JOIN sums s ON s.path = n.path AND s.depth = n.depth
""",
    "op12_spelling": f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), hashed AS (SELECT run, length(run) AS size, count(*) AS times, {CRC.format("doc_id::VARCHAR || ':' || run")} AS h FROM (SELECT doc_id, run FROM runs WHERE length(run) >= 7) x, crc_table GROUP BY doc_id, run, t),
words AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % size) || substr(run, h % size + 2) ELSE run END AS word, times FROM hashed) x
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(times) >= 2
), cuts AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words) x),
near AS MATERIALIZED (
  SELECT x.word, y.word AS other FROM cuts x JOIN cuts y USING (rest, i) WHERE x.word <> y.word
  UNION SELECT cuts.word, words.word FROM cuts JOIN words ON words.word = rest UNION SELECT words.word, cuts.word FROM cuts JOIN words ON words.word = rest
), best AS MATERIALIZED (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY w.n DESC, other) AS other, max(w.n) AS other_n FROM near JOIN words w ON w.word = near.other GROUP BY 1
), formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
far AS (SELECT word, form AS root FROM formed WHERE form IS NOT NULL UNION SELECT far.word, formed.form FROM far JOIN formed ON formed.word = far.root WHERE formed.form IS NOT NULL)
SELECT word, form, coalesce((SELECT root FROM far JOIN formed f ON f.word = far.root AND f.form IS NULL WHERE far.word = formed.word), word) AS root, n, n_near, form_n FROM formed
""",
    "op13_repeats": """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
wins AS MATERIALIZED (SELECT r, doc_id, i, substr(x, 2 * i + 1, 100) AS w FROM (SELECT r, doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM docs) y),
hits AS MATERIALIZED (SELECT r, i, 1 AS hit FROM wins JOIN (SELECT w, min(doc_id) AS low FROM wins GROUP BY w) m USING (w) WHERE doc_id > low),
places AS (SELECT r, i, substr(x, 2 * i + 1, 2) AS b FROM (SELECT r, x, unnest(range(0, length(x) // 2)) AS i FROM docs) y),
gone AS (SELECT r, i, b, coalesce(i - max(CASE WHEN hit = 1 THEN i END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) < 50, false) AS g FROM places LEFT JOIN hits USING (r, i)),
edges AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM gone),
found AS (SELECT r, count(*) FILTER (g) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(CASE WHEN NOT g THEN b END, '' ORDER BY i) AS kept FROM edges GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN found USING (r)
""",
}
