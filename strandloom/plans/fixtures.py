"""Sequence tables derived from the driver's tables by SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.session import measured_broadcasts, table


def _md5s(key: str, parts: str) -> str:
    return "concat(" + ", ".join(f"md5(concat(cast({key} AS varchar(20)), ':{p}'))" for p in parts.split()) + ")"


HEX = "'0123456789abcdef'"
SQL = {
    # A genome of 128 bases for each customer, practically free of repeats.
    "G": f"SELECT c_custkey AS id, translate({_md5s('c_custkey', '0 1 2 3')}, {HEX}, 'ACGTACGTACGTACGT') AS s FROM [customer]",
    # Six error-free reads of 60 bases for each genome, 12 apart.
    "H": "SELECT id * 6 + w AS rid, id, w, substr(s, 1 + w * 12, 60) AS s FROM (SELECT id, s, [U]([SEQ](0, 5)) AS w FROM ([G]) g) x",
    # Qualities of those reads.
    "HQ": f"SELECT rid, s, substr(translate({_md5s('rid', 'q0 q1')}, {HEX}, '#$%&5555IIIIIIII'), 1, 60) AS q FROM ([H]) h",
    # Read pairs of insert 100.
    "HP": "SELECT id * 5 + w AS pid, id, w, substr(s, 1 + 4 * w, 40) AS r1, reverse(translate(substr(s, 61 + 4 * w, 40), 'ACGT', 'TGCA')) AS r2 FROM (SELECT id, s, [U]([SEQ](0, 4)) AS w FROM ([G]) g) x",
    # Read pairs of inserts from 88 to 100 that start at every other base, so some lie over the middle.
    "DP": "SELECT id * 15 + w AS pid, id, w, substr(s, 1 + 2 * w, 40) AS r1, reverse(translate(substr(s, 61 + 2 * w - 3 * ((w * 7) % 5), 40), 'ACGT', 'TGCA')) AS r2 FROM (SELECT id, s, [U]([SEQ](0, 14)) AS w FROM ([G]) g) x",
    # Dense reads, some with a substitution at base 30; s0 is the truth.
    "E": "SELECT id * 16 + w AS rid, id, w, CASE WHEN (id * 16 + w) % 17 = 0 THEN concat(substr(s0, 1, 29), translate(substr(s0, 30, 1), 'ACGT', 'CGTA'), substr(s0, 31, 30)) ELSE s0 END AS s, s0 FROM (SELECT id, w, substr(s, 1 + w * 4, 60) AS s0 FROM (SELECT id, s, [U]([SEQ](0, 15)) AS w FROM ([G]) g) x) y",
    # Genomes that branch (two haplotypes that part), close to a circle, or hold a repeat longer than a read, by turns.
    "GR": f"SELECT id, 0 AS k, CASE id % 3 WHEN 0 THEN s WHEN 1 THEN concat(s, substr(s, 1, 60)) ELSE concat(substr(s, 1, 40), substr(t, 1, 70), substr(s, 41, 40), substr(t, 1, 70), substr(s, 81, 40)) END AS g FROM ([GT]) a UNION ALL SELECT id, 1, concat(substr(s, 1, 64), substr(t, 1, 64)) FROM ([GT]) b WHERE id % 3 = 0",
    "GT": f"SELECT c_custkey AS id, translate({_md5s('c_custkey', '0 1 2 3')}, {HEX}, 'ACGTACGTACGTACGT') AS s, translate({_md5s('c_custkey', '4 5 6 7')}, {HEX}, 'ACGTACGTACGTACGT') AS t FROM [customer]",
    # Reads of 60 bases, 8 apart, of those genomes.
    "R": "SELECT id * 64 + k * 32 + w AS rid, id, substr(g, 1 + 8 * w, 60) AS s FROM (SELECT id, k, g, [U]([SEQ](0, 31)) AS w FROM ([GR]) g) x WHERE 8 * w + 60 <= length(g)",
    # Whole documents as DNA, rich in repeats; and with N for what is no letter.
    "T": "SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', ''[g]), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM [documents]",
    "TN": "SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', 'N'[g]), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM [documents]",
    # Edges between vertex ends.
    "EDGES": "SELECT l_orderkey AS a, l_partkey AS b, CAST(l_quantity AS INT) AS ovlp FROM [lineitem]",
    # Vertices with a length and a number of reads.
    "VERTICES": "SELECT p_partkey AS id, CAST(200 + p_size * 40 AS BIGINT) AS len, CAST(1 + p_partkey % 37 AS BIGINT) AS nsr, CAST(p_partkey % 61 AS BIGINT) AS maxo FROM [part]",
}
TABLES = ("customer", "documents", "lineitem", "part", "orders", "benchmark")


def _expand(text: str) -> str:
    while any(f"[{name}]" in text for name in SQL):
        for name, sql in SQL.items():
            text = text.replace(f"[{name}]", sql)
    return text


def duck(name: str) -> str:
    """The fixture as a DuckDB query."""
    text = _expand(f"[{name}]").replace("[U]", "unnest").replace("[SEQ]", "generate_series").replace("[g]", ", 'g'")
    for t in TABLES:
        text = text.replace(f"[{t}]", t)
    return text


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    measured_broadcasts(spark)
    text = _expand(f"[{name}]").replace("[U]", "explode").replace("[SEQ]", "sequence").replace("[g]", "")
    used = {}
    for t in TABLES:
        if f"[{t}]" in text:
            text, used[t] = text.replace(f"[{t}]", f"{{{t}}}"), table(spark, sf_dir, t)
    return spark.sql(text, **used)
