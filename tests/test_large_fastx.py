"""Files too large to be held are read as lines, with the same records."""

import gzip
import random

import pytest

from strandloom.sources import fastx


def rows(spark, path):
    return sorted((tuple(r) for r in fastx.read_fastx(spark, path).collect()), key=str)


def test_lines_give_the_same_records(spark, tmp_path, monkeypatch):
    rng, base = random.Random(2), tmp_path / "some files"
    base.mkdir()
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    texts = []
    for end in ("\n", "\r\n", "\r"):
        parts = ["", "no record"]
        for k in range(40):
            s = word(rng.randint(0, 50))
            parts += [f"@r{k} caf\xe9 x", s[:20], s[20:], "+", "@" * min(20, len(s)), "+" * (len(s) - 20)] if k % 2 else [f">r{k}", s[:10], s[10:], ""]
        texts.append(end.join(parts).encode("latin-1"))
    texts += [texts[0] + b"\n@cut\nACGT\n+\nII", b"", b"\n"]
    for k, text in enumerate(texts):
        (base / f"{k}.fq").write_bytes(text)
    (base / "z.fq.gz").write_bytes(gzip.compress(texts[0]))
    want = rows(spark, str(base))
    monkeypatch.setattr(fastx, "WHOLE", 0)
    assert rows(spark, str(base)) == want
    assert len(want) > 150


def test_a_large_gzipped_file_of_another_name_is_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "a.fq").write_bytes(gzip.compress(b">a\nACGT\n"))
    monkeypatch.setattr(fastx, "WHOLE", 0)
    with pytest.raises(Exception, match="gzipped"):
        fastx.read_fastx(spark, str(tmp_path)).collect()
