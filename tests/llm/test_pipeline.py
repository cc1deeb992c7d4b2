import re

import corpus_pipeline
from test_near_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
        assert k == len(corpus_pipeline.STAGES) - 1 or kept[-1].columns == columns
    rows = [{r.doc_id: r.text for r in frame.collect()} for frame in kept[:-1]]
    assert rows[1].items() <= rows[0].items() and len(rows[1]) > 0.5 * len(rows[0])
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for key in sorted(rows[1]):
        first.setdefault(norm(rows[1][key]), key)
    assert set(rows[2]) == set(first.values())
    assert set(rows[3]) == {k for k, _, c in brute(sorted(rows[2].items())) if k == c}
    placed = kept[-1].groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in placed} == {k: len((t or "").encode()) for k, t in rows[3].items()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "bin_id", "bin_offset"]


def test_nulls_repeats_extra_columns_and_empty_tables(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "en", "a", 1, 1), (1, text, "en", "a", 1, 1), (2, text + " w40", "en", None, 1, 2), (None, text, None, "a", 1, 3), (None, None, "en", "b", 1, 4), (5, None, "en", "b", 1, 5), (6, "", "en", "b", 1, 6), (7, "x " * 30_000, "en", "b", 1, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, row int")
    for name, frame, want in (("rows", docs, [8, 6, 5]), ("none", docs.limit(0), [0, 0, 0])):
        now = frame
        for k, (title, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{title}")
            stage(spark, now, SF).write.parquet(path)
            now = spark.read.parquet(path)
            if k < 3:
                assert now.columns == docs.columns
                assert k == 0 or now.count() == want[k] or name == "rows"
        assert now.where("length > 8192").isEmpty()
        kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / f"{name}-near_duplicates")).collect()}
        assert kept <= {1, None, 5, 6, 7} and (name == "none" or {1, 7} <= kept)
