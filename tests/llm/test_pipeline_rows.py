"""Stages judge rows, not ids: rows with null or equal ids and different texts don't share a fate."""

import corpus_pipeline

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "ten words of a question that nobody should learn from"
TEXTS = ["a plain text without any id", "one more plain text of another kind", "what is " + ITEM + " here", "1 2 3"]


def written(spark, path, rows):
    spark.createDataFrame(rows, KINDS).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([("q", ITEM)], "item_id string, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_pipeline_null_and_equal_ids(spark, tmp_path):
    rows = [(None, t, "en", "a", 0) for t in TEXTS] + [(8, f"number eight says {t}", "en", "a", 0) for t in TEXTS[:3]] + [(8, "4 5 6", "en", "a", 0)]
    got = corpus_pipeline.run(spark, written(spark, tmp_path, rows)).collect()
    want = [(d, t) for d, t, *_ in rows if any(c.isalpha() for c in t) and ITEM not in t]
    assert len(want) == 4
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((d or 0, t) for d, t in want)


def test_language_stage_without_labels(spark):
    rows = [(k, t, None, "a", 0) for k, t in enumerate(["a plain text", "Ein Satz", "é", "1 2 3", "", None])]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, KINDS), "").collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2]
