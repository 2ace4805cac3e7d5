"""The corpus pipeline against a brute-force version of its five stages."""

import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_text_operators import brute_runs
from tests.llm.test_similar import survivors

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_pipeline(docs, items):
    """{doc_id: text} of what the stages keep."""
    docs = {d: t for d, t in docs.items() if any(c.isalpha() for c in t or "")}
    gone = brute_runs(docs, 50)
    cut = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ())) for d, t in docs.items()}
    docs = {d: t for d, t in cut.items() if d not in gone or t.strip()}
    keep = sorted(survivors(docs))
    windows = set()
    for text in items:
        w = words(text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(x) for x in windows}
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return {d: docs[d] for d in keep if clean(words(docs[d]))}


def test_pipeline_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_pipeline(docs, items)
    assert 0 < len(want) < len(docs)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "decoded").collect()
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter(want.items())


def test_pipeline_awkward_rows(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{k} and" for k in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "1 2 3", "en", "a", 5), (4, long, "en", None, 0), (4, long, "en", None, 0), (None, "a plain text of its own", "en", "a", 0), (6, long + "\n", "de", "b", 0)]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.decoded) for r in got) == {(4, long): 1, (None, "a plain text of its own"): 1}
    empty = tmp_path / "empty"
    spark.createDataFrame([], kinds).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
