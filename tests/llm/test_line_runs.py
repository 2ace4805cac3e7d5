"""Repeated runs of lines against brute force, and how the work grows with the lines of one text."""

import time

import numpy as np

from defect_spark.llm import line_dedup
from tests.llm.test_text_operators import brute_runs


def kept(text, gone):
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def test_all_given_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    gone = brute_runs(texts, 50)
    assert len(gone) > 20
    done = line_dedup.dedup_lines(docs).collect()
    assert {r.doc_id: (r.text, r.n_lines_removed) for r in done} == {d: (kept(t, gone.get(d, ())), len(gone.get(d, ()))) for d, t in texts.items()}


def test_runs_with_blank_lines_hot_lines_and_many_copies(spark):
    rng = np.random.default_rng(8)
    line = lambda: str(rng.choice(["the one common line", "", "  ", "x", "a b c", "w%d w%d" % tuple(rng.integers(0, 9, 2))]))
    passages = ["\n".join(line() for _ in range(int(rng.integers(3, 12)))) for _ in range(4)]
    texts = {d: "\n".join(str(rng.choice(passages)) if rng.random() < 0.4 else line() for _ in range(12)) for d in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    gone = brute_runs(texts, 9)
    assert {r.doc_id: set(r.gone) for r in line_dedup.repeated_lines(df, 9).collect()} == gone
    for r in line_dedup.dedup_lines(df, 9).collect():
        assert r.text == kept(texts[r.doc_id], gone.get(r.doc_id, ()))


def test_repeated_rows_nulls_and_clashing_columns(spark):
    long = "\n".join(f"line {k} of a passage" for k in range(12))
    rows = [(1, long, "x"), (1, long, "y"), (None, long + "\nend", "x"), (None, "own", None), (2, None, "x"), (2, "", "x"), (3, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Lines_Removed string")
    done = line_dedup.dedup_lines(df)
    assert done.columns == ["doc_id", "text", "n_lines_removed"]
    got = sorted((r.doc_id or 0, r.text or "", r.n_lines_removed) for r in done.collect())
    # a null id comes first, so its copy is the one that stays
    assert got == sorted([(1, "", 12), (1, "", 12), (0, long + "\nend", 0), (0, "own", 0), (2, "", 0), (2, "", 0), (3, "", 12)])
    assert line_dedup.digest(done).count() == len(rows)


def test_work_is_linear_in_the_lines_of_a_text(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "\n".join(f"w{k % (n // 2)}" for k in range(n)))], "doc_id long, text string")
        began = time.time()
        assert line_dedup.dedup_lines(df).first().n_lines_removed == n // 2
        return time.time() - began

    seconds(1000)
    assert seconds(32_000) < 4 * seconds(8000) + 5
