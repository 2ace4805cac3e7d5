"""Quality statistics against SQL, the learned list against its definition, and awkward tables."""

import duckdb
import numpy as np

from defect_spark.llm import quality

SF = "/root/testdata/sf0.001"
BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base_columns_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(quality.BASE_SQL).fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = quality.quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(map(tuple, made.select(*BASE).collect())) == want
    failed = {r.doc_id: (r.base_failed, r.kept) for r in made.collect()}
    for d, words, _, _, _, repeated in want:
        assert failed[d][0] == (words < 20 or 100 * repeated > 30 * words)
        assert not (failed[d][0] and failed[d][1])


def test_rules_cover_what_they_learned():
    rng = np.random.default_rng(1)
    values = {n: rng.random(900) for n in quality.FEATURES}
    bad = (values["symbols_a_word"] > 0.8) & (values["words"] < 0.7)
    rules = quality.learn(values, bad)
    covered = np.zeros(900, bool)
    for rule in rules:
        hit = quality.covered_by(rule, values)
        assert bad[hit & ~covered].mean() >= 0.95  # precision on what earlier rules left
        covered |= hit
    assert covered[bad].mean() > 0.8 and not covered[~bad].any() or covered[~bad].mean() < 0.02
    assert quality.learn(values, np.zeros(900, bool)) == []


def test_first_rule_that_holds_names_the_verdict(spark):
    T = quality.Test
    rules = [(T("symbols_a_word", True, 0.5), T("words", False, 30.0)), (T("symbols_a_word", True, 0.2),)]
    docs = spark.createDataFrame([(1, "a# " * 25), (2, "a# b c " * 20), (3, "alpha beta gamma delta " * 2), (4, None), (4, None)], "id long, text string").selectExpr("id", "text", "7 as doc_id", "1 as Kept")
    got = sorted((r.doc_id, r.rule, r.base_failed, r.kept) for r in quality.apply_rules(quality.statistics(docs, "id"), rules).collect())
    assert [g[:2] for g in got] == [(1, 1), (2, 2), (3, None), (4, None), (4, None)]
    assert all(not g[3] for g in got)  # rules or the base rule drop each
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert quality.quality(docs, labels, id_col="id").count() == 5
    assert quality.quality(docs.where("false"), labels, id_col="id").count() == 0
    assert quality.quality(docs, labels.where("false"), id_col="id").where("kept = base_failed").count() == 0
