"""Cross-parsing against a search for longest matches, samples, ties and awkward rows."""

import re
import unicodedata

import numpy as np

import corpus_pipeline
from defect_spark.llm import language
from defect_spark.llm.language import letters_of

SF = "/root/testdata/sf0.001"


def brute_letters(text):
    out = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()
    return f" {' '.join(out)} ".encode() if out else b""


def brute_phrases(sample, text):
    at = n = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at, n = max(at + 1, end - 1), n + 1
    return n


def test_letters(spark):
    odd = [None, "", " \n", "Ab3c  D_e½ⅧÉ漢字\x00x", "İstanbul ΣΑΣ", "٣ ² a"]
    for t in odd + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()]:
        assert letters_of(t) == brute_letters(t)


def test_whole_texts_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = language.learn(docs.where(~language.held_out()), rows_a_language=10, bytes_a_language=6000)
    assert sorted(learned) == ["de", "en", "es", "fr"] and all(0 < len(t.encode()) <= 6000 for t in learned.values())
    parser = language.CrossParser(learned)
    samples = [letters_of(learned[k]) for k in parser.langs]
    rows = docs.limit(60).collect()
    bare = [letters_of(r.text) for r in rows] + [b"", " ½ ñandú ".encode(), b" zzzz "]
    want = [[brute_phrases(s, t) for s in samples] for t in bare]
    assert parser.phrases(bare).tolist() == want
    assert parser.phrases(bare[:3]).tolist() == want[:3]  # one by one
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, learned).collect()}
    for r, counts, text in zip(rows, want, bare):
        bits = np.array(counts) * np.log2([len(s) for s in samples]) / len(text)
        best, second = np.sort(bits)[:2]
        lang, score = got[r.doc_id]
        assert lang == parser.langs[int(np.argmin(bits))] and abs(score - (1 - best / second)) < 1e-9


def test_samples_are_whole_texts(spark):
    rows = [(k, f"text number {'abcdefghij'[k % 10]} of language x", "x") for k in range(300)] + [(None, "y " * 3000, "y"), (None, "z", None), (5, "1 2", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.learn(docs, rows_a_language=20, bytes_a_language=200)
    assert sorted(learned) == ["x", "y"] and learned["y"] == " ".join(["y"] * 3000)
    parts = re.findall(r"text number [a-j] of language x", learned["x"])
    assert " ".join(parts) == learned["x"] and 1 < len(parts) <= 7
    assert language.learn(docs.where("false")) == {}


def test_ties_clashes_and_nulls(spark):
    rows = [(1, "same words", "b", 3), (2, "½ 12", "b", 3), (3, None, None, 3), (4, "same", None, 3), (4, "same", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Lang_Pred string, score int")
    made = language.with_language(docs, {"b": "same words", "a": "same words"})
    assert made.columns == ["doc_id", "text", "lang_pred", "score", "has_letters"]
    got = sorted((r.doc_id, r.lang_pred, r.score, r.has_letters) for r in made.collect())
    assert got == [(1, "a", 0.0, True), (2, "und", 0.0, False), (3, "und", 0.0, False), (4, "a", 0.0, True), (4, "a", 0.0, True)]
    one = language.identify(docs, {"b": "same words"}).where("doc_id = 1").first()
    assert (one.lang_pred, one.score) == ("b", 1.0)
    assert language.identify(docs.where("false"), {"b": "same"}).count() == 0


def test_pipeline_stage_sets_the_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    learned = language.learn(docs.where(~language.held_out()))
    want = {r.doc_id: r.lang_pred for r in language.identify(docs, learned).collect() if r.lang_pred != "und"}
    assert got == want


def test_ids_and_copies_have_no_part_in_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    one = language.learn(docs, rows_a_language=9, bytes_a_language=9000)
    moved = docs.selectExpr("doc_id * 7 + 1 as doc_id", "text", "lang")
    assert language.learn(moved.union(moved.limit(3)).repartition(5), rows_a_language=9, bytes_a_language=9000) == one
