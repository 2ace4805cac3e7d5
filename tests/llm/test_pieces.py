"""Unigram segmentation against a direct Viterbi over the whole text."""

import random

import numpy as np

from defect_spark.llm import unigram
from defect_spark.llm.queries import tokenizer

PATH = tokenizer("piece_bpe_32k.model")


def best_score(m, text, scores):
    """The highest total of any segmentation of a marked text; unknown characters cost a fixed score each."""
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - 20), end):
            s = scores.get(text[begin:end])
            if s is not None and best[begin] + s > best[end]:
                best[end] = best[begin] + s
        if text[end - 1] not in scores:
            best[end] = max(best[end], best[end - 1] + m.unknown_score)
    return best[-1]


def test_scores_match_direct_viterbi(spark):
    m = unigram.model(PATH)
    usable = [k for k, t in enumerate(m.types.tolist()) if t not in (unigram.CONTROL, unigram.UNKNOWN, unigram.BYTE)]
    scores = {m.pieces[k]: float(m.scores[k]) for k in usable}
    assert max(map(len, scores)) <= 20
    rng = random.Random(7)
    odd = ["".join(rng.choice(["a", "the", "▁", " ", "  ", "é", "漢", "字", "\n", "\t", "😀", "Z", "ing", "..", "\x07"]) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    for text, ids in zip(odd + docs, m.encode(odd + docs)):
        marked = unigram.MARK + text.replace(" ", unigram.MARK)
        held, at, run = 0.0, 0, b""
        for k in [*ids.tolist(), None]:
            if k is not None and m.types[k] == unigram.BYTE:
                run += bytes([int(m.pieces[k][3:5], 16)])
                continue
            held += len(run.decode()) * m.unknown_score
            run = b""
            held += float(m.scores[k]) if k is not None else 0.0
        assert abs(held - best_score(m, marked, scores)) < 1e-3 * max(1, abs(held))
        assert m.decode(ids) == text.replace("▁", " ")


def test_empty_and_clashing_tables(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, 5), (2, "", 5)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in unigram.encode(df, PATH).collect())
    assert got == [(0, 0, ""), (1, 2, "a b"), (1, 2, "a b"), (2, 0, "")]
    assert unigram.encode(df.where("false"), PATH).count() == 0
