"""The near-dedup stage against all pairs compared by five-word Jaccard similarity."""

from itertools import combinations

import numpy as np

import corpus_pipeline
from defect_spark.llm import similar, simhash

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def survivors(docs):
    parent = {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sorted(docs), 2):
        if jaccard(docs[a], docs[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {root(d) for d in docs}


def family(rng, copies):
    """Random texts, each with near copies by replaced words, and one line that all share."""
    vocabulary, out = [f"w{k}" for k in range(3000)], {}
    for _ in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(8, 300))))
        for _ in range(copies):
            words = base.copy()
            for at in rng.integers(0, len(words), int(rng.integers(0, max(2, len(words) // 30)))):
                words[at] = str(rng.choice(vocabulary))
            out[len(out) + 1] = "one line that every text has at its head\n" + " ".join(words)
    return out


def test_near_dedup_drops_all_near_copies(spark):
    docs = family(np.random.default_rng(11), 8)
    want = survivors(docs)
    assert 12 <= len(want) < len(docs) - 30
    df = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in docs.items()], KINDS)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(got) == sorted(want)
    for most, rows in ((2, 1024), (6, 3)):
        got = [r.doc_id for r in similar.keepers(df, most_pairs=most, sample_rows=20, block_rows=rows).collect()]
        assert sorted(got) == sorted(want)


def test_near_dedup_on_given_documents(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if (r.text or "").split()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(got) == sorted(survivors({r.doc_id: r.text for r in rows}))


def test_near_dedup_keeps_different_rows_of_one_id(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "a first text of its own", "en", "a", 1), (None, "quite another text with no id", "en", "a", 1), (7, "one text under seven", "en", "a", 1), (7, "and this is the other", "en", None, 1), (7, "and this is the other", "en", "b", 1), (None, long + " end", "en", "a", 1), (3, long, "en", "a", 1), (None, None, None, None, None), (9, "", "en", "a", 0)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, KINDS), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "a first text of its own"), (0, "quite another text with no id"), (3, long), (7, "and this is the other"), (7, "one text under seven"), (9, "")]
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], KINDS), "").count() == 0


def test_blocks_of_a_hot_shingle_are_bounded(spark):
    """Blocks hold at most block_rows sets, every pair of components meets once, and one-component pairs of blocks don't."""
    rows = spark.createDataFrame([(1, c, 100, 9, 0, 0, 0, c if c > 40 else 0) for c in range(1, 61)] + [(2, c, 3, 9, 0, 0, 0, 5) for c in (1, 2, 3)], "h long, cls long, held long, n int, i int, s long, t long, part long")
    made = similar.block_pairs(rows, 10).collect()
    assert max(max(len(r.g), len(r.o)) for r in made) <= 10
    met = [frozenset((a.cls, b.cls)) for r in made for a in r.g for b in r.o if a.part != b.part and (not r.own or a.cls < b.cls)]
    want = {frozenset((a, b)) for a in range(1, 61) for b in range(41, 61) if a != b}
    assert len(met) == len(set(met)) and set(met) == want
    assert sum(len(r.g) * len(r.o) for r in made) < 40 * 20 + 20 * 20 + 100


def test_shingles_are_counted_over_tasks(spark):
    sets = spark.createDataFrame([(c, [1, 100 + c, 7 if c < 2 else 200 + c]) for c in range(90)], "cls long, prefix array<long>")
    for frequent in ([], [1], [1, 101]):
        rows = similar.shared_rows(sets, frequent, 8).collect()
        assert {(r.h, r.held) for r in rows} == {(1, 90), (7, 2)}
        assert sorted((r.h, r.cls, r.i) for r in rows) == sorted([(1, c, 0) for c in range(90)] + [(7, 0, 2), (7, 1, 2)])


def test_names_of_sets_are_long(spark):
    a, b = (similar.shingles(t) for t in ("one two three four five six", "one two three four five seven"))
    x, y = similar.set_names([a, b, a])
    assert x[0] == x[2] and y[0] == y[2] and (x[0], y[0]) != (x[1], y[1])


def test_pipeline_keeps_every_link_of_op9(spark):
    """Of texts that op9 links one stays, though their similarity is under 0.8; links of both kinds make one component."""
    docs = family(np.random.default_rng(11), 8)
    df = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in docs.items()], KINDS)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    prints = {d: simhash.fingerprint(t) for d, t in docs.items()}
    root = {d: d for d in docs}
    linked = [(a, b) for a, b in combinations(sorted(docs), 2) if jaccard(docs[a], docs[b]) >= 0.8 or (prints[a] ^ prints[b]).bit_count() <= 3]
    for _ in docs:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    want = {root[d] for d in docs}
    assert len(want) < len(survivors(docs))
    assert sorted(r.doc_id for r in stage(spark, df, "").collect()) == sorted(want)
