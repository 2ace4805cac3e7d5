"""Word windows of items in documents against every window compared, with several shards and awkward rows."""

import re

import numpy as np

from defect_spark.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(window, len(x))
        some = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for at in range(len(w) - n + 1 if n else 0):
            if tuple(w[at : at + n]) in some:
                hit |= set(range(at, at + n))
                found.add(item or "")
    return len(w), sorted(hit), sorted(found)


def test_windows_match_brute_force(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(rng.choice(["a", "B", "c", "dé", "5"], n))
    items = [(f"i{k}", text(int(rng.integers(0, 9)))) for k in range(30)] + [("long", text(40)), (None, "a a"), ("i1", "c c"), ("null", None)]
    docs = [(k, text(int(rng.integers(0, 60))), k) for k in range(60)] + [(None, None, 0), (7, "", 0), (8, text(20_000), 0), (8, "a, B. c", 0), (8, "a, B. c", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, Spans int")
    table = spark.createDataFrame(items, "item_id string, text string")
    want = sorted((d or -1, *brute(t, items, 4)) for d, t, _ in docs)
    for shard_mb in (8, 2e-4):  # one shard, and several
        made = decontaminate.with_items(df, table, 4, shard_mb=shard_mb)
        got = [(r.doc_id or -1, r.n_words, [k for s in r.spans for k in range(s.start, s.end)], r["items"]) for r in made.collect()]
        assert sorted(got) == want
    assert made.columns == ["doc_id", "text", "n_words", "spans", "items"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id string, text string")
    assert [(r.n_words, r.spans) for r in decontaminate.find_items(docs, items).collect()] == [(2, [])]
    assert decontaminate.find_items(docs.where("false"), items).count() == 0
