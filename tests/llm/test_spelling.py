"""Spelling variants against brute force: every two words compared."""

import random
import re
import zlib
from collections import Counter

import pytest

from defect_spark.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least_n=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least_n}
    found = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, some in found.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(found[w]), n.get(form[w])))
    return out


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abéÉ") for _ in range(r.randint(4, 9))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "abababab", "bababab"]
    words = []
    for w in base:
        for _ in range(r.choice([3, 3, 7, 20])):
            words.append(w)
        for _ in range(4):
            i = r.randrange(len(w) + 1)
            v = r.choice([w[:i] + "b" + w[i:], w[:i] + w[i + 1 :], w[:i] + "a" + w[i + 1 :]])
            words += [v] * r.choice([2, 3, 6])
    r.shuffle(words)
    return [(k, " ".join(words[k::20])) for k in range(20)]


@pytest.mark.parametrize("most_rows", [4096, 4])
def test_equals_brute_force(spark, most_rows):
    rows = corpus(most_rows) + [(None, "Wording wording WORDING 1wording2"), (7, None), (8, ""), (9, "...")]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n long, word string")
    assert {tuple(r) for r in spelling.variants(docs, most_rows=most_rows).collect()} == brute(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = [tuple(r) for r in spelling.variants(docs, least_n=12).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, 12)


def test_hot_list_is_dealt_on(spark):
    """Words that share a half are split until no list is over the bound, and no pair is lost or told twice."""
    some = ["zzzzzzzz" + a + b + c + d for a in "abc" for b in "abc" for c in "abc" for d in "abc"]
    words = spark.createDataFrame([(w, 3 + k % 5) for k, w in enumerate(some)], "word string, n long")
    told = Counter()
    for r in spelling.near_words(words, most_rows=8).collect():
        told[r.word] += r.n_near
    assert dict(told) == {w: 8 for w in some}


def test_long_words_and_empty_table(spark):
    long = "ab" * 20_000
    rows = [(k, f"{long} {long}x {long}x {long}x") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(len(r.word), r.n_near) for r in spelling.variants(docs).collect()}
    assert (40_000, 1) in found and (40_001, 1) in found
    empty = spelling.variants(docs.where("false"))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0
