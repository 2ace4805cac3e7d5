"""The trie of conversation prefixes against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from defect_spark.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = set()
    for p, some in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in some if len(made[c]) == len(p))))
        out.add((min(some), len(p), min(members[p[:-1]]) if p else None, len(some), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed, n=120, turns=9):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(400), n):
        for t in range(r.randint(1, turns)):
            rows.append((c, t * 2, "user" if t % 2 else "assistant", r.choice(["a", "a", "b b", " c\tc  c"])))
    rows += [(c, t, "user", "same words here") for c in range(400, 440) for t in range(6)]
    return rows


@pytest.mark.parametrize("options", [{}, {"ratio": 2, "band": 2}, {"ratio": 4, "band": 3}])
def test_equals_brute_force(spark, options):
    rows = conversations(len(options)) + [(7, None, None, None), (8, None, "user", ""), (None, 1, "user", "x"), (500, 3, "user", "one"), (-3, 0, "user", "minus"), (-20, 0, "user", "less"), (-20, 1, "user", "more")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, d long, r long")
    found = [tuple(r) for r in prefix_trie.prefix_trie(table, **options).select(*COLUMNS).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_long_conversations_and_empty_table(spark, monkeypatch):
    """Deep paths are dealt by bands and chunks of turns."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = [(c, t, "user", f"w {t}" if t < 70 - c else f"{c} {t}") for c in range(5) for t in range(80)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {tuple(r) for r in prefix_trie.prefix_trie(table, ratio=2, band=4).select(*COLUMNS).collect()}
    assert found == brute(rows)
    assert prefix_trie.prefix_trie(table.where("false")).count() == 0


def test_turnless_conversations(spark):
    rows = [(c, 0, "user", "x") for c in (21, 22, 23, 24, 25, 26)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in prefix_trie.prefix_trie(table).select(*COLUMNS).collect()} == brute(rows)


def test_centroid_sums():
    r = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        parent = np.array([-1 if i == 0 or r.random() < 0.05 else r.integers(max(0, i - 4), i) for i in range(n)])
        order = r.permutation(n)
        moved = np.full(n, -1)
        moved[order] = np.where(parent >= 0, order[parent], -1)
        w = r.integers(0, 9, (n, 2))
        want = w.copy()
        for i in range(n):
            at = moved[i]
            while at >= 0:
                want[at] += w[i]
                at = moved[at]
        assert (prefix_trie.centroid_sums(moved, w) == want).all()
