"""SimHash links where one band value, or one ball of fingerprints, holds most of the points."""

import numpy as np
import pytest

from defect_spark.llm import simhash


def groups_of(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent}


def hot_band(rng):
    """Two thousand points that share sixteen bits, some of them linked, and some points elsewhere."""
    low = rng.integers(0, 1 << 48, 1500, dtype=np.uint64) << np.uint64(16)
    near = low[:500] ^ (np.uint64(1) << rng.integers(16, 64, 500, dtype=np.uint64))
    return np.concatenate([low | np.uint64(77), near | np.uint64(77), rng.integers(0, 1 << 63, 300, dtype=np.uint64)])


def ball(rng):
    """Points within a few bits of one: no tree can part them."""
    bits = rng.integers(0, 64, (2000, 5), dtype=np.uint64)
    flips = np.bitwise_xor.reduce(np.uint64(1) << bits, axis=1)
    return np.uint64(0x0123456789ABCDEF) ^ flips


@pytest.mark.parametrize("made", [hot_band, ball])
def test_hot_values_are_split_and_no_link_is_lost(spark, made):
    points = np.unique(made(np.random.default_rng(9)))
    signed = points.view(np.int64).tolist()
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    want = groups_of((signed[a], signed[b]) for a, b in zip(i.tolist(), j.tolist()) if a < b)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for bands, size in ((None, 64), (2, 200)):
        edges = simhash.link_edges(df, 3, shard_points=size, bands=bands).collect()
        assert all((e.u ^ e.v) & ((1 << 64) - 1) and e.u > e.v for e in edges)
        got = groups_of((e.u, e.v) for e in edges)
        assert {frozenset(x for x in got if got[x] == r) for r in set(got.values())} == {frozenset(x for x in want if want[x] == r) for r in set(want.values())}


def test_groups_are_bounded(spark):
    points = np.unique(np.concatenate([hot_band(np.random.default_rng(2)), ball(np.random.default_rng(3))])).view(np.int64).tolist()
    rows = spark.createDataFrame([(0, 0, p, True) for p in points], "band int, shard int, fp long, home boolean")
    split = simhash.in_blocks(simhash.split_shards(rows, 3, 100, 400), 100, 400)
    sizes = [r["count"] for r in split.groupBy(*simhash.GROUP).count().collect()]
    assert max(sizes) <= 400 + 60  # blocks are dealt by hash


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k + 1, k) for k in range(3000)], "u long, v long")
    roots = simhash.star_roots(chain).collect()
    assert len(roots) == 3000 and {r.root for r in roots} == {0}
