"""Neighbours by pivots: equal to all pairs compared, ties included, with far fewer pairs."""

import time

import numpy as np
import pytest

from defect_spark.operators import knn


def brute(queries, base, k, p):
    out = set()
    for q, x in queries:
        d = sorted((float((np.abs(np.array(x) - y) ** p).sum() ** (1 / p)) if p != 1 else float(np.abs(np.array(x) - y).sum()), o) for o, y in base if o != q)
        out |= {(q, o, r + 1, round(v, 9)) for r, (v, o) in enumerate(d[:k])}
    return out


@pytest.mark.parametrize("p", [1.0, 2.0, 3.0])
def test_pivots_on_clusters(spark, p):
    r = np.random.default_rng(int(p))
    centres = r.integers(-500, 500, (15, 4))
    points = [(i, (centres[i % 15] + r.integers(-3, 4, 4)).astype(float)) for i in range(1500)]  # whole numbers: many ties
    points += [(1500 + i, points[0][1]) for i in range(30)]  # copies of one point
    df = spark.createDataFrame([(i, x.tolist()) for i, x in points], "id long, v array<double>")
    asked = [q for q in points if q[0] % 7 == 0] + [(9999, np.array([5000.0] * 4))]
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in asked], "id long, v array<double>")
    near, work = knn.pivot_search(queries, df, 6, "id", "v", p, block_rows=64)
    found = [(r.query_id, r.base_id, r["rank"], round(r.dist, 9)) for r in near.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(asked, points, 6, p)
    w = work.first()
    assert w.all_pairs == len(asked) * len(points) and w.compared < w.all_pairs / 2


def test_join_beyond_blocks(spark):
    r = np.random.default_rng(5)
    points = [(i, r.normal(size=3)) for i in range(400)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in points], "id long, v array<double>")
    want = {(q, o, n) for q, o, n, _ in brute(points, points, 4, 2)}
    for rows in (32, 2048):
        assert {(x.query_id, x.base_id, x["rank"]) for x in knn.knn_join(df, df, 4, "id", "v", block_rows=rows).collect()} == want
    few = knn.pivot_search(df, df.where("id < 3"), 4, "id", "v", block_rows=32)[0]
    assert few.groupBy("query_id").count().where("count <> if(query_id < 3, 2, 3)").count() == 0
    assert knn.pivot_search(df, df.where("false"), 4, "id", "v")[0].count() == 0


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("copies", [0, 300])
def test_many_dimensions_shuffle_no_pairs(spark, copies, monkeypatch):
    """Where no pivot bars a row the search is exact, ties of copies included, and what is shuffled is in proportion to the rows."""
    monkeypatch.setattr(knn, "PACK", 512)
    r = np.random.default_rng(7)
    x = r.normal(size=(1500, 64)) * 3 + 100
    x[:copies] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4).cache()
    before = shuffled(spark)
    near, work = knn.pivot_search(df, df, 5, "id", "v", block_rows=64)
    found = sorted((q.query_id, q.base_id, q["rank"]) for q in near.collect())
    assert shuffled(spark) - before < 4 * x.nbytes
    want = []
    for q in range(len(x)):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want += [(q, int(o), n + 1) for n, o in enumerate(np.lexsort((np.arange(len(x)), d))[:5])]
    assert found == sorted(want) and work.first().all_pairs == 1500 * 1500


@pytest.mark.parametrize("p,scale", [(2, 1.0), (2, 1e-200), (2, 1e200), (1, 1.0), (0.5, 1.0)])
def test_a_block_meets_another(p, scale):
    """As all distances sorted, for any size of numbers, with barred pairs and more places than rows."""
    r = np.random.default_rng(3)
    make = lambda n, first: knn.Block({"n": n, "kind": "<f8", "held": np.ones(n, bool).tobytes(), "keys": (np.arange(n) + first).tobytes(), "vectors": (r.integers(0, 4, (n, 5)) * scale).tobytes()})
    q, blocks = make(300, 0), [make(500, 100), make(3, 7000), make(400, 2000)]
    for k in (1, 7, 600):
        nearest = knn.Nearest(300, k)
        for o in blocks:
            with np.errstate(all="ignore"):
                knn.meet(q, o, np.array([0, 2, 3]), p, [(nearest, lambda i, j: (q.keys[i] + o.keys[j]) % 3 == 0)], o.keys % 2)  # noqa: B023
        y, keys = np.concatenate([o.x for o in blocks]), np.concatenate([o.keys for o in blocks])
        for i in range(300):
            with np.errstate(all="ignore"):
                d = knn.distances(y[:, [0, 2, 3]], q.x[i, [0, 2, 3]], p)
            d[(q.keys[i] + keys) % 3 == 0] = np.inf
            want = knn.nearest(d, keys, k)
            n = len(want)
            assert nearest.keys[i, :n].tolist() == keys[want].tolist() and nearest.d[i, :n].tolist() == d[want].tolist()
            assert np.isinf(nearest.d[i, n:]).all() and nearest.more[i, :n].tolist() == (keys[want] % 2).tolist()


def test_a_block_meets_another_faster_than_row_by_row():
    """One product of matrices serves five limits: far less time than a scan a row and limit."""
    r = np.random.default_rng(4)
    x = r.normal(size=(2048, 64))
    b = knn.Block({"n": 2048, "kind": "<f8", "held": np.ones(2048, bool).tobytes(), "keys": np.arange(2048).tobytes(), "vectors": x.tobytes()})
    found = [knn.Nearest(2048, 5) for _ in range(5)]
    began = time.process_time()
    knn.meet(b, b, None, 2, [(n, lambda i, j: i == j) for n in found], b.keys)
    fast, began = time.process_time() - began, time.process_time()
    for _ in found:
        for i in range(0, 2048, 8):
            knn.nearest(knn.distances(x, x[i], 2), b.keys, 5)
    assert 2 * fast < 8 * (time.process_time() - began)
