"""SimHash near-dedup on awkward rows, and how many jobs large shards take."""

import numpy as np

from defect_spark.llm import simhash


def test_awkward_rows(spark):
    long = "word " * 200_000
    rows = [(1, None), (2, ""), (3, " \n "), (None, None), (None, "Some Words here and there"), (9, "some words here and there"), (9, "some words here and there"), (7, long), (8, long + "w"), (6, "é 漢字 x")]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, fp string, component_id long")
    found = simhash.near_duplicates(df)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found.collect()), key=str)
    assert len(got) == len(rows)
    zero = "0" * 16
    assert [x for x in got if x[1] == zero] == [(1, zero, 1), (2, zero, 1), (3, zero, 1), (None, zero, 1)]
    assert {x[2] for x in got if x[0] == 9} == {9} and [x[2] for x in got if x[0] is None and x[1] != zero] == [9]
    assert {x[0]: x[2] for x in got if x[0] in (7, 8)} == {7: 7, 8: 7}
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_jobs_do_not_grow_with_large_shards(spark):
    jobs = []
    for n in (1000, 8000):
        fps = np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n)
        df = spark.createDataFrame([(0, int(x) % (n // 250), int(x), True) for x in fps], "band int, shard int, fp long, home boolean")
        spark.sparkContext.setJobGroup(f"shards {n}", "")
        split = simhash.split_shards(df, 3, 50, 100)
        assert split.where("home").count() == n
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"shards {n}")))
    assert jobs[1] <= jobs[0] + 1


def test_few_edges_need_no_rounds_and_give_the_same_roots(spark):
    rng = np.random.default_rng(3)
    pairs = {(int(max(a, b)), int(min(a, b))) for a, b in rng.integers(-400, 400, (500, 2)) if a != b} | {(k, k - 1) for k in range(1001, 1060)}
    edges = spark.createDataFrame(sorted(pairs), "u long, v long").repartition(7)
    dealt = simhash.star_roots(edges, few=0)
    few = simhash.star_roots(edges)
    assert few.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, dealt.collect()))
    assert simhash.star_roots(edges.limit(0)).count() == 0
