"""Medians, codes, curves, fronts and mutual information that no task holds whole."""

import math
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from defect_spark.operators import cleaning, features, ranges, search, splits


def test_medians_of_many_columns_in_common_jobs(spark):
    r = np.random.default_rng(1)
    n = 30_000
    data = {"a": r.normal(size=n), "b": r.integers(0, 9, n).astype(float), "c": np.where(r.random(n) < 0.99, 5.0, r.random(n)), "d": np.full(n, 2.0), "e": np.arange(n) * 1e6}
    rows = [tuple(None if r.random() < 0.1 else float(v) for v in x) for x in zip(*data.values())] + [(None,) * 5]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}.x` double" for c in data)).cache()
    found = cleaning.exact_medians(df, [f"{c}.x" for c in data], most_counts=500)
    want = {f"{c}.x": statistics.median(row[k] for row in rows if row[k] is not None) for k, c in enumerate(data)}
    assert found == want
    jobs = []
    for n in (1, 30):
        wide = df.select(*((F.col("`a.x`") + i).alias(f"a{i}") for i in range(n))).cache()
        spark.sparkContext.setJobGroup(f"medians {n}", "")
        assert cleaning.exact_medians(wide, wide.columns, most_counts=500 * n) == {f"a{i}": pytest.approx(want["a.x"] + i, abs=1e-9) for i in range(n)}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"medians {n}")))
    assert jobs[0] == jobs[1]
    assert cleaning.exact_medians(df.where("false"), ["a.x"]) == {"a.x": None}
    assert cleaning.exact_medians(df.select((-F.col("`c.x`")).alias("c")), ["c"], 500) == {"c": -want["c.x"]}
    two = spark.createDataFrame([(1, "x"), (2, "x"), (3, "b"), (4, "b"), (5, None)], "k int, s string")
    assert cleaning.commonest(two, ["s", "k"]) == {"s": "b", "k": "1"}


def test_codes_of_skewed_values(spark):
    values = spark.range(100_000).select(F.concat(F.lit("http://www.example.org/"), F.col("id").cast("string")).alias("v")).union(spark.createDataFrame([("a",)], "v string"))
    sizes = Counter(r.part_ for r in ranges.placed(values, ["v"], rows_a_part=4000).select("part_").collect())
    assert max(sizes.values()) < 10_000
    made = features.ranks(values, "v", rows_a_part=4000).collect()
    assert [r.v for r in sorted(made, key=lambda r: r.rank_)] == sorted(r.v for r in made)


def test_ranks_within_classes_keep_folds(spark):
    """Folds are those of ranks by hash and key, for null classes and repeated keys too."""
    df = spark.range(900).selectExpr("id as key", "if(id % 9 = 0, null, id % 2) as label", "'x' as wide")
    made = splits.ranked(df, "label", "key", 42, rows_a_part=50).collect()
    by = {}
    for r in made:
        by.setdefault(r.label, []).append(r)
    import hashlib

    for rows in by.values():
        rows.sort(key=lambda r: (hashlib.md5(f"42:{r.key}".encode()).hexdigest(), r.key))
        assert [r["rank"] for r in rows] == list(range(len(rows))) and {r.class_rows for r in rows} == {len(rows)}
    twice = splits.stratified_kfold(df.union(df.where("key < 5")), "label", "key")
    assert twice.count() == 905 and twice.groupBy("key").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_curves_equal_a_fit_for_each_part(spark):
    r = np.random.default_rng(2)
    rows = [(i, int(i % 3), (r.normal(size=3) + i % 3).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "key long, label int, vector array<double>")
    steps = [0.1, 0.5, 1.0]
    got = {(x.fraction, x.fold): (x.correct, x.n) for x in splits.means_curve(df, "label", "key", "vector", steps).collect()}
    two = df.withColumn("label", (F.col("label") == 1).cast("int"))
    cells = {(x.fraction, x.fold): (x.tn, x.fp, x.fn, x.tp) for x in search.knn_curve(two, "label", "key", "vector", 3, fractions=steps).collect()}
    sets = splits.nested_train_sets(df, "label", "key", steps).collect()
    binary = {x.key: x for x in splits.nested_train_sets(two, "label", "key", steps).collect()}
    for x in steps:
        for fold in range(5):
            train = [s for s in sets if s.fold != fold and s.entered <= x]
            means = {y: np.mean([s.vector for s in train if s.label == y], axis=0) for y in {s.label for s in train}}
            tested = [s for s in sets if s.fold == fold]
            right = sum(min(means, key=lambda y: (((np.array(s.vector) - means[y]) ** 2).sum(), y)) == s.label for s in tested)
            assert got[x, fold] == (right, len(tested))
            train = [s for s in binary.values() if s.fold != fold and s.entered <= x]
            want = [0, 0, 0, 0]
            for q in (s for s in binary.values() if s.fold == fold):
                near = sorted((math.dist(q.vector, s.vector), s.key, s.label) for s in train)[: max(1, min(3, 20, len(train) // 5))]
                want[2 * q.label + int(sum(y for *_, y in near) * 2 > len(near))] += 1
            assert cells[x, fold] == tuple(want)


def brute_front(points):
    return {k for k, *p in points if not any(all(y >= x for x, y in zip(p, q)) and q != p for _, *q in points)}


@pytest.mark.parametrize("cells,rows", [(4096, 4096), (27, 16), (8, 5)])
def test_front_over_a_grid(spark, cells, rows):
    r = np.random.default_rng(cells)
    points = [(k, *(r.integers(0, 12, 3) / 12).tolist()) for k in range(300)]
    u = r.normal(size=(300, 3))
    points += [(300 + k, *(np.abs(v) / np.linalg.norm(v)).tolist()) for k, v in enumerate(u)]  # a front of many points
    df = spark.createDataFrame(points, "k long, a double, b double, c double").repartition(5)
    assert {x.k for x in search.pareto_front(df, ["a", "b", "c"], "k", cells, rows).collect()} == brute_front(points)


def test_nsga2_layers_and_crowding(spark):
    r = np.random.default_rng(8)
    points = [(k, *(r.integers(0, 10, 2) / 10).tolist()) for k in range(120)]
    df = spark.createDataFrame(points, "k long, a double, b double")
    left, want = list(points), []
    layer = 0
    while left:
        front = [p for p in left if p[0] in brute_front(left)]
        crowd = {p[0]: 0.0 for p in front}
        for i in (1, 2):
            order = sorted(front, key=lambda p: (p[i], p[0]))
            span = order[-1][i] - order[0][i]
            for j, p in enumerate(order):
                crowd[p[0]] += math.inf if j in (0, len(order) - 1) else (order[j + 1][i] - order[j - 1][i]) / (2 * span) if span else 0
        want += [(p[0], layer, crowd[p[0]]) for p in front]
        left, layer = [p for p in left if p not in front], layer + 1
    want.sort(key=lambda x: (x[1], -x[2], x[0]))
    found = [(x.k, x.layer, x.crowding) for x in search.nsga2_select(df, 40, ["a", "b"], "k").collect()]
    assert [x[:2] for x in found] == [x[:2] for x in want[:40]]
    assert all(a[2] == b[2] or abs(a[2] - b[2]) < 1e-12 for a, b in zip(found, want))
    assert search.nsga2_select(df.where("false"), 3, ["a", "b"], "k").count() == 0


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute_info(x, y, k=3):
    size = Counter(y)
    rows = [(a, b) for a, b in zip(x, y) if size[b] > 1]
    total = 0.0
    values = np.array([a for a, _ in rows])
    by = {b: np.sort(np.array([a for a, c in rows if c == b])) for b in size if size[b] > 1}
    for a, b in rows:
        n = min(k, size[b] - 1)
        radius = np.sort(np.abs(by[b] - a))[n]
        m = int((np.abs(values - a) < radius).sum()) if radius else int((values == a).sum())
        total += psi(n) - psi(size[b]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows)) if rows else 0.0


def test_mutual_information_by_ranges(spark):
    r = np.random.default_rng(4)
    y = r.integers(0, 3, 2000)
    y[:1] = 7  # a class of one row
    x = {"normal": r.normal(size=2000) + y, "noise": r.normal(size=2000), "whole": (r.integers(0, 6, 2000) + y).astype(float), "same": np.ones(2000)}
    rows = [(i, int(b), *(float(v[i]) for v in x.values())) for i, b in enumerate(y)]
    df = spark.createDataFrame(rows, "id long, y int, " + ", ".join(f"{c} double" for c in x))
    found = {f.feature: f.mi for f in features.mutual_info(df, list(x), "y", "id", range_rows=100, rows_a_part=500).collect()}
    for c, v in x.items():
        assert abs(found[c] - brute_info(v, y)) < 1e-9, c
    few = features.mutual_info(df.where("id < 5"), ["normal"], "y", "id").first()
    assert abs(few.mi - brute_info(x["normal"][:5], y[:5])) < 1e-9
    assert features.mutual_info(df.where("false"), ["normal"], "y", "id").first().mi == 0


def test_split_by_counts_of_draws(spark):
    """The rows of a sort by hash and key, with null classes and keys and narrow counts; almost nothing is shuffled."""
    import hashlib

    from tests.test_neighbours import shuffled

    df = spark.range(40_000).selectExpr("if(id = 7, null, concat('key ', id)) as key", "if(id % 9 = 0, null, id % 2) as label", "repeat('x', 200) as wide")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for few in (100_000, 3):
        before = shuffled(spark)
        made = splits.train_test_split(df, "label", "key", few=few)
        rows = made.collect()
        assert made.columns == ["key", "label", "wide", "is_test"] and (few == 3 or shuffled(spark) - before < 1_000_000)
        for c in (None, 0, 1):
            order = sorted((hashlib.md5(f"42:{r.key}".encode() if r.key else b"42").hexdigest(), r.is_test) for r in rows if r.label == c)
            n = math.ceil(len(order) * 0.2)
            assert [t for _, t in order] == [True] * n + [False] * (len(order) - n)
    twice = splits.train_test_split(df.union(df.where("key < 'key 2'")), None, "key")
    assert twice.groupBy("key").agg(F.count_distinct("is_test").alias("n")).where("n > 1").count() == 0
    assert splits.train_test_split(df.where("false"), "label", "key").count() == 0
    assert splits.train_test_split(df, "label", "key", 0.0).where("is_test").count() == 0
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
