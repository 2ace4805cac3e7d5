"""Operators on small tables with hand-made or brute-force expectations."""

import json
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from defect_spark.operators import cleaning, features, knn, metrics, models, profile, resample, search, splits
from defect_spark.plans.preprocess import PreprocessPlan
from defect_spark.sources import datasets


def test_target_rules(spark):
    df = spark.createDataFrame([(1, 2, "a", 3)], "loc int, Error int, is_class string, bug int")
    assert cleaning.detect_target(df) == "Error"
    assert cleaning.detect_target(df, "notebook") == "bug"
    assert cleaning.detect_target(df, "evaluator") == "is_class"
    assert cleaning.detect_target(spark.createDataFrame([(1, 2, 3)], "Error int, outcome int, loc int"), "evaluator") == "outcome"
    many = spark.range(12).selectExpr("id as label", "id % 2 as is_class", "id as other")
    assert cleaning.detect_target(many, "evaluator") == "is_class"
    assert cleaning.detect_target(many.select("other")) == "other"


def test_binarize_positive_rule():
    def chosen(values):
        return next((v for v in sorted(values) if v in cleaning.POSITIVE), sorted(values)[:2][-1])

    assert chosen(["N", "Y"]) == "Y" and chosen(["good", "poor"]) == "poor" and chosen(["x"]) == "x"


def test_binarize_on_rows(spark):
    df = spark.createDataFrame([("good",), ("poor",), (None,), ("poor",)], "t string")
    assert [r.t for r in cleaning.binarize_target(df, "t", "positive").collect()] == [0, 1, 1]
    with pytest.raises(ValueError):
        cleaning.target_values(spark.range(30).selectExpr("cast(id as string) as t"), "t", most=20)


@pytest.mark.parametrize("n", [1, 2, 25_001, 30_000])
def test_exact_median_of_many_values(spark, n):
    values = np.random.default_rng(n).permutation(n) / 7
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    assert cleaning.exact_medians(df, ["x"])["x"] == pytest.approx(statistics.median(values), abs=0)


def test_rows_all_null_and_no_values(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, None), (3, None, None)], "k int, x double, s string")
    assert [r.k for r in cleaning.drop_all_null_rows(df, "k").collect()] == [2]
    assert cleaning.exact_medians(df.where("k = 1"), ["x"]) == {"x": None}
    assert cleaning.impute(df, ["x"], ["s"]).where("k = 1").first()[1:] == (1.0, "unknown")


def test_id_columns(spark):
    df = spark.range(50).selectExpr("id as Row_ID", "id * 2 as serial", "id / 3.5 as metric", "id % 3 as class", "concat('a', id) as name")
    assert cleaning.drop_id_columns(df).columns == ["class"]
    assert cleaning.drop_id_columns(df, protect_continuous=True).columns == ["metric", "class"]
    assert cleaning.drop_id_columns(df, keep=("serial",)).columns == ["serial", "class"]


def test_label_encode_of_many_values_and_nulls(spark):
    words = [f"user_{k:05d}" for k in np.random.default_rng(0).permutation(3000)] + ["user_", "user_é"]
    df = spark.createDataFrame([(w,) for w in words + words[:5]] + [(None,)], "w string")
    codes = {v: k for k, v in enumerate(sorted(words))}
    got = [(r.w, r.code) for r in features.label_encode(df, "w", "code").collect()]
    assert len(got) == len(words) + 6 and all(codes.get(w) == c for w, c in got)
    numbers = spark.createDataFrame([(v,) for v in (3.5, -1.0, 3.5, 9.0, None)], "x double")
    assert sorted((r.x or 0, r.c) for r in features.label_encode(numbers, "x", "c").where("x is not null").collect()) == [(-1.0, 0), (3.5, 1), (3.5, 1), (9.0, 2)]


def test_feature_choice(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    made, missing = features.select_by_name(df, ["c", "zz", "a"], ["b"])
    assert made.columns == ["b", "c", "a"] and missing == ["zz"]
    assert features.select_by_index(df, [0, 1, 1, 1], ["a", "b", "c"]).columns == ["b", "c"]
    wide = spark.range(60).selectExpr("cast(id as string) as w", "cast(id % 3 as string) as s")
    assert features.drop_high_cardinality(wide, ["w", "s"]).columns == ["s"]
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.0), ("c", 0.5)], "feature string, mi double")
    assert [(r.feature, r["rank"]) for r in features.mi_ranking(scores, 2).orderBy("rank").collect()] == [("a", 1), ("c", 2)]


def test_class_checks(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", None)], "p string, y int")
    assert {r.p for r in profile.require_two_classes(df, "y", "p").collect()} == {"a"}
    with pytest.raises(ValueError):
        profile.require_two_classes(df.where("y = 1"), "y")


def test_preprocess_plan_is_kept_and_replayed(spark, tmp_path):
    rows = [(k, float(k % 7), None if k % 10 == 0 else float(k % 3), "xyz"[k % 3], "uv"[k % 2], None, f"n{k}", "Y" if k % 4 == 0 else "N") for k in range(60)]
    df = spark.createDataFrame([*rows, (60, *rows[0][1:]), (61, 1.0, 1.0, "x", "u", None, "q", None)], "k long, a double, b double, c string, d string, e string, name string, defect string")
    plan = PreprocessPlan().fit(df, "k")
    plan.save(str(tmp_path / "plan"), spark)
    again = PreprocessPlan.load(str(tmp_path / "plan"), spark)
    made = again.transform(df)
    assert made.columns == ["k", "defect", "a", "b", "c_y", "c_z", "d"] and made.count() == 60
    a = np.array([r[1] for r in rows])
    b = np.array([r[2] if r[2] is not None else statistics.median([x[2] for x in [*rows, (61, 1.0, 1.0)] if x[2] is not None]) for r in rows])
    got = {r.k: r for r in made.collect()}
    for r in rows:
        g = got[r[0]]
        assert g.a == pytest.approx((r[1] - a.mean()) / a.std()) and g.b == pytest.approx((b[r[0]] - b.mean()) / b.std())
        assert (g.defect, g.c_y, g.c_z, g.d) == (int(r[7] == "Y"), int(r[3] == "y"), int(r[3] == "z"), int(r[4] == "v"))
    new = spark.createDataFrame([(7, 2.0, None, "new", "v", "e", "nn", "Y")], df.schema)
    row = again.transform(new).first()
    assert (row.c_y, row.c_z, row.d, row.defect) == (0, 0, 1, 1)
    best = PreprocessPlan().fit(df, "k", k_features=2)
    assert len(best.transform(df).columns) == 4
    with pytest.raises(ValueError):
        PreprocessPlan().transform(df)


def cluster(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k, int(k % 4 == 0), (rng.normal(0, 1, 3) + 2 * (k % 4 == 0)).tolist()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "key long, label int, vector array<double>")


def test_smote_rows_lie_between_neighbours(spark):
    rows, df = cluster(spark)
    made = resample.smote(df, 1, ratio=0.8)
    assert made.where("label = 1").count() == int(0.8 * 45) and made.where("key >= 0").count() == 60
    few = [np.array(v) for _, y, v in rows if y]
    for r in made.where("key < 0").collect():
        v = np.array(r.vector)
        # on a segment between two minority rows
        assert any(abs(np.linalg.norm(v - a) + np.linalg.norm(v - b) - np.linalg.norm(a - b)) < 1e-9 for a in few for b in few)
    again = resample.smote(df.repartition(5), 1, ratio=0.8)
    assert sorted(map(str, made.collect())) == sorted(map(str, again.collect()))
    assert resample.smote(df, 1, ratio=0.1).count() == 60 and resample.smote(df.where("label = 0"), 1).count() == 45


def test_cleaning_by_neighbours(spark):
    rows, df = cluster(spark)
    near = {}
    for k, _, v in rows:
        order = sorted((np.linalg.norm(np.array(v) - np.array(w)), j) for j, _, w in rows if j != k)
        near[k] = [j for _, j in order]
    label = {k: y for k, y, _ in rows}
    links = {(a, near[a][0]) for a in near if near[near[a][0]][0] == a and a < near[a][0] and label[a] != label[near[a][0]]}
    assert {tuple(r) for r in resample.tomek_links(df).collect()} == links
    assert {r.key for r in resample.edited_nn(df).collect()} == {k for k in near if all(label[j] == label[k] for j in near[k][:3])}
    both = resample.smote_tomek(df, 1)
    assert resample.tomek_links(resample.smote(df, 1)).count() * 2 == resample.smote(df, 1).count() - both.count()
    assert resample.smote_enn(df, 1).count() <= resample.smote(df, 1).count()


@pytest.mark.parametrize("p", [1.0, 2.0, 3.0])
def test_neighbours_with_ties(spark, p):
    rows = [(k, [float(k % 5), float(k % 3)]) for k in range(40)]
    df = spark.createDataFrame(rows, "key long, vector array<double>")
    got = {(r.query_id, r["rank"]): r.base_id for r in knn.knn_join(df, df, 4, "key", "vector", p).collect()}
    for k, v in rows:
        order = sorted((sum(abs(a - b) ** p for a, b in zip(v, w)) ** (1 / p), j) for j, w in rows if j != k)
        assert [got[k, i + 1] for i in range(4)] == [j for _, j in order[:4]]


def test_models_fit_score_and_store(spark, tmp_path):
    rows, df = cluster(spark, 200)
    flat = df.selectExpr("key", "label", "vector[0] as a", "vector[1] as b", "vector[2] as c")
    columns = ["a", "b", "c"]
    made = [models.fit_logistic(flat, columns, "label"), models.fit_random_forest(flat, columns, "label", trees=5)]
    made += [models.fit_svm(flat, columns, "label", "key", kernel=k, landmarks=12, passes=6) for k in ("linear", "poly", "rbf", "sigmoid")]
    for model in made:
        scored = models.probabilities(model, flat, columns, "key", "label").withColumn("prediction", models.apply_threshold(F.col("probability"), F.col("own"), 0.5))
        row = models.evaluate(models.prediction_rows(scored, "key")).first()
        assert row.accuracy > 0.8 and row.roc_auc > 0.85
    importance = {r.feature: r.importance for r in models.feature_importance(spark, made[1], columns).collect()}
    assert set(importance) == set(columns) and sum(importance.values()) == pytest.approx(1)
    models.save_model(made[0], str(tmp_path / "m"), spark, {"f1": 0.5})
    loaded, meta = models.load_model(str(tmp_path / "m"), spark)
    assert meta["f1"] == 0.5 and loaded.coefficients == made[0].coefficients
    near = models.fit_knn(flat.where("key % 2 = 0"), columns, "label", "key", k=3)
    models.save_model(near, str(tmp_path / "k"), spark)
    again, meta = models.load_model(str(tmp_path / "k"), spark)
    assert json.dumps(meta["params"]) == json.dumps({"k": 3, "p": 2.0, "weights": "uniform"})
    asked = flat.where("key % 2 = 1").withColumn("extra", F.lit(1))
    one, two = (sorted(map(tuple, models.batch_score(asked, m, "key", "label").collect())) for m in (near, again))
    assert one == two and len(one) == 100
    with pytest.raises(ValueError):
        models.batch_score(asked.drop("b"), near, "key", "label")


def test_learning_curve_sets_are_nested(spark):
    df = spark.range(200).selectExpr("id as key", "cast(id % 3 = 0 as int) as label")
    sets = splits.nested_train_sets(df, "label", "key", [0.1, 0.5, 1.0]).collect()
    assert {r.fold for r in sets} == set(range(5)) and all(r.entered in (0.1, 0.5, 1.0) for r in sets)
    assert 0.05 < sum(r.entered <= 0.1 for r in sets) / 200 <= 0.1 and 0.4 < sum(r.entered <= 0.5 for r in sets) / 200 <= 0.5


def test_candidates_match_plain_voting(spark):
    rows, df = cluster(spark, 50)
    data = splits.stratified_kfold(df, "label", "key")
    some = [(0, 3, "uniform", 2, [1, 1, 0]), (1, 5, "distance", 1, [0, 1, 1]), (2, 30, "uniform", 3, [1, 1, 1]), (3, 3, "uniform", 2, [0, 0, 0])]
    population = spark.createDataFrame(some, "candidate long, k int, weights string, p int, mask array<int>")
    got = {(r.candidate, r.fold): (r.tn, r.fp, r.fn, r.tp) for r in search.evaluate_candidates(population, data).collect()}
    held = data.collect()
    for c, k, weights, p, mask in some:
        for fold in range(5):
            cells = [0, 0, 0, 0]
            train = [r for r in held if r.fold != fold]
            for q in (r for r in held if r.fold == fold):
                prediction = 0
                if any(mask):
                    order = sorted((sum(abs(a - b) ** p for a, b, m in zip(q.vector, r.vector, mask) if m) ** (1 / p), r.key, r.label) for r in train)[: min(k, 20, len(train) // 5)]
                    w = [1 if weights == "uniform" else 1 / d for d, _, _ in order]
                    prediction = int(sum(x for x, o in zip(w, order) if o[2]) > sum(x for x, o in zip(w, order) if not o[2]))
                cells[2 * q.label + prediction] += 1
            assert got[c, fold] == tuple(cells)
    best = {r.candidate: r.f1 for r in search.fitness(search.evaluate_candidates(population, data)).collect()}
    assert best[3] == 0


def test_pareto_front_with_ties(spark):
    rng = np.random.default_rng(6)
    points = [(k, *(rng.integers(0, 8, 3) / 8).tolist()) for k in range(400)]
    df = spark.createDataFrame(points, "k long, a double, b double, c double").repartition(7)
    best = {p[0] for p in points if not any(all(y >= x for x, y in zip(p[1:], q[1:])) and q[1:] != p[1:] for q in points)}
    assert {r.k for r in search.pareto_front(df, ["a", "b", "c"], "k").collect()} == best
    assert search.pareto_front(df.where("false"), ["a"], "k").count() == 0


def test_auc_keeps_under_monotone_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 3, int(rng.random() < 0.3), float(rng.integers(0, 500)) / 500) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, label int, score double")
    one = {r.g: (r.roc_auc, r.average_precision) for r in metrics.ranking_metrics(df, "g").collect()}
    two = {r.g: (r.roc_auc, r.average_precision) for r in metrics.ranking_metrics(df.withColumn("score", F.exp("score")), "g").collect()}
    for g in one:
        assert one[g] == pytest.approx(two[g])
        mine = [(y, s) for h, y, s in rows if h == g]
        wins = np.mean([(a > b) + (a == b) / 2 for y, a in mine if y for z, b in mine if not z])
        assert one[g][0] == pytest.approx(wins)


def test_projects_reports_and_catalog(spark, tmp_path):
    for name, more in (("ant", ""), ("ivy", "@attribute extra numeric\n")):
        (tmp_path / f"{name}.arff").write_text(f"@relation x\n@attribute loc numeric\n{more}@attribute bug {{Y,N}}\n@data\n" + ("1,2,Y\n" if more else "3,N\n4,?\n"))
    df = datasets.read_projects(spark, str(tmp_path))
    assert sorted((r.project, r["loc"], r.extra or 0, r.bug or "") for r in df.collect()) == [("ant", 3.0, 0, "N"), ("ant", 4.0, 0, ""), ("ivy", 1.0, 2.0, "Y")]
    assert {tuple(r) for r in datasets.dataset_catalog(df, "project").collect()} == {("ant", 2, 2), ("ivy", 1, 3)}
    with pytest.raises(ValueError):
        datasets.dataset_catalog(df.where("false"), "project")
    datasets.write_report({"all": df, "bugs": df.select("bug")}, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report/bugs"), header=True).columns == ["bug"]
    datasets.write_dataset(df, str(tmp_path / "stored"), "project")
    assert spark.read.parquet(str(tmp_path / "stored")).count() == 3
    assert search.grid(spark, {"k": [1, 3, 5], "p": [1, 2]}).count() == 6


def test_soft_vote_adds_in_the_order_of_members(spark):
    """However rows are dealt: a shuffle that brings the members in another order changes no digit."""
    rows = [(k, (k * 7 % 101) / 100, (k * 5 % 101) / 100, (k * 13 % 101) / 100) for k in range(2000)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    want = {k: (a + b + c) / 3 for k, a, b, c in rows}
    mixed = [df.select("k", F.col(x).alias("probability")).repartition(3 + i) for i, x in enumerate("abc")]
    assert {r.k: r.probability for r in models.soft_vote(mixed, "k").collect()} == want
    few = models.soft_vote([mixed[0], mixed[1].where("k < 5"), mixed[2].where("k < 0")], "k")
    assert {r.k: r.probability for r in few.where("k < 7").collect()} == {k: (a + b) / 2 if k < 5 else a for k, a, b, _ in rows[:7]}
