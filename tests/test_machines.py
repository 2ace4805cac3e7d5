"""Kernel machines: against an exact dual solution, in common passes, and stored with any other model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from defect_spark.operators import features, models, splits, svm


def two_moons(n=240, seed=1):
    r = np.random.default_rng(seed)
    y = (r.random(n) < 0.35).astype(int)
    t = r.random(n) * np.pi
    x = np.column_stack([np.cos(t) + y, np.where(y == 1, 0.5 - np.sin(t), np.sin(t))]) + r.normal(scale=0.15, size=(n, 2))
    return x, y


def dual(k, y, c, steps=40_000):
    """Margins of the exact machine, by pairs of multipliers that break the conditions most."""
    s = np.where(y == 1, 1.0, -1.0)
    top = c * len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))
    a, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(steps):
        up, low = ((s > 0) & (a < top - 1e-12)) | ((s < 0) & (a > 1e-12)), ((s < 0) & (a < top - 1e-12)) | ((s > 0) & (a > 1e-12))
        v = -s * g
        i, j = int(np.argmax(np.where(up, v, -np.inf))), int(np.argmin(np.where(low, v, np.inf)))
        if v[i] - v[j] < 1e-6:
            break
        step = (v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, top[i] - a[i] if s[i] > 0 else a[i], a[j] if s[j] > 0 else top[j] - a[j])
        a[i] += s[i] * step
        a[j] -= s[j] * step
        g += s * (k[:, i] - k[:, j]) * step
    return k @ (a * s) + (v[i] + v[j]) / 2


@pytest.mark.parametrize("kernel,options", [("linear", {}), ("rbf", {"gamma": 1.0}), ("poly", {"gamma": 0.5, "degree": 2, "coef0": 1.0})])
def test_margins_of_the_exact_machine(spark, kernel, options):
    """With every row a landmark margins are within 0.05 of the exact dual solution."""
    x, y = two_moons()
    df = spark.createDataFrame([(i, int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))], "key long, label int, u double, v double").repartition(3)
    made = models.fit_svm(df, ["u", "v"], "label", "key", c=2.0, kernel=kernel, landmarks=len(x), passes=30, **options)
    full = {"gamma": 0.1, "degree": 3, "coef0": 0.0} | options
    want = dual(svm.kernel_values(x, x, kernel, **full), y, 2.0)
    found = {r.key: r.margin for r in made.transform(df).collect()}
    assert max(abs(found[i] - want[i]) for i in range(len(x))) < 0.05


def test_candidates_fitted_together_equal_single_fits(spark):
    x, y = two_moons(200, 3)
    df = spark.createDataFrame([(i, int(b), [*map(float, a), float(i % 7)]) for i, (a, b) in enumerate(zip(x, y))], "key long, label int, vector array<double>")
    data = splits.stratified_kfold(df, "label", "key", 3)
    rows = [(0, 1.0, "rbf", 1.0, 3, 0.0, [1, 1, 0]), (1, 0.5, "linear", 0.1, 3, 0.0, [1, 1, 1]), (2, 2.0, "poly", 0.5, 2, 1.0, [1, 1, 0]), (3, 1.0, "sigmoid", 0.2, 3, 0.1, [1, 0, 1]), (4, 1.0, "rbf", 1.0, 3, 0.0, [0, 0, 0])]
    some = spark.createDataFrame(rows, "candidate long, c double, kernel string, gamma double, degree int, coef0 double, mask array<int>")

    def run(table):
        jobs = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"g{table.count()}", "")
        found = {(r.candidate, r.fold): (r.tn, r.fp, r.fn, r.tp) for r in svm.evaluate_svm_candidates(table, data, landmarks=30, passes=6).collect()}
        return found, len(jobs.getJobIdsForGroup(f"g{table.count()}"))

    together, jobs = run(some)
    assert set(together) == {(c, f) for c in range(4) for f in range(3)}
    single, most = {}, 0
    for r in rows[:4]:
        found, n = run(some.where(F.col("candidate") == r[0]))
        single |= found
        most = max(most, n)
    assert together == single and jobs <= most
    sizes = {f: n for f, n in data.groupBy("fold").count().collect()}
    assert all(sum(v) == sizes[f] for (_, f), v in together.items())
    cells = svm.evaluate_svm_candidates(some, data, landmarks=30, passes=6)
    fit = {r.candidate: r for r in svm.weighted_fitness(cells, some).collect()}
    assert fit[0].f1 > 0.85 and fit[4].f1 == fit[4].recall == -1
    want = np.mean([(tn + tp) / (tn + fp + fn + tp) for (c, _), (tn, fp, fn, tp) in together.items() if c == 0])
    assert fit[0].recall == pytest.approx(want)  # recall weighted by rows is accuracy


def test_every_family_is_stored_and_scores_the_same(spark, tmp_path):
    x, y = two_moons(160, 5)
    df = spark.createDataFrame([(i, int(b), float(a[0]), float(a[1]), float(i % 5)) for i, (a, b) in enumerate(zip(x, y))], "key long, label int, `a.x` double, b double, junk double").withColumnRenamed("a.x", "a")
    columns, mask = ["a", "junk", "b"], [1, 0, 1]
    train, new = df.where("key % 4 <> 0"), df.where("key % 4 = 0").withColumn("extra", F.lit("x"))
    scaler = features.fit_scaler(train, columns)
    scaled = features.apply_scaler(train, scaler, columns)
    used = ["a", "b"]
    made = {k: models.fit_svm(scaled, used, "label", "key", kernel=k, gamma=0.5, degree=2, coef0=1.0 if k == "poly" else 0.0, landmarks=20, passes=4) for k in svm.KINDS}
    made |= {"forest": models.fit_random_forest(scaled, used, "label", trees=5), "logistic": models.fit_logistic(scaled, used, "label")}
    packages = {n: models.ModelPackage(m, columns, scaler, mask, {"f1": 0.5}) for n, m in made.items()}
    packages["knn"] = models.ModelPackage(models.fit_knn(train, used, "label", "key", k=3), columns, None, mask)
    for name, package in packages.items():
        models.save_model(package, str(tmp_path / name), spark)
        again = models.load_package(str(tmp_path / name), spark)
        one, two = (sorted(map(tuple, models.batch_score(new, p, "key", "label").collect())) for p in (package, again))
        assert one == two and len(one) == 40, name
        assert again.mask == mask and (name == "knn" or again.metadata["f1"] == 0.5)
        assert models.evaluate(models.batch_score(new, again, "key", "label")).first().accuracy > 0.6, name
        with pytest.raises(ValueError):
            models.batch_score(new.drop("junk"), again, "key", "label")
    importance = {n: models.feature_importance(spark, m, used).count() for n, m in made.items()}
    assert importance == {"linear": 2, "poly": 0, "rbf": 0, "sigmoid": 0, "forest": 2, "logistic": 2}
    models.save_model(made["rbf"], str(tmp_path / "bare"), spark, {"f1": 1.0})
    bare, meta = models.load_model(str(tmp_path / "bare"), spark)
    assert meta["f1"] == 1.0 and bare.getOrDefault(bare.points) == made["rbf"].getOrDefault(made["rbf"].points)
