"""Registered queries of the report tables and configuration tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from defect_spark.operators import analysis
from defect_spark.plans.views import RESULTS, results
from defect_spark.registry import query, rounded

FEATURES = [f"f{i}" for i in range(9)]
METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
KEYS = {"opt_metric": ["accuracy", "f1", "recall"], "workflow": ["both", "default", "features", "none", "parameters"], "test_set": ["F", "O", "P"]}


@query(f"""(SELECT 'f1' AS chosen_by, run, f1, accuracy FROM ({RESULTS}) ORDER BY f1 DESC, run LIMIT 1)
UNION ALL (SELECT 'accuracy', run, f1, accuracy FROM ({RESULTS}) ORDER BY accuracy DESC, run LIMIT 1)""")
def best_run(spark, sf):
    df = results(spark, sf)
    some = [analysis.best_run(df, m).select(F.lit(m).alias("chosen_by"), "run", "f1", "accuracy") for m in ("f1", "accuracy")]
    return some[0].unionByName(some[1])


@query(f"""WITH r AS ({RESULTS}), n AS (SELECT feature, count(*) AS n FROM (SELECT unnest(features) AS feature FROM r) GROUP BY 1), b AS (SELECT features FROM r ORDER BY f1 DESC, run LIMIT 1)
SELECT feature, coalesce(n, 0) AS n, round(100 * coalesce(n, 0) / (SELECT count(*) FROM r), 6) AS percent, list_contains((SELECT features FROM b), feature) AS in_best
FROM (SELECT 'f' || i AS feature FROM range(9) t(i)) LEFT JOIN n USING (feature)""")
def feature_status(spark, sf):
    return rounded(analysis.feature_status(results(spark, sf), FEATURES, "f1"), "percent")


@query(f"SELECT run, unnest(features) AS feature, round(f1, 6) AS f1, round(recall, 6) AS recall FROM ({RESULTS})")
def features_by_run(spark, sf):
    return rounded(analysis.features_by_run(results(spark, sf), ["f1", "recall"]), "f1", "recall")


@query(f"""SELECT parameter, value, n, round(100 * n / sum(n) OVER (PARTITION BY parameter), 6) AS percent FROM (
  SELECT 'k' AS parameter, CAST(k AS VARCHAR) AS value, count(*) AS n FROM ({RESULTS}) GROUP BY 2 UNION ALL SELECT 'weights', weights, count(*) FROM ({RESULTS}) GROUP BY 2)""")
def value_distribution(spark, sf):
    return rounded(analysis.value_distribution(results(spark, sf), ["k", "weights"]), "percent")


@query(f"""WITH r AS ({RESULTS}) SELECT unnest(['mean_f1', 'std_f1', 'best_f1', 'mean_recall', 'std_recall', 'best_recall', 'mean_features', 'reduction_percent', 'runs', 'mode_k']) AS name,
  unnest([round(avg(f1), 5), round(stddev_samp(f1), 5), round(max(f1), 5), round(avg(recall), 5), round(stddev_samp(recall), 5), round(max(recall), 5), round(avg(len(features)), 5), round(100 * (1 - avg(len(features)) / 9), 5), CAST(count(*) AS DOUBLE),
  (SELECT CAST(k AS DOUBLE) FROM r GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)]) AS value FROM r""")
def overall_summary(spark, sf):
    return rounded(analysis.overall_summary(results(spark, sf), ["f1", "recall"], ["k"], 9), "value", digits=5)


@query(f"""WITH r AS (SELECT *, CAST(len(features) AS INTEGER) AS n FROM ({RESULTS})), g AS (SELECT DISTINCT opt_metric, workflow FROM r)
SELECT g.opt_metric, g.workflow, (SELECT k FROM r WHERE r.opt_metric = g.opt_metric AND r.workflow = g.workflow GROUP BY k ORDER BY count(*) DESC, k LIMIT 1) AS k_mode,
  (SELECT round(avg(k), 5) FROM r WHERE r.opt_metric = g.opt_metric AND r.workflow = g.workflow) AS k_mean, (SELECT min(k) FROM r WHERE r.opt_metric = g.opt_metric AND r.workflow = g.workflow) AS k_min, (SELECT max(k) FROM r WHERE r.opt_metric = g.opt_metric AND r.workflow = g.workflow) AS k_max,
  (SELECT weights FROM r WHERE r.opt_metric = g.opt_metric AND r.workflow = g.workflow GROUP BY weights ORDER BY count(*) DESC, weights LIMIT 1) AS weights_mode,
  (SELECT n FROM r WHERE r.opt_metric = g.opt_metric AND r.workflow = g.workflow GROUP BY n ORDER BY count(*) DESC, n LIMIT 1) AS features_mode,
  (SELECT round(avg(n), 5) FROM r WHERE r.opt_metric = g.opt_metric AND r.workflow = g.workflow) AS features_mean, (SELECT min(n) FROM r WHERE r.opt_metric = g.opt_metric AND r.workflow = g.workflow) AS features_min, (SELECT max(n) FROM r WHERE r.opt_metric = g.opt_metric AND r.workflow = g.workflow) AS features_max FROM g""")
def decoded_stats(spark, sf):
    return rounded(analysis.decoded_stats(results(spark, sf), ["opt_metric", "workflow"]), "k_mean", "features_mean", digits=5)


GRID = "(SELECT unnest(['accuracy', 'f1', 'recall']) AS opt_metric), (SELECT unnest(['both', 'default', 'features', 'none', 'parameters']) AS workflow), (SELECT unnest(['F', 'O', 'P']) AS test_set)"
CELLS = ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in METRICS)
SHOWN = ", ".join(f"round(coalesce({m}_mean, 0), 5) AS {m}_mean, round(coalesce({m}_std, 0), 5) AS {m}_std, printf('%.4f±%.4f', coalesce({m}_mean, 0), coalesce({m}_std, 0)) AS {m}_text" for m in METRICS)
MEANS = f"SELECT opt_metric, workflow, test_set, coalesce(runs, 0) AS runs, {SHOWN} FROM (SELECT * FROM {GRID}) g LEFT JOIN (SELECT opt_metric, workflow, test_set, count(*) AS runs, {CELLS} FROM ({RESULTS}) GROUP BY 1, 2, 3) r USING (opt_metric, workflow, test_set)"


@query(MEANS)
def aggregate_results(spark, sf):
    return rounded(analysis.aggregate_results(results(spark, sf), KEYS, METRICS), *(f"{m}_{x}" for m in METRICS for x in ("mean", "std")), digits=5)


@query(f"""SELECT coalesce(workflow, 'all') AS workflow, round(avg(f1) FILTER (WHERE opt_metric = 'accuracy'), 5) AS accuracy, round(avg(f1) FILTER (WHERE opt_metric = 'f1'), 5) AS f1, round(avg(f1) FILTER (WHERE opt_metric = 'recall'), 5) AS recall, round(avg(f1), 5) AS all_runs
FROM ({RESULTS}) GROUP BY GROUPING SETS ((workflow), ())""")
def workflow_matrix(spark, sf):
    return rounded(analysis.workflow_matrix(results(spark, sf), "workflow", "opt_metric", KEYS["opt_metric"], "f1"), *KEYS["opt_metric"], "all_runs", digits=5)


@query(f"SELECT opt_metric, workflow, test_set, round(avg(f1), 5) AS mean_f1 FROM ({RESULTS}) GROUP BY 1, 2, 3 ORDER BY round(avg(f1), 5) DESC, 1, 2, 3 LIMIT 10")
def top_combinations(spark, sf):
    table = results(spark, sf).groupBy("opt_metric", "workflow", "test_set").agg(F.round(F.avg("f1"), 5).alias("mean_f1"))
    return analysis.top_combinations(table, "mean_f1", ["opt_metric", "workflow", "test_set"])


@query(f"SELECT run, round(f1, 6) AS f1, array_to_string(features, ',') AS features FROM (SELECT * FROM ({RESULTS}) ORDER BY f1 DESC, run LIMIT 3)")
def ensemble_members(spark, sf):
    return rounded(analysis.ensemble_members(results(spark, sf)), "f1").withColumn("features", F.array_join("features", ","))
