"""The registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from defect_spark.operators import cleaning, features, knn, metrics, profile, search, splits
from defect_spark.plans.views import HOLES, LINES, RUNS, SCORED, line_defects, runs, scored, table, with_nulls
from defect_spark.registry import ORACLES, QUERIES, query, rounded

__all__ = ["ORACLES", "QUERIES"]


@query("""SELECT 'o_orderstatus' AS column_name, 'string' AS dtype, count(*) AS n_rows, count(*) - count(o_orderstatus) AS n_nulls, count(DISTINCT o_orderstatus) AS n_distinct FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', count(*), count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'o_custkey', 'bigint', count(*), count(*) - count(o_custkey), count(DISTINCT o_custkey) FROM orders""")
def profile_columns(spark, sf):
    return profile.profile_columns(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"))


@query(f"SELECT l_linestatus AS value, count(*) AS n FROM ({HOLES}) GROUP BY 1")
def value_counts(spark, sf):
    return profile.value_counts(with_nulls(line_defects(spark, sf)), "l_linestatus")


@query(f"SELECT l_linestatus, label, n, round(n / sum(n) OVER (PARTITION BY l_linestatus), 6) AS share FROM (SELECT l_linestatus, label, count(*) AS n FROM ({LINES}) GROUP BY 1, 2)")
def class_distribution(spark, sf):
    return rounded(profile.class_distribution(line_defects(spark, sf), "label", "l_linestatus"), "share")


@query(f"SELECT l_linestatus, round(max(n) / min(n), 6) AS imbalance, max(n) / min(n) > 1.5 AS rebalance FROM (SELECT l_linestatus, label, count(*) AS n FROM ({LINES}) GROUP BY 1, 2) GROUP BY 1")
def imbalance_gate(spark, sf):
    return rounded(profile.imbalance(line_defects(spark, sf), "label", "l_linestatus"), "imbalance")


@query("SELECT text, lang, source, min(doc_id) AS doc_id FROM (SELECT text, lang, source, doc_id FROM documents UNION ALL SELECT text, lang, source, -1 - doc_id FROM documents) GROUP BY 1, 2, 3")
def drop_duplicate_rows(spark, sf):
    docs = table(spark, sf, "documents").select("text", "lang", "source", "doc_id")
    return cleaning.drop_duplicate_rows(docs.unionByName(docs.withColumn("doc_id", -1 - F.col("doc_id"))), "doc_id")


@query("SELECT count(*) AS n_rows, count(DISTINCT (text, lang, source)) AS n_kept, count(*) - count(DISTINCT (text, lang, source)) AS n_removed FROM documents")
def duplicate_count(spark, sf):
    return cleaning.duplicate_count(table(spark, sf, "documents").select("text", "lang", "source", "doc_id"), "doc_id")


@query(f"SELECT row_id, l_quantity, l_linestatus FROM ({HOLES}) WHERE l_quantity IS NOT NULL OR l_linestatus IS NOT NULL")
def drop_all_null_rows(spark, sf):
    return cleaning.drop_all_null_rows(with_nulls(line_defects(spark, sf)).select("row_id", "l_quantity", "l_linestatus"), "row_id")


@query(f"""SELECT row_id, coalesce(l_quantity, (SELECT median(l_quantity) FROM ({HOLES}))) AS l_quantity,
  coalesce(l_linestatus, (SELECT l_linestatus FROM ({HOLES}) WHERE l_linestatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_linestatus FROM ({HOLES})""")
def impute(spark, sf):
    return cleaning.impute(with_nulls(line_defects(spark, sf)).select("row_id", "l_quantity", "l_linestatus"), ["l_quantity"], ["l_linestatus"])


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def label_encode(spark, sf):
    return features.label_encode(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code")


@query("""SELECT o_orderkey, o_custkey, CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders""")
def one_hot(spark, sf):
    return features.one_hot(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderstatus")


@query(f"SELECT row_id, round((l_quantity - m) / s, 6) AS l_quantity FROM ({LINES}), (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM ({LINES}))")
def standard_scale(spark, sf):
    df = line_defects(spark, sf).select("row_id", "l_quantity")
    return rounded(features.apply_scaler(df, features.fit_scaler(df, ["l_quantity"]), ["l_quantity"]), "l_quantity")


@query(f"""WITH x AS (SELECT label, unnest([{{'feature': 'discount', 'bin': CAST(CAST(floor(l_discount * 50) AS BIGINT) AS VARCHAR)}}, {{'feature': 'quantity', 'bin': CAST(CAST(floor(l_quantity / 5) AS BIGINT) AS VARCHAR)}}, {{'feature': 'status', 'bin': l_linestatus}}]) AS c FROM ({LINES})),
g AS (SELECT c.feature AS feature, c.bin AS bin, label, count(*) AS n FROM x GROUP BY 1, 2, 3),
w AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nx, sum(n) OVER (PARTITION BY feature, label) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM g)
SELECT feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM w GROUP BY 1""")
def binned_mutual_info(spark, sf):
    bins = {"discount": "cast(floor(l_discount * 50) as bigint)", "quantity": "cast(floor(l_quantity / 5) as bigint)", "status": "l_linestatus"}
    return rounded(features.binned_mutual_info(line_defects(spark, sf), bins, "label"), "mi")


@query(f"SELECT row_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) - 1) % 5 AS INTEGER) AS fold FROM ({LINES})")
def stratified_kfold(spark, sf):
    return splits.stratified_kfold(line_defects(spark, sf).select("row_id", "label"), "label", "row_id")


@query(f"SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) - 1 < ceil(count(*) OVER (PARTITION BY label) * CAST(0.2 AS DOUBLE)) AS is_test FROM ({LINES})")
def train_test_split(spark, sf):
    return splits.train_test_split(line_defects(spark, sf).select("row_id", "label"), "label", "row_id")


@query(f"SELECT row_id, label FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM ({LINES})) WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM ({LINES}) GROUP BY label))")
def random_under(spark, sf):
    return splits.random_under(line_defects(spark, sf).select("row_id", "label"), "label", "row_id")


@query(f"""SELECT row_id, label FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || row_id), row_id) AS k FROM ({LINES}))
WHERE k <= (SELECT greatest(min(n), floor(min(n) / 0.8)) FROM (SELECT count(*) AS n FROM ({LINES}) GROUP BY label))""")
def random_under_ratio(spark, sf):
    return splits.random_under(line_defects(spark, sf).select("row_id", "label"), "label", "row_id", ratio=0.8, seed=7)


@query(f"SELECT label, n, round(t / (c * n), 6) AS weight FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS c FROM ({LINES}) GROUP BY label)")
def class_weights(spark, sf):
    return rounded(splits.class_weights(line_defects(spark, sf), "label"), "weight")


NEAR = """SELECT * FROM (SELECT q.vec_id AS query_id, b.vec_id AS base_id, list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist, b.label AS label,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id) WHERE rank <= 5"""


def neighbours(spark, sf):
    base = table(spark, sf, "embeddings")
    return knn.knn_join(base.where("vec_id % 100 = 0"), base, 5, "vec_id", "embedding")


@query(f"SELECT query_id, base_id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM ({NEAR})")
def knn_join(spark, sf):
    return rounded(neighbours(spark, sf), "dist")


@query(f"SELECT query_id, label AS prediction, round(n / 5, 6) AS share FROM (SELECT query_id, label, count(*) AS n, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, label) AS k FROM ({NEAR}) GROUP BY 1, 2) WHERE k = 1")
def knn_predict(spark, sf):
    return rounded(knn.knn_vote(neighbours(spark, sf), table(spark, sf, "embeddings"), "vec_id", "label"), "share")


CELLS = f"SELECT fold, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM ({SCORED}) GROUP BY fold"
RATES = f"SELECT fold, round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS npv FROM ({CELLS})"


@query(CELLS)
def confusion_matrix(spark, sf):
    return metrics.confusion(scored(spark, sf), "fold")


@query(RATES)
def binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(scored(spark, sf), "fold"), "accuracy", "precision", "recall", "f1", "specificity", "npv")


@query(f"""WITH c AS (SELECT fold, CAST(k AS VARCHAR) AS class, count(*) FILTER (WHERE label = k) AS support, count(*) FILTER (WHERE prediction = k) AS predicted, count(*) FILTER (WHERE label = k AND prediction = k) AS hits FROM ({SCORED}), (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2),
e AS (SELECT fold, class, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, 2 * hits / (predicted + support) AS f1, support FROM c),
t AS (SELECT fold, sum(hits) / sum(support) AS a, CAST(sum(support) AS BIGINT) AS n FROM c GROUP BY fold),
u AS (SELECT * FROM e UNION ALL SELECT fold, 'accuracy', a, a, a, n FROM t UNION ALL SELECT fold, 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM e GROUP BY fold
UNION ALL SELECT fold, 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM e GROUP BY fold)
SELECT fold, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM u""")
def classification_report(spark, sf):
    return rounded(metrics.class_report(scored(spark, sf), "fold"), "precision", "recall", "f1")


STEPS = f"SELECT *, sum(p) OVER (PARTITION BY fold ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY fold ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY fold) AS np, sum(n) OVER (PARTITION BY fold) AS nn FROM (SELECT fold, score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM ({SCORED}) GROUP BY 1, 2)"


@query(f"SELECT fold, round(sum(n * (tp - p / 2)) / (max(np) * max(nn)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / max(np), 6) AS average_precision FROM ({STEPS}) GROUP BY fold")
def ranking_metrics(spark, sf):
    return rounded(metrics.ranking_metrics(scored(spark, sf), "fold"), "roc_auc", "average_precision")


@query(f"SELECT fold, score, round(tp / np, 6) AS tpr, round(fp / nn, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM ({STEPS}) UNION ALL SELECT DISTINCT fold, NULL, 0, 0, 1 FROM ({STEPS})")
def roc_pr_curve(spark, sf):
    """The start of a curve has no score."""
    made = metrics.curve(scored(spark, sf), "fold").withColumn("score", F.nullif("score", F.lit(float("inf"))))
    return rounded(made, "tpr", "fpr", "precision")


def spread(metric: str) -> str:
    return f"SELECT '{metric}' AS metric, round(avg({metric}), 5) AS mean, round(stddev_pop({metric}), 5) AS std, round(min({metric}), 5) AS min, round(max({metric}), 5) AS max FROM ({RATES})"


@query(f"{spread('f1')} UNION ALL {spread('recall')}")
def cv_summary(spark, sf):
    found = metrics.cv_summary(metrics.binary_metrics(scored(spark, sf), "fold"), ["f1", "recall"])
    return found.select("metric", *(F.round(c, 5).alias(c) for c in ("mean", "std", "min", "max")))


@query(f"SELECT run, f1, recall FROM ({RUNS}) a WHERE NOT EXISTS (SELECT 1 FROM ({RUNS}) b WHERE b.f1 >= a.f1 AND b.recall >= a.recall AND (b.f1 > a.f1 OR b.recall > a.recall))")
def pareto_front(spark, sf):
    return search.pareto_front(runs(spark, sf).select("run", "f1", "recall"), ["f1", "recall"], "run")


@query(f"SELECT param, run, f1 FROM (SELECT param, run, f1, row_number() OVER (PARTITION BY param ORDER BY f1 DESC, run) AS k FROM ({RUNS})) WHERE k = 1")
def best_solution(spark, sf):
    return search.best_solution(runs(spark, sf).select("param", "run", "f1"), "f1", "run", "param")


@query(f"SELECT feature, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM orders), 6) AS percent FROM (SELECT unnest(bits) AS feature FROM ({RUNS})) WHERE feature IS NOT NULL GROUP BY 1")
def feature_frequency(spark, sf):
    return rounded(search.feature_frequency(runs(spark, sf)), "percent")


BY_VALUE = ", ".join(f"round({e.format(m)}, 4) AS {m}_{n}" for m in ("f1", "recall") for n, e in (("mean", "avg({})"), ("std", "stddev_samp({})"), ("min", "min({})"), ("max", "max({})")))


@query(f"SELECT param AS value, count(*) AS n, {BY_VALUE} FROM ({RUNS}) GROUP BY 1")
def performance_by_value(spark, sf):
    found = search.performance_by_value(runs(spark, sf), "param", ["f1", "recall"])
    return rounded(found, *(c for c in found.columns if c not in ("value", "n")), digits=4)


# the other queries register themselves
from defect_spark import catalog_models, catalog_runs  # noqa: E402, F401
