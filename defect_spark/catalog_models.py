"""Registered queries of resampling, models, evaluation and search steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defect_spark.operators import cleaning, features, knn, metrics, models, profile, resample, search, splits, svm
from defect_spark.plans.preprocess import PreprocessPlan
from defect_spark.plans.views import LINES, RESULTS, SCORED_ROWS, TARGETS, doc_defects, line_defects, results, scored_rows, table, targets
from defect_spark.registry import query, rounded
from defect_spark.sources import datasets


# ---- cleaning, features and splits ----

YES, POSITIVE = (", ".join(f"'{w}'" for w in words) for words in (cleaning.YES, cleaning.POSITIVE))


@query(f"""SELECT row_id, CAST(target IN ({YES}) AS INTEGER) AS yes, CAST(lower(trim(target)) <> 'false' AS INTEGER) AS not_false, CAST(target = 'Y' AS INTEGER) AS y,
  CAST(target = (SELECT min(target) FROM ({TARGETS}) WHERE target IN ({POSITIVE})) AS INTEGER) AS positive FROM ({TARGETS}) WHERE target IS NOT NULL""")
def binarize_target(spark, sf):
    df = cleaning.drop_null_target(targets(spark, sf), "target")
    values = cleaning.target_values(df, "target")
    return df.select("row_id", *(cleaning.binarize(F.col("target"), r, values).alias(r) for r in ("yes", "not_false", "y", "positive")))


@query(f"SELECT l_linestatus, count(*) AS n_classes, round(min(n) / max(n), 6) AS ratio FROM (SELECT l_linestatus, label, count(*) AS n FROM ({LINES}) GROUP BY 1, 2) GROUP BY 1")
def class_ratio(spark, sf):
    return rounded(profile.class_ratio(line_defects(spark, sf), "label", "l_linestatus"), "ratio")


@query("SELECT source AS project, count(*) AS n_rows, CAST((count(text) > 0) AS INTEGER) + CAST((count(lang) > 0) AS INTEGER) + 1 AS n_columns FROM documents GROUP BY 1")
def dataset_catalog(spark, sf):
    return datasets.dataset_catalog(table(spark, sf, "documents").select("doc_id", "text", "lang", F.col("source").alias("project")), "project")


@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT a.source AS train_project, b.source AS test_project, a.n AS n_train, b.n AS n_test FROM n a, n b WHERE a.source <> b.source""")
def cross_project_pairs(spark, sf):
    return splits.cross_project_pairs(table(spark, sf, "documents"), "source")


@query(f"SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) - 1 < ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) AS is_test FROM ({LINES})")
def train_test_split_plain(spark, sf):
    return splits.train_test_split(line_defects(spark, sf).select("row_id"), None, "row_id")


MI = f"""WITH x AS (SELECT label, unnest([{{'feature': 'discount', 'bin': CAST(CAST(floor(l_discount * 50) AS BIGINT) AS VARCHAR)}}, {{'feature': 'quantity', 'bin': CAST(CAST(floor(l_quantity / 5) AS BIGINT) AS VARCHAR)}}, {{'feature': 'status', 'bin': l_linestatus}}]) AS c FROM ({LINES})),
g AS (SELECT c.feature AS feature, c.bin AS bin, label, count(*) AS n FROM x GROUP BY 1, 2, 3),
w AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nx, sum(n) OVER (PARTITION BY feature, label) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM g),
s AS (SELECT feature, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM w GROUP BY 1)"""


def scores(spark, sf):
    bins = {"discount": "cast(floor(l_discount * 50) as bigint)", "quantity": "cast(floor(l_quantity / 5) as bigint)", "status": "l_linestatus"}
    return features.binned_mutual_info(line_defects(spark, sf), bins, "label")


@query(f"{MI} SELECT feature, round(mi, 6) AS mi, CAST(row_number() OVER (ORDER BY mi DESC, feature) AS INTEGER) AS rank FROM s ORDER BY mi DESC, feature LIMIT 2")
def mi_ranking(spark, sf):
    return rounded(features.mi_ranking(scores(spark, sf), 2), "mi")


@query(f"{MI} SELECT feature, round(greatest(0.2, least(0.8, mi / ((SELECT sum(mi) FROM s) + 1e-10))), 6) AS prior FROM s")
def mi_prior(spark, sf):
    return rounded(features.mi_prior(scores(spark, sf)), "prior")


@query("""WITH d AS (SELECT min(d.doc_id) AS doc_id, d.lang, d.n_chars, d.source, l.toxic FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL),
s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM d), v AS (SELECT DISTINCT lang FROM d)
SELECT doc_id, toxic::INTEGER AS toxic, round((n_chars - m) / s, 5) AS n_chars, CAST(lang = 'en' AS INTEGER) AS lang_en, CAST(lang = 'es' AS INTEGER) AS lang_es, CAST(lang = 'fr' AS INTEGER) AS lang_fr FROM d, s""")
def preprocess_plan(spark, sf):
    df = doc_defects(spark, sf)
    made = PreprocessPlan().fit(df, "doc_id", "toxic").transform(df)
    return rounded(made.select("doc_id", "toxic", "n_chars", "lang_en", "lang_es", "lang_fr"), "n_chars", digits=5)


# ---- neighbours and resampling ----

@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT unnest([1, 7, 20, 29]) AS k)
SELECT source, CAST(k AS INTEGER) AS k, CAST(greatest(1, least(k, 20, n // 5)) AS INTEGER) AS cv, CAST(greatest(1, least(k, 20, n - 1)) AS INTEGER) AS test FROM n, k""")
def knn_cap_k(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).select("*", F.explode(F.array(*map(F.lit, (1, 7, 20, 29)))).alias("k"))
    return counts.select("source", "k", knn.knn_cap_k(F.col("k"), F.col("n")).alias("cv"), knn.knn_cap_k(F.col("k"), F.col("n"), cross_validation=False).alias("test"))


NEAR1 = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, base_id) AS rank FROM (
  SELECT q.vec_id AS query_id, b.vec_id AS base_id, b.label, list_sum(list_transform(range(1, 65), lambda i: abs(q.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) AS dist FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id)) WHERE rank <= 5"""


@query(f"""WITH n AS ({NEAR1}), w AS (SELECT query_id, label, CASE WHEN min(dist) OVER (PARTITION BY query_id) = 0 THEN CAST(dist = 0 AS DOUBLE) ELSE 1 / dist END AS w FROM n),
s AS (SELECT query_id, label, sum(w) AS w FROM w GROUP BY 1, 2)
SELECT query_id, label AS prediction, round(share, 6) AS share FROM (SELECT *, w / sum(w) OVER (PARTITION BY query_id) AS share, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, label) AS k FROM s) WHERE k = 1""")
def knn_predict_distance(spark, sf):
    base = table(spark, sf, "embeddings")
    near = knn.knn_join(base.where("vec_id % 100 = 0"), base, 5, "vec_id", "embedding", p=1.0)
    return rounded(knn.knn_vote(near, base, "vec_id", "label", "distance"), "share")


def two_classes(spark, sf) -> DataFrame:
    """Embeddings as (key, label, vector) with one class against the others."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("key"), (F.col("label") == 0).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))


TWO = "SELECT CAST(vec_id AS BIGINT) AS key, CAST(label = 0 AS INTEGER) AS label, embedding::DOUBLE[] AS vector FROM embeddings"
U = "(('0x' || substr(md5(concat_ws(':', '42', '{0}', i)), 1, 8))::BIGINT / 4294967296.0)"
GAP, BASE, PICK = U.format("gap"), U.format("base"), U.format("near")


MADE = f"""WITH t AS ({TWO}), m AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || key), key) - 1 AS r FROM t WHERE label = 1), c AS (SELECT count(*) FILTER (WHERE label = 1) AS few, count(*) FILTER (WHERE label = 0) AS many FROM t),
near AS (SELECT * FROM (SELECT a.key AS a, b.key AS b, b.vector AS y, row_number() OVER (PARTITION BY a.key ORDER BY list_distance(a.vector, b.vector), b.key) AS j FROM m a, m b WHERE a.key <> b.key) WHERE j <= 5),
d AS (SELECT i, CAST(floor({BASE} * few) AS BIGINT) AS r, CAST(floor({PICK} * least(5, few - 1)) AS BIGINT) + 1 AS j, {GAP} AS u FROM c, range((SELECT many - few FROM c)) t(i))
SELECT -1 - d.i AS key, 1 AS label, list_transform(range(1, 65), lambda k: m.vector[k] + d.u * (near.y[k] - m.vector[k])) AS vector FROM d JOIN m USING (r) JOIN near ON near.a = m.key AND near.j = d.j"""


@query(f"SELECT key, label, i, round(x, 5) AS x FROM (SELECT key, label, unnest(range(64)) AS i, unnest(vector) AS x FROM ({MADE}))")
def smote(spark, sf):
    made = resample.smote(two_classes(spark, sf), 1).where("key < 0")
    return rounded(made.select("key", "label", F.posexplode("vector").alias("i", "x")).withColumn("i", F.col("i").cast("long")), "x", digits=5)


def next_sql(rows: str, k: int) -> str:
    """(a, b, la, lb, j): the k nearest other rows of each row of a table (key, label, vector)."""
    return f"""SELECT a, p.b AS b, la, p.lb AS lb, j FROM (SELECT a, la, unnest(near) AS p, unnest(range(1, len(near) + 1)) AS j FROM (
  SELECT a.key AS a, a.label AS la, list_slice(list_sort(list({{'d': list_distance(a.vector, b.vector), 'b': b.key, 'lb': b.label}})), 1, {k}) AS near FROM {rows} a JOIN {rows} b ON a.key <> b.key GROUP BY 1, 2))"""


@query(f"WITH t AS MATERIALIZED ({TWO}), n AS MATERIALIZED ({next_sql('t', 1)}) SELECT x.a, x.b FROM n x JOIN n y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.la <> x.lb")
def tomek_links(spark, sf):
    return resample.tomek_links(two_classes(spark, sf))


@query(f"WITH t AS MATERIALIZED ({TWO}) SELECT a AS key, la AS label FROM ({next_sql('t', 3)}) GROUP BY 1, 2 HAVING bool_and(la = lb)")
def edited_nn(spark, sf):
    return resample.edited_nn(two_classes(spark, sf)).select("key", "label")


OVER = f"WITH made AS MATERIALIZED ({MADE}), v AS MATERIALIZED (SELECT key, label, vector FROM ({TWO}) UNION ALL SELECT key, label, vector FROM made)"


@query(f"""{OVER}, n AS MATERIALIZED ({next_sql('v', 1)}), gone AS (SELECT x.a AS key FROM n x JOIN n y ON x.a = y.b AND x.b = y.a WHERE x.la <> x.lb)
SELECT key, label FROM v WHERE key NOT IN (SELECT key FROM gone)""")
def smote_tomek(spark, sf):
    return resample.smote_tomek(two_classes(spark, sf), 1).select("key", "label")


@query(f"{OVER} SELECT a AS key, la AS label FROM ({next_sql('v', 3)}) GROUP BY 1, 2 HAVING bool_and(la = lb)")
def smote_enn(spark, sf):
    return resample.smote_enn(two_classes(spark, sf), 1).select("key", "label")


# ---- models and scoring ----

PARTS = f"""SELECT row_id, l_orderkey, CASE l_orderkey % 4 WHEN 0 THEN [1 - l_discount, l_discount] WHEN 1 THEN [l_discount, l_tax, 1 - l_discount - l_tax] END AS probability, CASE WHEN l_orderkey % 4 = 2 THEN l_tax * 10 - 0.4 END AS margin FROM ({LINES})"""


@query(f"SELECT row_id, round(CASE l_orderkey % 4 WHEN 0 THEN probability[2] WHEN 1 THEN list_max(probability) WHEN 2 THEN 1 / (1 + exp(-margin)) ELSE 0.5 END, 6) AS probability FROM ({PARTS})")
def score_probability(spark, sf):
    d, t, one = F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), F.lit(1.0)
    which = F.col("l_orderkey") % 4
    probability = F.when(which == 0, F.array(one - d, d)).when(which == 1, F.array(d, t, one - d - t))
    df = line_defects(spark, sf).select("row_id", probability.alias("probability"), F.when(which == 2, t * 10 - 0.4).alias("margin"))
    return rounded(df.select("row_id", models.score_probability(F.col("probability"), F.col("margin")).alias("probability")), "probability")


@query(f"SELECT row_id, CAST(probability > 0.5 AS INTEGER) AS own, CAST(probability >= 0.3 AS INTEGER) AS low, CAST(probability >= 0.7 AS INTEGER) AS high FROM ({SCORED_ROWS})")
def apply_threshold(spark, sf):
    p, own = F.col("probability"), F.col("probability") > 0.5
    return scored_rows(spark, sf).select("row_id", *(models.apply_threshold(p, own, t).alias(n) for n, t in (("own", 0.5), ("low", 0.3), ("high", 0.7))))


@query(f"SELECT row_id, label, prediction, round(probability, 6) AS probability, round(CASE WHEN prediction = 1 THEN probability ELSE 1 - probability END, 6) AS confidence, label = prediction AS correct FROM ({SCORED_ROWS})")
def prediction_rows(spark, sf):
    return rounded(models.prediction_rows(scored_rows(spark, sf), "row_id"), "probability", "confidence")


VOTES = f"SELECT row_id, (probability + second + third) / 3 AS p FROM ({SCORED_ROWS})"


@query(f"SELECT row_id, round(p, 6) AS probability, CAST(p > 0.5 AS INTEGER) AS prediction FROM ({VOTES})")
def soft_vote(spark, sf):
    df = scored_rows(spark, sf)
    members = [df.select("row_id", F.col(c).alias("probability")) for c in ("probability", "second", "third")]
    return rounded(models.soft_vote(members, "row_id"), "probability")


SCALED = """SELECT vec_id AS key, CAST(label = 0 AS INTEGER) AS label, vec_id % 10 = 0 AS is_test, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE) AS x FROM embeddings"""


@query(f"""WITH e AS ({SCALED}), s AS (SELECT [{', '.join(f'avg(x[{i}])' for i in range(1, 65))}] AS m, [{', '.join(f'stddev_pop(x[{i}])' for i in range(1, 65))}] AS d FROM e WHERE NOT is_test),
z AS (SELECT key, label, is_test, list_transform(range(1, 65), lambda i: (x[i] - m[i]) / d[i]) AS x FROM e, s),
n AS (SELECT * FROM (SELECT a.key, a.label, b.label AS near, row_number() OVER (PARTITION BY a.key ORDER BY list_distance(a.x, b.x), b.key) AS k FROM z a, z b WHERE a.is_test AND NOT b.is_test) WHERE k <= 5),
p AS (SELECT key, label, avg(near) AS p FROM n GROUP BY 1, 2)
SELECT key, label, CAST(p >= 0.3 AS INTEGER) AS prediction, round(p, 6) AS probability, round(CASE WHEN p >= 0.3 THEN p ELSE 1 - p END, 6) AS confidence, label = CAST(p >= 0.3 AS INTEGER) AS correct FROM p""")
def batch_score(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("key"), (F.col("label") == 0).cast("int").alias("label"), *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)))
    model = models.fit_knn(e.where("key % 10 <> 0"), [f"x{i}" for i in range(64)], "label", "key")
    return rounded(models.batch_score(e.where("key % 10 = 0"), model, "key", "label", 0.3), "probability", "confidence")


def fitted(spark, sf, fit) -> DataFrame:
    """Metrics on held-out rows (a fifth of each class) of a model of line items by label."""
    columns = ["l_quantity", "l_discount", "l_tax"]
    df = line_defects(spark, sf).select("row_id", "label", *(F.col(c).cast("double").alias(c) for c in columns))
    parted = splits.train_test_split(df, "label", "row_id")
    train, test = parted.where("not is_test").drop("is_test"), parted.where("is_test").drop("is_test")
    scaler = features.fit_scaler(train, columns)
    model = models.ModelPackage(fit(features.apply_scaler(train, scaler, columns), columns), columns, scaler)
    return models.evaluate(models.batch_score(test, model, "row_id", "label"))


@query(None)
def fit_logistic(spark, sf):
    return fitted(spark, sf, lambda df, columns: models.fit_logistic(df, columns, "label"))


@query(None)
def fit_random_forest(spark, sf):
    return fitted(spark, sf, lambda df, columns: models.fit_random_forest(df, columns, "label"))


@query(None)
def fit_svm(spark, sf):
    return fitted(spark, sf, lambda df, columns: models.fit_svm(df, columns, "label", "row_id"))


# ---- evaluation ----

@query(f"SELECT fold, label, prediction, count(*) AS n FROM ({SCORED_ROWS}) GROUP BY 1, 2, 3")
def confusion_cells(spark, sf):
    return metrics.confusion_cells(scored_rows(spark, sf), "fold")


@query(f"SELECT fold, label, count(*) FILTER (WHERE label = prediction) AS correct, count(*) AS n, round(count(*) FILTER (WHERE label = prediction) / count(*), 6) AS accuracy FROM ({SCORED_ROWS}) GROUP BY 1, 2")
def per_class_accuracy(spark, sf):
    return rounded(metrics.per_class_accuracy(scored_rows(spark, sf), "fold"), "accuracy")


ERRORS = f"SELECT fold, count(*) AS n, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM ({SCORED_ROWS}) GROUP BY 1"


@query(f"SELECT *, round(fp / n, 6) AS fp_share, round(fn / n, 6) AS fn_share FROM ({ERRORS})")
def error_breakdown(spark, sf):
    return rounded(metrics.error_breakdown(scored_rows(spark, sf), "fold"), "fp_share", "fn_share")


@query(f"""SELECT run, CASE WHEN f1 >= 0.8 THEN 'good' WHEN f1 >= 0.6 THEN 'fair' ELSE 'low' END AS f1_band, CASE WHEN recall >= 0.8 THEN 'good' WHEN recall >= 0.6 THEN 'fair' ELSE 'low' END AS recall_band,
  concat_ws(';', CASE WHEN f1 < 0.6 THEN 'tune or rebuild the model' END, CASE WHEN recall < 0.7 AND precision > 0.8 THEN 'too cautious: lower the threshold' END, CASE WHEN precision < 0.7 AND recall > 0.8 THEN 'too eager: raise the threshold' END,
  CASE WHEN accuracy > 0.8 AND f1 > 0.8 AND recall > 0.8 THEN 'excellent' WHEN accuracy > 0.7 AND f1 > 0.7 THEN 'good' END) AS advice FROM ({RESULTS})""")
def rate_metrics(spark, sf):
    made = metrics.rate_metrics(results(spark, sf), ["f1", "recall"])
    return made.select("run", "f1_band", "recall_band", F.array_join("advice", ";").alias("advice"))


@query(f"SELECT run, round(0.6 * f1 + 0.1 * accuracy + 0.1 * precision + CASE WHEN run % 3 = 0 THEN 0.2 * recall ELSE 0.1 * recall + 0.1 * roc_auc END, 6) AS score FROM ({RESULTS})")
def composite_score(spark, sf):
    auc = F.when(F.col("run") % 3 != 0, F.col("roc_auc"))
    made = metrics.composite_score(F.col("f1"), F.col("accuracy"), F.col("precision"), F.col("recall"), auc)
    return rounded(results(spark, sf).select("run", made.alias("score")), "score")


@query(f"SELECT row_id, label, prediction AS first, CAST(second > 0.5 AS INTEGER) AS second, label = prediction AS first_correct, label = CAST(second > 0.5 AS INTEGER) AS second_correct FROM ({SCORED_ROWS})")
def compare_models(spark, sf):
    df = scored_rows(spark, sf)
    other = df.withColumn("prediction", (F.col("second") > 0.5).cast("int"))
    return metrics.compare_models(df, other, "row_id")


def delta_sql(name: str, label: str) -> str:
    return f"SELECT fold, '{label}' AS metric, avg(CAST(label = prediction AS INTEGER)) AS first, avg(CAST(label = CAST(second > 0.5 AS INTEGER) AS INTEGER)) AS second FROM ({SCORED_ROWS}) GROUP BY 1"


@query(f"SELECT fold, metric, round(first, 6) AS first, round(second, 6) AS second, round(second - first, 6) AS delta FROM ({delta_sql('accuracy', 'accuracy')})")
def metric_deltas(spark, sf):
    df = scored_rows(spark, sf)
    one, two = (metrics.binary_metrics(x, "fold") for x in (df, df.withColumn("prediction", (F.col("second") > 0.5).cast("int"))))
    return rounded(metrics.metric_deltas(one, two, "fold", ["accuracy"]), "first", "second", "delta")


def by_project(spark, sf) -> DataFrame:
    df = scored_rows(spark, sf)
    some = [df.select(F.lit(m).alias("model"), F.col("fold").alias("project"), "label", (F.col(c) > 0.5).cast("int").alias("prediction"), F.round(c, 2).alias("score")) for m, c in (("one", "probability"), ("two", "second"))]
    return some[0].unionByName(some[1])


MODELS = f"""SELECT 'one' AS model, fold AS project, label, CAST(probability > 0.5 AS INTEGER) AS prediction, round(probability, 2) AS score FROM ({SCORED_ROWS})
  UNION ALL SELECT 'two', fold, label, CAST(second > 0.5 AS INTEGER), round(second, 2) FROM ({SCORED_ROWS})"""
PROJECTS = f"""SELECT model, project, macro_f1, roc_auc FROM (SELECT model, project, avg(f1) AS macro_f1 FROM (SELECT model, project, k, coalesce(2 * count(*) FILTER (WHERE label = k AND prediction = k) / nullif(count(*) FILTER (WHERE label = k) + count(*) FILTER (WHERE prediction = k), 0), 0) AS f1
  FROM ({MODELS}), (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN (SELECT model, project, sum(n * (tp - p / 2)) / (max(np) * max(nn)) AS roc_auc FROM (
  SELECT *, sum(p) OVER (PARTITION BY model, project ORDER BY score DESC) AS tp, sum(p) OVER (PARTITION BY model, project) AS np, sum(n) OVER (PARTITION BY model, project) AS nn FROM (
  SELECT model, project, score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM ({MODELS}) GROUP BY 1, 2, 3)) GROUP BY 1, 2) USING (model, project)"""


@query(f"SELECT model, project, round(macro_f1, 6) AS macro_f1, round(roc_auc, 6) AS roc_auc FROM ({PROJECTS})")
def cross_project_scores(spark, sf):
    return rounded(metrics.cross_project_scores(by_project(spark, sf), "model", "project")[0], "macro_f1", "roc_auc")


@query(f"SELECT model, count(*) AS projects, " + ", ".join(f"round(quantile_cont({m}, {q}), 5) AS {m}_{n}" for m in ("macro_f1", "roc_auc") for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))) + f" FROM ({PROJECTS}) GROUP BY 1")
def cross_project_quartiles(spark, sf):
    made = metrics.cross_project_scores(by_project(spark, sf), "model", "project")[1]
    return rounded(made, *(c for c in made.columns if c not in ("model", "projects")), digits=5)


DRAW = "(('0x' || substr(md5(concat_ws(':', '42', {0})), 1, 8))::BIGINT / 4294967296.0)"
FRACTIONS = [0.1, 0.325, 0.55, 0.775, 1.0]


CURVE = """e AS (SELECT CAST(vec_id AS BIGINT) AS key, {0} AS label, embedding::DOUBLE[] AS v FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || key), key) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM e),
s AS (SELECT key, label, v, r % 5 AS fold, (r // 5 + 1) / ceil(n / 5) AS share FROM r), c AS (SELECT f.fraction, g.fold FROM (SELECT unnest([0.1, 0.325, 0.55, 0.775, 1.0]::DOUBLE[]) AS fraction) f, range(5) g(fold))"""


@query(f"""WITH {CURVE.format("label")},
m AS (SELECT c.fraction, c.fold, label, i, avg(v[i]) AS m FROM c JOIN s ON s.fold <> c.fold AND s.share <= c.fraction, range(1, 65) t(i) GROUP BY 1, 2, 3, 4), w AS MATERIALIZED (SELECT fraction, fold, label, list(m ORDER BY i) AS m FROM m GROUP BY 1, 2, 3),
p AS (SELECT w.fraction, w.fold, s.key, s.label, w.label AS prediction, row_number() OVER (PARTITION BY w.fraction, s.key ORDER BY list_distance(s.v, w.m), w.label) AS k FROM s JOIN w ON s.fold = w.fold)
SELECT fraction, CAST(fold AS INTEGER) AS fold, count(*) FILTER (WHERE label = prediction) AS correct, count(*) AS n FROM p WHERE k = 1 GROUP BY 1, 2""")
def learning_curve(spark, sf):
    return splits.means_curve(table(spark, sf, "embeddings").withColumn("key", F.col("vec_id").cast("long")), "label", "key", "embedding", FRACTIONS)


@query(f"""WITH {CURVE.format("CAST(label = 0 AS INTEGER)")}, pairs AS MATERIALIZED (SELECT q.key, q.fold, q.label, b.key AS near, b.label AS "is", b.fold AS other, b.share, list_distance(q.v, b.v) AS d FROM s q JOIN s b ON q.fold <> b.fold),
k AS (SELECT c.fraction, c.fold, greatest(1, least(5, 20, count(*) // 5)) AS k FROM c JOIN s ON s.fold <> c.fold AND s.share <= c.fraction GROUP BY 1, 2),
o AS (SELECT k.fraction, p.fold, p.key, p.label, p."is", k.k, row_number() OVER (PARTITION BY k.fraction, p.key ORDER BY d, near) AS j FROM pairs p JOIN k ON k.fold = p.fold AND p.share <= k.fraction),
v AS (SELECT fraction, fold, key, label, CAST(avg("is") > 0.5 AS INTEGER) AS p FROM o WHERE j <= k GROUP BY 1, 2, 3, 4)
SELECT fraction, CAST(fold AS INTEGER) AS fold, count(*) FILTER (WHERE label = 0 AND p = 0) AS tn, count(*) FILTER (WHERE label = 0 AND p = 1) AS fp, count(*) FILTER (WHERE label = 1 AND p = 0) AS fn, count(*) FILTER (WHERE label = 1 AND p = 1) AS tp FROM v GROUP BY 1, 2""")
def knn_learning_curve(spark, sf):
    return search.knn_curve(two_classes(spark, sf), "label", "key", "vector", fractions=FRACTIONS)


# ---- search steps ----

@query(f"""SELECT c_custkey AS candidate, CAST(floor({DRAW.format("'k', c_custkey")} * 20) AS INTEGER) + 1 AS k, CASE WHEN {DRAW.format("'weights', c_custkey")} < 0.5 THEN 'uniform' ELSE 'distance' END AS weights, CASE WHEN {DRAW.format("'p', c_custkey")} < 0.5 THEN 1 ELSE 2 END AS p,
  array_to_string(list_transform(range(8), lambda j: CAST({DRAW.format("'mask', c_custkey, j")} < 0.5 AS INTEGER)), '') AS mask FROM customer""")
def random_candidates(spark, sf):
    made = search.random_candidates(table(spark, sf, "customer"), "c_custkey", 8)
    return made.withColumn("mask", F.array_join(F.col("mask").cast("array<string>"), ""))


@query(f"""SELECT c_custkey AS candidate, round(0.01 + {DRAW.format("'c', c_custkey")} * 9.99, 6) AS c, round(0.001 + {DRAW.format("'gamma', c_custkey")} * 9.999, 6) AS gamma, ['linear', 'poly', 'rbf', 'sigmoid'][1 + CAST(floor({DRAW.format("'kernel', c_custkey")} * 4) AS BIGINT)] AS kernel,
  2 + CAST(floor({DRAW.format("'degree', c_custkey")} * 4) AS INTEGER) AS degree, round({DRAW.format("'coef0', c_custkey")} * 10, 6) AS coef0, array_to_string(list_transform(range(8), lambda j: CAST({DRAW.format("'mask', c_custkey, j")} < 0.1 * (j + 1) AS INTEGER)), '') AS mask FROM customer""")
def random_svm_candidates(spark, sf):
    made = search.random_svm_candidates(table(spark, sf, "customer"), "c_custkey", 8, prior=[0.1 * (i + 1) for i in range(8)])
    return rounded(made.withColumn("mask", F.array_join(F.col("mask").cast("array<string>"), "")), "c", "gamma", "coef0")


GENES = "SELECT CAST(o_orderkey AS BIGINT) AS candidate, list_transform(range(6), lambda i: CAST((o_orderkey * (37 + i * 11)) % 101 AS DOUBLE) / 101) AS genes FROM orders"


def genes(spark, sf) -> DataFrame:
    made = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (F.col("o_orderkey") * (37 + i * 11) % 101).cast("double") / 101)
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("candidate"), made.alias("genes"))


@query(f"""SELECT candidate, array_to_string(list_transform(genes[1:3], lambda g: CAST(g > 0.5 AS INTEGER)), '') AS mask, CAST(greatest(1, floor(genes[4] * 20)) AS INTEGER) AS k, CASE WHEN genes[5] > 0.5 THEN 'distance' ELSE 'uniform' END AS weights,
  CASE WHEN genes[6] < 0.33 THEN 1 WHEN genes[6] < 0.66 THEN 2 ELSE 3 END AS p FROM ({GENES})""")
def decode_genes(spark, sf):
    return search.decode_genes(genes(spark, sf)).select("candidate", F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"), "k", "weights", "p")


@query(f"""SELECT candidate, i, round(CASE WHEN {DRAW.format("'whether', candidate, i")} < 0.3 THEN genes[i + 1] + 0.2 * sqrt(-2 * ln(1 - {DRAW.format("'length', candidate, i")})) * cos(2 * pi() * {DRAW.format("'angle', candidate, i")}) ELSE genes[i + 1] END, 6) AS x FROM ({GENES}), range(6) t(i)""")
def mutate_gaussian(spark, sf):
    made = search.mutate_gaussian(genes(spark, sf), "genes", "candidate")
    return rounded(made.select("candidate", F.posexplode("genes").alias("i", "x")).withColumn("i", F.col("i").cast("long")), "x")


LAYERS = "(SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_custkey * 7919 % 97 AS DOUBLE) AS a, CAST(c_custkey * 104729 % 89 AS DOUBLE) AS b FROM customer)"


@query(f"""WITH RECURSIVE p AS MATERIALIZED {LAYERS}, beats AS MATERIALIZED (SELECT x.k AS k, y.k AS by FROM p x JOIN p y ON y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b)),
deep AS (SELECT k, 0 AS layer FROM p UNION SELECT b.k, d.layer + 1 FROM deep d JOIN beats b ON b.by = d.k WHERE d.layer < 12), l AS (SELECT k, a, b, max(layer) AS layer FROM deep JOIN p USING (k) GROUP BY 1, 2, 3),
f AS (SELECT layer, count(*) AS n, max(a) - min(a) AS ra, max(b) - min(b) AS rb FROM l GROUP BY 1),
o AS (SELECT l.*, n, ra, rb, row_number() OVER wa AS ia, lead(a) OVER wa - lag(a) OVER wa AS ga, row_number() OVER wb AS ib, lead(b) OVER wb - lag(b) OVER wb AS gb FROM l JOIN f USING (layer) WINDOW wa AS (PARTITION BY layer ORDER BY a, k), wb AS (PARTITION BY layer ORDER BY b, k)),
c AS (SELECT k, layer, CASE WHEN ia IN (1, n) OR ib IN (1, n) THEN CAST('inf' AS DOUBLE) ELSE coalesce(ga / nullif(2 * ra, 0), 0) + coalesce(gb / nullif(2 * rb, 0), 0) END AS crowding FROM o)
SELECT k, layer, CASE WHEN isinf(crowding) THEN -1 ELSE round(crowding, 6) END AS crowding FROM c ORDER BY layer, c.crowding DESC, k LIMIT 30""")
def nsga2_select(spark, sf):
    k = F.col("c_custkey").cast("long")
    scored = table(spark, sf, "customer").select(k.alias("k"), (k * 7919 % 97).cast("double").alias("a"), (k * 104729 % 89).cast("double").alias("b"))
    made = search.nsga2_select(scored, 30, ["a", "b"], "k")
    return made.select("k", "layer", F.when(F.col("crowding") == float("inf"), -1.0).otherwise(F.round("crowding", 6)).alias("crowding"))


BITS = "SELECT CAST(o_orderkey AS BIGINT) AS candidate, list_transform(range(12), lambda i: CAST((o_orderkey * 37 // CAST(pow(2, i) AS BIGINT)) % 2 AS INTEGER)) AS bits, list_transform(range(12), lambda i: CAST((o_custkey * 53 // CAST(pow(2, i) AS BIGINT)) % 2 AS INTEGER)) AS other FROM orders"


def candidates(spark, sf) -> DataFrame:
    bit = lambda c, m: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (F.floor(F.col(c) * m / F.pow(F.lit(2.0), i)) % 2).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("candidate"), bit("o_orderkey", 37).alias("bits"), bit("o_custkey", 53).alias("other"))


@query(f"""SELECT candidate, round(pow(10, (bits[1] * 16 + bits[2] * 8 + bits[3] * 4 + bits[4] * 2 + bits[5]) / 31), 6) AS c, round(pow(10, -1 + (bits[6] * 16 + bits[7] * 8 + bits[8] * 4 + bits[9] * 2 + bits[10]) / 31), 6) AS gamma,
  ['linear', 'poly', 'rbf', 'sigmoid'][1 + bits[11] * 2 + bits[12]] AS kernel FROM ({BITS})""")
def decode_candidate(spark, sf):
    return rounded(search.decode_svm(candidates(spark, sf)).select("candidate", "c", "gamma", "kernel"), "c", "gamma")


@query(f"""SELECT candidate, array_to_string(list_transform(range(12), lambda i: CASE WHEN {DRAW.format("'uniform', candidate, i")} < 0.5 THEN other[i + 1] ELSE bits[i + 1] END), '') AS uniform_child,
  array_to_string(list_transform(range(12), lambda i: CASE WHEN i BETWEEN least(one, two) AND greatest(one, two) THEN other[i + 1] ELSE bits[i + 1] END), '') AS two_point_child,
  round(list_sum(list_transform(range(12), lambda i: (1.3 - 1.6 * {DRAW.format("'blend', candidate, i")}) * bits[i + 1] + (1.6 * {DRAW.format("'blend', candidate, i")} - 0.3) * other[i + 1])), 5) AS blend_total
  FROM (SELECT *, floor({DRAW.format("'two_point', candidate, 1")} * 12) AS one, floor({DRAW.format("'two_point', candidate, 2")} * 12) AS two FROM ({BITS}))""")
def crossover(spark, sf):
    df = candidates(spark, sf)
    made = {k: search.crossover(df, "bits", "other", k, "candidate").select("candidate", F.col("child_a").alias(k)) for k in ("uniform", "two_point", "blend")}
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "")
    joined = made["uniform"].join(made["two_point"], "candidate").join(made["blend"], "candidate")
    return joined.select("candidate", text("uniform").alias("uniform_child"), text("two_point").alias("two_point_child"), F.round(F.aggregate("blend", F.lit(0.0), lambda a, x: a + x), 5).alias("blend_total"))


@query(f"""SELECT candidate, array_to_string(list_transform(range(12), lambda i: CASE WHEN {DRAW.format("'flip', candidate, i")} < 0.05 THEN 1 - bits[i + 1] ELSE bits[i + 1] END), '') AS bits,
  CASE WHEN {DRAW.format("'k', 'whether', candidate")} < 0.3 THEN [1, 3, 5, 7][1 + CAST(floor({DRAW.format("'k', 'value', candidate")} * 4) AS BIGINT)] ELSE 9 END AS k FROM ({BITS})""")
def mutate(spark, sf):
    df = search.mutate_mask(candidates(spark, sf).withColumn("k", F.lit(9)), "bits", "candidate")
    df = search.mutate_parameter(df, "k", [1, 3, 5, 7], "candidate")
    return df.select("candidate", F.array_join(F.col("bits").cast("array<string>"), "").alias("bits"), "k")


@query(f"""WITH p AS (SELECT CAST(s_suppkey AS BIGINT) AS candidate, CAST(s_suppkey * 13 % 7 AS DOUBLE) / 7 AS f1, CAST(s_suppkey * 11 % 5 AS DOUBLE) / 5 AS recall FROM supplier), n AS (SELECT *, row_number() OVER (ORDER BY candidate) - 1 AS member FROM p),
d AS (SELECT i AS slot, CAST(floor({DRAW.format("0, i, j")} * (SELECT count(*) FROM p)) AS BIGINT) AS member FROM range((SELECT count(*) FROM p)) t(i), range(3) s(j))
SELECT slot, candidate FROM (SELECT slot, candidate, row_number() OVER (PARTITION BY slot ORDER BY f1 DESC, recall DESC, candidate) AS k FROM d JOIN n USING (member)) WHERE k = 1""")
def tournament_select(spark, sf):
    s = F.col("s_suppkey").cast("long")
    population = table(spark, sf, "supplier").select(s.alias("candidate"), ((s * 13 % 7).cast("double") / 7).alias("f1"), ((s * 11 % 5).cast("double") / 5).alias("recall"))
    return search.tournament_select(population, population.count(), ["f1", "recall"])


@query(f"SELECT workflow, k, round(avg(f1), 5) AS avg, round(stddev_pop(f1), 5) AS std, round(min(f1), 5) AS min, round(max(f1), 5) AS max FROM ({RESULTS}) GROUP BY 1, 2")
def generation_stats(spark, sf):
    return rounded(search.generation_stats(results(spark, sf), ["workflow", "k"], "f1"), "avg", "std", "min", "max", digits=5)


CELLS = f"""WITH e AS (SELECT CAST(vec_id AS BIGINT) AS key, CAST(label = 0 AS INTEGER) AS label, embedding::DOUBLE[] AS x FROM embeddings),
r AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || key), key) - 1) % 5 AS fold FROM e), z AS (SELECT fold, count(*) AS n FROM r GROUP BY 1),
c AS (SELECT i AS candidate, 2 * i + 1 AS k, list_transform(range(64), lambda j: CAST((i + 1) * 37 // CAST(pow(2, j % 8) AS BIGINT) % 2 AS INTEGER)) AS mask FROM range(4) t(i)),
d AS (SELECT c.candidate, q.fold, q.key, q.label, b.label AS near, least(c.k, 20, ((SELECT count(*) FROM r) - z.n) // 5) AS k,
  row_number() OVER (PARTITION BY c.candidate, q.key ORDER BY sqrt(list_sum(list_transform(range(1, 65), lambda i: c.mask[i] * (q.x[i] - b.x[i]) * (q.x[i] - b.x[i])))), b.key) AS rank FROM c, r q JOIN z USING (fold) JOIN r b ON b.fold <> q.fold),
p AS (SELECT candidate, fold, key, label, CAST(avg(near) > 0.5 AS INTEGER) AS prediction FROM d WHERE rank <= k GROUP BY 1, 2, 3, 4)
SELECT candidate, fold, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM p GROUP BY 1, 2"""


@query(CELLS)
def evaluate_candidates(spark, sf):
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: (F.floor((F.col("id") + 1) * 37 / F.pow(F.lit(2.0), j % 8)) % 2).cast("int"))
    some = spark.range(4).select(F.col("id").alias("candidate"), (2 * F.col("id") + 1).cast("int").alias("k"), F.lit("uniform").alias("weights"), F.lit(2).alias("p"), bits.alias("mask"))
    return search.evaluate_candidates(some, splits.stratified_kfold(two_classes(spark, sf), "label", "key"))


@query(None)
def evaluate_svm_candidates(spark, sf):
    """Four machines, one a kernel, with all features or every other one, by five folds of all embeddings."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: ((j + 1) % (F.col("id") % 2 + 1) == 0).cast("int"))
    kernel = F.get(F.array(*map(F.lit, search.KERNELS)), F.col("id").cast("int"))
    some = spark.range(4).select(F.col("id").alias("candidate"), F.lit(1.0).alias("c"), kernel.alias("kernel"), F.lit(0.05).alias("gamma"), F.lit(2).alias("degree"), F.lit(1.0).alias("coef0"), bits.alias("mask"))
    cells = svm.evaluate_svm_candidates(some, splits.stratified_kfold(two_classes(spark, sf), "label", "key"), landmarks=30)
    return svm.weighted_fitness(cells, some)


@query(f"""WITH t AS MATERIALIZED ({TWO}) SELECT a AS query_id, b AS base_id, CAST(j AS INTEGER) AS rank FROM ({next_sql('t', 5)})""")
def knn_pivot_join(spark, sf):
    df = two_classes(spark, sf)
    near, _ = knn.pivot_search(df, df, 5, "key", "vector", block_rows=64)
    return near.select("query_id", "base_id", F.col("rank").cast("int").alias("rank"))


INFO = "SELECT d.doc_id, toxic, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS x FROM documents d JOIN labels l USING (doc_id) UNION ALL SELECT d.doc_id, toxic, 'n_lines', CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) FROM documents d JOIN labels l USING (doc_id)"


@query(f"""WITH v AS MATERIALIZED ({INFO}), n AS (SELECT feature, toxic, count(*) AS n FROM v GROUP BY 1, 2), p AS MATERIALIZED (SELECT a.feature, a.doc_id, a.x, a.toxic, n.n, b.toxic AS other, b.doc_id AS o, abs(a.x - b.x) AS d FROM v a JOIN v b USING (feature) JOIN n ON n.feature = a.feature AND n.toxic = a.toxic),
r AS (SELECT feature, doc_id, max(d) AS r, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY feature, doc_id ORDER BY d) AS j FROM p WHERE toxic = other AND o <> doc_id) WHERE j <= 3 GROUP BY 1, 2),
m AS (SELECT feature, doc_id, r.n, count(*) FILTER (WHERE d < r.r OR (d = 0 AND r.r = 0)) AS m FROM p JOIN r USING (feature, doc_id) GROUP BY 1, 2, 3), h AS MATERIALIZED (SELECT i AS n, -0.5772156649015329 + coalesce(sum(1.0 / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS psi FROM range(1, (SELECT count(*) + 2 FROM labels)) t(i)),
s AS (SELECT feature, count(*) AS c, avg((SELECT psi FROM h WHERE h.n = 3) - a.psi - b.psi) AS t FROM m JOIN h a ON a.n = m.n JOIN h b ON b.n = m.m GROUP BY 1)
SELECT feature, round(greatest(0, h.psi + t), 6) AS mi FROM s JOIN h ON h.n = s.c""")
def mutual_info(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    df = df.withColumn("n_lines", F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))))
    return rounded(features.mutual_info(df, ["n_chars", "n_lines"], "toxic", "doc_id"), "mi")


@query("SELECT CAST(l_linenumber % 2 AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1")
def detect_target(spark, sf):
    """Classes of the column that the evaluator's rule finds: label has too many values, Error is no name of that rule."""
    key = F.col("l_orderkey") % 50
    df = table(spark, sf, "lineitem").select(key.alias("Error"), key.alias("label"), (F.col("l_linenumber") % 2).alias("is_class"), F.col("l_returnflag").alias("bug"))
    return profile.value_counts(df.select(F.col(cleaning.detect_target(df, "evaluator")).cast("string").alias("value")), "value")
