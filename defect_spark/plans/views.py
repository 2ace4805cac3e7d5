"""Labelled views over the given tables; each has the same meaning in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: quantities, a project and a label."""
    row_id = F.expr("concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint))")
    return table(spark, sf_dir, "lineitem").select(row_id.alias("row_id"), "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("label"))


LINES = "SELECT concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id, l_orderkey, l_partkey, l_quantity, l_discount, l_tax, l_linestatus, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem"


def with_nulls(df: DataFrame) -> DataFrame:
    """line_defects with holes: a quantity and a status of about one row in five are null, both of one in ten."""
    hole = lambda c, *ks: F.when(~(F.col("l_orderkey") % 10).isin(*ks), F.col(c)).alias(c)
    return df.select("row_id", "l_orderkey", hole("l_quantity", 3, 5), hole("l_linestatus", 4, 5), "label")


HOLES = f"SELECT row_id, l_orderkey, CASE WHEN l_orderkey % 10 NOT IN (3, 5) THEN l_quantity END AS l_quantity, CASE WHEN l_orderkey % 10 NOT IN (4, 5) THEN l_linestatus END AS l_linestatus, label FROM ({LINES})"


# How labels are written in datasets, null for a missing one.
WRITTEN = ["Y", "yes", "true", "True", "1", "no", "FALSE ", "false", None, "M", "bug", "N", "0"]


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, target): line items with a label as text, in many spellings, some missing."""
    target = F.get(F.array(*map(F.lit, WRITTEN)), (F.col("l_orderkey") % len(WRITTEN)).cast("int"))
    return line_defects(spark, sf_dir).select("row_id", target.alias("target"))


TARGETS = f"SELECT row_id, ['Y', 'yes', 'true', 'True', '1', 'no', 'FALSE ', 'false', NULL, 'M', 'bug', 'N', '0'][1 + l_orderkey % 13] AS target FROM ({LINES})"


def doc_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, n_chars, source, toxic) of labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"), "source")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fold, label, score, prediction): a made-up score of line items, with many ties."""
    df = table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    score = ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("label") * 25) % 101).cast("double") / 100.0
    df = df.select((F.col("l_orderkey") % 5).cast("long").alias("fold"), "label", score.alias("score"))
    return df.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


SCORED = "SELECT *, CAST(score >= 0.5 AS INTEGER) AS prediction FROM (SELECT CAST(l_orderkey % 5 AS BIGINT) AS fold, label, CAST((l_partkey * 7 + l_suppkey * 3 + label * 25) % 101 AS DOUBLE) / 100 AS score FROM (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem))"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, param, f1, recall, features): one made-up search result for each order."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("long").alias("run"), (F.col("o_custkey") % 20 + 1).cast("long").alias("param"), ((F.col("o_orderkey") * 13 % 97).cast("double") / 97).alias("f1"), ((F.col("o_custkey") * 11 % 89).cast("double") / 89).alias("recall"), chosen_features().alias("features"))


def chosen_features() -> Column:
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.shiftrightunsigned(F.col("o_orderkey") * 37, 3).bitwiseAND(255) / F.pow(F.lit(2.0), i) % 2 >= 1, F.concat(F.lit("f"), i.cast("string")))), lambda x: x.isNotNull())


RUNS = "SELECT CAST(o_orderkey AS BIGINT) AS run, CAST(o_custkey % 20 + 1 AS BIGINT) AS param, CAST(o_orderkey * 13 % 97 AS DOUBLE) / 97 AS f1, CAST(o_custkey * 11 % 89 AS DOUBLE) / 89 AS recall, [CASE WHEN (((o_orderkey * 37) >> 3) & (CAST(1 AS BIGINT) << i)) > 0 THEN 'f' || i END FOR i IN range(8)] AS bits FROM orders"


def picked(values: list[str], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results of workflows on test sets, one made-up run for each order: keys, parameters, six scores and features."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    score = lambda a, b: (a % b).cast("double") / float(b)
    made = {
        "opt_metric": picked(["f1", "recall", "accuracy"], o % 3), "workflow": picked(["default", "features", "parameters", "both"], c % 4), "test_set": F.col("o_orderstatus"),
        "k": (c % 20 + 1).cast("long"), "weights": picked(["uniform", "distance"], o % 2),
        "f1": score(o * 13, 97), "recall": score(c * 11, 89), "precision": score(o * 7, 83), "accuracy": score(o + c, 79), "roc_auc": score(o * 3 + c, 73), "pr_auc": score(c * 5, 71),
    }
    return table(spark, sf_dir, "orders").select(o.cast("long").alias("run"), *(e.alias(n) for n, e in made.items()), chosen_features().alias("features"))


RESULTS = """SELECT CAST(o_orderkey AS BIGINT) AS run, ['f1', 'recall', 'accuracy'][1 + o_orderkey % 3] AS opt_metric, ['default', 'features', 'parameters', 'both'][1 + o_custkey % 4] AS workflow, o_orderstatus AS test_set,
  CAST(o_custkey % 20 + 1 AS BIGINT) AS k, ['uniform', 'distance'][1 + o_orderkey % 2] AS weights, CAST(o_orderkey * 13 % 97 AS DOUBLE) / 97 AS f1, CAST(o_custkey * 11 % 89 AS DOUBLE) / 89 AS recall, CAST(o_orderkey * 7 % 83 AS DOUBLE) / 83 AS precision,
  CAST((o_orderkey + o_custkey) % 79 AS DOUBLE) / 79 AS accuracy, CAST((o_orderkey * 3 + o_custkey) % 73 AS DOUBLE) / 73 AS roc_auc, CAST(o_custkey * 5 % 71 AS DOUBLE) / 71 AS pr_auc, list_filter(bits, lambda x: x IS NOT NULL) AS features
  FROM (SELECT *, [CASE WHEN (((o_orderkey * 37) >> 3) & (CAST(1 AS BIGINT) << i)) > 0 THEN 'f' || i END FOR i IN range(8)] AS bits FROM orders)"""


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, fold, label, probability, prediction, second, third): line items with three made-up scores."""
    row_id = F.expr("concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint))")
    label = (F.col("l_returnflag") == "R").cast("int")
    score = lambda a, b, c: ((F.col("l_partkey") * a + F.col("l_suppkey") * b + F.col("label") * c) % 101).cast("double") / 100.0
    df = table(spark, sf_dir, "lineitem").select(row_id.alias("row_id"), (F.col("l_orderkey") % 5).cast("long").alias("fold"), label.alias("label"), "l_partkey", "l_suppkey")
    df = df.select("row_id", "fold", "label", score(7, 3, 25).alias("probability"), score(5, 11, 30).alias("second"), score(13, 2, 0).alias("third"))
    return df.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


SCORED_ROWS = f"""SELECT *, CAST(probability > 0.5 AS INTEGER) AS prediction FROM (SELECT row_id, fold, label, CAST((l_partkey * 7 + l_suppkey * 3 + label * 25) % 101 AS DOUBLE) / 100 AS probability,
  CAST((l_partkey * 5 + l_suppkey * 11 + label * 30) % 101 AS DOUBLE) / 100 AS second, CAST((l_partkey * 13 + l_suppkey * 2) % 101 AS DOUBLE) / 100 AS third
  FROM (SELECT concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id, CAST(l_orderkey % 5 AS BIGINT) AS fold, l_partkey, l_suppkey, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem))"""
