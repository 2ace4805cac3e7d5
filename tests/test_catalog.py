"""Every query with SQL against DuckDB at the smallest scale, and the readers."""

import math

import duckdb
import pytest

from defect_spark import catalog
from defect_spark.operators import cleaning, metrics
from defect_spark.sources import datasets

SF = "/root/testdata/sf0.001"


def norm(v):
    return "null" if v is None else ("nan" if math.isnan(v) else f"{v:.6g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "documents", "labels", "embeddings", "customer", "supplier"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted([norm(r[names.index(c)]) for c in df.columns] for r in cur.fetchall())
    assert sorted([norm(v) for v in r] for r in df.collect()) == expected


def test_readers(spark, tmp_path):
    arff = tmp_path / "a.arff"
    arff.write_text("% c\r\n@RELATION r\r\n@ATTRIBUTE loc NUMERIC\r\n@attribute bug {false,true}\r\n@DATA\r\n1.5,true\r\n?,false\r\n")
    assert datasets.detect_format(spark, str(arff)) == "arff"
    assert sorted(map(tuple, datasets.read_arff(spark, str(arff)).collect()), key=str) == [(1.5, "true"), (None, "false")]
    csv = tmp_path / "a.csv"
    csv.write_text("a;b\n1;x\n")
    assert [tuple(r) for r in datasets.read_csv_dataset(spark, str(csv)).collect()] == [(1, "x")]


def test_cleaning_of_nulls(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, 4.0, "b", None), (3, 8.0, "a", None)], "k int, x double, s string, z string")
    assert cleaning.drop_all_null_columns(df).columns == ["k", "x", "s"]
    filled = {r.k: (r.x, r.s, r.z) for r in cleaning.impute(df, ["x"], ["s", "z"]).collect()}
    assert filled[1] == (6.0, "a", "unknown")


def test_metrics_of_one_class(spark):
    df = spark.createDataFrame([(0, 1, 0.5, 1), (0, 1, 0.5, 1)], "fold int, label int, score double, prediction int")
    assert {(r.score, r.tpr, r.fpr) for r in metrics.curve(df, "fold").collect()} == {(float("inf"), 0.0, 0.0), (0.5, 1.0, 0.0)}
    row = metrics.ranking_metrics(df, "fold").first()
    assert row.roc_auc is None and row.average_precision is None
    assert metrics.binary_metrics(df, "fold").first().specificity == 0.0


def test_rows_without_a_score_are_left_out(spark):
    rows = [(0, 1, 0.9, 1), (0, 0, 0.8, 1), (0, 1, 0.7, 1), (0, 0, 0.1, 0), (0, 1, None, 0), (0, None, 0.5, 0)]
    df = spark.createDataFrame(rows, "fold int, label int, score double, prediction int")
    one, two = (metrics.ranking_metrics(x, "fold").first() for x in (df, df.where("score is not null and label is not null")))
    assert one == two and one.roc_auc == 0.75
    assert metrics.curve(df, "fold").count() == 5


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_sql_run(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert rows and all(v is not None for v in rows[0])
