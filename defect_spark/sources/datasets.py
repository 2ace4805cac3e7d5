"""Readers and writers of metric datasets: CSV with any separator, ARFF, folders of projects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defect_spark.operators.profile import union_all


def detect_format(spark: SparkSession, path: str) -> str:
    head = [r.value.strip().lower() for r in spark.read.text(path).limit(50).collect()]
    return "arff" if path.lower().endswith(".arff") or any(x.startswith(("@relation", "@data")) for x in head) else "csv"


def read_csv_dataset(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A CSV with a header; the separator is the commonest of , ; and tab in the header."""
    if sep is None:
        header = (spark.read.text(path).first() or [""])[0]
        sep = max(",;\t", key=header.count)
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep)


ARFF_OPTIONS = {"nullValue": "?", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "quote": "'"}


def arff_schema(spark: SparkSession, path: str) -> str:
    """The attributes of a file as columns: numeric ones as doubles, others as strings."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r$", "")).alias("line"))
    fields = []
    for r in lines.where(F.lower("line").startswith("@attribute")).collect():
        name, kind = re.match(r"@attribute\s+('[^']+'|\"[^\"]+\"|\S+)\s+(.*)", r.line, re.I).groups()
        number = kind.strip().lower() in ("numeric", "real", "integer")
        fields.append(f"`{name.strip(chr(39) + chr(34))}` {'double' if number else 'string'}")
    return ", ".join(fields)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Numeric attributes as doubles, others as strings, ? as null."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r$", "")).alias("line"))
    rows = lines.where("line <> '' and not startswith(line, '@') and not startswith(line, '%')")
    return rows.select(F.from_csv("line", arff_schema(spark, path), ARFF_OPTIONS).alias("x")).select("x.*")


def write_dataset(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of CSV files for each (small) result table."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").csv(f"{path}/{name}", header=True)


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """All .arff files of a folder in one table, with project, the file's name; columns that a file lacks are null.

    Files are grouped by their attributes, so the work is one scan for each different header.
    """
    lines = spark.read.text(path, pathGlobFilter="*.arff").select(F.trim(F.regexp_replace("value", "\r$", "")).alias("line"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.arff$", 1).alias("project"), F.col("_metadata.file_path").alias("file"))
    heads: dict[str, list[str]] = {}
    for r in lines.where(F.lower("line").startswith("@attribute")).select("file").distinct().collect():
        heads.setdefault(arff_schema(spark, r.file), []).append(r.file)
    if not heads:
        raise ValueError(f"no datasets in {path}")
    rows = lines.where("line <> '' and not startswith(line, '@') and not startswith(line, '%')")
    tables = [rows.where(F.col("file").isin(files)).select(F.from_csv("line", schema, ARFF_OPTIONS).alias("x"), "project").select("x.*", "project") for schema, files in heads.items()]
    return union_all(tables)


def dataset_catalog(df: DataFrame, project: str) -> DataFrame:
    """(project, n_rows, n_columns) of the datasets in df; columns of nulls only don't count, and no rows are an error."""
    data = [c for c in df.columns if c != project]
    found = df.groupBy(project).agg(F.count("*").alias("n_rows"), *(F.count(F.col(f"`{c}`")).alias(f"n_{k}") for k, c in enumerate(data)))
    if not found.limit(1).count():
        raise ValueError("no rows")
    held = sum((F.col(f"n_{k}") > 0).cast("int") for k in range(len(data)))
    return found.select(project, "n_rows", held.alias("n_columns"))
