"""Profiles of tables: columns, values and classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_columns(df: DataFrame) -> DataFrame:
    """(column_name, dtype, n_rows, n_nulls, n_distinct), one row per column.

    Distinct values are counted by grouping (column, value) pairs as text, so one shuffle of
    pre-aggregated pairs does for all columns.
    """
    kinds = dict(df.dtypes)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("dtype"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns)))
    values = df.select(cells.alias("x")).select("x.*").groupBy("column_name", "dtype", "v").agg(F.count("*").alias("n"))
    sums = values.groupBy("column_name", "dtype").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_nulls"), F.count("v").alias("n_distinct"))
    return sums.select("column_name", "dtype", "n_rows", "n_nulls", "n_distinct")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), nulls included."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def class_distribution(df: DataFrame, label: str, group: str) -> DataFrame:
    """(group, label, n, share) for each class of each group."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("all"))
    return counts.join(totals, group).select(group, label, "n", (F.col("n") / F.col("all")).alias("share"))


def class_ratio(df: DataFrame, label: str, group: str) -> DataFrame:
    """(group, n_classes, ratio): smallest over largest class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.count("*").alias("n_classes"), (F.min("n") / F.max("n")).alias("ratio"))


def imbalance(df: DataFrame, label: str, group: str, ratio: float = 1.5) -> DataFrame:
    """(group, imbalance, rebalance): largest over smallest class, and whether that is over ratio."""
    counts = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    found = counts.groupBy(group).agg((F.max("n") / F.min("n")).alias("imbalance"))
    return found.withColumn("rebalance", F.col("imbalance") > ratio)


def require_two_classes(df: DataFrame, label: str, project: str | None = None) -> DataFrame:
    """df, or ValueError if the label has fewer than two values; with project, the rows of projects that have two."""
    known = df.where(F.col(label).isNotNull())
    if project:
        enough = known.groupBy(project).agg(F.min(label).alias("a"), F.max(label).alias("b")).where("a <> b").select(project)
        return df.join(enough, project, "left_semi")
    if len(known.select(label).distinct().limit(2).collect()) < 2:
        raise ValueError(f"{label} has fewer than two classes")
    return df


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
