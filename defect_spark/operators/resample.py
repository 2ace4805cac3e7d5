"""Rebalancing by neighbours: SMOTE, Tomek links, edited nearest neighbours.

Rows are (key long, label, vector array<double>); keys are not negative. Draws are hashes, so a
seed always gives the same rows, on any number of tasks. The neighbour searches are exact. In many
dimensions their work grows with the square of the rows they take (the minority for SMOTE, all
rows for the cleaning steps), but no pairs are written. Cut large tables into groups first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defect_spark.operators import knn, ranges
from defect_spark.operators.splits import ranked


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a hash of seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def smote(df: DataFrame, minority: int, k: int = 5, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """df with made rows until the minority label has ratio times the rows of the largest other label.

    A made row lies between a minority row and one of its k nearest of that label, all drawn by
    hashes; keys are -1, -2, .... Nothing is made when the minority is large enough or has fewer
    than two rows. A row with fewer than k neighbours draws among those it has.
    """
    counts = {r.label: r.n for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    few = counts.get(minority, 0)
    wanted = int(ratio * max([n for label, n in counts.items() if label != minority], default=0)) - few
    if wanted <= 0 or few < 2:
        return df
    rows = df.where(F.col("label") == minority)
    near = knn.knn_join(rows, rows, k, "key", "vector")
    base = ranked(rows, "label", "key", seed).select("rank", F.col("key").alias("base"), F.col("vector").alias("x"))
    number = F.col("id")
    draws = df.sparkSession.range(wanted).select("id", F.floor(uniform(seed, F.lit("base"), number) * few).alias("rank"), F.floor(uniform(seed, F.lit("near"), number) * min(k, few - 1) + 1).cast("int").alias("j"), uniform(seed, F.lit("gap"), number).alias("gap"))
    drawn = draws.join(base, "rank").join(near.select(F.col("query_id").alias("base"), F.col("rank").alias("j"), "base_id"), ["base", "j"])
    both = drawn.join(rows.select(F.col("key").alias("base_id"), F.col("vector").alias("y")), "base_id")
    made = F.zip_with("x", "y", lambda a, b: a + F.col("gap") * (b - a))
    new = both.select((-1 - F.col("id")).alias("key"), F.lit(minority).cast(df.schema["label"].dataType).alias("label"), made.alias("vector"))
    return df.select("key", "label", "vector").unionByName(new)


def tomek_links(df: DataFrame) -> DataFrame:
    """(a, b), a < b: rows of different labels that are each other's nearest row."""
    nearest = knn.knn_join(df, df, 1, "key", "vector").select(F.col("query_id").alias("a"), F.col("base_id").alias("b"))
    mutual = nearest.join(nearest.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).where("a < b")
    label = df.select("key", "label")
    sides = mutual.join(label.withColumnsRenamed({"key": "a", "label": "la"}), "a").join(label.withColumnsRenamed({"key": "b", "label": "lb"}), "b")
    return sides.where("la <> lb").select("a", "b")


def without_tomek_links(df: DataFrame) -> DataFrame:
    """df without both ends of every Tomek link."""
    gone = tomek_links(df).select(F.explode(F.array("a", "b")).alias("key"))
    return df.join(gone, "key", "left_anti")


def edited_nn(df: DataFrame, k: int = 3) -> DataFrame:
    """The rows whose k nearest rows all have their own label."""
    near = knn.knn_join(df, df, k, "key", "vector").select(F.col("query_id").alias("key"), "base_id")
    labels = df.select(F.col("key").alias("base_id"), F.col("label").alias("other"))
    agree = near.join(labels, "base_id").join(df.select("key", "label"), "key").groupBy("key").agg(F.bool_and(F.col("label") == F.col("other")).alias("all_"))
    return df.join(agree.where("all_").select("key"), "key", "left_semi")


def smote_tomek(df: DataFrame, minority: int, k: int = 5, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    return without_tomek_links(ranges.checkpointed(smote(df, minority, k, ratio, seed)))


def smote_enn(df: DataFrame, minority: int, k: int = 5, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    return edited_nn(ranges.checkpointed(smote(df, minority, k, ratio, seed)))
