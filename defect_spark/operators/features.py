"""Encoding, scaling and feature scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defect_spark.operators import ranges


def ranks(values: DataFrame, column: str, rows_a_part: int = 1 << 17) -> DataFrame:
    """values (distinct, not null) with rank_, from 0, in ascending order, counted by ranges of values of equal size."""
    made = ranges.ranks(values.select(column), [], [column], "rank_", rows_a_part)
    return made.withColumn("rank_", F.col("rank_").cast("int"))


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """out: the rank of the value among the sorted distinct values, from 0; null for null."""
    book = ranks(df.select(column).where(F.col(column).isNotNull()).distinct(), column)
    coded = df.join(book.select(F.col(column).alias("value_"), F.col("rank_").alias(out)), F.col(column) == F.col("value_"), "left")
    return coded.drop("value_")


def high_cardinality(df: DataFrame, columns: list[str], most: int = 50) -> list[str]:
    row = df.agg(*(F.count_distinct(c).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] > most]


def drop_high_cardinality(df: DataFrame, columns: list[str], most: int = 50) -> DataFrame:
    return df.drop(*high_cardinality(df, columns, most))


def one_hot(df: DataFrame, column: str, most: int = 50) -> DataFrame:
    """A 0/1 column for each value but the first in order; a constant column gives none. At most ``most`` values."""
    values = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    made = [F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in values[1:]]
    return df.select(*(c for c in df.columns if c != column), *made)


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with each column's mean and population deviation (1 where that is zero)."""
    scale = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    return df.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *(scale(c).alias(f"scale_{c}") for c in columns))


def apply_scaler(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    joined = df.crossJoin(F.broadcast(fitted))  # one row
    return joined.select(*(((F.col(c) - F.col(f"mean_{c}")) / F.col(f"scale_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns))


def binned_mutual_info(df: DataFrame, features: dict[str, str], label: str) -> DataFrame:
    """(feature, mi): mutual information, in nats, of each binned feature (a SQL expression) with label."""
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.expr(e).cast("string").alias("bin")) for n, e in features.items())))
    counts = df.select(F.col(label).alias("y"), cells.alias("x")).select("y", "x.*").groupBy("feature", "bin", "y").agg(F.count("*").alias("n"))
    by_bin = counts.groupBy("feature", "bin").agg(F.sum("n").alias("nx"))
    by_y = counts.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = counts.groupBy("feature").agg(F.sum("n").alias("all"))
    joined = counts.join(by_bin, ["feature", "bin"]).join(by_y, ["feature", "y"]).join(total, "feature")
    part = F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))
    return joined.groupBy("feature").agg(F.sum(part).alias("mi"))


def digamma(n: Column) -> Column:
    """The logarithmic derivative of the gamma function at a whole number of 1 or more, to about 1e-14."""
    x = n + 10.0
    far = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    return far - F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, i: s + 1 / (n + i))


def mutual_info(df: DataFrame, features: list[str], label: str, key: str, k: int = 3, range_rows: int = 1 << 16, rows_a_part: int = 1 << 17) -> DataFrame:
    """(feature, mi): mutual information, in nats, of each numeric feature with the class, by k nearest neighbours in the class.

    A row's radius is the distance of its k-th neighbour in its class (of all others where there
    are fewer); the rows of any class nearer than that are counted, those at distance 0 if the
    radius is 0. Classes of one row are left out, as are rows with a null in the feature or the
    class; the result is not below 0. Keys are different: they order equal values.
    Sorted rows of a class are cut into ranges of ``range_rows`` with k rows of either neighbour
    range beside them, and rows in a radius are counted by ranks, so no feature is one task.
    """
    cells = F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("x")) for f in features)))
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.col(key).alias("key"), cells).where("x IS NOT NULL")
    sizes = rows.groupBy("feature", "y").agg(F.count("*").alias("class_rows")).where("class_rows > 1")
    rows = ranges.ranks(rows.join(sizes, ["feature", "y"]), ["feature", "y"], ["x", "key"], "at", rows_a_part)
    own, inner = F.floor(F.col("at") / range_rows), F.col("at") % range_rows
    told = F.array_compact(F.array(own, F.when(inner < k, own - 1), F.when(inner >= range_rows - k, own + 1)))
    beside = Window.partitionBy("feature", "y", "range").orderBy("at")
    step = lambda i: F.lag("x", i).over(beside) if i > 0 else F.lead("x", -i).over(beside)
    near = rows.withColumn("range", F.explode(told)).select("*", own.alias("own"), *(step(i).alias(f"b{i}") for i in range(1, k + 1)), *(step(-i).alias(f"a{i}") for i in range(1, k + 1))).where("range = own")
    number = F.least(F.lit(k), F.col("class_rows") - 1)
    below = lambda i: F.lit(0.0) if not i else F.col("x") - F.col(f"b{i}")
    above = lambda i: F.lit(0.0) if not i else F.col(f"a{i}") - F.col("x")
    # the nearest ``number`` rows are some before and the others after; a missing one is no choice
    choice = lambda i, j: F.when((number == i + j) & below(i).isNotNull() & above(j).isNotNull(), F.greatest(below(i), above(j)))
    radius = F.array_min(F.array_compact(F.array(*(choice(i, n - i) for n in range(1, k + 1) for i in range(n + 1)))))
    near = near.withColumn("r", radius)
    # a row at the radius is the bound itself: x less the radius may be rounded past it
    low = F.array_max(F.filter(F.array(*(f"b{i}" for i in range(1, k + 1))), lambda v: F.col("x") - v == F.col("r")))
    high = F.array_min(F.filter(F.array(*(f"a{i}" for i in range(1, k + 1))), lambda v: v - F.col("x") == F.col("r")))
    near = near.select("feature", "key", "x", "class_rows", number.alias("k"), "r", F.coalesce(low, F.col("x") - F.col("r")).alias("low"), F.coalesce(high, F.col("x") + F.col("r")).alias("high"))
    near = ranges.checkpointed(near)
    # rows below a place: its rank among values and places, less that among places
    open_ = F.col("r") > 0
    places = near.select("feature", "key", F.inline(F.array(
        F.struct(F.col("low").alias("v"), F.when(open_, 2).otherwise(0).alias("order"), F.lit(-1).alias("sign")),
        F.struct(F.col("high").alias("v"), F.when(open_, 0).otherwise(2).alias("order"), F.lit(1).alias("sign")),
    )))
    order = ["v", "order", "key", "sign"]
    among = ranges.ranks(places, ["feature"], order, "among", rows_a_part)
    every = places.unionByName(near.select("feature", "key", F.col("x").alias("v"), F.lit(1).alias("order"), F.lit(0).alias("sign")))
    every = ranges.ranks(every, ["feature"], order, "all_rank", rows_a_part)
    signed = every.where("sign <> 0").select("feature", "key", (F.col("sign") * F.col("all_rank")).alias("s")).unionByName(among.select("feature", "key", (-F.col("sign") * F.col("among")).alias("s")))
    counts = signed.groupBy("feature", "key").agg(F.sum("s").alias("m"))
    terms = near.join(counts, ["feature", "key"]).select("feature", digamma(F.col("k")).alias("k"), digamma(F.col("class_rows")).alias("c"), digamma(F.col("m")).alias("m"))
    means = terms.groupBy("feature").agg((digamma(F.count("*")) + F.avg("k") - F.avg("c") - F.avg("m")).alias("mi"))
    named = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return named.join(means, "feature", "left").select("feature", F.greatest(F.lit(0.0), F.coalesce("mi", F.lit(0.0))).alias("mi"))


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """The k features with the highest mi, ties by name."""
    return scores.orderBy(F.desc("mi"), "feature").limit(k)


def mi_ranking(scores: DataFrame, n: int = 10) -> DataFrame:
    """(feature, mi, rank) of the n features with the highest mi, ties by name."""
    return select_k_best(scores, n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mi"), "feature")))  # n rows


# What keeps the sum from being zero, and the bounds of a selection probability.
TINY, LEAST_PRIOR, MOST_PRIOR = 1e-10, 0.2, 0.8


def mi_prior(scores: DataFrame) -> DataFrame:
    """(feature, prior): the share of all mi, clipped, as a probability to select the feature."""
    total = scores.agg(F.sum("mi").alias("sum"))
    share = F.col("mi") / (F.col("sum") + TINY)
    clipped = F.greatest(F.lit(LEAST_PRIOR), F.least(F.lit(MOST_PRIOR), share))
    return scores.crossJoin(F.broadcast(total)).select("feature", clipped.alias("prior"))  # one row


def missing_features(columns: list[str], wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in columns]


def select_by_name(df: DataFrame, wanted: list[str], keep: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """df with keep and those of wanted that it has, and the names it lacks."""
    there = [c for c in wanted if c in df.columns]
    return df.select(*keep, *(F.col(f"`{c}`") for c in there)), missing_features(df.columns, wanted)


def select_by_index(df: DataFrame, mask: list[int], features: list[str], keep: list[str] = ()) -> DataFrame:
    """df with keep and the features whose mask is 1; more mask than features is ignored."""
    return df.select(*keep, *(F.col(f"`{c}`") for c, bit in zip(features, mask) if bit))
