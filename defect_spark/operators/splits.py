"""Splits and class balance, by ranks of a seeded hash of the row key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defect_spark.operators import ranges


def draw(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def ranked(df: DataFrame, label: str, key: str, seed: int, rows_a_part: int = 1 << 17) -> DataFrame:
    """df with rank, from 0, within its class in hash order of key, and class_rows, the keys of the class.

    Only keys are ranked, range by range (see ranges), and joined back; rows that repeat a key of
    a class share its rank. Null is a class and a key like any other.
    """
    keys = df.select(F.col(label).alias("c_"), F.col(key).alias("k_")).distinct().withColumn("draw_", draw("k_", seed))
    placed = ranges.ranks(keys, ["c_"], ["draw_", "k_"], "rank", rows_a_part).drop("draw_")
    counts = keys.groupBy(F.col("c_").alias("d_")).agg(F.count("*").alias("class_rows"))
    sized = placed.join(counts, F.col("c_").eqNullSafe(F.col("d_"))).drop("d_")
    return df.join(sized, F.col(label).eqNullSafe(F.col("c_")) & F.col(key).eqNullSafe(F.col("k_"))).drop("c_", "k_")


def stratified_kfold(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """df with fold: each class is dealt evenly."""
    return ranked(df, label, key, seed).withColumn("fold", (F.col("rank") % folds).cast("int")).drop("rank", "class_rows")


MOST_CLASSES = 10_000  # whose places are sent to every task; more are joined
DIGITS = 3  # hexadecimal digits of a draw that one count adds


def small(classes: DataFrame) -> DataFrame:
    """A written table with a row a class, marked to be sent to every task if these are few."""
    return F.broadcast(classes) if classes.count() <= MOST_CLASSES else classes


def last_of(df: DataFrame, label: str, key: str, share: float, seed: int, few: int = 100_000) -> DataFrame:
    """(c_, d_, last_): the draw and key of the last of the first ceil(share * rows) rows of each class in hash order, a row a class.

    Rows are counted by the first digits of their draw, then by more digits where the place lies,
    until at most ``few`` rows of a class are left to order: no table is sorted or shuffled whole.
    """
    rows = df.select(F.col(label).alias("c_"), F.col(key).alias("k_"), draw(key, seed).alias("draw_"))
    inside = rows
    for digits in range(DIGITS, 32 + DIGITS, DIGITS):
        first = digits == DIGITS
        counts = inside.groupBy("c_", F.substring("draw_", 1, digits).alias("p_")).agg(F.count("*").alias("n_"), *([] if first else [F.first("left_").alias("left_")]))
        by_class = Window.partitionBy("c_")
        if first:
            counts = counts.withColumn("left_", F.ceil(F.sum("n_").over(by_class) * share))
        before = F.coalesce(F.sum("n_").over(by_class.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("before_", before).where("before_ < left_ AND before_ + n_ >= left_")
        found = ranges.checkpointed(found.select(F.col("c_").alias("g_"), "p_", (F.col("left_") - F.col("before_")).alias("left_"), "n_"))  # a row a class
        inside = rows.join(small(found.drop("n_")), F.col("c_").eqNullSafe(F.col("g_")) & (F.substring("draw_", 1, digits) == F.col("p_"))).drop("g_", "p_")
        if (found.agg(F.max("n_").alias("n")).first().n or 0) <= few:
            break
    counts = inside.groupBy("c_", "draw_", "k_").agg(F.count("*").alias("n_"), F.first("left_").alias("left_"))
    order = Window.partitionBy("c_").orderBy("draw_", F.col("k_").asc_nulls_first())
    before = F.coalesce(F.sum("n_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = counts.withColumn("before_", before).where("before_ < left_ AND before_ + n_ >= left_")
    return ranges.checkpointed(at.select("c_", F.col("draw_").alias("d_"), F.col("k_").alias("last_")))


def train_test_split(df: DataFrame, label: str | None, key: str, test: float = 0.2, seed: int = 42, few: int = 100_000) -> DataFrame:
    """df with is_test: of each class the first ceil(test * rows) in hash order of key, or of all rows where label is None.

    Rows that repeat a key of a class go together. Null is a class and a key like any other.
    """
    if label is None:
        return train_test_split(df.withColumn("all_", F.lit(0)), "all_", key, test, seed, few).drop("all_")
    own, k = draw(key, seed), F.col(key)
    early = k.isNull() | k.eqNullSafe(F.col("last_")) | F.coalesce(k < F.col("last_"), F.lit(False))
    joined = df.join(small(last_of(df, label, key, test, seed, few)), F.col(label).eqNullSafe(F.col("c_")), "left")
    return joined.withColumn("is_test", F.coalesce((own < F.col("d_")) | ((own == F.col("d_")) & early), F.lit(False))).drop("c_", "d_", "last_")


def cross_project_pairs(df: DataFrame, project: str, train: list[str] | None = None, test: list[str] | None = None) -> DataFrame:
    """(train_project, test_project, n_train, n_test) of every two different projects, or of the named ones.

    Its rows are pairs of projects, so it is for a list of projects, not for a column of many values.
    """
    counts = df.groupBy(project).agg(F.count("*").alias("n"))
    some = lambda names: counts.where(F.col(project).isin(names)) if names else counts
    a = some(train).select(F.col(project).alias("train_project"), F.col("n").alias("n_train"))
    b = some(test).select(F.col(project).alias("test_project"), F.col("n").alias("n_test"))
    return a.join(b, F.col("train_project") != F.col("test_project")).select("train_project", "test_project", "n_train", "n_test")


def nested_train_sets(df: DataFrame, label: str, key: str, fractions: list[float], folds: int = 5, seed: int = 42) -> DataFrame:
    """df with fold and entered: the smallest of fractions whose training sets hold the row. Sets of a fold are nested."""
    placed = ranked(df, label, key, seed).withColumn("fold", (F.col("rank") % folds).cast("int"))
    share = (F.floor(F.col("rank") / folds) + 1) / F.ceil(F.col("class_rows") / folds)
    first = F.lit(None).cast("double")
    for x in sorted(fractions, reverse=True):
        first = F.when(share <= x, F.lit(float(x))).otherwise(first)
    return placed.withColumn("entered", first).drop("rank", "class_rows")


def learning_curve(df: DataFrame, label: str, key: str, score: Callable[[DataFrame, DataFrame], DataFrame], fractions: list[float] = (0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5, seed: int = 42) -> DataFrame:
    """(fraction, fold, correct, n): score(train, test) gives (key, prediction); each fold is tested by nested parts of the others.

    This is for any model, with a fit and a scan for each fraction and fold; see means_curve and
    search.knn_curve for models that need one.
    """
    sets = nested_train_sets(df, label, key, list(fractions), folds, seed)
    out = []
    for x in fractions:
        for fold in range(folds):
            test = sets.where(F.col("fold") == fold)
            found = score(sets.where((F.col("fold") != fold) & (F.col("entered") <= x)), test).select(key, "prediction")
            joined = test.select(key, label).join(found, key)
            out.append(joined.agg(F.count_if(F.col(label) == F.col("prediction")).alias("correct"), F.count("*").alias("n")).select(F.lit(float(x)).alias("fraction"), F.lit(fold).alias("fold"), "correct", "n"))
    return reduce(lambda a, b: a.unionByName(b), out)


def means_curve(df: DataFrame, label: str, key: str, vector: str, fractions: list[float] = (0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5, seed: int = 42, most_labels: int = 1000) -> DataFrame:
    """(fraction, fold, correct, n) of a nearest-mean model, the smallest label on a tie: one scan to learn, one to test.

    Sums of vectors are added by fold, step and label once. A training set's sums are those of
    all folds but one, up to its step. Labels are at most ``most_labels``, an error beyond; rows
    whose training set is empty are not counted, as are rows with a null label.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    steps = sorted(float(x) for x in fractions)
    sets = ranges.checkpointed(nested_train_sets(rows, "label", "key", steps, folds, seed))
    if sets.select("label").distinct().limit(most_labels + 1).count() > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    sums = sets.select("fold", "entered", "label", F.posexplode("v").alias("i", "x")).groupBy("fold", "entered", "label", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    part = lambda c, fold, x: F.coalesce(F.sum(F.when((F.col("fold") == fold) & (F.col("entered") <= x), F.col(c))), F.lit(0))
    names = [(fold, k, c) for fold in range(folds) for k in range(len(steps)) for c in ("s", "n")]
    wide = sums.groupBy("label", "i").agg(*(part(c, fold, steps[k]).alias(f"{c}_{fold}_{k}") for fold, k, c in names))
    rest = lambda c, fold, k: reduce(lambda a, b: a + b, (F.col(f"{c}_{f}_{k}") for f in range(folds) if f != fold), F.lit(0))
    trained = F.array(*(F.struct(F.lit(fold).alias("fold"), F.lit(k).alias("k"), rest("s", fold, k).alias("s"), rest("n", fold, k).alias("n")) for fold in range(folds) for k in range(len(steps))))
    means = wide.select("label", "i", F.inline(trained)).where("n > 0").select("fold", "k", "label", "i", (F.col("s") / F.col("n")).alias("m"))
    means = means.groupBy("fold", "k", "label").agg(F.sort_array(F.collect_list(F.struct("i", "m")))["m"].alias("m"))
    models = means.groupBy("fold").agg(F.collect_list(F.struct("k", "label", "m")).alias("models"))  # steps times labels
    square = lambda m: F.aggregate(F.zip_with("v", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    nearest = lambda k: F.array_min(F.transform(F.filter("models", lambda m: m["k"] == k), lambda m: F.struct(square(m["m"]).alias("d"), m["label"].alias("label"))))["label"]
    tested = sets.join(F.broadcast(models), "fold")  # a row a fold
    found = tested.select("fold", "label", F.inline(F.array(*(F.struct(F.lit(x).alias("fraction"), nearest(k).alias("prediction")) for k, x in enumerate(steps)))))
    return found.where("prediction IS NOT NULL").groupBy("fraction", "fold").agg(F.count_if(F.col("label") == F.col("prediction")).alias("correct"), F.count("*").alias("n"))


def random_under(df: DataFrame, label: str, key: str, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Drops rows of larger classes until the smallest has ratio times their rows."""
    least = F.broadcast(df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("least")))
    most = F.greatest(F.col("least"), F.floor(F.col("least") / F.lit(ratio)))
    return ranked(df, label, key, seed).crossJoin(least).where(F.col("rank") < most).drop("rank", "class_rows", "least")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = F.broadcast(counts.agg(F.sum("n").alias("all"), F.count("*").alias("classes")))
    return counts.crossJoin(totals).select(label, "n", (F.col("all") / (F.col("classes") * F.col("n"))).alias("weight"))
