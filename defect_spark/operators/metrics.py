"""Classification metrics of prediction tables, for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defect_spark.operators import ranges


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, group: str) -> DataFrame:
    """(group, tn, fp, fn, tp) of label and prediction, both 0 or 1."""
    cell = lambda y, p: F.count_if((F.col("label") == y) & (F.col("prediction") == p))
    return df.groupBy(group).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def confusion_cells(df: DataFrame, group: str) -> DataFrame:
    """(group, label, prediction, n): the long form, for any number of classes."""
    return df.groupBy(group, "label", "prediction").agg(F.count("*").alias("n"))


def binary_metrics(df: DataFrame, group: str) -> DataFrame:
    """Accuracy, precision, recall, f1, specificity and npv; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    made = {"accuracy": ratio(tp + tn, tn + fp + fn + tp), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "specificity": ratio(tn, tn + fp), "npv": ratio(tn, tn + fn)}
    return confusion(df, group).select(group, *(e.alias(n) for n, e in made.items()))


def class_report(df: DataFrame, group: str) -> DataFrame:
    """(group, class, precision, recall, f1, support) with rows for each class, 'accuracy' (in all three), 'macro' and 'weighted'."""
    both = df.select(group, F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("is_label"), F.lit(0).alias("is_pred"), F.lit(0).alias("hit")), F.struct(F.col("prediction").alias("c"), F.lit(0).alias("is_label"), F.lit(1).alias("is_pred"), F.coalesce((F.col("label") == F.col("prediction")).cast("int"), F.lit(0)).alias("hit")))).alias("x")).select(group, "x.*")
    sums = both.groupBy(group, F.col("c").cast("string").alias("class")).agg(F.sum("is_label").alias("support"), F.sum("is_pred").alias("predicted"), F.sum("hit").alias("hits"))
    hits, predicted, support = F.col("hits"), F.col("predicted"), F.col("support")
    each = sums.select(group, "class", ratio(hits, predicted).alias("precision"), ratio(hits, support).alias("recall"), ratio(2 * hits, predicted + support).alias("f1"), "support")
    macro = each.groupBy(group).agg(F.lit("macro").alias("class"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    weighted = each.groupBy(group).agg(F.lit("weighted").alias("class"), *(ratio(F.sum(F.col(c) * support), F.sum("support")).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    accuracy = ratio(F.sum("hits"), F.sum("support"))
    total = sums.groupBy(group).agg(F.lit("accuracy").alias("class"), *(accuracy.alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    return each.unionByName(total).unionByName(macro).unionByName(weighted)


def score_ranges(df: DataFrame, column: str, number: int = 128) -> Column:
    """The number of a value's range, from 0 for the highest; the cuts are approximate quantiles, so ranges hold about equally many rows."""
    cuts = df.agg(F.percentile_approx(column, [k / number for k in range(1, number)], 1000).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col(column))) if cuts else F.lit(0)


def score_steps(df: DataFrame, group: str) -> DataFrame:
    """(group, score, p, n, tp, fp): a row for each distinct score with its own and the cumulated counts, highest first.

    Counts are cumulated within score ranges and the sums of the ranges before are added, so a
    group with many distinct scores isn't one task. Rows without a score or a label are left out.
    """
    counts = df.where("score IS NOT NULL AND label IS NOT NULL").groupBy(group, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    counts = ranges.checkpointed(counts)
    counts = counts.withColumn("range_", score_ranges(df, "score"))
    before = Window.partitionBy(group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(group, "range_").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    offsets = sums.select(F.col(group).alias("g_"), F.col("range_").alias("r_"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_") for c in ("p", "n")))
    down = Window.partitionBy(group, "range_").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    own = counts.select("*", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"))
    joined = own.join(offsets, F.col(group).eqNullSafe(F.col("g_")) & (F.col("range_") == F.col("r_")))
    return joined.select(group, "score", "p", "n", (F.col("tp") + F.col("p_")).alias("tp"), (F.col("fp") + F.col("n_")).alias("fp"))


def ranking_metrics(df: DataFrame, group: str) -> DataFrame:
    """(group, roc_auc, average_precision), exact with ties; null for a group of one class."""
    steps = score_steps(df, group)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0))
    step = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    sums = steps.groupBy(group).agg(area.alias("area"), step.alias("steps"), F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    both = (F.col("all_p") > 0) & (F.col("all_n") > 0)
    return sums.select(group, F.when(both, F.col("area") / (F.col("all_p") * F.col("all_n"))).alias("roc_auc"), F.when(both, F.col("steps") / F.col("all_p")).alias("average_precision"))


def curve(df: DataFrame, group: str) -> DataFrame:
    """(group, score, tpr, fpr, precision) at each distinct score, and where both curves start: an infinite score that no row reaches.

    Rows without a score or a label are left out.
    """
    totals = df.where("score IS NOT NULL AND label IS NOT NULL").groupBy(F.col(group).alias("g_")).agg(F.count_if(F.col("label") == 1).alias("all_p"), F.count_if(F.col("label") == 0).alias("all_n"))
    made = score_steps(df, group).join(totals, F.col(group).eqNullSafe(F.col("g_")))
    start = totals.select(F.col("g_").alias(group), F.lit(float("inf")).alias("score"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"), F.lit(1.0).alias("precision"))
    return start.unionByName(made.select(group, F.col("score").cast("double").alias("score"), ratio(F.col("tp"), F.col("all_p")).alias("tpr"), ratio(F.col("fp"), F.col("all_n")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision")))


def cv_summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(metric, mean, std, min, max) over the rows of metrics; std is the population's."""
    long = metrics.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


# The published weights of the score.
F1_WEIGHT, OTHER_WEIGHT, RECALL_WITHOUT_AUC = 0.6, 0.1, 0.2


def composite_score(f1: Column, accuracy: Column, precision: Column, recall: Column, auc: Column) -> Column:
    """A weighted mean of scores; without an area under the curve its weight goes to recall."""
    rest = F1_WEIGHT * f1 + OTHER_WEIGHT * accuracy + OTHER_WEIGHT * precision
    return rest + F.when(auc.isNull(), RECALL_WITHOUT_AUC * recall).otherwise(OTHER_WEIGHT * recall + OTHER_WEIGHT * auc)


def per_class_accuracy(df: DataFrame, group: str) -> DataFrame:
    """(group, label, correct, n, accuracy) of each class; a null prediction is wrong."""
    correct = F.count_if(F.col("label") == F.col("prediction"))
    return df.groupBy(group, "label").agg(correct.alias("correct"), F.count("*").alias("n")).withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def error_breakdown(df: DataFrame, group: str) -> DataFrame:
    """(group, n, fp, fn, fp_share, fn_share): false positives and negatives, and their shares of all rows."""
    cells = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if((F.col("label") == 0) & (F.col("prediction") == 1)).alias("fp"), F.count_if((F.col("label") == 1) & (F.col("prediction") == 0)).alias("fn"))
    return cells.select("*", ratio(F.col("fp"), F.col("n")).alias("fp_share"), ratio(F.col("fn"), F.col("n")).alias("fn_share"))


# Lower bounds of the bands, and the bounds that advice is given by.
GOOD, FAIR = 0.8, 0.6
LOW_F1, LOW_RATE, HIGH_RATE, SOLID = 0.6, 0.7, 0.8, 0.7


def band(metric: Column) -> Column:
    return F.when(metric >= GOOD, "good").when(metric >= FAIR, "fair").when(metric.isNotNull(), "low")


def rate_metrics(metrics: DataFrame, names: list[str]) -> DataFrame:
    """metrics (with accuracy, precision, recall and f1) with a band for each of names and an array of advice."""
    accuracy, precision, recall, f1 = (F.col(c) for c in ("accuracy", "precision", "recall", "f1"))
    excellent = (accuracy > HIGH_RATE) & (f1 > HIGH_RATE) & (recall > HIGH_RATE)
    advice = F.array(
        F.when(f1 < LOW_F1, "tune or rebuild the model"),
        F.when((recall < LOW_RATE) & (precision > HIGH_RATE), "too cautious: lower the threshold"),
        F.when((precision < LOW_RATE) & (recall > HIGH_RATE), "too eager: raise the threshold"),
        F.when(excellent, "excellent").when((accuracy > SOLID) & (f1 > SOLID), "good"),
    )
    return metrics.select("*", *(band(F.col(n)).alias(f"{n}_band") for n in names), F.array_compact(advice).alias("advice"))


def compare_models(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, label, first, second, first_correct, second_correct): the predictions of two models for the rows that both have."""
    joined = a.select(key, "label", F.col("prediction").alias("first")).join(b.select(key, F.col("prediction").alias("second")), key)
    return joined.select("*", (F.col("first") == F.col("label")).alias("first_correct"), (F.col("second") == F.col("label")).alias("second_correct"))


def metric_deltas(a: DataFrame, b: DataFrame, group: str, names: list[str]) -> DataFrame:
    """(group, metric, first, second, delta) of two tables of metrics."""
    long = lambda df, side: df.select(group, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias(side)) for n in names))).alias("x")).select(group, "x.*")
    return long(a, "first").join(long(b, "second"), [group, "metric"]).withColumn("delta", F.col("second") - F.col("first"))


def cross_project_scores(df: DataFrame, model: str, project: str) -> tuple[DataFrame, DataFrame]:
    """(model, project, macro_f1, roc_auc) and, for each model, the quartiles of both over its projects."""
    both = df.withColumn("group_", F.struct(model, project))
    macro = class_report(both, "group_").where(F.col("class") == "macro").select("group_", F.col("f1").alias("macro_f1"))
    auc = ranking_metrics(both, "group_").select("group_", "roc_auc")
    each = macro.join(auc, "group_").select(f"group_.{model}", f"group_.{project}", "macro_f1", "roc_auc")
    cuts = [F.percentile(m, F.lit(q)).alias(f"{m}_{n}") for m in ("macro_f1", "roc_auc") for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return each, each.groupBy(model).agg(F.count("*").alias("projects"), *cuts)
