"""Report tables over the results of many runs.

A runs table has a row for each run: its number, scores, parameters and an array of selected
features. All of these are aggregations or projections; only result tables of fixed size (one
row, or one for each parameter) are joined by broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_run(runs: DataFrame, metric: str, key: str = "run") -> DataFrame:
    """The one row with the highest metric (null last), the smallest key on a tie."""
    return runs.orderBy(F.desc_nulls_last(metric), key).limit(1)


def feature_status(runs: DataFrame, features: list[str], metric: str, column: str = "features", key: str = "run") -> DataFrame:
    """(feature, n, percent, in_best) for each of features, never selected ones with zeros."""
    chosen = runs.select(F.explode(column).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    total = runs.agg(F.count("*").alias("runs"))
    best = best_run(runs, metric, key).select(F.col(column).alias("best"))
    named = runs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, features))).alias("feature"))
    joined = named.join(chosen, "feature", "left").crossJoin(F.broadcast(total)).join(F.broadcast(best), how="left")  # one row each
    n = F.coalesce("n", F.lit(0))
    return joined.select("feature", n.alias("n"), F.coalesce(F.try_divide(100.0 * n, F.col("runs")), F.lit(0.0)).alias("percent"), F.coalesce(F.array_contains("best", F.col("feature")), F.lit(False)).alias("in_best"))


def features_by_run(runs: DataFrame, scores: list[str], column: str = "features", key: str = "run") -> DataFrame:
    """A row for each run and selected feature, with the run's scores."""
    return runs.select(key, F.explode(column).alias("feature"), *scores)


def value_distribution(runs: DataFrame, params: list[str]) -> DataFrame:
    """(parameter, value, n, percent): how often each value of each parameter occurs, nulls included."""
    cells = F.explode(F.array(*(F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value")) for p in params)))
    counts = runs.select(cells.alias("x")).select("x.*").groupBy("parameter", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("parameter").agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(totals), "parameter").select("parameter", "value", "n", (100 * F.col("n") / F.col("all")).alias("percent"))  # a row for each parameter


def overall_summary(runs: DataFrame, metrics: list[str], params: list[str], n_features: int, column: str = "features") -> DataFrame:
    """(name, value): mean, sample deviation and maximum of each metric, features and reduction, the mode of each numeric parameter."""
    size = F.size(column)
    made = [x for m in metrics for x in (F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"std_{m}"), F.max(m).alias(f"best_{m}"))]
    made += [F.avg(size).alias("mean_features"), (100 * (1 - F.avg(size) / n_features)).alias("reduction_percent"), F.count("*").cast("double").alias("runs")]
    made += [F.mode(p, True).cast("double").alias(f"mode_{p}") for p in params]
    one = runs.agg(*made)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in one.columns))).alias("x")).select("x.*")


def decoded_stats(runs: DataFrame, groups: list[str], k: str = "k", weights: str = "weights", column: str = "features") -> DataFrame:
    """For each group the mode, mean and range of k and of the feature count, and the commonest weights; the smallest on ties."""
    size = F.size(column)
    return runs.groupBy(*groups).agg(
        F.mode(k, True).alias("k_mode"), F.avg(k).alias("k_mean"), F.min(k).alias("k_min"), F.max(k).alias("k_max"), F.mode(weights, True).alias("weights_mode"),
        F.mode(size, True).alias("features_mode"), F.avg(size).alias("features_mean"), F.min(size).alias("features_min"), F.max(size).alias("features_max"),
    )


def aggregate_results(results: DataFrame, keys: dict[str, list[str]], metrics: list[str]) -> DataFrame:
    """For every combination of the given key values: runs, and of each metric mean, population deviation and 'mean±deviation'; zeros without runs."""
    grid = reduce(lambda df, name: df.select("*", F.explode(F.array(*map(F.lit, keys[name]))).alias(name)), keys, results.sparkSession.range(1).select())
    found = results.groupBy(*keys).agg(F.count("*").alias("runs"), *(x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))))
    joined = grid.join(found, list(keys), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    made = [x for m in metrics for x in (zero(f"{m}_mean").alias(f"{m}_mean"), zero(f"{m}_std").alias(f"{m}_std"), F.format_string("%.4f±%.4f", zero(f"{m}_mean"), zero(f"{m}_std")).alias(f"{m}_text"))]
    return joined.select(*keys, F.coalesce("runs", F.lit(0)).alias("runs"), *made)


def workflow_matrix(results: DataFrame, row: str, column: str, values: list[str], metric: str) -> DataFrame:
    """Mean of a metric: a row for each value of row and one 'all', a column for each of values and 'all_runs'."""
    cells = [F.avg(F.when(F.col(column) == v, F.col(metric))).alias(v) for v in values]
    made = results.rollup(row).agg(F.grouping(row).alias("g"), *cells, F.avg(metric).alias("all_runs"))
    return made.select(F.when(F.col("g") == 1, "all").otherwise(F.col(row)).alias(row), *values, "all_runs")


def top_combinations(table: DataFrame, metric: str, keys: list[str], n: int = 10) -> DataFrame:
    """The n rows with the highest metric, ties by the keys."""
    return table.orderBy(F.desc_nulls_last(metric), *keys).limit(n)


def ensemble_members(runs: DataFrame, n: int = 3, metric: str = "f1", key: str = "run", column: str = "features") -> DataFrame:
    """(run, metric, features) of the n best runs, for models.soft_vote."""
    return top_combinations(runs, metric, [key], n).select(key, metric, column)
