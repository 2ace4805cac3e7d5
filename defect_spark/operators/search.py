"""Tables of candidate configurations and what is chosen from them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from defect_spark.operators import knn, ranges, splits
from defect_spark.operators.metrics import ratio
from defect_spark.operators.resample import uniform


def grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """Every combination of the values, one column for each parameter."""
    out = spark.range(1).select()
    for name, some in values.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, some))).alias(name))
    return out


def unbeaten(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which points no row of others beats: at least equal in every column and better in one."""
    out = np.ones(len(points), bool)
    for i, x in enumerate(points):
        out[i] = not ((others >= x).all(1) & (others > x).any(1)).any()
    return out


def front_of(points: np.ndarray) -> np.ndarray:
    """The points that no other of them beats; one is only beaten by a point of a larger sum."""
    left, out = points[np.argsort(-points.sum(1), kind="stable")], []
    while len(left):
        x = left[0]
        out.append(x)
        left = left[1:][~(left[1:] <= x).all(1) | (left[1:] == x).all(1)]
    return np.array(out).reshape(-1, points.shape[1])


def point_blocks(cells: pa.ChunkedArray | pa.Array, row: int, width: int) -> np.ndarray:
    return np.asarray(cells[row].values.flatten()).reshape(-1, width)


def pareto_front(scored: DataFrame, objectives: list[str], key: str, most_cells: int = 4096, block_rows: int = 4096) -> DataFrame:
    """Rows of scored that no other row beats: at least equal in every objective and better in one.

    Objectives are doubles without nulls. Quantiles cut them into a grid of at most ``most_cells``
    cells; a cell with another above it in every objective has no row of the front. Of the others
    each block of points keeps its own front, and meets only blocks of cells that are at least as
    high in every objective, so no task sees all that is left. Rows with equal objectives stay or
    go together; key isn't looked at.
    """
    width = len(objectives)
    points = scored.select(F.array(*(F.col(o).cast("double") for o in objectives)).alias("v")).distinct()
    each = max(2, int(most_cells ** (1 / width) + 1e-9))
    shares = [i / each for i in range(1, each)]
    cuts = points.agg(*(F.percentile_approx(F.col("v")[i], shares, 1000).alias(str(i)) for i in range(width))).first()
    if cuts[0] is None:
        return scored.limit(0)
    place = lambda i: F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts[i])))), lambda c: c <= F.col("v")[i]))
    celled = ranges.checkpointed(points.select("v", F.array(*map(place, range(width))).alias("cell")))
    counts = {tuple(r.cell): r.n for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # most_cells at most
    held = np.array(sorted(counts))
    kept = [c for c in held if not (held > c).all(1).any()]
    spark = scored.sparkSession
    parts = spark.createDataFrame([([int(x) for x in c], -(-counts[tuple(c)] // block_rows)) for c in kept], "cell array<int>, parts int")
    above = [(i, j) for i, c in enumerate(kept) for j, d in enumerate(kept) if (d >= c).all()]
    pairs = spark.createDataFrame([([int(x) for x in kept[i]], [int(x) for x in kept[j]]) for i, j in above], "cell array<int>, over array<int>")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fronts = [front_of(point_blocks(b.column("vs"), row, width)) for row in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("part"), pa.array([f.tolist() for f in fronts], pa.list_(pa.list_(pa.float64())))], ["cell", "part", "vs"])

    def beaten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in range(b.num_rows):
                mine = point_blocks(b.column("vs"), row, width)
                out += mine[~unbeaten(mine, point_blocks(b.column("os"), row, width))].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], ["v"])

    blocks = celled.join(F.broadcast(parts), "cell").groupBy("cell", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part")).agg(F.collect_list("v").alias("vs"))  # a row a cell
    blocks = ranges.checkpointed(blocks.mapInArrow(own, "cell array<int>, part long, vs array<array<double>>"))
    met = blocks.join(F.broadcast(pairs), "cell").join(blocks.select(F.col("cell").alias("over"), F.col("vs").alias("os")), "over")  # cells squared
    gone = met.select("vs", "os").mapInArrow(beaten, "v array<double>").distinct()
    front = blocks.select(F.explode("vs").alias("v")).join(gone, "v", "left_anti")
    best = front.select(*(F.col("v")[i].alias(o) for i, o in enumerate(objectives)))
    return scored.join(best, objectives, "left_semi").select(*scored.columns)


def nsga2_select(scored: DataFrame, n: int, objectives: list[str], key: str) -> DataFrame:
    """(key, layer, crowding) of the n best rows: by layer from 0, then by crowding distance, then by key.

    A layer is the front of what earlier layers leave; layers are taken off until n rows are
    found. A row's crowding distance is the sum over objectives of the gap between its neighbours
    in the layer (ordered by objective and key), as a share of the layer's range and of their
    number; the ends of a layer are infinitely far. Keys are different and not null; objectives
    are doubles without nulls.
    """
    left = ranges.checkpointed(scored.select(key, *(F.col(o).cast("double").alias(o) for o in objectives)))
    layers, held = None, 0
    while held < n and not left.isEmpty():
        front = ranges.checkpointed(pareto_front(left, objectives, key).withColumn("layer", F.lit(0 if layers is None else layers[1])))
        left = ranges.checkpointed(left.join(front.select(key), key, "left_anti"))
        held += front.count()
        layers = (front, 1) if layers is None else (layers[0].unionByName(front), layers[1] + 1)
    if layers is None:
        return scored.select(key, F.lit(0).alias("layer"), F.lit(0.0).alias("crowding")).limit(0)
    rows = layers[0]
    shares = []
    for o in objectives:
        order = ranges.ranks(rows.select("layer", key, o), ["layer"], [o, key], "at")
        ends = rows.groupBy("layer").agg(F.count("*").alias("rows_"), (F.max(o) - F.min(o)).alias("range_"))
        before = order.select("layer", (F.col("at") + 1).alias("at"), F.col(o).alias("low_"))
        after = order.select("layer", (F.col("at") - 1).alias("at"), F.col(o).alias("high_"))
        both = order.join(before, ["layer", "at"], "left").join(after, ["layer", "at"], "left").join(ends, "layer")
        end = (F.col("at") == 0) | (F.col("at") == F.col("rows_") - 1)
        gap = F.when(F.col("range_") > 0, (F.col("high_") - F.col("low_")) / (len(objectives) * F.col("range_"))).otherwise(0.0)
        shares.append(both.select(key, "layer", F.when(end, F.lit(float("inf"))).otherwise(gap).alias("share")))
    crowded = reduce(lambda a, b: a.unionByName(b), shares).groupBy(key, "layer").agg(F.sum("share").alias("crowding"))
    return crowded.orderBy("layer", F.desc("crowding"), key).limit(n)


def best_solution(scored: DataFrame, metric: str, key: str, group: str) -> DataFrame:
    """The row of each group with the highest metric, the smallest key on a tie."""
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(metric), key)
    return scored.withColumn("k_", F.row_number().over(order)).where("k_ = 1").drop("k_")


def generation_stats(scored: DataFrame, group: list[str], metric: str) -> DataFrame:
    return scored.groupBy(*group).agg(F.avg(metric).alias("avg"), F.stddev_pop(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"))


def feature_frequency(runs: DataFrame, features: str = "features") -> DataFrame:
    """(feature, n, percent) over runs."""
    total = F.broadcast(runs.agg(F.count("*").alias("runs")))
    counts = runs.select(F.explode(features).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    return counts.crossJoin(total).select("feature", "n", (100 * F.col("n") / F.col("runs")).alias("percent"))


def performance_by_value(runs: DataFrame, param: str, metrics: list[str]) -> DataFrame:
    """(value, n, then mean, std, min and max of each metric) for each value of a parameter; std is the sample's."""
    made = [e.alias(f"{m}_{n}") for m in metrics for n, e in (("mean", F.avg(m)), ("std", F.stddev_samp(m)), ("min", F.min(m)), ("max", F.max(m)))]
    return runs.groupBy(F.col(param).alias("value")).agg(F.count("*").alias("n"), *made)


def random_mask(seed: int, key: Column, features: int, prior: list[float] | None) -> Column:
    """A 0 or 1 for each feature; prior is the probability of a 1, a half unless given."""
    chance = F.array(*map(F.lit, prior or [0.5] * features))
    return F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda i: (uniform(seed, F.lit("mask"), key, i) < F.get(chance, i)).cast("int"))


def random_candidates(ids: DataFrame, key: str, features: int, seed: int = 42, most_k: int = 20, prior: list[float] | None = None) -> DataFrame:
    """(candidate, k, weights, p, mask) drawn by hashes for each value of key; prior is the probability of each feature."""
    c = F.col(key)
    made = {
        "k": F.floor(uniform(seed, F.lit("k"), c) * most_k).cast("int") + 1,
        "weights": F.when(uniform(seed, F.lit("weights"), c) < 0.5, "uniform").otherwise("distance"),
        "p": F.when(uniform(seed, F.lit("p"), c) < 0.5, 1).otherwise(2),
        "mask": random_mask(seed, c, features, prior),
    }
    return ids.select(c.alias("candidate"), *(e.alias(name) for name, e in made.items()))


# The ranges that a machine's parameters are drawn from, first and when they change.
FIRST_RANGES = {"c": (0.01, 10.0), "gamma": (0.001, 10.0), "coef0": (0.0, 10.0)}
CHANGE_RANGES = {"c": (0.001, 20.0), "gamma": (0.0001, 10.0), "coef0": (0.0, 10.0)}
DEGREES = [2, 3, 4, 5]


def random_svm_candidates(ids: DataFrame, key: str, features: int, seed: int = 42, prior: list[float] | None = None) -> DataFrame:
    """(candidate, c, gamma, kernel, degree, coef0, mask) drawn by hashes for each value of key."""
    c = F.col(key)
    real = lambda n: (F.lit(FIRST_RANGES[n][0]) + uniform(seed, F.lit(n), c) * (FIRST_RANGES[n][1] - FIRST_RANGES[n][0])).alias(n)
    pick = lambda n, some: F.get(F.array(*map(F.lit, some)), F.floor(uniform(seed, F.lit(n), c) * len(some)).cast("int")).alias(n)
    return ids.select(c.alias("candidate"), real("c"), real("gamma"), pick("kernel", KERNELS), pick("degree", DEGREES), real("coef0"), random_mask(seed, c, features, prior).alias("mask"))


# Kernels by number, and the ranges that bit strings of a candidate stand for.
KERNELS = ["linear", "poly", "rbf", "sigmoid"]


def decode_bits(bits: Column, low: float, high: float) -> Column:
    """10 to the power of the bits' number, spread evenly over low to high; bits is an array of 0 and 1."""
    number = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a * 2 + b)
    return F.pow(F.lit(10.0), low + number / (F.pow(F.lit(2.0), F.size(bits)) - 1) * (high - low))


def decode_svm(candidates: DataFrame, bits: str = "bits") -> DataFrame:
    """candidates with c (1 to 10), gamma (0.1 to 1) and kernel from 12 bits: five, five and two."""
    part = lambda at, n: F.slice(bits, at, n)
    kernel = F.get(F.array(*map(F.lit, KERNELS)), F.aggregate(part(11, 2), F.lit(0), lambda a, b: a * 2 + b))
    return candidates.select("*", decode_bits(part(1, 5), 0, 1).alias("c"), decode_bits(part(6, 5), -1, 0).alias("gamma"), kernel.alias("kernel"))


def decode_genes(candidates: DataFrame, genes: str = "genes", most_k: int = 20) -> DataFrame:
    """candidates with mask, k, weights and p from an array of doubles: a gene a feature, then three for the parameters.

    A feature is in over a half; k is the whole part of most_k times its gene, 1 at least; weights
    are by distance over a half; p is 1, 2 or 3 by thirds (.33 and .66).
    """
    n = F.size(genes)
    last = lambda i: F.get(F.col(genes), n - i)
    mask = F.transform(F.slice(F.col(genes), F.lit(1), n - 3), lambda g: (g > 0.5).cast("int"))
    k = F.greatest(F.lit(1), F.floor(last(3) * most_k)).cast("int")
    p = F.when(last(1) < 0.33, 1).when(last(1) < 0.66, 2).otherwise(3)
    return candidates.select("*", mask.alias("mask"), k.alias("k"), F.when(last(2) > 0.5, "distance").otherwise("uniform").alias("weights"), p.alias("p"))


def tournament_select(population: DataFrame, n: int, metrics: list[str], key: str = "candidate", size: int = 3, seed: int = 42, generation: int = 0) -> DataFrame:
    """(slot, key): for each of n slots the best of ``size`` drawn members by metrics in order, the smallest key on a tie.

    Members are numbered by key; the population is a table of candidates, not data.
    """
    order = Window.orderBy(key)
    numbered = population.select((F.row_number().over(order) - 1).alias("member"), key, *metrics)
    count = population.count()
    draws = population.sparkSession.range(n).select(F.col("id").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("j"))
    drawn = draws.withColumn("member", F.floor(uniform(seed, F.lit(generation), F.col("slot"), F.col("j")) * count).cast("int"))
    best = drawn.join(numbered, "member").groupBy("slot").agg(F.max_by(key, F.struct(*metrics, -F.col(key))).alias(key))
    return best


def crossover(pairs: DataFrame, a: str, b: str, kind: str, key: str, seed: int = 42, alpha: float = 0.3) -> DataFrame:
    """pairs with child_a and child_b of two arrays: two_point (a stretch changes sides), uniform (each gene by half a chance) or blend."""
    n = F.size(a)
    u = lambda *k: uniform(seed, F.lit(kind), F.col(key), *k)
    if kind == "two_point":
        one, two = F.floor(u(F.lit(1)) * n), F.floor(u(F.lit(2)) * n)
        swap = lambda i: (i >= F.least(one, two)) & (i <= F.greatest(one, two))
    elif kind == "uniform":
        swap = lambda i: u(i) < 0.5
    elif kind == "blend":
        # each gene moves to a point of the stretch between the parents, widened by alpha
        share = lambda i: (1 + 2 * alpha) * u(i) - alpha
        mixed = lambda x, y: F.transform(x, lambda v, i: (1 - share(i)) * v + share(i) * F.get(y, i))
        return pairs.select("*", mixed(F.col(a), F.col(b)).alias("child_a"), mixed(F.col(b), F.col(a)).alias("child_b"))
    else:
        raise ValueError(f"unknown kind {kind}")
    child = lambda x, y: F.transform(x, lambda v, i: F.when(swap(i), F.get(y, i)).otherwise(v))
    return pairs.select("*", child(F.col(a), F.col(b)).alias("child_a"), child(F.col(b), F.col(a)).alias("child_b"))


def mutate_mask(population: DataFrame, mask: str, key: str, rate: float = 0.05, seed: int = 42) -> DataFrame:
    """population with each bit of the mask flipped by chance ``rate``."""
    flipped = F.transform(mask, lambda v, i: F.when(uniform(seed, F.lit("flip"), F.col(key), i) < rate, 1 - v).otherwise(v))
    return population.withColumn(mask, flipped)


def mutate_parameter(population: DataFrame, column: str, values: list, key: str, rate: float = 0.3, seed: int = 42) -> DataFrame:
    """population with the parameter drawn anew from values by chance ``rate``."""
    pick = F.get(F.array(*map(F.lit, values)), F.floor(uniform(seed, F.lit(column), F.lit("value"), F.col(key)) * len(values)).cast("int"))
    return population.withColumn(column, F.when(uniform(seed, F.lit(column), F.lit("whether"), F.col(key)) < rate, pick).otherwise(F.col(column)))


def mutate_real(population: DataFrame, column: str, low: float, high: float, key: str, rate: float = 0.05, seed: int = 42) -> DataFrame:
    """population with the number drawn anew between low and high by chance ``rate``."""
    drawn = low + uniform(seed, F.lit(column), F.lit("value"), F.col(key)) * (high - low)
    return population.withColumn(column, F.when(uniform(seed, F.lit(column), F.lit("whether"), F.col(key)) < rate, drawn).otherwise(F.col(column)))


def mutate_svm(population: DataFrame, key: str = "candidate", rate: float = 0.05, seed: int = 42) -> DataFrame:
    """population of machines with each parameter drawn anew and each bit of the mask flipped by chance ``rate``."""
    for name, (low, high) in CHANGE_RANGES.items():
        population = mutate_real(population, name, low, high, key, rate, seed)
    population = mutate_parameter(population, "kernel", KERNELS, key, rate, seed)
    return mutate_mask(mutate_parameter(population, "degree", DEGREES, key, rate, seed), "mask", key, rate, seed)


def mutate_gaussian(population: DataFrame, genes: str, key: str, sigma: float = 0.2, rate: float = 0.3, seed: int = 42) -> DataFrame:
    """population with a normal step of deviation sigma added to each gene (of an array of doubles) by chance ``rate``."""
    u = lambda what, i: uniform(seed, F.lit(what), F.col(key), i)
    step = lambda i: F.sqrt(-2 * F.log(1 - u("length", i))) * F.cos(2 * math.pi * u("angle", i)) * sigma
    return population.withColumn(genes, F.transform(genes, lambda g, i: F.when(u("whether", i) < rate, g + step(i)).otherwise(g)))


GROUP = 8  # candidates that are followed in one search


def evaluate_candidates(candidates: DataFrame, data: DataFrame, most_candidates: int = 10_000) -> DataFrame:
    """(candidate, fold, tn, fp, fn, tp): each candidate (candidate, k, weights, p, mask) tested on each fold of data.

    data is (key long, label 0 or 1, vector, fold); its packed blocks meet as in knn_join, once for
    all candidates of one mask and distance, and a row's k nearest of other folds are kept. candidates is a population, not data:
    it goes to every task and has at most ``most_candidates`` rows, an error beyond. With share in
    candidates and entered in data only training rows that entered at or below share are asked. k is capped as in cross-validation. A candidate without features
    predicts 0; a row without a row of another fold isn't counted.
    """
    shared = "share" in candidates.columns and "entered" in data.columns
    named = candidates.select(F.col("candidate").cast("long").alias("candidate"), "k", "weights", "p", "mask", (F.col("share") if shared else F.lit(1.0)).cast("double").alias("share"))
    some = [r.asDict() for r in named.limit(most_candidates + 1).collect()]
    if len(some) > most_candidates:
        raise ValueError(f"more than {most_candidates} candidates")
    data = data.select("key", "label", "vector", "fold", (F.col("entered") if shared else F.lit(0.0)).cast("double").alias("entered"))
    sizes = data.groupBy("fold", "entered").agg(F.count("*").alias("n")).collect()  # folds times shares
    folds = sorted({r.fold for r in sizes})
    allowed = lambda f, share: max(1, min(knn.MOST_NEIGHBOURS, sum(r.n for r in sizes if r.fold != f and r.entered <= share) // knn.ROWS_A_NEIGHBOUR))
    most = {(f, share): allowed(f, share) for f in folds for share in {c["share"] for c in some}}

    kinds = {"label": "<i4", "fold": "<i4", "entered": "<f8"}
    able = sorted((c for c in some if any(c["mask"])), key=lambda c: (c["mask"], c["p"]))
    groups = [able[i : i + GROUP] for i in range(0, len(able), GROUP)]
    neighbours = lambda c: min(c["k"], max((most[f, c["share"]] for f in folds), default=1))

    def start(group: list[dict], q: dict):
        q = knn.Block(q, kinds)
        near = [knn.Nearest(len(q.keys), neighbours(c)) for c in group]
        return (q, group, near), sum(x.d.size for x in near)

    def visit(state, o: dict) -> None:
        q, group, near = state
        o = knn.Block(o, kinds, held=True)
        barred = lambda c: lambda i, j: (q.more["fold"][i] == o.more["fold"][j]) | (o.more["entered"][j] > c["share"])
        for (mask, p), same in groupby(zip(group, near), lambda x: (x[0]["mask"], x[0]["p"])):
            knn.meet(q, o, np.flatnonzero(mask), p, [(x, barred(c)) for c, x in same], o.more["label"])

    def done(state) -> Iterator[pa.RecordBatch]:
        q, group, near = state
        for c, x in zip(group, near):
            at = x.found()
            row = at[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), c["candidate"])), pa.array(q.keys[row]), pa.array(q.more["label"][row]), pa.array(q.more["fold"][row]), pa.array(x.keys[at]), pa.array(x.more[at].astype(np.int32)), pa.array(x.d[at])], ["candidate", "key", "label", "fold", "other", "near", "dist"])

    schema = "candidate long, key long, label int, fold int, other long, near int, dist double"
    rows = knn.packed(data, "key", "vector", max(map(neighbours, able), default=1), sum(r.n for r in sizes), kinds)
    found = data.sparkSession.createDataFrame([], schema)
    for group in groups:
        found = found.union(knn.met(rows, rows, partial(start, group), visit, done, schema))
    own = Window.partitionBy("candidate", "key")
    spec = data.sparkSession.createDataFrame([(c["candidate"], f, min(c["k"], most[f, c["share"]]), c["weights"]) for c in some for f in folds], "candidate long, fold int, k int, weights string")
    ranked = found.withColumn("rank", F.row_number().over(own.orderBy("dist", "other"))).join(F.broadcast(spec), ["candidate", "fold"])  # the population
    kept = ranked.where(F.col("rank") <= F.col("k")).withColumn("zero", F.min("dist").over(own) == 0)
    weight = F.when(F.col("weights") != "distance", F.lit(1.0)).when(F.col("zero"), (F.col("dist") == 0).cast("double")).otherwise(1 / F.nullif(F.col("dist"), F.lit(0.0)))
    side_of = lambda y: F.sum(F.when(F.col("near") == y, weight).otherwise(0.0))
    voted = kept.groupBy("candidate", "key", "label", "fold").agg((side_of(1) > side_of(0)).cast("int").alias("prediction"))
    empty = data.select("label", "fold").crossJoin(F.broadcast(candidates.where(~F.exists("mask", lambda x: x != 0)).select(F.col("candidate").cast("long").alias("candidate"))))
    both = voted.select("candidate", "fold", "label", "prediction").unionByName(empty.select("candidate", "fold", "label", F.lit(0).alias("prediction")))
    cell = lambda y, p: F.count_if((F.col("label") == y) & (F.col("prediction") == p))
    return both.groupBy("candidate", "fold").agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def knn_curve(df: DataFrame, label: str, key: str, vector: str, k: int = 5, p: float = 2.0, weights: str = "uniform", fractions: list[float] = (0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5, seed: int = 42) -> DataFrame:
    """(fraction, fold, tn, fp, fn, tp): the learning curve of a neighbour model; all fractions and folds in one search.

    Each fold is tested by nested parts of the others; k is capped by each part's rows.
    """
    sets = splits.nested_train_sets(df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")), "label", "key", list(fractions), folds, seed)
    wide = df.select(F.size(vector).alias("n")).first()
    steps = sorted(map(float, fractions))
    some = df.sparkSession.createDataFrame([(i, k, weights, p, [1] * (wide.n if wide else 0), x) for i, x in enumerate(steps)], "candidate long, k int, weights string, p double, mask array<int>, share double")
    cells = evaluate_candidates(some, ranges.checkpointed(sets))
    return cells.select(F.get(F.array(*map(F.lit, steps)), F.col("candidate").cast("int")).alias("fraction"), "fold", "tn", "fp", "fn", "tp")


def fitness(cells: DataFrame) -> DataFrame:
    """(candidate, f1, recall): means over folds of evaluated candidates; 0 where undefined."""
    recall, f1 = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return cells.groupBy("candidate").agg(F.avg(f1).alias("f1"), F.avg(recall).alias("recall"))
