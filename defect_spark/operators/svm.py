"""Kernel support vector machines by landmark maps; all candidates and folds are fitted in the same passes.

A row's features are its kernel values with the landmarks times the inverse square root of the
landmarks' own kernel matrix, so that the penalty on the weights is the kernel's norm (for a kernel
that is not positive, the negative part is left out). The hinge loss is rounded over a stretch of
``delta`` below 1, and that stretch is made smaller in steps. In a pass over the data every task
adds up loss, gradient and curvature of each candidate and fold; the sums of tasks are added in a
tree, a Newton step follows, and the next pass finds how far to take it. The number of passes does not depend on the number of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defect_spark.operators.ranges import checkpointed

KINDS = ("linear", "poly", "rbf", "sigmoid")
STRETCHES = (1.0, 0.3, 0.1, 0.03, 0.01)
LENGTHS = 2.0 ** -np.arange(-1, 12)  # of a Newton step, all tried in one pass
DAMPINGS = np.array([0, 1e-3, 1e-2, 1e-1, 1.0])  # steps for so much more curvature are tried with it
NO_FOLD = -1  # held out from no row


def kernel_values(x: np.ndarray, y: np.ndarray, kernel: str, gamma: float, degree: int, coef0: float) -> np.ndarray:
    dot = x @ y.T
    if kernel == "poly":
        return (gamma * dot + coef0) ** degree
    if kernel == "sigmoid":
        return np.tanh(gamma * dot + coef0)
    if kernel == "rbf":
        return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * dot, 0))
    return dot


class Candidate:
    """One configuration: which columns, which kernel, and the map from rows to features."""

    def __init__(self, name: int, points: np.ndarray, c: float = 1.0, kernel: str = "rbf", gamma: float = 0.1, degree: int = 3, coef0: float = 0.0, mask: list[int] | None = None):
        if kernel not in KINDS:
            raise ValueError(f"unknown kernel {kernel}")
        self.name, self.c = name, c
        self.options = {"kernel": kernel, "gamma": float(gamma), "degree": int(degree), "coef0": float(coef0)}
        self.on = np.arange(points.shape[1]) if mask is None else np.flatnonzero(mask)
        self.points = points[:, self.on]
        if kernel == "linear":
            self.basis = np.eye(len(self.on))
        else:
            values, vectors = np.linalg.eigh(kernel_values(self.points, self.points, **self.options))
            some = values > 1e-10 * max(values.max(initial=0), 1e-300)
            self.basis = vectors[:, some] / np.sqrt(values[some])

    def features(self, x: np.ndarray) -> np.ndarray:
        """With a last column of ones, for the intercept."""
        x = x[:, self.on]
        made = (x if self.options["kernel"] == "linear" else kernel_values(x, self.points, **self.options)) @ self.basis
        return np.column_stack([made, np.ones(len(x))])


def candidates_of(table: DataFrame, points: np.ndarray, most: int = 10_000) -> list[Candidate]:
    """The candidates of a table (candidate, c, kernel, gamma, degree, coef0, mask) that have a feature; an error beyond ``most`` rows."""
    rows = table.select(F.col("candidate").cast("long").alias("candidate"), *(c for c in ("c", "kernel", "gamma", "degree", "coef0", "mask") if c in table.columns)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} candidates")
    made = [r.asDict() for r in sorted(rows)]
    return [Candidate(r.pop("candidate"), points, **r) for r in made if r.get("mask") is None or any(r["mask"])]


def landmarks_of(data: DataFrame, number: int) -> np.ndarray:
    """The vectors of the ``number`` rows with the smallest hash of key."""
    rows = data.orderBy(F.xxhash64("key"), "key").select("vector").limit(number).collect()
    if not rows:
        raise ValueError("no rows to learn from")
    return np.array([r.vector for r in rows], float)


def columns_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, labels as -1 and 1, folds) of a batch."""
    x = np.asarray(b.column("vector").flatten()).reshape(b.num_rows, -1)
    return x, np.where(np.asarray(b.column("label")) == 1, 1.0, -1.0), np.asarray(b.column("fold"))


def added(parts: DataFrame, fan: int = 8) -> np.ndarray:
    """The sum of arrays of doubles, a row each, added in a tree of tasks; at most ``fan`` arrays reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for cell in b.column(0):
                x = np.frombuffer(cell.as_buffer())
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    n = parts.rdd.getNumPartitions()
    while n > fan:
        n = -(-n // fan)
        parts = parts.repartition(n).mapInArrow(run, "sums binary")
    rows = parts.collect()
    return sum(np.frombuffer(r.sums) for r in rows)


def fit_all(data: DataFrame, candidates: list[Candidate], folds: list[int], stretches: tuple[float, ...] = STRETCHES, passes: int = 8) -> list[np.ndarray]:
    """For each candidate an array of weights, a row for each of folds (the one held out, or NO_FOLD).

    data has key, label (0 or 1), vector and fold. Classes weigh the same in every training set.
    ``passes`` bounds the Newton steps for each stretch, two passes each: one for the step, one for
    its length. A fit that is done earlier waits for the others.
    """
    counts = {(r.fold, r.label): r.n for r in data.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}  # folds times two
    sizes = np.array([[sum(n for (f, y), n in counts.items() if y == label and f != fold) for label in (0, 1)] for fold in folds], float)
    rows = sizes.sum(1)
    class_weight = rows[:, None] / (2 * np.maximum(sizes, 1))
    penalty = [1 / (c.c * rows) for c in candidates]
    width = [c.basis.shape[1] + 1 for c in candidates]
    shape = [(len(folds), w) for w in width]
    held_out = np.array(folds)
    spark = data.sparkSession
    common = spark.sparkContext.broadcast((candidates, held_out, class_weight, rows))  # the population

    def sums(weights: list[np.ndarray], delta: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(loss, gradient, curvature) of each candidate, each for all folds."""
        now = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some, held_out, class_weight, rows = common.value
            total = [[np.zeros(len(held_out)), np.zeros(w.shape), np.zeros((*w.shape, w.shape[1]))] for w in now.value]
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, fold = columns_of(b)
                share = class_weight[:, (y > 0).astype(int)].T * (fold[:, None] != held_out) / rows
                for c, w, (loss, slope, curve) in zip(some, now.value, total):
                    phi = c.features(x)
                    short = 1 - y[:, None] * (phi @ w.T)
                    part = np.clip(short / delta, 0, 1)
                    loss += (share * np.where(short > delta, short - delta / 2, part * part * delta / 2)).sum(0)
                    slope += (-share * y[:, None] * part).T @ phi
                    inside = (short > 0) & (short <= delta)
                    for f in range(len(held_out)):
                        at = np.flatnonzero(inside[:, f] & (share[:, f] > 0))
                        curve[f] += (phi[at] * (share[at, f] / delta)[:, None]).T @ phi[at]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([v.ravel() for t in total for v in t]).tobytes()], pa.binary())], ["sums"])

        flat, at, out = added(data.mapInArrow(run, "sums binary")), 0, []
        for f, w in shape:
            loss, slope, curve = flat[at : at + f].copy(), flat[at + f : at + f + f * w].reshape(f, w).copy(), flat[at + f + f * w : at + f + f * w + f * w * w].reshape(f, w, w).copy()
            out.append((loss, slope, curve))
            at += f + f * w + f * w * w
        now.unpersist()
        return out

    def losses(weights: list[np.ndarray], steps: list[np.ndarray], delta: float) -> list[np.ndarray]:
        """The loss of each candidate for all folds at each of LENGTHS along each of its steps."""
        now = spark.sparkContext.broadcast((weights, steps))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some, held_out, class_weight, rows = common.value
            total = np.zeros((len(some), len(held_out), len(DAMPINGS), len(LENGTHS)))
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, fold = columns_of(b)
                share = class_weight[:, (y > 0).astype(int)].T * (fold[:, None] != held_out) / rows
                for k, (c, w, d) in enumerate(zip(some, *now.value)):
                    phi = c.features(x)
                    short = 1 - y[:, None] * (phi @ w.T)
                    for i in range(len(DAMPINGS)):
                        change = y[:, None] * (phi @ d[:, i].T)
                        for j, t in enumerate(LENGTHS):
                            left = short - t * change
                            part = np.clip(left / delta, 0, 1)
                            total[k, :, i, j] += (share * np.where(left > delta, left - delta / 2, part * part * delta / 2)).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        flat = added(data.mapInArrow(run, "sums binary")).reshape(len(shape), len(folds), len(DAMPINGS), len(LENGTHS))
        now.unpersist()
        return list(flat)

    weights = [np.zeros(s) for s in shape]
    scale = [None] * len(shape)  # mean curvature with every row inside the stretch
    every = np.arange(len(folds))
    for delta in stretches:
        done = [np.zeros(len(folds), bool) for _ in shape]
        for _ in range(passes):
            steps, before = [], []
            for k, (loss, slope, curve) in enumerate(sums(weights, delta)):
                plain = np.r_[np.ones(width[k] - 1), 0]  # the intercept isn't penalised
                before.append(loss + penalty[k] / 2 * (weights[k] ** 2 @ plain))
                slope = slope + penalty[k][:, None] * weights[k] * plain
                if scale[k] is None:
                    scale[k] = np.trace(curve, axis1=1, axis2=2) / width[k]
                more = 1e-9 + DAMPINGS * scale[k][:, None]
                bent = (curve + penalty[k][:, None, None] * np.diag(plain))[:, None] + more[:, :, None, None] * np.eye(width[k])
                step = -np.linalg.solve(bent, np.repeat(slope[:, None, :, None], len(DAMPINGS), 1))[..., 0]
                done[k] |= -(slope * step[:, 0]).sum(1) < 1e-9
                step[done[k]] = 0
                steps.append(step)
            if all(d.all() for d in done):
                break
            for k, loss in enumerate(losses(weights, steps, delta)):
                plain = np.r_[np.ones(width[k] - 1), 0]
                at = weights[k][:, None, None, :] + LENGTHS[:, None] * steps[k][:, :, None, :]
                loss = (loss + penalty[k][:, None, None] / 2 * (at**2 @ plain)).reshape(len(folds), -1)
                best = loss.argmin(1)
                better = loss[every, best] < before[k] - 1e-12
                done[k] |= ~better
                weights[k] = np.where(better[:, None] & ~done[k][:, None], at.reshape(len(folds), -1, width[k])[every, best], weights[k])
    common.unpersist()
    return weights


def machine(candidate: Candidate, weights: np.ndarray) -> tuple[list[list[float]], list[float], float]:
    """(points, coefficients, intercept): margins are sums of coefficients times kernel values with points.

    A linear machine has no points and a coefficient a column.
    """
    points = [] if candidate.options["kernel"] == "linear" else candidate.points.tolist()
    return points, (candidate.basis @ weights[:-1]).tolist(), float(weights[-1])


def evaluate_svm_candidates(candidates: DataFrame, data: DataFrame, landmarks: int = 50, **options) -> DataFrame:
    """(candidate, fold, tn, fp, fn, tp): each candidate fitted without each fold of data and tested on it.

    candidates has candidate, c, kernel, gamma, degree, coef0 and mask (an array of 0 and 1), those
    missing by default; one without a feature has no row. data has key long, label 0 or 1, vector
    and fold. Landmarks are the same rows for all candidates and folds; only their vectors are used.
    """
    data = checkpointed(data.select("key", F.col("label").cast("int").alias("label"), F.col("vector").cast("array<double>").alias("vector"), F.col("fold").cast("int").alias("fold")))
    some = candidates_of(candidates, landmarks_of(data, landmarks))
    folds = sorted(r.fold for r in data.select("fold").distinct().collect())
    fitted = fit_all(data, some, folds, **options) if some else []
    shared = data.sparkSession.sparkContext.broadcast((some, fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(some), len(folds), 2, 2), np.int64)
        for b in batches:
            if b.num_rows:
                x, y, fold = columns_of(b)
                at = np.searchsorted(folds, fold)
                for k, (c, w) in enumerate(zip(*shared.value)):
                    positive = (c.features(x) * w[at]).sum(1) > 0
                    np.add.at(counts[k], (at, (y > 0).astype(int), positive.astype(int)), 1)
        k, f, label, prediction = np.nonzero(counts)
        names = np.array([c.name for c in some], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names[k]), pa.array(np.array(folds, np.int32)[f]), pa.array(label), pa.array(prediction), pa.array(counts[k, f, label, prediction])], ["candidate", "fold", "label", "prediction", "n"])

    cells = data.mapInArrow(run, "candidate long, fold int, label long, prediction long, n long")
    cell = lambda y, p: F.coalesce(F.sum(F.when((F.col("label") == y) & (F.col("prediction") == p), F.col("n"))), F.lit(0))
    return cells.groupBy("candidate", "fold").agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def weighted_fitness(cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """(candidate, f1, precision, recall): means over folds of scores weighted by the classes' rows; -1 without a feature."""

    def scores(tp: str, fp: str, fn: str):
        """Precision, recall and F1 of a class, each times its rows; 0 where undefined."""
        safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
        rows = F.col(tp) + F.col(fn)
        return [rows * x for x in (safe(F.col(tp), F.col(tp) + F.col(fp)), safe(F.col(tp), rows), safe(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn)))]

    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    one, zero = scores("tp", "fp", "fn"), scores("tn", "fn", "fp")
    means = cells.select("candidate", *(((a + b) / total).alias(n) for a, b, n in zip(one, zero, ("precision", "recall", "f1")))).groupBy("candidate").agg(*(F.avg(n).alias(n) for n in ("f1", "precision", "recall")))
    named = candidates.select(F.col("candidate").cast("long").alias("candidate"))
    return named.join(means, "candidate", "left").select("candidate", *(F.coalesce(n, F.lit(-1.0)).alias(n) for n in ("f1", "precision", "recall")))
