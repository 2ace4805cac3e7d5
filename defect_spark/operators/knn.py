"""Exact nearest neighbours of a query set, by blocks that pivots allow, and votes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defect_spark.operators import ranges

BLOCK = 2048
PACK = 4096  # rows of a packed block
CHUNK = 256  # queries that are compared with a block at a time


def packed(df: DataFrame, key: str, vector: str, k: int, rows: int, more: dict[str, str] | None = None) -> DataFrame:
    """Blocks of at most PACK of the rows of df, written once: (id, n, kind, keys, vectors, held and more), each column the bytes of an array.

    more has other numeric columns and numpy's kinds for them. Vectors are four-byte numbers
    where that loses nothing. held marks the rows that can be neighbours: of equal vectors with
    equal other columns the k + 1 smallest keys of a block.
    """
    more = more or {}
    names = ["n", "kind", "keys", "vectors", "held", *more]

    def block(rows: pa.Table) -> pa.RecordBatch:
        columns = [c.combine_chunks() for c in rows.columns]
        keys = np.asarray(columns[0])
        x = np.asarray(columns[1].flatten(), float).reshape(len(keys), -1)
        others = [np.asarray(c).astype(kind) for c, kind in zip(columns[2:], more.values())]
        same = np.ascontiguousarray(np.column_stack([x, *others, np.zeros(len(keys))])) + 0.0
        _, name, times = np.unique(same.view(f"V{8 * same.shape[1]}").ravel(), return_inverse=True, return_counts=True)
        held = np.ones(len(keys), bool)
        if times.max() > k + 1:
            order = np.lexsort((keys, name))
            held[order[np.arange(len(keys)) - np.searchsorted(name[order], name[order]) > k]] = False
        small = x.astype(np.float32)
        x = small if (small == x).all() else x
        return pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int32()), pa.array([x.dtype.str]), *(pa.array([c.tobytes()], pa.binary()) for c in (keys, x, held, *others))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, rows = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                left.append(b.slice(at, PACK - rows))
                at, rows = at + left[-1].num_rows, rows + left[-1].num_rows
                if rows == PACK:
                    yield block(pa.Table.from_batches(left))
                    left, rows = [], 0
        if rows:
            yield block(pa.Table.from_batches(left))

    some = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"), *more).coalesce(max(1, -(-rows // PACK)))
    made = some.mapInArrow(run, ", ".join(["n int, kind string", *(f"{c} binary" for c in names[2:])]))
    return ranges.checkpointed(made.withColumn("id", F.monotonically_increasing_id()))


class Block:
    """The arrays of a packed block; only its held rows where they are to be neighbours."""

    def __init__(self, cell: dict, more: dict[str, str] | None = None, held: bool = False):
        n = cell["n"]
        on = np.frombuffer(cell["held"], bool) if held else np.ones(n, bool)
        self.keys = np.frombuffer(cell["keys"], np.int64)[on]
        self.x = np.frombuffer(cell["vectors"], cell["kind"]).reshape(n, -1).astype(float)[on]
        self.more = {c: np.frombuffer(cell[c], kind)[on] for c, kind in (more or {}).items()}


class Nearest:
    """The k nearest rows found so far of each row of a block: distances, keys, and one number more of each, in order."""

    def __init__(self, n: int, k: int):
        self.d = np.full((n, k), np.inf)
        self.keys = np.zeros((n, k), np.int64)
        self.more = np.zeros((n, k), np.int64)

    def add(self, q: np.ndarray, d: np.ndarray, keys: np.ndarray, more: np.ndarray) -> None:
        """Hits of the rows q. The nearest stay, ties by key."""
        rows, k = np.unique(q), self.d.shape[1]
        old = np.isfinite(self.d[rows])
        q = np.r_[np.repeat(rows, k)[old.ravel()], q]
        d, keys, more = (np.r_[a[rows][old], b] for a, b in ((self.d, d), (self.keys, keys), (self.more, more)))
        order = np.lexsort((keys, d, q))
        q, d, keys, more = q[order], d[order], keys[order], more[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        on = place < k
        at = q[on], place[on]
        self.d[rows] = np.inf
        self.d[at], self.keys[at], self.more[at] = d[on], keys[on], more[on]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of what was found."""
        return np.nonzero(np.isfinite(self.d))


def exact(x: np.ndarray, y: np.ndarray, q: np.ndarray, o: np.ndarray, p: float) -> np.ndarray:
    """The distances of the pairs (q, o) of rows of x and y."""
    cut = max(1, (1 << 22) // max(1, x.shape[1]))
    return np.concatenate([distances(x[q[i : i + cut]], y[o[i : i + cut]], p) for i in range(0, len(q), cut)] or [np.zeros(0)])


def meet(q: Block, o: Block, columns: np.ndarray | None, p: float, asked: list[tuple[Nearest, Callable]], more: np.ndarray) -> None:
    """Adds to each (nearest, barred) of asked what block o has; barred(i, j) tells which rows of q and o may not meet.

    Euclidean distances of a chunk of queries are a product of matrices in four-byte numbers, with
    a bound on its rounding; only pairs that may be within a row's k-th distance are computed
    again as distances() has them. So results are exact. Columns are those of a mask, or None.
    """
    x, y = (q.x, o.x) if columns is None else (q.x[:, columns], o.x[:, columns])
    if not len(y):
        return
    fast = p == 2
    if fast:
        centre = y.mean(0)
        u, v = x - centre, y - centre
        scale = max(np.abs(u).max(initial=0), np.abs(v).max(initial=0)) or 1.0
        fast = 1e-140 < scale < 1e150  # beyond, squares are no numbers that can be compared
    if fast:
        u, v, wide = u / scale, v / scale, u.shape[1]
        norms, most = (u * u).sum(1), np.sqrt((v * v).sum(1).max())
        slack = 2 * (wide + 16) * 2.0**-24 * (np.sqrt(norms) + most) ** 2 + 1e-37
        left = np.column_stack([-2 * u, np.ones(len(u))]).astype(np.float32)
        right = np.ascontiguousarray(np.column_stack([v, (v * v).sum(1)]).astype(np.float32).T)
    for at in range(0, len(x), CHUNK):
        rows = np.arange(at, min(at + CHUNK, len(x)))
        if fast:
            near = left[rows] @ right
        else:
            near = np.array([distances(y, x[i], p) for i in rows])
        for nearest, barred in asked:
            k = nearest.d.shape[1]
            limits = nearest.d[rows, k - 1]
            with np.errstate(invalid="ignore", over="ignore"):
                bound = (limits / scale) ** 2 - norms[rows] + slack[rows] if fast else limits
            new = np.flatnonzero(np.isinf(limits))
            hit = near <= bound.astype(near.dtype)[:, None]
            if len(new):
                able = near[new].copy()
                able[barred(rows[new][:, None], np.arange(len(y))[None])] = np.inf
                if k < len(y):
                    bound = np.partition(able, k - 1, axis=1)[:, k - 1] + (2 * slack[rows[new]].astype(np.float32) if fast else 0)
                    hit[new] = (able <= bound[:, None]) & (able < np.inf)
                else:
                    hit[new] = able < np.inf
            i, j = np.divmod(np.flatnonzero(hit), len(y))
            i = rows[i]
            if len(i):
                on = ~barred(i, j)
                i, j = i[on], j[on]
            if len(i):
                d = exact(x, y, i, j, p) if fast else near[i - at, j]
                on = np.isfinite(d) & (d <= nearest.d[i, k - 1])
                if on.any():
                    nearest.add(i[on], d[on], o.keys[j[on]], more[j[on]])


LIVE = 1 << 20  # places of neighbours that a task holds at a time
MOST_TASKS, HELD_BLOCKS = 1000, 8


def dealt(blocks: DataFrame, parts: int) -> DataFrame:
    """Packed blocks dealt evenly over parts, written once."""
    return ranges.checkpointed(blocks.repartitionByRange(parts, "id"))


def met(queries: DataFrame, base: DataFrame, start: Callable, visit: Callable, done: Callable, schema: str) -> DataFrame:
    """The rows that done gives, written once, after each packed block of queries met every packed block of base.

    start(q) makes a state and tells its number of places, visit(state, o) changes it and
    done(state) gives rows. A task has about one block of queries and reads base part by part, so
    no pair of blocks is shuffled. Beyond LIVE places, or where files lie on certain hosts and
    tasks are made by host, a block is given away early: a query may have more results than one.
    """
    parts = max(1, min(queries.count(), MOST_TASKS))
    queries = dealt(queries, parts)
    held = base.count()
    if held > HELD_BLOCKS * base.rdd.getNumPartitions():
        base = dealt(base, -(-held // HELD_BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = {}
        for b in batches:
            for row in range(b.num_rows):
                name = b.column("id")[row].as_py()
                if name not in states:
                    while states and sum(n for _, n in states.values()) > LIVE:
                        yield from done(states.pop(next(iter(states)))[0])
                    states[name] = start(b.column("q")[row].as_py())
                visit(states[name][0], b.column("o")[row].as_py())
        for state, _ in states.values():
            yield from done(state)

    whole = lambda df: F.struct(*df.columns)
    pairs = queries.select("id", whole(queries).alias("q")).crossJoin(base.select(whole(base).alias("o")).hint("shuffle_replicate_nl"))
    return ranges.checkpointed(pairs.coalesce(parts).mapInArrow(run, schema))


def all_pairs(queries: DataFrame, base: DataFrame, k: int, p: float) -> DataFrame:
    """(query_id, base_id, dist), written once: the k nearest others of base of each query; both are packed, and may be one."""

    def start(q: dict):
        q = Block(q)
        return (q, Nearest(len(q.keys), k)), len(q.keys) * k

    def visit(state, o: dict) -> None:
        q, nearest = state
        o = Block(o, held=True)
        meet(q, o, None, p, [(nearest, lambda i, j: q.keys[i] == o.keys[j])], np.zeros(len(o.keys), np.int64))

    def done(state) -> Iterator[pa.RecordBatch]:
        q, nearest = state
        at = nearest.found()
        yield pa.RecordBatch.from_arrays([pa.array(q.keys[at[0]]), pa.array(nearest.keys[at]), pa.array(nearest.d[at])], ["query_id", "base_id", "dist"])

    return met(queries, base, start, visit, done, "query_id long, base_id long, dist double")


def distances(y: np.ndarray, x: np.ndarray, p: float) -> np.ndarray:
    """The Minkowski distances of the rows of y from the point x."""
    diff = np.abs(y - x)
    return np.sqrt((diff * diff).sum(1)) if p == 2 else diff.sum(1) if p == 1 else (diff**p).sum(1) ** (1 / p)


def nearest(d: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least finite distances, ties by key."""
    if len(d) > k:
        # all at the k-th distance, so that ties go by key
        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        near = some[np.lexsort((keys[some], d[some]))[:k]]
    else:
        near = np.lexsort((keys, d))
    return near[np.isfinite(d[near])]


def searched(pairs: DataFrame, k: int, p: float) -> DataFrame:
    """(query_id, base_id, dist) of packs of queries q and blocks of rows o: the k nearest of each block within a query's limit."""

    def side(cell) -> tuple[np.ndarray, np.ndarray]:
        keys = np.asarray(cell.values.field("key"))
        return keys, np.asarray(cell.values.field("vector").flatten()).reshape(len(keys), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                q, x = side(b.column("q")[row])
                o, y = side(b.column("o")[row])
                limits = np.asarray(b.column("q")[row].values.field("limit"))
                out = []
                for at in range(len(q)):
                    d = distances(y, x[at], p)
                    d[(o == q[at]) | (d > limits[at])] = np.inf
                    near = nearest(d, o, k)
                    out.append((np.full(len(near), q[at]), o[near], d[near]))
                a, c, d = (np.concatenate(v) for v in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(d)], ["query_id", "base_id", "dist"])

    return pairs.select("q", "o").mapInArrow(run, "query_id long, base_id long, dist double")


def merged(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("dist", "base_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


SLACK = 1 + 1e-9  # rounding of distances must not cut a tie off


#: Queries and rows of the trial that tells whether pivots bar anything, and how many times the rows of both sides may be sent to rings.
TRIED, TRIAL_ROWS, MOST_SENT = 64, 1024, 4


def reach_share(queries: DataFrame, base: DataFrame, pivots: np.ndarray, some: list, k: int, p: float) -> float:
    """The share of the rows of base that lie in rings within the k-th distance of a query, by TRIED queries and the rows in some."""
    asked = queries.orderBy(F.xxhash64("key"), "key").limit(TRIED).collect()
    if not asked:
        return 0.0
    x, ids = np.array([r.vector for r in asked], float).reshape(len(asked), -1), np.array([r.key for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(len(ids), k)
        for b in batches:
            keys = np.asarray(b.column("key"))
            y = np.asarray(b.column("vector").flatten()).reshape(len(keys), -1)
            for i in range(len(ids)):
                d = distances(y, x[i], p)
                d[keys == ids[i]] = np.inf
                near = nearest(d, keys, k)
                best.add(np.full(len(near), i), d[near], keys[near], np.zeros(len(near), np.int64))
        at = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(best.d[at])], ["i", "d"])

    found = base.mapInArrow(run, "i long, d double").groupBy("i").agg(F.slice(F.array_sort(F.collect_list("d")), 1, k).alias("d")).collect()  # k a task and query
    limit = np.full(len(ids), np.inf)
    for r in found:
        if len(r.d) >= k:
            limit[r.i] = r.d[k - 1]
    y = np.array([r.vector for r in some], float).reshape(len(some), -1)
    to = np.array([distances(pivots, v, p) for v in y]).reshape(len(y), -1)
    own = to.argmin(1)
    away = np.array([distances(pivots, v, p) for v in x]).reshape(len(x), -1)
    return float((np.abs(away[:, own] - to[np.arange(len(y)), own]) <= limit[:, None]).mean())


def pivot_search(queries: DataFrame, base: DataFrame, k: int, key: str, vector: str, p: float = 2.0, block_rows: int = BLOCK, most_pivots: int = 256) -> tuple[DataFrame, DataFrame]:
    """(neighbours, work) by blocks that the triangle inequality allows; p must be 1 or more.

    At most ``most_pivots`` rows are pivots. Each row belongs to its nearest pivot's cell, and a
    cell is cut by the distance from the pivot into blocks of ``block_rows``, so a block is a ring
    with an inner and an outer radius. The counts and radii of the cells bound a query's k-th
    distance at first; the block around the query in its own cell bounds it again; then it goes to
    every other block whose ring comes within that bound. Where a trial tells that queries would
    be sent to so many rings that it costs more than MOST_SENT times the rows of both sides, as in
    many dimensions, every packed block is compared instead. work has (query blocks shipped, pairs
    compared, all pairs).
    """
    if p < 1:
        raise ValueError("pivots need a metric: p must be 1 or more")
    pick = lambda df: df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    base, queries = pick(base), pick(queries)
    n = base.count()
    if not n:
        none = base.sparkSession.createDataFrame([], "query_id long, base_id long, dist double")
        return merged(none, k), base.sparkSession.createDataFrame([(0, 0, 0)], "shipped long, compared long, all_pairs long")
    some = base.orderBy(F.xxhash64("key"), "key").limit(max(most_pivots, TRIAL_ROWS)).collect()
    pivots = np.unique(np.array([r.vector for r in some[: max(1, min(most_pivots, -(-n // block_rows)))]], float), axis=0)
    same = queries.semanticHash() == base.semanticHash() and queries.sameSemantics(base)
    count = n if same else queries.count()
    sent = count * -(-n // block_rows) * reach_share(queries, base, pivots, some, k, p)
    if sent > MOST_SENT * (count + n):
        rows = packed(base, "key", "vector", k, n)
        found = all_pairs(rows if same else packed(queries, "key", "vector", k, count), rows, k, p)
        number = -(-n // PACK)
        return merged(found, k), base.sparkSession.createDataFrame([(count * number, count * n, count * n)], "shipped long, compared long, all_pairs long")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("vector").flatten()).reshape(b.num_rows, -1)
            d = np.array([distances(pivots, v, p) for v in x]).reshape(b.num_rows, -1)
            cell = d.argmin(1) if d.size else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("vector"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["key", "vector", "c", "far"])

    assigned = base.mapInArrow(assign, "key long, vector array<double>, c int, far double")
    rows = ranges.ranks(assigned, ["c"], ["far", "key"], "at").withColumn("block", F.floor(F.col("at") / block_rows))
    made = rows.groupBy("c", "block").agg(F.collect_list(F.struct("key", "vector")).alias("o"), F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n"))  # block_rows at most
    made = ranges.checkpointed(made)
    rings = made.select("c", "block", "low", "high", "n")
    cells = {r.c: r for r in rings.groupBy("c").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()}  # a row a pivot
    held = np.array(sorted(cells), np.int64)
    low, high, number = (np.array([cells[c][x] for c in held.tolist()], float) for x in ("low", "high", "n"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("vector").flatten()).reshape(b.num_rows, -1)
            out = []
            for i, q in enumerate(b.column("key").to_pylist()):
                d = distances(pivots[held], x[i], p)
                order = np.argsort(d + high)
                # all rows of the first cells in this order are within the last one's reach; one may be the query itself
                enough = np.searchsorted(np.cumsum(number[order]), k + 1)
                limit = float((d + high)[order[enough]]) * SLACK if enough < len(order) else np.inf
                on = np.flatnonzero((low - d <= limit) & (d - high <= limit))
                out.append((np.full(len(on), q), held[on], d[on], np.full(len(on), limit)))
            if out:
                a, c, d, limit = (np.concatenate(v) for v in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c.astype(np.int32)), pa.array(d), pa.array(limit)], ["key", "c", "d", "limit"])

    gap = F.greatest(F.lit(0.0), F.col("low") - F.col("d"), F.col("d") - F.col("high"))
    pairs = queries.mapInArrow(reach, "key long, c int, d double, limit double").join(rings, "c").withColumn("gap", gap).where("gap <= limit")
    home = F.row_number().over(Window.partitionBy("key").orderBy("gap", "d", "c", "block"))
    pairs = ranges.checkpointed(pairs.select("key", "c", "block", "limit", "gap", "n", (home == 1).alias("home")))

    def shipped(asked: DataFrame) -> DataFrame:
        sizes = asked.groupBy("c", "block").agg(F.ceil(F.count("*") / block_rows).alias("packs"))
        sent = asked.join(queries, "key").join(sizes, ["c", "block"])
        packs = sent.groupBy("c", "block", F.pmod(F.xxhash64("key"), F.col("packs")).alias("pack")).agg(F.collect_list(F.struct("key", "vector", "limit")).alias("q"))
        return searched(packs.join(made.select("c", "block", "o"), ["c", "block"]), k, p)

    first = ranges.checkpointed(shipped(pairs.where("home")))
    bounds = first.groupBy(F.col("query_id").alias("key")).agg(F.when(F.count("*") >= k, F.max("dist") * SLACK).alias("bound"))
    more = pairs.where("not home").join(bounds, "key", "left").withColumn("limit", F.least("limit", "bound")).where("gap <= limit")
    more = ranges.checkpointed(more.select("key", "c", "block", "limit", "gap", "n"))
    counted = pairs.where("home").select("n").union(more.select("n"))
    asked = queries.agg(F.count("*").alias("asked"))
    work = counted.agg(F.count("*").alias("shipped"), F.coalesce(F.sum("n"), F.lit(0)).alias("compared")).crossJoin(asked).select("shipped", "compared", (F.col("asked") * n).alias("all_pairs"))  # one row
    return merged(first.unionByName(shipped(more)), k), work


def knn_join(queries: DataFrame, base: DataFrame, k: int, key: str, vector: str, p: float = 2.0, block_rows: int = BLOCK) -> DataFrame:
    """(query_id, base_id, dist, rank): the k nearest other rows of base by the Minkowski distance, ties by base_id.

    Keys must be longs; vectors of one length, without nulls. A row isn't its own neighbour. A
    base of more than four blocks is searched by pivots; where p is below 1, which is no metric,
    every block is compared.
    """
    n = base.count()
    if p >= 1 and n > 4 * block_rows:
        return pivot_search(queries, base, k, key, vector, p, block_rows)[0]
    return merged(all_pairs(packed(queries, key, vector, k, queries.count()), packed(base, key, vector, k, n), k, p), k)


def knn_shares(neighbours: DataFrame, labels: DataFrame, key: str, label: str, weights: str = "uniform") -> DataFrame:
    """(query_id, label, w, share): each label's weight among the neighbours, and its share of all.

    weights: uniform, or distance (1 / dist; neighbours at distance 0, if any, are the only ones).
    """
    joined = neighbours.join(labels.select(F.col(key).alias("base_id"), F.col(label).alias("label")), "base_id")
    if weights == "distance":
        zero = F.min("dist").over(Window.partitionBy("query_id")) == 0
        weight = F.when(zero, (F.col("dist") == 0).cast("double")).otherwise(1 / F.nullif(F.col("dist"), F.lit(0.0)))
    else:
        weight = F.lit(1.0)
    sums = joined.withColumn("w", weight).groupBy("query_id", "label").agg(F.sum("w").alias("w"))
    return sums.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("query_id")))


def knn_vote(neighbours: DataFrame, labels: DataFrame, key: str, label: str, weights: str = "uniform") -> DataFrame:
    """(query_id, prediction, share): the label with most weight, the smallest on a tie, and its share; see knn_shares."""
    best = knn_shares(neighbours, labels, key, label, weights).groupBy("query_id").agg(F.max(F.struct("w", (-F.col("label")).alias("l"), "share")).alias("b"))
    return best.select("query_id", (-F.col("b.l")).alias("prediction"), F.col("b.share").alias("share"))


#: The most neighbours ever asked for, and the share of training rows in cross-validation.
MOST_NEIGHBOURS, ROWS_A_NEIGHBOUR = 20, 5


def knn_cap_k(k: Column, rows: Column, cross_validation: bool = True) -> Column:
    """k clamped to what the rows allow: one to a fifth of them in cross-validation, to all but one in a test."""
    most = F.floor(rows / ROWS_A_NEIGHBOUR) if cross_validation else rows - 1
    return F.greatest(F.lit(1), F.least(k, F.lit(MOST_NEIGHBOURS), most)).cast("int")
