"""SimHash near-duplicate groups: fingerprints, vantage-point shards, components.

A fingerprint is made from three-word shingles. Equal fingerprints are merged before any
search, so a group of exact copies costs one point. The 64 bits are cut into bands; two
fingerprints within ``radius`` bits differ in at most ``radius // bands`` bits of one band. For
each band a vantage-point tree over a sample deals the distinct fingerprints to shards by the
band's Hamming distance to pivots; a fingerprint so close to a shard's boundary also queries
that shard, so every linked pair meets where one of the two lives. With more bands than radius no
boundary is crossed and a fingerprint costs one row a band at every size; whole fingerprints lie
near all boundaries. A shard that a hot band value makes too large is dealt on by a second tree
over all bits, where fingerprints within ``radius`` of a boundary query the leaf beyond it, and a
leaf that stays too large is cut to blocks. Inside a group the tree goes on, over the band and then
over all bits, pruned by the triangle inequality, and only a spanning forest of links leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defect_spark.llm.common import checkpointed, pairs_of

BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    docs = pairs_of(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def distances(points: np.ndarray, pivot) -> np.ndarray:
    return np.bitwise_count(points ^ pivot).astype(np.int16)


def choose_pivot(points: np.ndarray, seed: int) -> tuple[np.uint64, int, np.ndarray]:
    """Of a few points the one with the widest spread of distances, their median, the distances."""
    best = None
    for pivot in points[np.random.default_rng(seed).integers(0, len(points), 5)]:
        d = distances(points, pivot)
        spread = float(d.std())
        if best is None or spread > best[0]:
            best = (spread, pivot, int(np.median(d)), d)
    return best[1], best[2], best[3]


class VantageTree:
    """A tree of (pivot, median distance) nodes over the bits in mask; its leaves are the shards."""

    def __init__(self, sample: np.ndarray, leaves: int, mask: np.uint64):
        self.mask = mask
        self.pivot: list[int] = []
        self.median: list[int] = []
        self.child: list[tuple[int, int]] = []
        self.leaves = 0
        self.root = self._grow(sample & mask, leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        """The node's number, or -1 - shard for a leaf."""
        if leaves >= 2 and len(points) >= 2:
            pivot, median, d = choose_pivot(points, len(self.pivot))
            near = d <= median
            if near.any() and not near.all():
                at = len(self.pivot)
                self.pivot.append(int(pivot))
                self.median.append(median)
                self.child.append((0, 0))
                self.child[at] = (self._grow(points[near], leaves // 2), self._grow(points[~near], leaves - leaves // 2))
                return at
        self.leaves += 1
        return -self.leaves

    def deal(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, indices, whether at home there) for every shard that a point lives in or must query."""
        points = points & self.mask
        stack = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at, home
                continue
            d, m = distances(points[at], np.uint64(self.pivot[node])), self.median[node]
            near, far = self.child[node]
            go = d <= m + radius
            stack.append((near, at[go], home[go] & (d[go] <= m)))
            go = d > m - radius
            stack.append((far, at[go], home[go] & (d[go] > m)))


class Forest:
    """Union-find over array indices that takes whole arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while True:
            over = self.parent[up]
            if (over == up).all():
                self.parent[at] = up
                return up
            up = over

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.roots(a), self.roots(b)
            open_ = a != b
            if not open_.any():
                return
            low, high = np.minimum(a[open_], b[open_]), np.maximum(a[open_], b[open_])
            # each high root takes its smallest partner; the rest come round again
            order = np.lexsort((low, high))
            low, high = low[order], high[order]
            first = np.r_[True, high[1:] != high[:-1]]
            self.parent[high[first]] = low[first]
            a, b = high, low


def band_masks(bands: int) -> list[np.uint64]:
    """The 64 bits in ``bands`` stretches of about equal width."""
    cuts = [64 * k // bands for k in range(bands + 1)]
    return [np.uint64((1 << high) - (1 << low)) for low, high in zip(cuts, cuts[1:])]


def links_within(points: np.ndarray, home: np.ndarray, radius: int, mask: np.uint64, band_radius: int, block: int = 1 << 20) -> np.ndarray:
    """For each point the index of its group's root, over all pairs that have a point at home and are close in the band."""
    forest = Forest(len(points))
    banded, everything = points & mask, (points, radius)
    stack = [(np.flatnonzero(home), np.arange(len(points)), 0, (banded, band_radius))]
    while stack:
        inside, asking, depth, (bits, reach) = stack.pop()
        if not len(inside) or not len(asking):
            continue
        if len(inside) * len(asking) > block and len(inside) > 64 and depth < 64:
            pivot, m, d = choose_pivot(bits[inside], depth)
            near = d <= m
            if near.all() and d.any():  # the median is the largest distance
                m -= 1
                near = d <= m
            if near.any() and not near.all():
                q = distances(bits[asking], pivot)
                stack.append((inside[near], asking[q <= m + reach], depth + 1, (bits, reach)))
                stack.append((inside[~near], asking[q > m - reach], depth + 1, (bits, reach)))
                continue
            if bits is banded:
                stack.append((inside, asking, depth, everything))
                continue
        step = max(1, block // len(inside))
        own = points[inside]
        for at in range(0, len(asking), step):
            some = asking[at : at + step]
            i, j = np.nonzero(np.bitwise_count(points[some][:, None] ^ own[None, :]) <= radius)
            i, j = some[i], inside[j]
            other = i != j
            forest.join(i[other], j[other])
    return forest.roots(np.arange(len(points)))


GROUP = ("band", "shard", "leaf", "home_block", "ask_block")


def sampled(points: DataFrame, wanted: int, count: int) -> np.ndarray:
    """About ``wanted`` of the fingerprints in column fp, chosen by hash."""
    share = min(1.0, wanted / max(1, count))
    some = points.where(F.xxhash64("fp") <= F.lit(int(share * ((1 << 63) - 1)) * 2 - (1 << 63) + 1)) if share < 1 else points
    return np.array(sorted(r.fp for r in some.select("fp").collect()), np.int64).view(np.uint64)


def split_shards(dealt: DataFrame, radius: int, shard_points: int, most_points: int) -> DataFrame:
    """dealt with leaf: shards of over ``most_points`` rows are dealt on by a second tree over all bits.

    A fingerprint within ``radius`` of a leaf's boundary also queries that leaf. Each such shard
    has about two sample points a leaf on the driver, one for ``shard_points`` / 2 of its rows;
    one job takes the samples of all shards.
    """
    sizes = dealt.groupBy("band", "shard").agg(F.count("*").alias("n")).where(F.col("n") > most_points)
    leaves = F.ceil(F.col("n") / shard_points)
    # the samples of all large shards in one job: a share of each shard's rows, by hash
    chosen = dealt.join(sizes, ["band", "shard"]).where(F.xxhash64("fp") / float(1 << 63) <= 4 * leaves / F.col("n") - 1)
    held: dict[tuple[int, int, int], list[int]] = {}
    for r in chosen.select("band", "shard", leaves.alias("leaves"), "fp").collect():
        held.setdefault((r.band, r.shard, r.leaves), []).append(r.fp)
    trees = {key[:2]: VantageTree(np.array(sorted(fps), np.int64).view(np.uint64), key[2], np.uint64((1 << 64) - 1)) for key, fps in held.items()}
    if not trees:
        return dealt.select("band", "shard", F.lit(0).alias("leaf"), "fp", "home")
    shared = dealt.sparkSession.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            band, shard, fps, home = (b.column(n).to_numpy(zero_copy_only=False) for n in ("band", "shard", "fp", "home"))
            order = np.lexsort((shard, band))
            cuts = np.flatnonzero((np.diff(band[order]) != 0) | (np.diff(shard[order]) != 0)) + 1
            leaf_of, from_, own_of = [], [], []
            for rows in np.split(order, cuts):
                tree = shared.value.get((int(band[rows[0]]), int(shard[rows[0]]))) if len(rows) else None
                for leaf, at, own in tree.deal(fps[rows].view(np.uint64), radius) if tree else [(0, np.arange(len(rows)), np.ones(len(rows), bool))]:
                    leaf_of.append(np.full(len(at), leaf, np.int32))
                    from_.append(rows[at])
                    own_of.append(own & home[rows[at]])
            some = np.concatenate(from_)
            yield pa.RecordBatch.from_arrays([pa.array(band[some]), pa.array(shard[some]), pa.array(np.concatenate(leaf_of)), pa.array(fps[some]), pa.array(np.concatenate(own_of))], ["band", "shard", "leaf", "fp", "home"])

    return dealt.mapInArrow(deal, "band int, shard int, leaf int, fp long, home boolean")


def in_blocks(dealt: DataFrame, shard_points: int, most_points: int) -> DataFrame:
    """dealt with home_block and ask_block: what the trees leave too large becomes a grid of bounded groups.

    The points at home in a leaf are cut to blocks, and so are all that query it; each pair of
    blocks is a group. Copies are in proportion to the blocks.
    """
    counts = dealt.groupBy("band", "shard", "leaf").agg(F.count("*").alias("asks"), F.count_if("home").alias("homes")).where(F.col("asks") > most_points)
    blocks = [(*r[:3], -(-r.homes // shard_points) or 1, -(-r.asks // shard_points)) for r in counts.collect()]
    one = dealt.select("*", F.lit(0).alias("home_block"), F.lit(0).alias("ask_block"))
    if not blocks:
        return one
    # a row for most_points dealt rows at most
    grid = F.broadcast(dealt.sparkSession.createDataFrame(blocks, "band int, shard int, leaf int, nh int, na int"))
    joined = dealt.join(grid, ["band", "shard", "leaf"], "left")
    small = joined.where("nh is null").select("band", "shard", "leaf", "fp", "home", F.lit(0).alias("home_block"), F.lit(0).alias("ask_block"))
    part = lambda n: F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    large = joined.where("nh is not null")
    homes = large.where("home").select("band", "shard", "leaf", "fp", "home", part("nh").alias("home_block"), every("na").alias("ask_block"))
    asks = large.select("band", "shard", "leaf", "fp", F.lit(False).alias("home"), every("nh").alias("home_block"), part("na").alias("ask_block"))
    return small.unionByName(homes).unionByName(asks)


def link_edges(points: DataFrame, radius: int = 3, shard_points: int = 16384, bands: int | None = None, most_points: int | None = None) -> DataFrame:
    """(u, v), u > v: spanning forests of all links between the distinct longs in column fp.

    A tree has a shard for ``shard_points`` fingerprints and is fitted on two sample points a
    shard, or two for each value a band can have if these are fewer. Shards and leaves over
    ``most_points`` (four times shard_points) are split; see split_shards and in_blocks. bands is
    radius + 1 unless given.
    """
    spark = points.sparkSession
    count = points.count()
    masks = band_masks(bands or radius + 1)
    reach = radius // len(masks)
    shards = max(1, -(-count // shard_points))
    values = 1 << min(40, 64 // len(masks))
    held = sampled(points, 2 * min(shards, values), count) if shards > 1 else np.zeros(0, np.uint64)
    trees = spark.sparkContext.broadcast([VantageTree(held, shards, m) for m in masks])
    most_points = most_points or 4 * shard_points

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.asarray(b.column(0)).view(np.uint64)
            for band, tree in enumerate(trees.value):
                for shard, at, home in tree.deal(fps, reach):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, band, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(fps[at].view(np.int64)), pa.array(home)], ["band", "shard", "fp", "home"])

    def search(group: pa.Table) -> pa.Table:
        fps = np.array(group.column("fp")).view(np.uint64)
        order = np.argsort(fps.view(np.int64), kind="stable")
        fps = fps[order]
        root = links_within(fps, np.array(group.column("home"))[order], radius, masks[group.column("band")[0].as_py()], reach)
        at = np.flatnonzero(fps[root] != fps)
        return pa.table({"u": fps[at].view(np.int64), "v": fps[root[at]].view(np.int64)})

    dealt = checkpointed(points.select("fp").mapInArrow(deal, "band int, shard int, fp long, home boolean"))
    groups = in_blocks(split_shards(dealt, radius, shard_points, most_points), shard_points, most_points)
    return groups.groupBy(*GROUP).applyInArrow(search, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def few_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, root) of a bounded number of edges."""
    made = list(batches)
    if made:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in made]) for k in (0, 1))
        nodes, at = np.unique(np.r_[u, v], return_inverse=True)
        forest = Forest(len(nodes))
        forest.join(at[: len(u)], at[len(u) :])
        root = nodes[forest.roots(np.arange(len(nodes)))]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root != nodes]), pa.array(root[root != nodes])], ["u", "root"])


def star_roots(edges: DataFrame, few: int = 1 << 17) -> DataFrame:
    """(u, root): for each node of edges (u > v) that isn't its component's smallest, the smallest.

    Large-star and small-star steps; each round is checkpointed and hot nodes only take part
    through joins that adaptive execution can split. At most ``few`` edges are joined in one task:
    rounds would deal them over many tasks that cost far more than their rows.
    """

    def state(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r.n, r.s

    def each(e: DataFrame, pairs) -> DataFrame:
        return e.select(F.explode(pairs).alias("e")).select("e.u", "e.v")

    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    edges = checkpointed(edges)
    before = state(edges)
    if not before[0]:
        return edges.withColumnRenamed("v", "root")
    if before[0] <= few:
        return checkpointed(edges.select("u", "v").coalesce(1).mapInArrow(few_roots, "u long, root long"))
    while True:
        both = each(edges, F.array(pair("u", "v"), pair("v", "u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.when(F.col("v") != F.col("m"), F.array(pair("v", "m"), pair("u", "m"))).otherwise(F.array(pair("u", "m")))
        edges = checkpointed(each(edges.join(least, "u"), moved).distinct())
        now = state(edges)
        if now == before:
            return edges.withColumnRenamed("v", "root")
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, shard_points: int = 16384, bands: int | None = None, most_points: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    Texts are lower-cased (A-Z) and split at ASCII white space. Fingerprints that differ in at
    most ``radius`` bits are linked; component_id is the smallest doc_id reachable.
    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and
    ties are returned as often as they come in. A null doc_id never names a component unless
    nothing else is reachable. An empty table gives an empty result; other columns are ignored.
    """
    made = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    classes = checkpointed(made.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    roots = star_roots(link_edges(classes, radius, shard_points, bands, most_points)).withColumnRenamed("u", "fp")
    placed = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_fp = placed.join(named, "root").select("fp", "component_id")
    return made.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
