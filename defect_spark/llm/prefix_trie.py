"""A trie of conversation prefixes, rolled up by centroid decomposition of its parent edges.

A node is named by hashes of its turns, added up along the conversation (exclusive or of 128 bits,
each turn hashed with its depth), so prefixes meet without their texts. Members are counted first.
The tree is then dealt to tasks in connected components: a component's nodes have member counts
between two powers of ``ratio`` and depths in one band, so it has fewer than ratio * band nodes
and no one path or wide node makes it larger. In a task every component is split at its centroid
again and again; the total below a centroid is added to the nodes on its path to the component's
top. Components hang together in the same way: their totals go to the nodes they hang from, by
member counts, and over bands by the same method on the tree of components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defect_spark.llm.common import checkpointed
from defect_spark.operators.ranges import placed, ranks

CHUNK = 4096  # turns of a conversation that one window adds up
WORD = r"[^\x20\x09-\x0D]+"


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 20, most_shared: int = 3) -> tuple[DataFrame, DataFrame]:
    """(convs, rows): each conversation begins with the first h turns of the first of its family.

    convs has (conv, n, h, head, ended): its own turns, how many of them are replaced, the turns
    that replace them, and whether it has no turn at all. rows has (conv, d, t, u, words, ends):
    the rebuilt turns from depth 1, t and u the hashes of role and text.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(F.lit(1), role, text).alias("t"), F.xxhash64(F.lit(2), text, role).alias("u"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = checkpointed(rows.where("conv IS NOT NULL"))  # texts are read and hashed once
    rows = checkpointed(ranks(rows, ["conv"], ["turn", "t", "u"], "pos").drop("turn"))
    first = F.when(F.col("pos") < most_shared, F.struct("pos", "t", "u", "words"))
    groups = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(first)).alias("own_head"))  # at most most_shared turns
    bases = groups.select(F.col("conv").alias("base"), F.col("own_head").alias("base_head"))
    h = (F.crc32(F.col("conv").cast("string")) % (most_shared + 1)).cast("int")
    convs = groups.withColumn("h", h).withColumn("base", F.col("conv") - F.pmod(F.col("conv"), F.lit(family))).join(bases, "base", "left")
    none = F.col("own_head").isNull()  # an empty list of the right type
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("base_head", F.filter("own_head", lambda x: none)), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(F.filter("own_head", lambda x: none))
    convs = convs.select("conv", "n", "h", head.alias("head"))
    convs = checkpointed(convs.withColumn("ended", (F.size("head") == 0) & (F.col("n") <= F.col("h"))))
    shared = convs.select("conv", "n", "h", F.size("head").alias("b"), F.posexplode("head").alias("i", "x"))
    shared = shared.select("conv", (F.col("i") + 1).cast("long").alias("d"), "x.t", "x.u", "x.words", ((F.col("n") <= F.col("h")) & (F.col("i") + 1 == F.col("b"))).alias("ends"))
    own = rows.join(convs.select("conv", "n", "h", F.size("head").alias("b")), "conv").where(F.col("pos") >= F.col("h"))
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("b") + 1).alias("d"), "t", "u", "words", (F.col("pos") + 1 == F.col("n")).alias("ends"))
    return convs, shared.unionByName(own)


def named(rows: DataFrame) -> DataFrame:
    """rows with (x, y), the name of the prefix that ends there, and (px, py), its parent's.

    A conversation is added up in chunks of turns, so a long one isn't one task.
    """
    at = [F.xxhash64(F.lit(k), "d", "t", "u").alias(c) for k, c in ((3, "a"), (4, "b"))]
    rows = rows.select("conv", "d", "words", "ends", *at, F.floor((F.col("d") - 1) / CHUNK).alias("chunk"))
    along = Window.partitionBy("conv", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    made = rows.select("*", F.bit_xor("a").over(along).alias("x"), F.bit_xor("b").over(along).alias("y"))
    if rows.agg(F.max("chunk")).first()[0]:
        totals = rows.groupBy("conv", "chunk").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
        earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # over chunks
        before = totals.select("conv", "chunk", F.bit_xor("a").over(earlier).alias("ba"), F.bit_xor("b").over(earlier).alias("bb")).where("chunk > 0")
        made = made.join(before, ["conv", "chunk"], "left")
        whole = lambda c, e: F.col(c).bitwiseXOR(F.coalesce(e, F.lit(0)))
        made = made.withColumn("x", whole("x", "ba")).withColumn("y", whole("y", "bb"))
    return made.select("conv", "d", "words", "ends", "x", "y")


def centroid_sums(parent: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums over subtrees of a forest: parent has each node's parent, or -1; weights a row a node."""
    n = len(parent)
    depth, up = np.zeros(n, np.int64), parent.copy()
    while (some := up >= 0).any():
        depth[some] += 1
        up[some] = parent[up[some]]
    sums = np.zeros_like(weights)
    gone = np.zeros(n, bool)
    live = np.argsort(depth, kind="stable")
    while len(live):
        cuts = np.flatnonzero(np.diff(depth[live])) + 1
        levels = np.split(live, cuts)
        size, below = np.ones(n, np.int64), weights.copy()
        inner = [level[(parent[level] >= 0) & ~gone[parent[level]]] for level in levels]
        for nodes in reversed(inner):
            np.add.at(size, parent[nodes], size[nodes])
            np.add.at(below, parent[nodes], below[nodes])
        top = np.arange(n)
        for nodes in inner:
            top[nodes] = top[parent[nodes]]
        # the centroid is the deepest node that has half of its component or more below it
        half = live[2 * size[live] >= size[top[live]]]
        half = half[np.lexsort((size[half], top[half]))]
        centroid = half[np.r_[True, top[half][1:] != top[half][:-1]]]
        total, at = below[centroid], centroid
        while len(at):
            sums[at] += total  # centroids of different components never meet
            on = (parent[at] >= 0) & ~gone[parent[at]]
            at, total = parent[at[on]], total[on]
        gone[centroid] = True
        live = live[~gone[live]]
    return sums


def component_sums(nodes: DataFrame, held_rows: int = 50_000) -> DataFrame:
    """(r, d, leaves, saved) of nodes (r, d, pr, pd, tr, td, leaves, saved): sums over the subtree within the component (tr, td)."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        column = {c: rows.column(c).to_numpy() for c in ("r", "d", "pr", "pd", "tr", "td", "leaves", "saved")}
        place = {k: i for i, k in enumerate(zip(column["r"].tolist(), column["d"].tolist()))}
        parent = np.fromiter((place.get(k, -1) for k in zip(column["pr"].tolist(), column["pd"].tolist())), np.int64, len(place))
        outside = (column["tr"][parent] != column["tr"]) | (column["td"][parent] != column["td"])
        parent[outside] = -1
        sums = centroid_sums(parent, np.column_stack([column["leaves"], column["saved"]]))
        return pa.RecordBatch.from_arrays([pa.array(column["r"]), pa.array(column["d"]), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["r", "d", "leaves", "saved"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < held_rows:
                continue
            rows = pa.Table.from_batches(held)
            tr, td = rows.column("tr").to_numpy(), rows.column("td").to_numpy()
            cut = int(np.argmax((tr == tr[-1]) & (td == td[-1])))  # the last component may go on
            if cut:
                yield solve(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held and sum(x.num_rows for x in held):
            yield solve(pa.Table.from_batches(held))

    dealt = nodes.select("r", "d", "pr", "pd", "tr", "td", "leaves", "saved").repartition("tr", "td").sortWithinPartitions("tr", "td")
    return dealt.mapInArrow(run, "r long, d long, leaves long, saved long")


def with_added(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """nodes with leaves and saved of more (r, d, leaves, saved) added."""
    extra = more.groupBy("r", "d").agg(F.sum("leaves").alias("l_"), F.sum("saved").alias("s_"))
    both = nodes.join(extra, ["r", "d"], "left")
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return both.select(*(c for c in nodes.columns if c not in ("leaves", "saved")), add("leaves", "l_"), add("saved", "s_"))


def hung(tops: DataFrame) -> DataFrame:
    """Totals of components, at the nodes that they hang from."""
    return tops.where("pd >= 1").select(F.col("pr").alias("r"), F.col("pd").alias("d"), "leaves", "saved")


def subtree_sums(nodes: DataFrame, paths: DataFrame, band: int) -> DataFrame:
    """(r, d, leaves, saved): sums over the subtree of each node.

    nodes: (r, d) names a node, (pr, pd) its parent, l is its class by members and k its depth.
    paths has (conv, r, d, l, k): the nodes along each conversation. l falls and k grows along it.
    """
    along = Window.partitionBy("conv", "l", "b").orderBy("d")
    tops = paths.withColumn("b", F.floor(F.col("k") / band)).withColumn("top", F.first(F.struct("r", "d")).over(along))
    tops = tops.where("conv = r").select("r", "d", F.col("top.r").alias("tr"), F.col("top.d").alias("td"))
    nodes = checkpointed(nodes.join(tops, ["r", "d"]))
    is_top = (F.col("r") == F.col("tr")) & (F.col("d") == F.col("td"))
    if nodes.agg(F.max("k")).first()[0] >= band:
        # a tree of components; what hangs below each one is found in the same way
        parts = nodes.groupBy("tr", "td").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select(F.col("tr").alias("r"), F.col("td").alias("d"), "leaves", "saved")
        shape = nodes.where(is_top).select("r", "d", "pr", "pd", "l", F.floor(F.col("k") / band).alias("k"))
        above = nodes.select(F.col("r").alias("pr"), F.col("d").alias("pd"), F.col("tr").alias("cr"), F.col("td").alias("cd"))
        hangs = shape.join(above, ["pr", "pd"], "left")
        outer = hangs.select("r", "d", F.coalesce("cr", "pr").alias("pr"), F.coalesce("cd", F.lit(0)).cast("long").alias("pd"), "l", "k").join(parts, ["r", "d"])
        steps = paths.groupBy("conv", "l", F.floor(F.col("k") / band).alias("k")).agg(F.min(F.struct("d", "r")).alias("x"))
        sums = subtree_sums(checkpointed(outer), checkpointed(steps.select("conv", "x.r", "x.d", "l", "k")), band)
        below = sums.join(shape.select("r", "d", "pr", "pd"), ["r", "d"])
        return component_sums(with_added(nodes, hung(below)))
    done, waiting = None, None
    for level in sorted(r.l for r in nodes.select("l").distinct().collect()):  # powers of ratio: a few
        some = nodes.where(F.col("l") == level)
        found = checkpointed(component_sums(with_added(some, waiting) if waiting else some))
        totals = hung(found.join(some.where(is_top).select("r", "d", "pr", "pd"), ["r", "d"]))
        waiting = totals if waiting is None else waiting.unionByName(totals)
        done = found if done is None else done.unionByName(found)
    return done


def digests(ends: DataFrame) -> DataFrame:
    """(r, d, ends_sha256) of ends (r, d, conv): the hash of the ascending conversations, comma-joined.

    Ranges of ids are joined side by side; the hash then runs over these strings of one node in
    order, holding one batch of them.
    """
    chunks = placed(ends, ["r", "d", "conv"]).groupBy("r", "d", "part_").agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))  # a range's rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], ["r", "d", "ends_sha256"])
        for b in batches:
            out: list[tuple] = []
            for r, d, ids in zip(b.column("r").to_pylist(), b.column("d").to_pylist(), b.column("ids").to_pylist()):
                if key == (r, d):
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (r, d), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["r", "d", "ends_sha256"])
        if key:
            yield made()

    return chunks.repartition("r", "d").sortWithinPartitions("r", "d", "part_").select("r", "d", "ids").mapInArrow(run, "r long, d long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 20, most_shared: int = 3, ratio: int = 1024, band: int = 64) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row a node.

    See the module and rebuilt. Turns are ordered by turn, null first; of equal turns the order is
    that of a hash of role and text, and repeated rows are repeated turns. A null role or text is
    empty; rows with a null conv_id belong to no conversation and are left out. A family's first
    id is the next lower multiple of ``family``, for negative ids too. An empty table gives no
    node, not even a root; other columns are ignored.
    """
    convs, rows = rebuilt(turns, conv_col, turn_col, role_col, text_col, family, most_shared)
    rows = checkpointed(named(rows))
    found = rows.groupBy("d", "x", "y").agg(F.min("conv").alias("r"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"))
    found = found.select("d", "x", "y", "r", "n_convs", (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaves"))
    known = checkpointed(rows.join(found, ["d", "x", "y"]).select("conv", "d", "r", "n_convs", "leaves", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "ends"))

    # the parent of a node is the node before it on its conversation; a band's last row is told to the next band too
    root = convs.agg(F.min("conv").alias("root_conv"), F.count("*").alias("n_convs"), F.count_if("ended").alias("n_ends")).where("n_convs > 0")
    own_band = F.floor(F.col("d") / band)
    told = F.when(F.col("d") % band == band - 1, F.array(own_band, own_band + 1)).otherwise(F.array(own_band))
    before = F.lag("r").over(Window.partitionBy("conv", "b").orderBy("d"))
    nodes = known.withColumn("b", F.explode(told)).withColumn("pr", before).where((F.col("b") == own_band) & (F.col("conv") == F.col("r")))
    size = F.floor(F.log2(F.col("n_convs")) / float(np.log2(ratio))).cast("int").alias("l")
    nodes = nodes.crossJoin(F.broadcast(root.select("root_conv")))  # one row
    nodes = checkpointed(nodes.select("r", "d", F.coalesce("pr", "root_conv").alias("pr"), (F.col("d") - 1).alias("pd"), size, F.col("d").alias("k"), "n_convs", "leaves", "saved"))
    sums = subtree_sums(nodes.drop("n_convs"), known.select("conv", "r", "d", size, F.col("d").alias("k")), band) if not nodes.isEmpty() else nodes.select("r", "d", "leaves", "saved")

    hash_of = digests(known.where("ends").select("r", "d", "conv").unionByName(convs.where("ended").crossJoin(F.broadcast(root)).select(F.col("root_conv").alias("r"), F.lit(0).cast("long").alias("d"), "conv")))
    everything = nodes.agg(F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    none = F.lit(None).cast("long")
    top = root.crossJoin(everything).select(F.col("root_conv").alias("r"), F.lit(0).cast("long").alias("d"), none.alias("pr"), "n_convs", F.greatest("leaves", F.lit(1)).alias("leaves"), "saved")
    parts = [
        nodes.select("r", "d", F.struct("pr", "n_convs").alias("node")),
        top.select("r", "d", F.struct("pr", "n_convs").alias("node")),
        nodes.groupBy(F.col("pr").alias("r"), F.col("pd").alias("d")).agg(F.count("*").alias("n_children")),
        sums.select("r", "d", "leaves", "saved"),
        top.select("r", "d", "leaves", "saved"),
        hash_of,
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    made = both.groupBy("r", "d").agg(F.max("node").alias("node"), F.max("n_children").alias("n_children"), F.max("leaves").alias("leaves"), F.max("saved").alias("saved"), F.max("ends_sha256").alias("ends_sha256"))
    zero: Column = F.lit(0).cast("long")
    return made.select(F.col("r").alias("conv_id"), F.col("d").alias("depth"), F.col("node.pr").alias("parent_conv_id"), F.col("node.n_convs").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


ORACLE = r"""
WITH codes AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda t, b: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END, i)) AS code
), own AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
), cut AS (
  SELECT c, turns, xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, x: xor(a >> 8, code[(xor(a, x) & 255) + 1]), 4294967295)) % 4 AS h FROM own, codes
), made AS (
  SELECT a.c, list_concat(list_slice(coalesce(b.turns, []), 1, a.h), list_slice(a.turns, a.h + 1, len(a.turns))) AS seq FROM cut a LEFT JOIN own b ON b.c = a.c - ((a.c % 20) + 20) % 20
), steps AS (
  SELECT c, seq, unnest(range(len(seq) + 1)) AS d FROM made
), nodes AS (
  SELECT list_slice(seq, 1, d) AS p, d, min(c) AS r, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(seq) = d), '') AS ends FROM steps GROUP BY 1, 2
), sized AS (
  SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM nodes
), kids AS (
  SELECT a.r, a.d, count(*) AS k FROM sized a JOIN sized b ON b.d = a.d + 1 AND list_slice(b.p, 1, a.d) = a.p GROUP BY 1, 2
), sums AS (
  SELECT a.r, a.d, sum(b.saved) AS saved, count(*) FILTER (WHERE k.k IS NULL) AS leaves
  FROM sized a JOIN sized b ON b.d >= a.d AND list_slice(b.p, 1, a.d) = a.p LEFT JOIN kids k ON k.r = b.r AND k.d = b.d GROUP BY 1, 2
)
SELECT a.r AS conv_id, a.d AS depth, p.r AS parent_conv_id, a.n AS n_convs, coalesce(k.k, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM sized a LEFT JOIN sized p ON a.d = p.d + 1 AND p.p = list_slice(a.p, 1, p.d) LEFT JOIN kids k ON k.r = a.r AND k.d = a.d JOIN sums s ON s.r = a.r AND s.d = a.d
"""
