"""SimHash near-dedup by similarity: the links of op9's trees, and exactly those its fingerprints can't see.

A text is its set of word shingles; equal sets are merged before any search. Sets whose SimHash
fingerprints are linked by the vantage-point trees, and pass the bound on the whole sets, are
joined first. At a similarity of 0.8 most pairs differ in more bits than trees can search, so the
rest comes from prefixes: two different sets with a similarity of ``least`` or more share one of
their first n - ceil(least * n) + 1 of n shingles, in one order for all texts. Grouping prefixes
finds every such pair, and each candidate is confirmed on the whole sets.
With ``by_fingerprint`` texts that op9 links by its own fingerprints (three-word shingles, repeats
included) are linked whatever their similarity.
The order puts shingles first that are rare in a sample, which keeps the groups small; the sample
decides the cost only.

In a group of more than ``most_pairs`` sets a few stars connect most of a family of near copies at
a cost in proportion to its rows. Groups whose sets are in one component by then are left; the
others are ordered by component and cut into blocks of ``block_rows`` sets, and blocks meet unless
all their sets are in one component. So no task holds a whole group, however many share a shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defect_spark.llm.common import checkpointed, same
from defect_spark.llm.simhash import fingerprint, link_edges, majority, star_roots
from defect_spark.operators.ranges import ranks

STARS = 4
WIDE = 2048  # buckets of the parities that decide which whole sets are compared
ROWS = 512  # texts whose sets a worker holds at a time
#: Spark's setting to delete a query's shuffle files when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FREQUENT = 16  # rows of the sample with a shingle that is dealt over several tasks


def shingles(text: str | None, size: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted 64-bit hashes of a text's shingles; a shorter text is one shingle, one without words none."""
    words = (text or "").encode().lower().split()
    parts = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)] if words else []
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), parts), np.uint64).view(np.int64))


def parities(grams: np.ndarray, buckets: int = 128) -> np.ndarray:
    """Longs of bits: whether a set has an odd number of shingles in each bucket."""
    odd = np.bincount(grams & (buckets - 1), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def set_names(sets: list[np.ndarray]) -> list[pa.Array]:
    """128 bits that name each set, as two columns of longs."""
    made = np.frombuffer(b"".join(xxhash.xxh3_128_digest(g.tobytes()) for g in sets), ">i8").astype(np.int64).reshape(-1, 2)
    return [pa.array(made[:, 0]), pa.array(made[:, 1])]


def row_key(text: Column) -> Column:
    """With doc_id this names a row: 128 bits of its text."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


def common_shingles(docs: DataFrame, size: int, sample_rows: int, often: int = 3) -> dict[int, int]:
    """Shingles of at least ``often`` different texts in a sample of about ``sample_rows`` rows, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                grams = [shingles(t.as_py(), size) for t in b.column(0)[at : at + 64]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams))], ["h"])

    step = max(1, docs.count() // sample_rows)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).select("text").distinct()
    return {r.h: r.n for r in some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= often).collect()}


def prefixes(docs: DataFrame, size: int, least: float, found: dict[int, int]) -> DataFrame:
    """(doc_id, key, sim, na, nb, n, fp, s, t, wide, prefix): sim is op9's fingerprint of the text, (na, nb) names the set, n is its size, fp its fingerprint, the next its parities."""
    known = np.array(sorted(found), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((known, np.array([found[h] for h in known.tolist()], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = shared.value
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            sims, sets, sizes, prints, odd, wide, cuts = [], [], [], [], [], [], []
            for t in b.column(2):
                text = t.as_py()
                sims.append(fingerprint(text))
                grams = shingles(text, size)
                n = len(grams)
                sets.append(grams)
                sizes.append(n)
                prints.append(majority(grams.view(np.uint64)))
                odd.append(parities(grams))
                wide.append(parities(grams, WIDE))
                if len(known):
                    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    grams = grams[np.lexsort((grams, np.where(known[at] == grams, times[at], 0)))]
                cuts.append(grams[: n - math.ceil(least * n - 1e-9) + 1])
            bits = np.array(odd, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(sims, np.uint64).view(np.int64)), *set_names(sets), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(wide, pa.list_(pa.int64())), pa.array(cuts, pa.list_(pa.int64()))], ["doc_id", "key", "sim", "na", "nb", "n", "fp", "s", "t", "wide", "prefix"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, key struct<x: long, y: long>, sim long, na long, nb long, n int, fp long, s long, t long, wide array<long>, prefix array<long>")


def whole_sets(asked: DataFrame, sets: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(cls, grams), written once: the shingles of the sets in asked (cls), each read from the text that gave it its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                cut = b.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array([shingles(t.as_py(), size) for t in cut.column(1)], pa.list_(pa.int64()))], ["cls", "grams"])

    keys = sets.select("cls", "doc_id", "key").join(asked.distinct(), "cls")
    texts = docs.alias("a").join(keys.alias("b"), same("doc_id", "key")).select("b.cls", "a.text")
    return checkpointed(texts.mapInArrow(run, "cls long, grams array<long>"))


def confirmed(pairs: DataFrame, grams: DataFrame, least: float) -> DataFrame:
    """(u, v), u > v: the pairs (a, b) of sets whose similarity is ``least`` or more."""
    both = pairs.join(grams.select(F.col("cls").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("cls").alias("b"), F.col("grams").alias("y")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("s"), (F.size("x") + F.size("y")).alias("n"))
    return shared.where(F.col("s") * (1 + least) >= F.col("n") * least - 1e-9).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def able_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose WIDE parities allow a similarity of ``least``; see all_pairs."""
    side = lambda c, n, w: sets.select(F.col("cls").alias(c), F.col("n").alias(n), F.col("wide").alias(w))
    both = pairs.join(side("a", "m", "v"), "a").join(side("b", "n", "w"), "b")
    odd = F.aggregate(F.zip_with("v", "w", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = F.col("m") + F.col("n") - 2 * F.ceil(least / (1 + least) * (F.col("m") + F.col("n")) - 1e-9)
    return both.where(odd <= most).select("a", "b")


def twin_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """(a, b): sets whose fingerprints are equal or linked by the trees; one set stands for each fingerprint."""
    sets = sets.select("fp", "cls")
    firsts = checkpointed(sets.groupBy("fp").agg(F.min("cls").alias("first")))
    equal = sets.join(firsts, "fp").where("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b"))
    edges = link_edges(firsts.select("fp"), radius)
    ends = [firsts.select(F.col("fp").alias(x), F.col("first").alias(y)) for x, y in (("u", "a"), ("v", "b"))]
    linked = edges.join(ends[0], "u").join(ends[1], "v").select("a", "b")
    return equal.union(linked).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def fingerprint_links(members: DataFrame, sets: DataFrame, radius: int) -> DataFrame:
    """(u, v), u > v: of each component that op9 makes of texts, its sets with the smallest of them."""
    rows = members.select("sim", "na", "nb").distinct().join(sets.select("na", "nb", "cls"), ["na", "nb"]).select("sim", "cls")
    points = checkpointed(rows.select(F.col("sim").alias("fp")).distinct())
    roots = star_roots(link_edges(points, radius)).withColumnRenamed("u", "sim")
    placed = checkpointed(rows.join(roots, "sim", "left").select(F.coalesce("root", "sim").alias("root"), "cls").distinct())
    least = placed.groupBy("root").agg(F.min("cls").alias("v"))
    return placed.join(least, "root").where("cls > v").select(F.col("cls").alias("u"), "v").distinct()


def shared_rows(prefixed: DataFrame, frequent: list[int], salts: int = 64) -> DataFrame:
    """(h, cls, i, held) of (cls, prefix): the prefix shingles that two sets or more have, and in how many prefixes each is.

    Shingles are counted where they meet, in one shuffle. ``frequent`` ones, by the sample, are
    dealt over ``salts`` tasks and their counts added.
    """
    rows = prefixed.select("cls", F.posexplode("prefix").alias("i", "h"))
    named = prefixed.sparkSession.createDataFrame([(h, True) for h in frequent], "h long, often boolean")
    rows = rows.join(F.broadcast(named), "h", "left")  # shingles of the sample
    rows = rows.withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64("cls"), F.lit(salts))).otherwise(0))
    kept = checkpointed(rows.withColumn("own", F.count("*").over(Window.partitionBy("h", "salt"))).where("own > 1 OR often").select("h", "cls", "i", "own", "often"))
    totals = kept.where("often").groupBy("h").agg(F.count("*").alias("total"))
    return kept.join(F.broadcast(totals), "h", "left").select("h", "cls", "i", F.coalesce("total", "own").alias("held")).where("held > 1")  # at most the frequent ones


def star_pairs(rows: DataFrame, most_pairs: int) -> DataFrame:
    """(a, b): each set of a large group with the group's leader, in at most STARS groups a set."""
    large = rows.where(F.col("held") > most_pairs).select("h", "cls")
    tops = large.groupBy("h").agg(F.min(F.struct(F.xxhash64("cls", "h").alias("r"), "cls")).alias("top")).select("h", F.col("top.cls").alias("b"))
    stars = large.select("h", F.col("cls").alias("a")).join(tops, "h").where("a <> b")
    stars = stars.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("h"), "h"))).where(f"k <= {STARS}")
    return stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def block_pairs(rows: DataFrame, block_rows: int) -> DataFrame:
    """(g, o, own): the blocks of each group that must meet, each an array of its sets; own where a block meets itself."""
    mixed = rows.groupBy("h").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("h")
    rows = checkpointed(rows.join(mixed, "h", "left_semi"))
    small = rows.where(F.col("held") <= block_rows).withColumn("block", F.lit(0).cast("long"))
    large = rows.where(F.col("held") > block_rows)
    if not large.isEmpty():
        small = small.unionByName(ranks(large, ["h"], ["part", "cls"], "block").withColumn("block", F.floor(F.col("block") / block_rows)))
    made = small.groupBy("h", "block").agg(F.collect_list(F.struct("cls", "n", "i", "s", "t", "part")).alias("g"), F.min("part").alias("p"), F.max("part").alias("q"))  # block_rows at most
    made = checkpointed(made)
    alone = made.where("p <> q").select("g", F.col("g").alias("o"), F.lit(True).alias("own"))
    if large.isEmpty():
        return alone
    cut = made.join(large.select("h").distinct(), "h", "left_semi")
    shape = cut.select("h", "block", "p", "q")
    other = shape.select("h", F.col("block").alias("over"), F.col("p").alias("op"), F.col("q").alias("oq"))
    meet = shape.join(other, "h").where("block < over AND NOT (p = q AND op = oq AND p = op)").select("h", "block", "over")
    met = meet.join(cut.select("h", "block", "g"), ["h", "block"]).join(cut.select("h", F.col("block").alias("over"), F.col("g").alias("o")), ["h", "over"])
    return alone.unionByName(met.select("g", "o", F.lit(False).alias("own")))


def all_pairs(blocks: DataFrame, least: float) -> DataFrame:
    """(a, b): sets of two components that can still have a similarity of ``least`` or more.

    A pair needs o = least / (1 + least) of the sum of its sizes in common. Shingles that come
    before the first common one are not shared, so that one stands at a place of at most the size
    less o in either set; only there do two sets meet. Each bucket whose parities differ has a
    shingle that is not shared, so there may be at most as many as the sizes less twice o.
    """
    need = lambda a, b: F.ceil(least / (1 + least) * (a["n"] + b["n"]) - 1e-9)

    def close(a: Column):
        size = lambda b: F.least(a["n"], b["n"]) >= F.greatest(a["n"], b["n"]) * least - 1e-9
        place = lambda b: (a["i"] <= a["n"] - need(a, b)) & (b["i"] <= b["n"] - need(a, b))
        odd = lambda b: F.bit_count(a["s"].bitwiseXOR(b["s"])) + F.bit_count(a["t"].bitwiseXOR(b["t"])) <= a["n"] + b["n"] - 2 * need(a, b)
        once = lambda b: (b["cls"] > a["cls"]) | ~F.col("own")
        return lambda b: once(b) & (b["part"] != a["part"]) & size(b) & place(b) & odd(b)

    rows = blocks.select(F.explode("g").alias("a"), "o", "own").select("a", F.explode(F.filter("o", close(F.col("a")))).alias("b"))
    return rows.select(F.greatest("a.cls", "b.cls").alias("a"), F.least("a.cls", "b.cls").alias("b")).distinct()


def numbered(docs: DataFrame, size: int, least: float, sample_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sets, rows): (doc_id, key, sim, na, nb) of docs, each different set once under a number cls, and its shared_rows.

    A set's number is that of one of its rows, which stays as the rows are written.
    """
    found = common_shingles(docs, size, sample_rows)
    made = checkpointed(prefixes(docs, size, least, found).withColumn("cls", F.monotonically_increasing_id()))
    sets = made.groupBy("na", "nb").agg(F.min(F.struct("cls", "doc_id", "key", "n", "fp", "s", "t", "wide")).alias("x")).select("na", "nb", "x.*")
    sets = checkpointed(sets)
    again = made.select("cls").join(sets.select("cls"), "cls", "left_anti")
    prefixed = made.select("cls", "prefix").join(again, "cls", "left_anti")
    rows = shared_rows(prefixed, [h for h, n in found.items() if n >= FREQUENT])
    return made.select("doc_id", "key", "sim", "na", "nb"), sets, rows


def keepers(docs: DataFrame, size: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8192, most_pairs: int = 256, radius: int = 3, block_rows: int = 1024, by_fingerprint: bool = False) -> DataFrame:
    """(doc_id, key): of each component of texts linked by a similarity of ``least`` or more its smallest row.

    Words are cut as by SimHash. Rows are ordered by doc_id, null last, then by row_key; repeats
    of a row are one. Null texts and texts without words are alike. least must be over a half. An
    empty table gives an empty result; other columns are ignored. With by_fingerprint the links
    of op9 within ``radius`` bits count as well. The session's CLEANUP is switched
    on and stays so: steps are written once, and their shuffles are larger than the input.
    """
    if least <= 0.5:
        raise ValueError("least must be over 0.5")
    docs.sparkSession.conf.set(CLEANUP, "true")
    docs = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    members, sets, rows = numbered(docs, size, least, sample_rows)
    pairs = checkpointed(able_pairs(twin_pairs(sets, radius).union(star_pairs(rows, most_pairs)).distinct(), sets, least))
    ends = lambda p: p.select(F.col("a").alias("cls")).union(p.select(F.col("b").alias("cls")))
    grams = whole_sets(ends(pairs), sets, docs, size)
    linked = confirmed(pairs, grams, least)
    linked = checkpointed(linked.union(fingerprint_links(members, sets, radius)).distinct() if by_fingerprint else linked)
    roots = star_roots(linked).withColumnRenamed("u", "cls")
    placed = sets.select("cls", "n", "s", "t").join(roots, "cls", "left").withColumn("part", F.coalesce("root", "cls")).drop("root")
    pairs = all_pairs(block_pairs(rows.join(placed, "cls"), block_rows), least)
    pairs = checkpointed(able_pairs(pairs, sets, least))
    rest = ends(pairs).distinct().join(grams.select("cls"), "cls", "left_anti")
    more = confirmed(pairs, grams.unionByName(whole_sets(rest, sets, docs, size)), least)
    roots = star_roots(more.union(linked).distinct()).withColumnRenamed("u", "cls")
    named = sets.select("na", "nb", "cls").join(roots, "cls", "left").select("na", "nb", F.coalesce("root", "cls").alias("root"))
    first = members.join(named, ["na", "nb"]).groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "key")).alias("x"))
    return first.select("x.doc_id", "x.key")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, text and others) that keepers names, each once; of repeats the least."""
    others = F.struct(*(c for c in docs.columns if c != "doc_id"))
    rows = docs.select("doc_id", row_key(F.col("text")).alias("key"), others.alias("row"))
    kept = rows.alias("a").join(keepers(docs, **options).alias("b"), same("doc_id", "key"), "left_semi")
    return kept.groupBy("doc_id", "key").agg(F.min("row").alias("row")).select("doc_id", "row.*").select(*docs.columns)
