"""Benchmark decontamination: Wu-Manber search for the word windows of benchmark items.

Words are the alphabet. For each pattern length the shift table maps a block (the last two
words under the search window) to how far the window may jump; a block that ends some pattern
has shift 0 and leads to its suffix bucket, where the first word picks candidates and a direct
comparison confirms them. Texts are scanned whole, in place; nothing is shuffled. Item texts are
broadcast, and each worker makes its own tables of them. A benchmark over the bound is cut to
shards with a scan each, one after another; a scan writes what it found in the few documents with
hits, and these are joined in the end.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defect_spark.llm.common import LOWER, UPPER, checkpointed, pairs_of

#: Upper case to lower case; every other ASCII byte but letters and digits to a space.
WORD_BYTES = bytes(ord(chr(c).lower()) if chr(c) in UPPER else c if c > 127 or chr(c).isdigit() or chr(c) in LOWER else 32 for c in range(256))
SPANS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("items", T.ArrayType(T.StringType()))])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class LengthClass:
    """The shift table and suffix buckets of all patterns of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[bytes, list[tuple[tuple, set[str]]]]] = {}

    def add(self, pattern: tuple, item: str) -> None:
        n, b = self.length, self.block
        for end in range(b, n + 1):
            key = pattern[end - b : end]
            self.shift[key] = min(self.shift.get(key, self.most), n - end)
        same_start = self.bucket.setdefault(pattern[n - b :], {}).setdefault(pattern[0], [])
        for known, items in same_start:
            if known == pattern:
                items.add(item)
                return
        same_start.append((pattern, {item}))

    def scan(self, words: list[bytes], spans: list[tuple[int, int]], items: set[str]) -> None:
        length, most, shift, bucket = self.length, self.most, self.shift, self.bucket
        get, end, n, two = shift.get, length, len(words), self.block == 2
        while end <= n:
            key = (words[end - 2], words[end - 1]) if two else (words[end - 1],)
            jump = get(key, most)
            if jump:
                end += jump
                continue
            start = end - length
            for pattern, of in bucket[key].get(words[start], ()):
                if tuple(words[start:end]) == pattern:
                    if spans and start <= spans[-1][1] and start >= spans[-1][0]:
                        spans[-1] = (spans[-1][0], end)
                    else:
                        spans.append((start, end))
                    items |= of
                    break
            end += 1


def build(rows: list[tuple], window: int) -> list[LengthClass]:
    """Classes from (item_id, text) rows; an item of fewer than ``window`` words is one pattern."""
    classes: dict[int, LengthClass] = {}
    for item, text in rows:
        words = words_of(text)
        n = min(window, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            classes.setdefault(n, LengthClass(n)).add(tuple(words[at : at + n]), "" if item is None else str(item))
    return [classes[n] for n in sorted(classes, reverse=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_built: tuple[str, list[LengthClass]] = ("", [])


def classes_for(token: str, rows: list[tuple], window: int) -> list[LengthClass]:
    """The tables of a shard of items, made once per worker; only the last shard's are kept."""
    global _built
    if _built[0] != token:
        _built = (token, build(rows, window))
    return _built[1]


def scanned(docs: DataFrame, rows: list[tuple], window: int, text_col: str) -> DataFrame:
    """docs with n_words, spans and items for a shard of (item_id, text) rows."""
    shared, token = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = classes_for(token, shared.value, window)
        for b in batches:
            counts, all_spans, all_items = [], [], []
            for text in b.column(b.schema.get_field_index(text_col)):
                words = words_of(text.as_py())
                spans: list[tuple[int, int]] = []
                found: set[str] = set()
                for c in classes:
                    mine: list[tuple[int, int]] = []
                    c.scan(words, mine, found)
                    spans += mine
                counts.append(len(words))
                all_spans.append([{"start": s, "end": e} for s, e in merged(spans)])
                all_items.append(sorted(found))
            new = [pa.array(counts, pa.int64()), pa.array(all_spans, span_type), pa.array(all_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *SPANS.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *SPANS.fields]))


def merged_spans(spans: Column) -> Column:
    """Sorted spans of several scans as disjoint ones."""

    def add(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.sort_array(spans), F.slice(spans, 1, 0), add)


def with_items(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_mb: float = 8) -> DataFrame:
    """docs with n_words, spans and items: word spans inside windows of items, and the items' ids, sorted.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none,
    is one window. Words are runs of digits, letters (A-Z lower-cased) and non-ASCII characters.
    spans are disjoint, in order, end excluded. Null texts have no words; a null item_id is
    listed as ''. Repeated rows and items are returned and searched as they come; an empty items
    table gives no spans, an empty docs table no rows; other columns come along, ones with those
    three names are replaced. At most ``shard_mb`` MB of item texts are broadcast at a time (a
    single longer item is a shard).
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in SPANS.names))
    items = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(held / (shard_mb * (1 << 20))))
    part = lambda k: [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).toLocalIterator()]
    if shards == 1:
        return scanned(docs, part(0), window, text_col)
    # equal texts have equal hits, so these are keyed by the text
    key = [F.xxhash64(text_col).alias("k1_"), F.xxhash64(F.lit(1), text_col).alias("k2_")]
    texts = docs.select(F.col(text_col).alias("text"))
    hits = None
    for k in range(1, shards):
        found = scanned(texts, part(k), window, "text").where(F.size("spans") > 0)
        found = checkpointed(found.select(F.xxhash64("text").alias("k1_"), F.xxhash64(F.lit(1), "text").alias("k2_"), F.col("spans").alias("s_"), F.col("items").alias("i_")).dropDuplicates(["k1_", "k2_"]))
        hits = found if hits is None else hits.unionByName(found)
    more = hits.groupBy("k1_", "k2_").agg(F.flatten(F.collect_list("s_")).alias("s_"), F.flatten(F.collect_list("i_")).alias("i_"))
    both = scanned(docs, part(0), window, text_col).select("*", *key).join(more, ["k1_", "k2_"], "left")
    spans = F.when(F.col("s_").isNull(), F.col("spans")).otherwise(merged_spans(F.concat("spans", "s_")))
    names = F.when(F.col("i_").isNull(), F.col("items")).otherwise(F.array_sort(F.array_distinct(F.concat("items", "i_"))))
    return both.select(*(F.col(f"`{c}`") for c in docs.columns), "n_words", spans.alias("spans"), names.alias("items"))


def find_items(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_mb: float = 8) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document; see with_items."""
    return with_items(pairs_of(docs, id_col, text_col), items, window, "text", item_col, item_text_col, shard_mb).select("doc_id", "n_words", "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    """The per-document report: counts, the digest of the item ids and the verdict."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM p), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT places.doc_id, places.i, places.n, p.item_id FROM places JOIN p ON places.s = p.s AND places.n = p.n),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id
"""
