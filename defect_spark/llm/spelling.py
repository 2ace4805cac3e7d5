"""Spelling variants: words one edit apart, found by banded edit-matrix rows over sorted lists.

Two words that are one edit apart share the first half of the shorter one or its last half, so a
word is dealt by both halves, once as the shorter word of a pair and once as the longer one. What
the words of a group share is cut off; the middles that are left are sorted. A run of neighbours
in that list whose longest common prefix reaches a depth has one row of the edit matrix for a
query, three cells wide, computed once for the whole run; a run whose row is above one edit is
skipped with all that is below it. Groups over a bound are dealt on by the halves of their
middles, until a middle is a single character: such a group has no more words than letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defect_spark.llm.common import checkpointed, pairs_of

RUN = "[A-Za-zÀ-ÿ]"
EVERY = 97  # one run in so many loses a character
NO_BOUND = 1 << 30


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, most_held: int = 200_000) -> DataFrame:
    """(word, n): occurrences of the words of whole texts; counted in each task before they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # shorter runs cannot become words; a match is a whole run, as it begins where the run does
        find, crc = re.compile(RUN + "{%d,}" % least_chars).findall, zlib.crc32
        held: dict[str, int] = {}
        full = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                if not text.is_valid:
                    continue
                name = doc_id.as_py()
                start = crc(f"{'' if name is None else name}:".encode())
                for w, n in Counter(find(text.as_py().encode().lower().decode())).items():
                    h = crc(w.encode(), start)
                    if not h % EVERY:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least_chars:
                            continue
                    held[w] = held.get(w, 0) + n
                if len(held) > most_held:
                    yield full()
                    held.clear()
        yield full()

    return pairs_of(docs, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dealt(words: DataFrame) -> DataFrame:
    """Rows of words under the halves they may share with a word one edit apart.

    Columns: length (of the shorter word of a pair), a and b (characters shared at the front and
    the end), bound (the common prefix of a pair must be below it), pre and suf (what is shared),
    mid (the rest), asks (whether the word is as long as ``length``), n.
    """
    size = F.length("word")
    roles = F.array(F.struct(size.alias("length"), F.lit(True).alias("asks")), F.struct((size - 1).alias("length"), F.lit(False).alias("asks")))
    rows = words.select(F.lit("").alias("pre"), F.lit("").alias("suf"), F.col("word").alias("mid"), "n", F.inline(roles)).withColumn("bound", F.lit(NO_BOUND))
    return halved(rows)


def halved(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first half of its middle shared, and with the last half."""
    size = F.col("length") - F.length("pre") - F.length("suf")  # of the shorter word's middle
    x = F.floor(size / 2).cast("int")
    y = size - x
    whole = F.length("mid")
    cut = lambda start, n: F.substr(F.col("mid"), start, n)
    one = F.lit(1)
    front = F.struct(F.concat("pre", cut(one, x)).alias("pre"), F.col("suf").alias("suf"), cut(x + 1, whole - x).alias("mid"), F.col("bound").alias("bound"))
    back = F.struct(F.col("pre").alias("pre"), F.concat(cut(whole - y + 1, y), "suf").alias("suf"), cut(one, whole - y).alias("mid"), (F.length("pre") + x).cast("int").alias("bound"))
    return rows.select("length", "asks", "n", F.inline(F.array(front, back)))


KEY = ["length", "bound", "pre", "suf"]


def near_in_list(keys: np.ndarray, mids: list[str], asks: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): places of words exactly one edit apart, x asking, in a list sorted by key and middle.

    room: a pair's middles must have a common prefix shorter than this. Words of different keys
    never meet. Pairs of two asking words come in both orders.
    """
    n = len(mids)
    size = np.fromiter(map(len, mids), np.int64, n)
    flat = np.frombuffer("".join(mids).encode("latin-1"), np.uint8)
    begin = np.cumsum(size) - size

    def char(word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The character of a word at a place, 0 outside of it; no word has 0."""
        there = (at >= 0) & (at < size[word])
        out = np.zeros(len(word), np.uint8)
        out[there] = flat[begin[word[there]] + at[there]]
        return out

    lcp = np.zeros(n, np.int64)  # with the word before; -1 where a key begins
    lcp[0] = -1
    lcp[1:][keys[1:] != keys[:-1]] = -1
    live = np.flatnonzero(lcp >= 0)
    depth = 0
    while len(live):
        at = np.full(len(live), depth)
        live = live[(char(live, at) == char(live - 1, at)) & (size[live] > depth) & (size[live - 1] > depth)]
        depth += 1
        lcp[live] = depth

    first = np.flatnonzero(lcp < 0)
    last = np.r_[first[1:], n]
    group = np.cumsum(lcp < 0) - 1
    q = np.flatnonzero(asks & (last - first > 1)[group])
    low, high = first[group[q]], last[group[q]]  # the run of each state
    shared = np.zeros(len(q), np.int64)
    back, diagonal, ahead = np.full(len(q), 2), np.zeros(len(q), np.int64), np.ones(len(q), np.int64)
    inside = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    depth = 0
    while len(q):
        ends = size[low] == depth  # a run's first word may end here; the others go on
        gap = size[q] - depth
        edits = np.where(gap == 0, diagonal, np.where(gap == 1, ahead, np.where(gap == -1, back, 2)))
        hit = ends & (edits == 1)
        found.append((q[hit], low[hit]))
        depth += 1
        inside = inside[size[inside] >= depth]
        opens = np.flatnonzero(lcp[inside] < depth)
        starts = inside[opens]
        stops = inside[np.r_[opens[1:], len(inside)] - 1] + 1 if len(opens) else starts
        from_, to = np.searchsorted(starts, low), np.searchsorted(starts, high)
        many = to - from_
        state = np.repeat(np.arange(len(q)), many)
        child = np.repeat(from_ - (np.cumsum(many) - many), many) + np.arange(len(state))
        q, low, high = q[state], starts[child], stops[child]
        c = char(low, np.full(len(low), depth - 1))
        here = char(q, np.full(len(q), depth - 1))
        at_back, at_ahead = char(q, np.full(len(q), depth - 2)), char(q, np.full(len(q), depth))
        b = np.minimum(back[state] + (at_back != c), diagonal[state] + 1)
        d = np.minimum(np.minimum(diagonal[state] + (here != c), ahead[state] + 1), b + 1)
        a = np.minimum(ahead[state] + (at_ahead != c), d + 1)
        shared = shared[state]
        shared += (shared == depth - 1) & (here == c)
        keep = (np.minimum(np.minimum(b, d), a) <= 1) & (shared < room[q])
        q, low, high, shared, back, diagonal, ahead = (v[keep] for v in (q, low, high, shared, b, d, a))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(v) for v in zip(*found))


def near_counts(lists: DataFrame) -> DataFrame:
    """(word, n_near, best): for each word of sorted lists how many are near it, and the most frequent of them.

    best is (less, word): minus its occurrences, and the word; the least is the best. A word has a
    row for each list in which it has a near word.
    """

    def solve(rows: pa.Table) -> pa.RecordBatch:
        length, bound = (rows.column(c).to_numpy() for c in ("length", "bound"))
        pre, suf, mids = (rows.column(c).to_pylist() for c in ("pre", "suf", "mid"))
        asks, n = rows.column("asks").to_numpy(zero_copy_only=False), rows.column("n").to_numpy()
        keys = np.zeros(len(mids), np.int64)
        keys[1:] = np.cumsum([a != b for a, b in zip(zip(length[1:], bound[1:], pre[1:], suf[1:]), zip(length, bound, pre, suf))])
        x, y = near_in_list(keys, mids, asks, bound - np.fromiter(map(len, pre), np.int64, len(pre)))
        more = ~asks[y]  # a longer word never asks, so it is told
        x, y = np.r_[x, y[more]], np.r_[y, x[more]]
        some = np.unique(x)
        words = dict(zip(some.tolist(), (pre[i] + mids[i] + suf[i] for i in some.tolist())))
        names = np.array([words[i] for i in some.tolist()], object)
        rank = np.zeros(len(mids), np.int64)
        rank[some[np.argsort(names, kind="stable")]] = np.arange(len(some))
        order = np.lexsort((rank[y], -n[y], x))
        x, y = x[order], y[order]
        at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
        best = pa.StructArray.from_arrays([pa.array(-n[y[at]]), pa.array([words[i] for i in y[at].tolist()], pa.string())], ["less", "word"])
        return pa.RecordBatch.from_arrays([pa.array([words[i] for i in x[at].tolist()], pa.string()), pa.array(np.diff(np.r_[at, len(x)])), best], ["word", "n_near", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            last = [b.column(c)[b.num_rows - 1].as_py() for c in KEY]
            rows = pa.Table.from_batches(held)
            # the last key may go on in the next batch; its rows are at the end
            cut = rows.num_rows
            columns = [rows.column(c) for c in KEY]
            while cut and all(c[cut - 1].as_py() == v for c, v in zip(columns, last)):
                cut -= 1
            if cut:
                yield solve(rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return lists.select(*KEY, "mid", "asks", "n").mapInArrow(run, "word string, n_near long, best struct<less: long, word: string>")


def near_words(words: DataFrame, most_rows: int = 4096) -> DataFrame:
    """near_counts of words (word, n), each word once; lists have at most ``most_rows`` rows or middles of one character."""
    rows, parts = dealt(words), []
    while True:
        counts = rows.groupBy(*KEY).agg(F.count("*").alias("rows_"), F.count_if("asks").alias("asks_"))
        large = (F.col("rows_") > most_rows) & (F.col("length") - F.length("pre") - F.length("suf") > 1)
        wide = checkpointed(counts.where(large & (F.col("asks_") > 0)))
        hot = not wide.isEmpty()
        parts.append(rows.join(wide, KEY, "left_anti") if hot else rows)
        if not hot:
            break
        rows = checkpointed(halved(rows.join(wide, KEY, "left_semi")))
    lists = reduce(lambda a, b: a.unionByName(b), parts)
    return near_counts(lists.repartition(*KEY).sortWithinPartitions(*KEY, "mid"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last word, twice as far each round. Forms have no cycles."""
    root = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = checkpointed(root.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        root = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return root


def larger(n: Column, of: Column) -> Column:
    return n >= 2 * of


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3, most_rows: int = 4096) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of docs with ``least_n`` occurrences or more.

    A run of letters is lower-cased (A to Z); one in 97, chosen by its doc_id and itself, loses a
    character. Near words differ by one inserted, deleted or replaced character. A word's form is
    its near word with most occurrences (on a tie the smallest), if twice its own or more; root
    is the last of the forms. Null texts have no words; a null doc_id reads as nothing before the
    colon; repeated rows count again. An empty table gives an empty result; other columns are ignored.
    """
    words = checkpointed(word_counts(docs, id_col, text_col, least_chars).where(F.col("n") >= least_n))
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less: long, word: string>").alias("best"))
    told = near_words(words, most_rows).select("word", F.lit(None).cast("long").alias("n"), "n_near", "best")
    made = own.unionByName(told).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    up = larger(-F.col("best.less"), F.col("n"))
    made = checkpointed(made.select("word", "n", "n_near", F.when(up, F.col("best.word")).alias("form"), F.when(up, -F.col("best.less")).alias("form_n")))
    roots = followed(made.where("form is not null"))
    return made.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
