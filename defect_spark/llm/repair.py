"""Token-id files compressed by a Re-Pair grammar per shard.

A shard holds the ids of consecutive documents. Frequent id pairs are replaced by nonterminals,
round after round: a round takes all pairs that occur at least 1/FALL as often as the commonest
one and replaces them at once (where two would overlap the commoner wins). It goes on until no
pair occurs ``least`` times. A rule costs three stored numbers and saves one for each use, so
rarer pairs would not pay for theirs. No rule joins documents: no pair begins with a symbol that
ends in the end id. So documents begin and end at symbols. A shard row has the rules, the
expansion length of every rule and the sequence: cumulated expansion lengths lead to any document
without expanding the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from defect_spark.llm.byte_bpe import batches_of, encoder, gathered
from defect_spark.llm.common import new_path, pairs_of

FALL = 16


def kinds_of(a: np.ndarray, b: np.ndarray, open_: np.ndarray, least: int, salt: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places, kind at each or -1, pair of each kind, count of the commonest): all places of pairs that occur ``least`` times.

    With a salt a kind is a hash slot and stands for one of its pairs; the places of its other
    pairs have kind -1 and come round with another salt. Without one all pairs are sorted.
    """
    if salt is None:
        pairs, back, n = np.unique((a.astype(np.int64) << 32) | b, return_inverse=True, return_counts=True)
        places = np.flatnonzero((n >= least)[back] & open_)
        return places, back[places], pairs, int(n.max(initial=0))
    bits = max(10, min(20, (4 * len(a)).bit_length()))
    slot = ((a.view(np.uint32) * np.uint32(2654435761 + 2 * salt) + b.view(np.uint32) * np.uint32(2246822519)) >> np.uint32(32 - bits)).astype(np.int64)
    slot[~open_] = 1 << bits
    count = np.bincount(slot, minlength=(1 << bits) + 1)
    count[1 << bits] = 0
    places = np.flatnonzero((count >= least)[slot])
    slot = slot[places]
    pair = (a[places].astype(np.int64) << 32) | b[places]
    pairs = np.zeros(1 << bits, np.int64)
    pairs[slot] = pair
    return places, np.where(pairs[slot] == pair, slot, -1), pairs, int(count.max())


def compress(ids: np.ndarray, first_symbol: int, least: int = 4, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rules as pairs, sequence): symbol first_symbol + i stands for rules[i]."""
    seq, rules = ids.astype(np.int32), []
    closed = np.zeros(first_symbol, bool)  # symbols whose last id is end_id
    closed[end_id] = True
    bound, salt = max(least, len(seq) // FALL), 0
    asked = None  # all places
    while True:
        a, b = (seq[:-1], seq[1:]) if asked is None else (seq[asked], seq[asked + 1])
        places, back, pairs, most = kinds_of(a, b, ~closed[a], bound, salt)
        wanted = np.bincount(back[back >= 0], minlength=len(pairs)) >= bound
        hit = (back >= 0) & wanted[back]
        if not hit.any():
            if bound > least:
                bound = max(least, min(bound, most) // FALL)
            elif salt is None or not len(places):
                break
            else:
                salt = None  # no slot stands for a frequent pair: look at all of them
            continue
        maybe = places if asked is None else asked[places]
        n = np.bincount(back[hit], minlength=len(pairs))
        at, back = maybe[hit], back[hit]
        weight = (((n[back] << 32) + back) << 1) + (at & 1)
        near = np.diff(at) == 1
        after, before = np.r_[np.where(near, weight[1:], 0), 0], np.r_[0, np.where(near, weight[:-1], 0)]
        wins = (weight > before) & (weight > after)
        at, back = at[wins], back[wins]
        number = np.zeros(len(pairs), np.int32)
        number[back] = 1
        used = np.flatnonzero(number)
        number[used] = len(closed) + np.arange(len(used))
        seq[at] = number[back]
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq = seq[stays]
        made = np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], 1)
        rules.append(made)
        closed = np.r_[closed, closed[made[:, 1]]]
        if bound == least:
            # pairs with a new symbol, or frequent and not replaced: no other can still be frequent
            gone, new = at + 1, at - np.arange(len(at))
            behind = np.searchsorted(gone, maybe)
            left = (maybe - behind)[gone[np.minimum(behind, len(gone) - 1)] != maybe]
            flag = np.zeros(len(seq) + 1, bool)
            flag[np.concatenate([new, left])] = True
            flag[new - 1] = True  # place -1 is the spare one
            asked = np.flatnonzero(flag[: len(seq) - 1])
        else:
            bound = max(least, bound // FALL)
        salt = 0 if salt is None else salt + 1
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), seq


def expansion_lengths(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """How many ids each rule stands for; rules only point to earlier ones."""
    parts = np.maximum(rules - first_symbol, -1)  # -1: an id
    out = np.zeros(len(rules) + 1, np.int64)  # 0: not known yet
    out[-1] = 1
    todo = np.arange(len(rules))
    while len(todo):
        made = out[parts[todo]]
        known = (made > 0).all(axis=1)
        out[todo[known]] = made[known].sum(axis=1)
        todo = todo[~known]
    return out[:-1]


def strung(symbols: np.ndarray, flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray, first_symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many of each symbol), from the expansions of rules in flat."""
    inner = symbols >= first_symbol
    size, base = np.ones(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
    size[inner], base[inner] = lengths[symbols[inner] - first_symbol], begin[symbols[inner] - first_symbol]
    out, many = np.repeat(symbols, size), np.repeat(inner, size)
    out[many] = flat[gathered(base, size)[many]]
    return out, size


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids of a sequence of symbols. Rules are expanded by length: their parts are shorter."""
    begin = np.cumsum(lengths) - lengths
    flat = np.empty(int(lengths.sum()), np.int64)
    order = np.argsort(lengths, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(some):
            flat[gathered(begin[some], lengths[some])] = strung(rules[some].ravel(), flat, begin, lengths, first_symbol)[0]
    return strung(seq, flat, begin, lengths, first_symbol)[0]


def document(shard: dict, index: int) -> np.ndarray:
    """The ids of one document of a shard row, without expanding the others."""
    first = shard["first_symbol"]
    rules = np.frombuffer(shard["rules"], np.int32).reshape(-1, 2).astype(np.int64)
    lengths = np.frombuffer(shard["rule_lengths"], np.int32).astype(np.int64)
    seq = np.frombuffer(shard["body"], np.int32).astype(np.int64)
    size = np.ones(len(seq), np.int64)
    size[seq >= first] = lengths[seq[seq >= first] - first]
    ends = np.cumsum(size)
    stop = np.cumsum(np.asarray(shard["n_tokens"], np.int64))
    low = np.searchsorted(ends, stop[index - 1], "right") if index else 0
    todo = seq[low : np.searchsorted(ends, stop[index]) + 1][::-1].tolist()
    out = []
    while todo:
        x = todo.pop()
        if x < first:
            out.append(x)
        else:
            todo += rules[x - first][::-1].tolist()
    return np.array(out, np.int64)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_ids: int = 1 << 20, first_symbol: int = 1 << 17) -> None:
    """Encodes docs and writes their ids, in ascending (id, text) order, as shard rows under path.

    Each text's ids are followed by end_id; null and empty texts have only that. A shard closes
    at ``shard_ids`` ids, so one text may exceed it. Rows with equal ids keep a row each, null ids
    come first. Files are Parquet rows of part, seq, doc_ids, n_tokens, n_ids, first_symbol,
    rules, rule_lengths and body (little-endian 32-bit).
    """
    docs = pairs_of(docs, id_col, text_col)
    kind = dict(docs.dtypes)["doc_id"]
    fields = ["part", "seq", "doc_ids", "n_tokens", "n_ids", "first_symbol", "rules", "rule_lengths", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer_path, "ids")
        end = np.array([end_id], np.int32)
        held_ids: list = []
        held: list[np.ndarray] = []
        total, id_type = 0, None

        def shard() -> pa.RecordBatch:
            rules, body = compress(np.concatenate(held), first_symbol, end_id=end_id)
            lengths = expansion_lengths(rules, first_symbol)
            row = [part, seq, held_ids, [len(x) for x in held], total, first_symbol, *(x.astype(np.int32).tobytes() for x in (rules, lengths, body))]
            types = [pa.int32(), pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], fields)

        for b in batches:
            id_type = b.column(0).type
            for cut in batches_of(b, 1):
                texts = [t or "" for t in cut.column(1).to_pylist()]
                for doc_id, ids in zip(cut.column(0).to_pylist(), enc.texts(texts)):
                    held_ids.append(doc_id)
                    held.append(np.concatenate([ids, end]))
                    total += len(ids) + 1
                    if total >= shard_ids:
                        yield shard()
                        held_ids, held, total, seq = [], [], 0, seq + 1
        if held:
            yield shard()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(run, f"part int, seq int, doc_ids array<{kind}>, n_tokens array<long>, n_ids long, first_symbol int, rules binary, rule_lengths binary, body binary")
    shards.write.mode("overwrite").parquet(path)


def read_ids(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, part, seq, at, n_tokens, ids_crc32[, ids]) of the documents in shard rows; at: ids before it in its shard."""
    kind = dict(shards.dtypes)["doc_ids"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                x = {n: b.column(n)[row].as_py() for n in b.schema.names if n != "doc_ids"}
                rules = np.frombuffer(x["rules"], np.int32).reshape(-1, 2).astype(np.int64)
                lengths = np.frombuffer(x["rule_lengths"], np.int32).astype(np.int64)
                ids = expand(np.frombuffer(x["body"], np.int32).astype(np.int64), rules, lengths, x["first_symbol"]).astype("<u4")
                sizes = np.array(x["n_tokens"], np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, sizes)]
                doc_ids = b.column("doc_ids")[row].values
                out = [doc_ids, pa.array(np.full(len(sizes), x["part"], np.int32)), pa.array(np.full(len(sizes), x["seq"], np.int32)), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                names = ["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return shards.mapInArrow(run, f"doc_id {kind}, part int, seq int, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def fetch(shards: DataFrame, doc_ids: list) -> DataFrame:
    """(doc_id, ids) of the documents named in a bounded list, each found and expanded on its own."""
    kind = dict(shards.dtypes)["doc_ids"][6:-1]
    wanted = set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                found = [(d, document(row, k)) for k, d in enumerate(row["doc_ids"]) if d in wanted]
                id_type = b.schema.field("doc_ids").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], id_type), pa.array([x.astype(np.int32) for _, x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    some = shards.where(F.arrays_overlap("doc_ids", F.array(*(F.lit(d).cast(kind) for d in doc_ids))))
    return some.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, shard_start): ids in all shards before; the unsplit window is over parts only."""
    sizes = shards.select("part", "seq", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("inner")).alias("shard_start"))


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from files written for docs.

    See write_ids for nulls, ties and repeated rows; an empty table gives an empty result.
    """
    path = new_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer_path, **options)
    shards = docs.sparkSession.read.parquet(path)
    found = read_ids(shards).join(shard_starts(shards), ["part", "seq"])
    return found.select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
