"""Packing of documents into windows by lexical retrieval.

Documents are encoded once and written. Token counts over all documents give BM25's document
frequencies and mean length. Each task then reads its documents in shards of bounded size: whole
windows of a document stand alone, and its rest goes into the shard's inverted index. The longest
unused rest is a seed; its neighbours by BM25 that are unused fill its window in order of score,
those that fit whole first, then the best one cut to what is left. So every window is full but the
last of a shard, which is laid out in sequences whose lengths are powers of two.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defect_spark.llm.byte_bpe import batches_of, encoder, gathered
from defect_spark.llm.common import new_path, pairs_of

K1, B = 1.2, 0.75  # BM25's usual constants


def vocabulary_size(tokenizer_path: str) -> int:
    """One more than the highest id of a vocabulary file."""
    with open(tokenizer_path, encoding="utf-8") as f:
        made = json.load(f)
    return 1 + max([*made["model"]["vocab"].values(), *(t["id"] for t in made["added_tokens"])])


def write_encoded(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, end_id: int) -> None:
    """Rows (doc_id, ids) of docs, and a row a task of (n_docs, n_ids, counts): documents that hold each id."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    names = ["doc_id", "ids", "n_docs", "n_ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, counts, n_docs, n_ids = encoder(tokenizer_path, "ids"), np.zeros(vocabulary, np.int64), 0, 0
        last, id_type = np.zeros(vocabulary, np.int64), None
        for b in batches:
            id_type = b.column(0).type
            for cut in batches_of(b, 1):
                made = [np.append(x, end_id) for x in enc.texts([t or "" for t in cut.column(1).to_pylist()])]
                sizes = np.fromiter(map(len, made), np.int64, len(made))
                for ids in made:  # an id counts at its last place in a document
                    places = np.arange(len(ids))
                    last[ids] = places
                    counts[ids[last[ids] == places]] += 1
                n_docs, n_ids = n_docs + len(made), n_ids + int(sizes.sum())
                none = pa.nulls(len(made), pa.int64())
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array([x.astype(kind).tobytes() for x in made], pa.binary()), none, none, pa.nulls(len(made), pa.binary())], names)
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([counts.tobytes()], pa.binary())], names)

    docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary, n_docs long, n_ids long, counts binary").write.parquet(path)


def statistics(written: DataFrame, vocabulary: int) -> tuple[int, int, np.ndarray]:
    """(documents, ids, documents that hold each id) of all documents; at most a number for each id of the vocabulary is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column(0):
                counts += np.frombuffer(x.as_buffer(), np.int64)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["id", "n"])

    rows = written.where("counts IS NOT NULL")
    sizes = rows.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_ids").alias("n_ids")).first()
    held = np.zeros(vocabulary, np.int64)
    for r in rows.select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        held[r.id] = r.n
    return sizes.n_docs or 0, sizes.n_ids or 0, held


class Index:
    """An inverted index of a shard's texts (arrays of ids), with BM25 weights by the statistics of all documents."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float):
        n = self.n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        keys, times = np.unique(np.concatenate(texts).astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)
        ids, self.text = np.divmod(keys, n)
        self.weight = idf[ids] * times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[self.text] / mean))
        opens = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        lists = np.cumsum(np.r_[True, ids[1:] != ids[:-1]]) - 1  # the posting list of each entry
        self.begin, self.size = opens, np.diff(np.r_[opens, len(ids)])
        by_text = np.argsort(self.text, kind="stable")
        self.lists, self.ends = lists[by_text], np.r_[0, np.cumsum(np.bincount(self.text, minlength=n))]

    def scores(self, text: int) -> np.ndarray:
        """The score of every text for the distinct ids of one of them."""
        asked = self.lists[self.ends[text] : self.ends[text + 1]]
        at = gathered(self.begin[asked], self.size[asked])
        return np.bincount(self.text[at], self.weight[at], self.n)


def windows(texts: list[np.ndarray], index: Index, width: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (text, start, length): a seed and the neighbours that fill it; only the last may be short."""
    left = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.zeros(len(texts), np.int64)
    while (seed := int(left.argmax())) >= 0 and left[seed]:
        made, room = [(seed, int(start[seed]), int(left[seed]))], width - int(left[seed])
        left[seed] = 0
        unused = np.flatnonzero(left) if room else []
        if len(unused):
            unused = unused[np.argsort(-index.scores(seed)[unused], kind="stable")]
            sizes, at = left[unused], 0
            while room:
                fits = sizes[at:] <= room
                step = int(fits.argmax()) if len(fits) else 0
                if not len(fits) or not fits[step]:
                    break
                at += step
                t = int(unused[at])
                made.append((t, int(start[t]), int(left[t])))
                room -= int(left[t])
                left[t] = 0
                at += 1
            rest = unused[left[unused] > 0]
            if room and len(rest):  # all of these are longer than the room
                t = int(rest[0])
                made.append((t, int(start[t]), room))
                start[t] += room
                left[t] -= room
                room = 0
        yield made


def laid_out(window: list[tuple[int, int, int]], width: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Sequences of (text, start, length, offset): a full window as it is, a short one cut into powers of two."""
    total = sum(n for _, _, n in window)
    sizes = [total] if total == width else [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    parts = iter(window)
    text, start, left = next(parts)
    for size in sizes:
        made, offset = [], 0
        while offset < size:
            if not left:
                text, start, left = next(parts)
            n = min(left, size - offset)
            made.append((text, start, n, offset))
            start, left, offset = start + n, left - n, offset + n
        yield made


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", width: int = 1024, end_id: int = 0, shard_ids: int = 1 << 19, shard_texts: int = 4096, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row a piece of a document.

    A document is its ids and end_id; null and empty texts have only that. start is the piece's
    place in its document, offset its place in its sequence. A sequence has ``width`` ids, or a
    power of two at a shard's end, so none is padded. A shard holds documents of one task up to
    ``shard_ids`` ids (less than a window of each) or ``shard_texts`` documents. Of equal scores
    the earlier row comes first; repeated rows and null ids are documents like any other. The
    encoded documents are written first, so a lost task repeats the same work on the same rows.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = pairs_of(docs, id_col, text_col)
    doc_kind = dict(docs.dtypes)["doc_id"]
    vocabulary = max(vocabulary_size(tokenizer_path), end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    path = new_path(spark, "encoded")
    write_encoded(docs, path, tokenizer_path, vocabulary, end_id)
    written = spark.read.parquet(path)
    n_docs, n_ids, held = statistics(written, vocabulary)
    shared = spark.sparkContext.broadcast(np.log1p((n_docs - held + 0.5) / (held + 0.5)))  # a number for each id of the vocabulary
    mean = n_ids / max(1, n_docs)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, sequence = shared.value, TaskContext.get().partitionId() << 32
        owners: list[tuple] = []  # (doc_id, where its rest begins, ids of the document)
        rests: list[np.ndarray] = []
        rows: list[tuple] = []
        total, id_type = 0, None

        def piece(doc_id, start: int, ids: np.ndarray, size: int, offset: int) -> None:
            row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), size, sequence, offset)
            rows.append(row + (ids.astype(np.int32),) if with_ids else row)

        def shard() -> None:
            nonlocal sequence
            for window in windows(rests, Index(rests, idf, mean), width):
                for made in laid_out(window, width):
                    for t, start, n, offset in made:
                        doc_id, before, size = owners[t]
                        piece(doc_id, before + start, rests[t][start : start + n], size, offset)
                    sequence += 1

        def out() -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 6, pa.list_(pa.int32())]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows.clear()
            return made

        for b in batches:
            id_type = b.column(0).type
            for doc_id, stored in zip(b.column(0), b.column(1)):
                ids, name = np.frombuffer(stored.as_buffer(), kind), doc_id.as_py()
                cut = len(ids) // width * width
                for at in range(0, cut, width):
                    piece(name, at, ids[at : at + width], len(ids), 0)
                    sequence += 1
                    if len(rows) >= 4096:
                        yield out()
                if cut < len(ids):
                    owners.append((name, cut, len(ids)))
                    rests.append(ids[cut:])
                    total += len(ids) - cut
                if total >= shard_ids or len(rests) >= shard_texts:
                    shard()
                    yield out()
                    owners, rests, total = [], [], 0
        if rests:
            shard()
        if rows:
            yield out()

    pieces = f"doc_id {doc_kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return written.where("counts IS NULL").select("doc_id", "ids").mapInArrow(run, pieces)
