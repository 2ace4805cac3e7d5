"""Packing: every id once, full windows, and the neighbours that plain BM25 gives."""

import math
import zlib
from collections import Counter

import numpy as np

from defect_spark.llm import packing
from defect_spark.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
PATH = tokenizer("byte_bpe_50k.json")


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def brute_windows(docs, width, held, n_docs, mean):
    """The windows of one shard, with BM25 in plain loops."""
    rests = [d[len(d) // width * width :] for d in docs]
    left, start = [len(r) for r in rests], [0] * len(rests)
    idf = {i: math.log1p((n_docs - n + 0.5) / (n + 0.5)) for i, n in held.items()}
    out = []
    while any(left):
        seed = max(range(len(left)), key=lambda k: (left[k], -k))
        made, room = [(seed, start[seed], left[seed])], width - left[seed]
        left[seed] = 0
        score = {}
        for k in range(len(left)):
            tf = Counter(rests[k])
            score[k] = sum(idf[i] * tf[i] * 2.2 / (tf[i] + 1.2 * (0.25 + 0.75 * len(rests[k]) / mean)) for i in sorted(set(rests[seed])) if tf[i])
        order = sorted((k for k in range(len(left)) if left[k]), key=lambda k: (-round(score[k], 9), k))
        for k in order:
            if left[k] <= room:
                made.append((k, start[k], left[k]))
                room -= left[k]
                left[k] = 0
        for k in order:
            if room and left[k]:
                made.append((k, start[k], room))
                start[k] += room
                left[k] -= room
                room = 0
        out.append(made)
    return out


def check(rows, docs, width):
    """Pieces cover each document once and in order; sequences have no gap and no padding."""
    want = Counter((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in docs)
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for some in by_seq.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == width or at < width and at & (at - 1) == 0
    return want, by_doc, by_seq


def test_pieces_of_given_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    ids = encoded([t for _, t in docs])
    rows = packing.pack(table, PATH, shard_ids=1 << 15).collect()
    want, by_doc, by_seq = check(rows, list(zip((d for d, _ in docs), ids)), 1024)
    for (d, n), some in by_doc.items():
        joined = [i for r in sorted(some, key=lambda r: r.start) for i in r.ids]
        assert len(joined) == n and want[d, n, zlib.crc32(np.array(joined, "<u4").tobytes())]
    assert len(by_doc) == len(docs)
    full = sum(1 for s in by_seq.values() if sum(r.length for r in s) == 1024)
    assert full == sum(map(len, ids)) // 1024 or full > 0.9 * sum(map(len, ids)) / 1024


def test_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").coalesce(1)
    docs = table.collect()
    ids = encoded([r.text for r in docs])
    held = Counter(i for d in ids for i in set(d))
    rows = packing.pack(table, PATH, width=256).coalesce(1).collect()
    windows = brute_windows(ids, 256, held, len(ids), sum(map(len, ids)) / len(ids))
    place = {r.doc_id: k for k, r in enumerate(docs)}
    found = {}
    for r in rows:
        cut = len(ids[place[r.doc_id]]) // 256 * 256
        if r.start >= cut:
            found.setdefault(r.sequence_id, []).append((r.offset, (place[r.doc_id], r.start - cut, r.length)))
    made = [[x for _, x in sorted(v)] for _, v in sorted(found.items())]
    assert made[: len(windows) - 1] == windows[:-1]
    assert sum(n for s in made[len(windows) - 1 :] for _, _, n in s) == sum(n for _, _, n in windows[-1])


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (None, "one"), (4, "one"), (4, "one"), (5, "word " * 30_000), (6, "é 漢字 \n\n ")]
    table = spark.createDataFrame([(*d, 1, b"") for d in docs], "doc_id long, text string, start int, ids binary")
    ids = encoded([t for _, t in docs])
    rows = packing.pack(table, PATH).collect()
    _, by_doc, _ = check(rows, list(zip((d for d, _ in docs), ids)), 1024)
    assert sum(r.length for r in rows) == sum(map(len, ids))
    assert {k: sum(r.length for r in v) for k, v in by_doc.items() if k[0] == 5} == {(5, len(ids[5])): len(ids[5])}
    empty = packing.pack(table.where("false"), PATH)
    assert empty.count() == 0 and "sequence_id" in empty.columns
