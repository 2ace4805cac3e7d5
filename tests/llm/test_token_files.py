"""Token files and section counts against the tokenizers library on whole texts."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from defect_spark.llm import byte_bpe, repair, token_counts
from defect_spark.llm.queries import tokenizer

PATH = tokenizer("byte_bpe_50k.json")
PARTS = [*"abAB19'.,!é漢 \n\t\r 　_-", "  ", "\n\n", "<|endoftext|>", "'s", " \n", "\n ", "\x1c", "​", "😀"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n):
    rng = random.Random(1)
    words = ["ab", "é", "x'll", "12", "!?", "漢字", "don't", "\n"]
    some = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(n)]
    return some + [" ".join(rng.choice(words) for _ in range(rng.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("what", ["ids", "spans"])
def test_encoder_is_the_library(library, what):
    texts = odd_texts(2000)
    enc = byte_bpe.Encoder(PATH, what, memo=500)
    for at in range(0, len(texts), 64):
        for text, got in zip(texts[at : at + 64], enc.texts(texts[at : at + 64])):
            want = library.encode(text, add_special_tokens=False)
            assert got.tolist() == (want.ids if what == "ids" else [list(x) for x in want.offsets])


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, 30, int(rng.integers(0, 40))) for _ in range(60)]
    docs = [np.r_[texts[k], 0] for k in rng.integers(0, 60, 400)] + [np.zeros(1, np.int64)] * 50 + [np.r_[np.full(300, 5), 0]]
    ids, sizes = np.concatenate(docs), [len(d) for d in docs]
    rules, seq = repair.compress(ids, 100)
    lengths = repair.expansion_lengths(rules, 100)
    assert np.array_equal(repair.expand(seq, rules, lengths, 100), ids)
    last = {k: k for k in range(100)}
    for k, (a, b) in enumerate(rules.tolist()):
        assert last[a] != 0  # no rule joins two documents
        last[100 + k] = last[b]
    pairs = Counter((a, b) for a, b in zip(seq[:-1].tolist(), seq[1:].tolist()) if last[a] != 0)
    # a frequent pair that is left overlaps itself, as in a run of one symbol
    assert all(n < 4 or a == b for (a, b), n in pairs.items())
    assert len(seq) + 3 * len(rules) < len(ids) / 2
    shard = {"first_symbol": 100, "n_tokens": sizes} | {k: x.astype(np.int32).tobytes() for k, x in (("rules", rules), ("rule_lengths", lengths), ("body", seq))}
    for k, d in enumerate(docs):
        assert repair.document(shard, k).tolist() == d.tolist()
    for some in (np.zeros(0, np.int64), np.zeros(1, np.int64), np.full(9, 7), np.zeros(9, np.int64)):
        rules, seq = repair.compress(some, 100)
        assert np.array_equal(repair.expand(seq, rules, repair.expansion_lengths(rules, 100), 100), some)


def test_token_files_match_the_library(spark, library, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(odd_texts(100))] + [(20_000, None), (20_001, "")], "doc_id long, text string")
    both = docs.union(odd).repartition(3)
    start, want, ids = 0, {}, {}
    for r in sorted(both.collect()):
        ids[r.doc_id] = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id] = (start, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
        start += len(ids[r.doc_id])
    for options in ({}, {"shard_ids": 5000}):
        got = repair.round_trip(both, PATH, **options).collect()
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(want)
    path = str(tmp_path / "ids")
    repair.write_ids(both, path, PATH, shard_ids=5000)
    some = sorted(ids)[::7]
    found = repair.fetch(spark.read.parquet(path), some).collect()
    assert {r.doc_id: r.ids for r in found} == {d: ids[d] for d in some} and len(found) == len(some)
    assert repair.round_trip(both.where("false"), PATH).count() == 0


def brute_counts(spans, text, rule):
    """Tokens of each line of a text, character by character."""
    section, lines = [], text.split("\n")
    for k, line in enumerate(lines):
        section += [k] * (len(line) + (k < len(lines) - 1))
    out = [0.0] * len(lines)
    for start, end in spans:
        owners = [section[c] for c in range(start, max(end, start + 1))]
        if rule == "start":
            out[owners[0]] += 1
        elif rule == "split":
            for k in owners:
                out[k] += 1 / len(owners)
        else:
            out[max(sorted(set(owners)), key=owners.count)] += 1
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_match_brute_force(spark, library, rule):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(10_000 + k, t) for k, t in enumerate([*odd_texts(150), "a\n\n\n\n\n  b", None, "", "\n\n\n", "word " * 3000])]
    both = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {}
    for r in token_counts.token_counts(both, PATH, rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.start, r.end, r.n_tokens, r.doc_tokens)
    rows = both.collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        text = r.text or ""
        spans = library.encode(text, add_special_tokens=False).offsets
        want = brute_counts(spans, text, rule)
        mine = [got[r.doc_id][k] for k in range(len(want))]
        assert np.allclose([m[2] for m in mine], want) and {m[3] for m in mine} == {len(spans)}
        assert "".join(text[m[0] : m[1]] for m in mine) == text


def test_token_counts_of_no_rows(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string, section int"), PATH).count() == 0
