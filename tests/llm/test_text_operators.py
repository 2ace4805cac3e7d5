"""The text operators against brute force, round trips and held-out labels, with awkward rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from defect_spark.llm import byte_bpe, chat, decontaminate, language, licenses, line_dedup, quality, repair, simhash, token_counts, unigram
from defect_spark.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "one"), (5, "word " * 30_000), (6, "é 漢字 \\ </turn> ### x: y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(a, b, "en", 1, True) for a, b in AWKWARD], "doc_id long, text string, lang string, h int, at boolean")


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "\\b\\h\\e", "", None, "</turn", "### ", "a: b", "\\\\h"]
    rows = [(k, t, r, x) for k in range(3) for t, (r, x) in enumerate([(r, x) for r in ("user", "assistant", None, "a: b") for x in hard])] + [(None, None, None, None)]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert all(r.round_trip for r in made.collect())
    report = {r.conv_id: r for r in chat.digest(made).collect()}
    assert report[0].n_turns == 32 and report[0].loss_chars == sum(len(x or "") for x in hard)
    assert made.where("false").count() == 0


def brute_runs(docs, least):
    first, out = {}, {}
    for d in sorted(docs):
        lines = [(k, x.strip(" \t\x0b\x0c\r")) for k, x in enumerate(docs[d].split("\n"))]
        lines = [x for x in lines if x[1]]
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(len(x.split()) for _, x in lines[i : j + 1]) >= least:
                    key = tuple(x for _, x in lines[i : j + 1])
                    if first.setdefault(key, (d, i)) != (d, i):
                        out.setdefault(d, set()).update(range(lines[i][0], lines[j][0] + 1))
                    break
            for h in range(i, -1, -1):
                if sum(len(x.split()) for _, x in lines[h : i + 1]) >= least:
                    key = tuple(x for _, x in lines[h : i + 1])
                    if first.setdefault(key, (d, h)) != (d, h):
                        out.setdefault(d, set()).update(range(lines[h][0], lines[i][0] + 1))
                    break
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = {d: "\n".join(" ".join(["w%d" % x] * int(x % 4)) for x in rng.integers(0, 12, 25)) for d in range(12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: set(r.gone) for r in line_dedup.repeated_lines(df, 8).collect()} == brute_runs(texts, 8)


def test_line_dedup_awkward(awkward):
    done = line_dedup.dedup_lines(awkward)
    assert done.count() == len(AWKWARD) and done.columns == [*awkward.columns, "n_lines_removed"]
    assert done.where("doc_id = 1").first().text is None
    assert line_dedup.dedup_lines(awkward.where("false")).count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame([("a", "one two three"), ("b", " ".join("abcdefghijkl")), (None, None)], "item_id string, text string")
    df = spark.createDataFrame([(1, "x One, two three y"), (2, "z b c d e f g h i j k q"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.digest(decontaminate.find_items(df, items)).collect()}
    assert got == {1: (3, 1), 2: (10, 1), 3: (0, 0)}


def test_language_held_out(docs, awkward):
    words = language.learn(docs.where(~language.held_out()))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = language.identify(docs, words).select("doc_id", "lang_pred", language.held_out().alias("held_out")).collect()
    held = [r for r in out if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    got = [(r.doc_id, r.lang_pred) for r in language.identify(awkward, words).collect()]
    assert len(got) == len(AWKWARD) and {k for k, v in got if v == "und"} == {1, 2, 3}
    assert {r.lang_pred for r in language.identify(awkward, {}).collect()} == {"und"}


def test_suffix_automaton_phrases():
    text = "abracadabra "
    parser = language.SuffixAutomaton(text)
    for word in ("abra", "cadx", "zzz", "rabb", ""):
        at, n = 0, 0
        while at < len(word):
            k = max((j for j in range(1, len(word) - at + 1) if word[at : at + j] in text), default=1)
            at, n = at + k, n + 1
        assert parser.phrases(word) == n


def test_quality_statistics(docs, awkward):
    for df in (docs, awkward):
        texts = Counter()
        for r in df.collect():
            t = r.text or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            cover = {k for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            texts[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)] += 1
        got = quality.statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert Counter(map(tuple, got)) == texts


def test_quality_keeps_clean(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    done = quality.quality(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    good = [r for r in done if r.quality == 1]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert quality.quality(docs, labels.where("false")).where("kept = base_failed").count() == 0


def test_token_ids_round_trip(awkward):
    path = tokenizer("byte_bpe_50k.json")
    enc = byte_bpe.Encoder(path, "ids")
    expected = Counter((a, len(i) + 1, zlib.crc32(np.r_[i, 0].astype("<u4").tobytes())) for (a, b), i in zip(AWKWARD, enc.texts([b or "" for _, b in AWKWARD])))
    got = repair.round_trip(awkward, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(s + n == t for (s, n), (t, _) in zip(starts, starts[1:])) and starts[0][0] == 0


def test_token_counts_sum(awkward):
    for rule in token_counts.RULES:
        out = token_counts.token_counts(awkward.where("doc_id = 6 or doc_id = 3"), tokenizer("byte_bpe_50k.json"), rule).collect()
        for d in (3, 6):
            mine = [r for r in out if r.doc_id == d]
            assert abs(sum(r.n_tokens for r in mine) - mine[0].doc_tokens) < 1e-9


def test_pieces_round_trip(awkward):
    out = unigram.encode(awkward, tokenizer("piece_bpe_32k.model")).collect()
    assert Counter((r.doc_id, r.decoded) for r in out) == Counter((a, b or "") for a, b in AWKWARD)


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(docs):
    rows = docs.collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for bands in (None, 1, 2):
        got = simhash.near_duplicates(docs, shard_points=32, bands=bands).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{p:016x}", root(d)) for d, p in prints.items()}


def test_simhash_links_within_match_all_pairs():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (3000, 2), dtype=np.uint64)).sum(1, dtype=np.uint64)
    points = np.unique(seeds[rng.integers(0, 60, 3000)] ^ flips)
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    for mask in simhash.band_masks(4):
        root = simhash.links_within(points, np.ones(len(points), bool), 3, mask, 0, block=4096)
        forest = simhash.Forest(len(points))
        forest.join(*np.nonzero(close & ((points[:, None] ^ points[None, :]) & mask == 0)))
        want = forest.roots(np.arange(len(points)))
        pairs = set(zip(root.tolist(), want.tolist()))
        # the search may link more than the band's pairs, never fewer
        assert all(len({r for r, w in pairs if w == k}) == 1 for k in set(want.tolist()))


def test_licenses_match_brute_force(docs, awkward):
    def brute(text):
        out = []
        for line in (text or "").lower().split("\n"):
            g = licenses.bigrams(line)
            scores = [2 * len(g & licenses.bigrams(t)) / (len(g) + len(licenses.bigrams(t))) for ts in licenses.TEMPLATES.values() for t in ts]
            out += [max(scores)] if max(scores) >= 0.8 else []
        return out

    got = {r.doc_id: [m.score for m in r.matches if m.kind == "line"] for r in licenses.scan(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}
    assert licenses.scan(awkward).count() == len(AWKWARD)
