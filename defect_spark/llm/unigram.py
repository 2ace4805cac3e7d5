"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

White space is written as the marker U+2581 with one marker before the text. No piece holds a
marker after another character, so the best segmentation of a text is made of the best
segmentations of its words (a run of markers and what follows); each different word is solved
once per worker, many words at a time, and kept in a bounded memo.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from defect_spark.llm.byte_bpe import Memo
from defect_spark.llm.common import pairs_of

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: What an unknown character costs below the worst piece, as in the public library.
UNKNOWN_PENALTY = 10.0


class DoubleArray:
    """A trie over code points: the child of state s by character c is base[s] + code(c), if check there is s."""

    def __init__(self, words: list[str], values: list[int]):
        letters = [ord(c) for c, _ in Counter(chain.from_iterable(words)).most_common()]  # common ones lie close together
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[letters] = np.arange(1, len(letters) + 1)
        tree: list[dict[int, int]] = [{}]
        value = [-1]
        for w, v in zip(words, values):
            at = 0
            for c in w:
                k = int(self.codes[ord(c)])
                if k not in tree[at]:
                    tree.append({})
                    value.append(-1)
                    tree[at][k] = len(tree) - 1
                at = tree[at][k]
            value[at] = v
        size = 2 * len(tree) + 2 * len(letters) + 16
        used = np.zeros(size, bool)
        used[0] = True
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        place, free = {0: 0}, 1
        order = [0]
        for node in order:
            kids = tree[node]
            if not kids:
                continue
            keys = np.array(sorted(kids))
            while used[free]:
                free += 1
            low, step = max(free, int(keys[0]) + 1), 256
            while True:
                if low + step + int(keys[-1]) >= len(used):
                    grow = len(used) + step
                    used = np.r_[used, np.zeros(grow, bool)]
                    self.base, self.check, self.value = np.r_[self.base, np.zeros(grow, np.int32)], np.r_[self.check, np.full(grow, -1, np.int32)], np.r_[self.value, np.full(grow, -1, np.int32)]
                starts = low + np.flatnonzero(~used[low : low + step]) - int(keys[0])
                if len(keys) > 1 and len(starts):
                    for k in keys[1:]:
                        starts = starts[~used[starts + k]]
                if len(starts):
                    start = int(starts[0])
                    break
                low, step = low + step, 2 * step
            here = place.pop(node)
            self.base[here] = start
            used[start + keys] = True
            for k in keys.tolist():
                at = start + k
                self.check[at] = here
                self.value[at] = value[kids[k]]
                place[kids[k]] = at
                order.append(kids[k])
        last = int(np.flatnonzero(used)[-1]) + len(letters) + 2
        pad = max(0, last - len(self.base))
        self.base, self.check, self.value = np.r_[self.base, np.zeros(pad, np.int32)][:last], np.r_[self.check, np.full(pad, -1, np.int32)][:last], np.r_[self.value, np.full(pad, -1, np.int32)][:last]


class UnigramModel:
    """Pieces, scores and types of a model file, ready to encode and decode."""

    def __init__(self, path: str, memo: int = 300_000):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.pieces = [p.piece for p in model.pieces]
        self.types = np.array([p.type for p in model.pieces])
        self.scores = np.array([p.score for p in model.pieces], np.float64)
        usable = [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in usable):
            raise ValueError("a piece has a white-space marker after another character")
        self.trie = DoubleArray([self.pieces[i] for i in usable], usable)
        self.unknown = int(np.flatnonzero(self.types == UNKNOWN)[0])
        self.unknown_score = float(self.scores[usable].min()) - UNKNOWN_PENALTY
        found = {int(self.pieces[i][3:5], 16): i for i in np.flatnonzero(self.types == BYTE)}
        self.byte_ids = np.array([found.get(b, self.unknown) for b in range(256)], np.int32)
        self.has_bytes = len(found) == 256
        self.memo = Memo(memo)

    def solve(self, words: list[str]) -> list[bytes]:
        """The ids of each word as int32 bytes: the highest sum of scores, on a tie the shortest last piece."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(text)
        code = self.trie.codes[text]
        stop = np.repeat(np.cumsum(lengths), lengths)  # where the word of each position ends
        start = np.arange(n)
        state, live, at = np.zeros(n, np.int64), np.arange(n), np.arange(n)
        edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.zeros(n, bool)
        depth = 0
        while len(live):  # one more character for every start that is still in the trie
            c = code[at]
            to = self.trie.base[state] + c
            ok = (c > 0) & (self.trie.check[to] == state) & (self.trie.base[state] > 0)
            live, to, at = live[ok], to[ok], at[ok] + 1
            piece = self.trie.value[to]
            hit = piece >= 0
            edges.append((live[hit], at[hit], piece[hit].astype(np.int64)))
            if depth == 0:
                single[live[hit]] = True
            more = at < stop[live]
            live, state, at = live[more], to[more], at[more]
            depth += 1
        lone = start[~single]
        edges.append((lone, lone + 1, np.full(len(lone), -1, np.int64)))
        a, b, piece = (np.concatenate(x) for x in zip(*edges))
        score = np.where(piece >= 0, self.scores[piece], self.unknown_score)
        begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
        end_in_word = b - begin[a]
        order = np.lexsort((-a, end_in_word))
        a, b, piece, score, end_in_word = a[order], b[order], piece[order], score[order], end_in_word[order]
        # best[i + word]: of the prefix ending before position i; one slot more than characters for each word
        slot = lambda pos, word: pos + word
        word = np.repeat(np.arange(len(words)), lengths)
        best = np.full(n + len(words), -np.inf)
        best[slot(np.cumsum(lengths) - lengths, np.arange(len(words)))] = 0.0
        via = np.full(n + len(words), -1, np.int64)
        cut = np.searchsorted(end_in_word, np.arange(1, int(lengths.max(initial=0)) + 2))
        for k in range(len(cut) - 1):
            some = slice(cut[k], cut[k + 1])
            reach = best[slot(a[some], word[a[some]])] + score[some]
            target = slot(b[some], word[a[some]])
            if not len(target):
                continue
            # a stable sort by score within a target keeps the shortest of the equal ones first
            by = np.lexsort((-reach, target))
            target, reach, edge = target[by], reach[by], np.arange(cut[k], cut[k + 1])[by]
            first = np.r_[True, target[1:] != target[:-1]]
            best[target[first]], via[target[first]] = reach[first], edge[first]
        # walk back all words at once
        pos, at_word = np.cumsum(lengths).copy(), np.arange(len(words))
        floor = np.cumsum(lengths) - lengths
        picked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        open_ = pos > floor
        while open_.any():
            pos, at_word = pos[open_], at_word[open_]
            e = via[slot(pos, at_word)]
            picked.append((at_word, a[e], piece[e]))
            pos = a[e]
            open_ = pos > floor[at_word]
        if not picked:
            return [b""] * len(words)
        w, p, ids = (np.concatenate(x) for x in zip(*picked))
        order = np.argsort(p, kind="stable")
        w, p, ids = w[order], p[order], ids[order]
        size = np.bincount(w, minlength=len(words))
        out, at = [], 0
        for i, k in enumerate(size.tolist()):
            mine = ids[at : at + k]
            if (mine < 0).any():
                parts: list[int] = []
                for q, x in zip(p[at : at + k].tolist(), mine.tolist()):
                    parts += [x] if x >= 0 else self.fallback(words[i][q - int(floor[i])])
                out.append(np.array(parts, np.int32).tobytes())
            else:
                out.append(mine.astype(np.int32).tobytes())
            at += k
        return out

    def fallback(self, char: str) -> list[int]:
        return self.byte_ids[list(char.encode())].tolist() if self.has_bytes else [self.unknown]

    def words(self, text: str) -> list[str]:
        """Words without their first marker; an empty one stands for a further marker of a run."""
        return text.split(" ") if text else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = []
        for t in texts:
            parts = self.words(t.replace(MARK, " "))
            if "" in parts:  # runs of white space: glue the markers to the word that follows
                glued, run = [], 0
                for p in parts[:-1]:
                    if p:
                        glued.append(MARK * run + p)
                        run = 0
                    else:
                        run += 1
                glued.append(MARK * run + parts[-1])
                parts = glued
            cut.append(parts)
        seen = set(chain.from_iterable(cut))
        known = {k: self.memo.get(k) for k in seen}
        todo = [k for k, v in known.items() if v is None]
        for at in range(0, len(todo), 1 << 15):
            some = todo[at : at + (1 << 15)]
            for k, made in zip(some, self.solve([MARK + k for k in some])):
                known[k] = made
                self.memo.put(k, made)
        return [np.frombuffer(b"".join(map(known.__getitem__, parts)), np.int32) for parts in cut]

    def surfaces(self) -> list[bytes]:
        """What each id adds to a decoded text, markers as spaces."""
        out = []
        for piece, kind in zip(self.pieces, self.types.tolist()):
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                out.append(b"")
            elif kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append(piece.replace(MARK, " ").encode())
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces joined, markers to spaces, the leading marker dropped."""
        if not hasattr(self, "_surfaces"):
            self._surfaces = self.surfaces()
        text = b"".join(map(self._surfaces.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_loaded: dict[str, UnigramModel] = {}


def model(path: str) -> UnigramModel:
    if path not in _loaded:
        _loaded[path] = UnigramModel(path)
    return _loaded[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the unigram ids of each whole text and what they decode to.

    decoded is the text again (a marker character in it comes back as a space). Null and empty
    texts have no ids and decode to ''. Rows come out as they come in, repeats and all; an empty
    table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                cut = b.slice(at, 256)
                made = m.encode([t or "" for t in cut.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, made)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(made) if made else np.zeros(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([cut.column(0), ids, pa.array([m.decode(x) for x in made], pa.string())], ["doc_id", "ids", "decoded"])

    docs = pairs_of(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string")
