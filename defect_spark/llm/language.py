"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a sample of its labelled texts. A whole text is parsed
from left to right into longest matches of an automaton (a byte that the automaton doesn't know
is a phrase of its own); the language with the fewest normalised phrases wins. Texts and samples
are lower-cased, anything but letters becomes one space, and UTF-8 bytes are the symbols. With n
bytes of sample and m of text, c phrases mean an estimated cross entropy of c * log2(n) / m bits
a byte, which is what languages are compared by.

An automaton becomes one table: the entry of a state and a byte has the next state and whether a
phrase begins there. Texts of a batch are parsed side by side, a byte of each at a time; the few
longest ones are finished one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defect_spark.llm.common import pairs_of

UNDETERMINED = "und"
#: ASCII bytes that are not letters to spaces; the bytes of other characters stay.
LETTER_BYTES = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
#: Texts that are parsed together, in bytes; fewer than FEW are parsed one by one.
BATCH, FEW = 4 << 20, 32


def letters_of(text: str | None) -> bytes:
    """The lower-cased words of a text between single spaces, as UTF-8; empty without letters."""
    text = (text or "").lower()
    if not text.isascii():
        odd = [c for c in set(text) if c > "\x7f" and not c.isalpha()]
        if odd:
            text = text.translate(dict.fromkeys(map(ord, odd), " "))
    bare = b" ".join(text.encode().translate(LETTER_BYTES).split())
    return b" " + bare + b" " if bare else b""


class SuffixAutomaton:
    """All substrings of a sequence; a state is a dict of its transitions."""

    def __init__(self, text):
        self.next: list[dict] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new


    def phrases(self, text) -> int:
        """How many longest matches make up the text; an unknown symbol is a phrase."""
        count, state = 0, 0
        for c in text:
            to = self.next[state].get(c)
            count += to is None or state == 0
            state = self.next[0].get(c, 0) if to is None else to
        return count


class CrossParser:
    """The automata of all languages as one table, built from their samples; made once per worker."""

    def __init__(self, learned: dict[str, str]):
        self.langs = sorted(learned)
        samples = [letters_of(learned[k]) for k in self.langs]
        self.bits = np.log2([max(2, len(s)) for s in samples])
        known = sorted(set(b"".join(samples)))
        self.code = np.zeros(256, np.uint8)  # 0: in no sample
        self.code[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        # a sample of n bytes has fewer than 2 n states; entries are twice their places
        entry = np.int32 if 2 * sum(map(len, samples)) * self.width < 1 << 30 else np.int64
        tables, rows = [], 0
        self.roots = []
        for sample in samples:
            states = SuffixAutomaton(self.code[np.frombuffer(sample, np.uint8)].tolist()).next
            base = rows * self.width
            self.roots.append(base)
            # from any state a byte that doesn't go on begins a phrase, as from the root
            root = np.full(self.width, base << 1 | 1, entry)
            for c, to in states[0].items():
                root[c] = (base + to * self.width) << 1 | 1
            table = np.tile(root, (len(states), 1))
            at = np.repeat(np.arange(1, len(states)), [len(s) for s in states[1:]])
            cs = np.fromiter((c for s in states[1:] for c in s), np.int64, len(at))
            table[at, cs] = (base + np.fromiter((to for s in states[1:] for to in s.values()), np.int64, len(at)) * self.width) << 1
            tables.append(table.ravel())
            rows += len(states)
            del states
        self.table = np.concatenate(tables) if tables else np.zeros(0, entry)
        self.one_by_one = memoryview(self.table)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """How many longest matches make up each text, in each language."""
        count = np.zeros((len(texts), len(self.langs)), np.int64)
        if not self.langs or not texts:
            return count
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        codes = self.code[np.frombuffer(b"".join(texts), np.uint8)].astype(self.table.dtype)
        at = (np.cumsum(size) - size)[order]
        size = size[order]
        state = np.tile(np.array(self.roots, self.table.dtype), (len(texts), 1))
        made = np.zeros_like(state)
        step, here = np.empty_like(state), np.empty(len(texts), self.table.dtype)
        live = len(texts) - np.searchsorted(size[::-1], np.arange(size[0]), "right")  # texts longer than t
        done = 0
        for done, n in enumerate([*live.tolist(), 0]):
            if n < FEW:
                break
            np.take(codes, at[:n], out=here[:n], mode="clip")
            np.add(state[:n], here[:n, None], out=step[:n])
            np.take(self.table, step[:n], out=state[:n], mode="clip")
            np.bitwise_and(state[:n], 1, out=step[:n])
            made[:n] += step[:n]
            state[:n] >>= 1
            at[:n] += 1
        for k in range(int(np.sum(size > done))):
            rest = codes[at[k] : at[k] + size[k] - done].tolist()
            for j in range(len(self.langs)):
                s, n, table = int(state[k, j]), 0, self.one_by_one
                for c in rest:
                    s = table[s + c]
                    n += s & 1
                    s >>= 1
                made[k, j] += n
        count[order] = made
        return count

    def judged(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, scores, whether there are letters)."""
        bare = list(map(letters_of, texts))
        size = np.fromiter(map(len, bare), np.int64, len(bare))
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), size > 0
        entropy = self.phrases(bare) * self.bits / np.maximum(size, 1)[:, None]
        best = np.argmin(entropy, axis=1)
        score = np.ones(len(texts))
        if len(self.langs) > 1:
            two = np.partition(entropy, 1, axis=1)
            score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-300)
        langs = [self.langs[k] if n else UNDETERMINED for k, n in zip(best.tolist(), size.tolist())]
        return langs, np.where(size > 0, score, 0.0), size > 0


def learn(docs: DataFrame, rows_a_language: int = 100, bytes_a_language: int = 64_000, text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """The sample of each language, its whole texts joined by spaces.

    It is drawn from the ``rows_a_language`` different labelled texts with the smallest hashes: in
    that order each text whose letters still fit into ``bytes_a_language`` is taken, and if none
    does the shortest. So long texts are passed over more often. Null languages and texts without
    letters are left out; copies of a text are one.
    """
    docs = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(text_col)).alias("h")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # by leading zeros of the hash: the levels above the cut hold enough rows, and not twice as many
    level = (64 - F.length(F.bin("h"))).alias("level")
    levels = docs.select("lang", "h").distinct().groupBy("lang", level).agg(F.count("*").alias("n"))
    down = Window.partitionBy("lang").orderBy(F.desc("level"))
    cuts = levels.select("lang", "level", (F.sum("n").over(down) - F.col("n")).alias("above")).where(F.col("above") < rows_a_language).groupBy("lang").agg(F.min("level").alias("cut"))
    some = docs.join(F.broadcast(cuts), "lang").where(level >= F.col("cut"))  # one row a language
    some = some.groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(level), "h", "text"))).where(F.col("k") <= rows_a_language)
    texts: dict[str, list[str]] = {}
    for r in first.select("lang", "k", "text").orderBy("lang", "k").toLocalIterator():
        texts.setdefault(r.lang, []).append(letters_of(r.text).decode().strip())
    out = {}
    for lang, found in texts.items():
        taken, held = [], 0
        for t in found:
            if held + len(t.encode()) + 1 <= bytes_a_language:
                taken.append(t)
                held += len(t.encode()) + 1
        out[lang] = " ".join(taken or [min(found, key=len)])
    return out


_made: tuple[dict, CrossParser] | None = None


def parser_for(learned: dict[str, str]) -> CrossParser:
    global _made
    if _made is None or _made[0] != learned:
        _made = (learned, CrossParser(learned))
    return _made[1]


def with_language(docs: DataFrame, learned: dict[str, str], text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and has_letters.

    ``und`` with score 0 if the text is null or has no letters, or nothing was learned. The score
    is the winner's lead in entropy over the next, 0 to 1; 1 if there is no other. Equal entropies
    go to the language that comes first by name. Rows come out as they come in, repeats and all;
    an empty table gives an empty result; other columns come along, ones with those three names
    are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("has_letters", T.BooleanType())]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in {f.name for f in new}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_for(shared.value)
        for b in batches:
            text = b.column(b.schema.get_field_index(text_col))
            cost = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)) // BATCH
            cuts = [0, *(np.flatnonzero(np.diff(cost)) + 1).tolist(), b.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                part = b.slice(low, high - low)
                langs, score, letters = parser.judged(text.slice(low, high - low).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(letters)], [*b.schema.names, *(f.name for f in new)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


def identify(docs: DataFrame, learned: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every text; see with_language."""
    return with_language(pairs_of(docs, id_col, text_col), learned).select("doc_id", "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
