"""Byte-level BPE encoding of whole texts with the tokenizers library, chunk by chunk.

The pre-tokenizer of these vocabularies never lets a token cross the space before a word or a
lone line break between words, so a text is cut there, each different chunk is encoded by the
library once per worker (a bounded memo), and the results are strung together. Nor does a token
cross from a letter or digit to a punctuation mark, so a chunk that ends in marks is put together
from the chunk without them. Texts with other runs of white space, or with a special token's
string, are encoded whole.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator
from itertools import repeat
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks that make a tail of a chunk, of at most TAIL of them; an apostrophe can begin a token with letters.
MARKS = string.punctuation.replace("'", "")
TAIL = 3
LATIN = pa.array([c for c in map(chr, range(0x250)) if c.isalnum()])
#: Texts that are encoded together, in bytes.
BATCH = 4 << 20

_loaded: dict[tuple[str, str], Encoder] = {}


class Memo:
    """A dict of bounded size: what was not used while the newer half filled up is forgotten."""

    def __init__(self, most: int):
        self.half, self.new, self.old = most // 2, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Codes(dict):
    """Numbers for chunks in order of appearance; new ones are listed in fresh."""

    def __init__(self):
        self.fresh: list[str] = []

    def of(self, chunks: np.ndarray) -> np.ndarray:
        """The numbers of chunks that differ from each other."""
        found = np.fromiter(map(self.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(found < 0)
        found[new] = np.arange(len(self), len(self) + len(new))
        some = chunks[new].tolist()
        self.update(zip(some, found[new].tolist()))
        self.fresh += some
        return found


class Grown:
    """An array that rows are appended to; its space doubles, so appending is cheap."""

    def __init__(self, dtype, *width: int):
        self.data, self.n = np.zeros((1024, *width), dtype), 0

    def add(self, rows: np.ndarray) -> None:
        stop = self.n + len(rows)
        if stop > len(self.data):
            more = np.zeros((max(stop, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : stop] = rows
        self.n = stop


def irregular(text: str) -> bool:
    """White space that merges with its neighbours, so that chunks would interact."""
    return "  " in text or " \n" in text or "\n\n\n" in text or "\n\n " in text or text[-1] == " " or text.endswith("\n\n")


def batches_of(rows: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """rows in slices with about BATCH bytes of the texts in a column; a longer text is alone."""
    cost = np.cumsum(pc.fill_null(pc.binary_length(rows.column(column)), 0).to_numpy(zero_copy_only=False)) // BATCH
    cuts = [0, *(np.flatnonzero(np.diff(cost)) + 1).tolist(), rows.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if low < high:
            yield rows.slice(low, high - low)


def gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices begin[0], begin[0] + 1, ... of every stretch, strung together."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Encoder:
    """what: 'ids' gives int32 ids, 'spans' int32 pairs of code-point start and end.

    A chunk is a word with the space or line break before it; its key lacks the space. The memo
    holds at most about ``memo`` chunks: when it is full the half used most often stays.
    """

    GROUP = 1000  # chunks that the library encodes as one string

    def __init__(self, path: str, what: str, memo: int = 1_000_000):
        from tokenizers import Tokenizer, processors

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if what == "spans":
            self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab()
        # a chunk's first token, and no other of its tokens, begins with its space or line break
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t[0] == "Ġ" or t == "Ċ"]] = True
        self.what, self.most, self.width = what, memo, 1 if what == "ids" else 2
        self.codes = Codes()
        # of each chunk: begin and number of its tokens in flat, its characters, in how many batches it was used
        self.begin, self.size, self.chars, self.used = (Grown(np.int64) for _ in range(4))
        self.flat = Grown(np.int32, self.width)
        self.tails: dict[str, np.ndarray] = {}

    def whole(self, text: str) -> np.ndarray:
        """What the library gives for one string."""
        if self.what == "ids":
            return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32).reshape(-1, 1)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int32).reshape(-1, 2)

    def group(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, tokens of each chunk), from one string that holds all chunks."""
        if self.what == "ids":
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, np.int32)
            made = ids.reshape(-1, 1)
        else:
            found = self.tokenizer.encode("".join(chunks), add_special_tokens=False)
            ids, made = np.array(found.ids, np.int32), np.array(found.offsets, np.int32).reshape(-1, 2)
        at = np.flatnonzero(self.opens[ids])
        size = np.diff(np.r_[at, len(ids)])
        if len(at) != len(chunks) or at[0]:
            raise ValueError("the vocabulary has tokens that cross words")
        if self.what == "spans":
            chars = np.fromiter(map(len, chunks), np.int64, len(chunks))
            made = made - np.repeat(np.cumsum(chars) - chars, size)[:, None].astype(np.int32)
        return made, size

    def tailed(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(places in fresh of chunks that end in marks, codes of these without the marks, the marks); new codes join fresh.

        Only what ends in a Latin letter or a digit is cut: there all versions of Unicode agree.
        """
        keys = pa.array(fresh, pa.string())
        cores = pc.utf8_rtrim(keys, MARKS)
        size = pc.subtract(pc.binary_length(keys), pc.binary_length(cores)).to_numpy()  # marks are ASCII
        ends = pc.is_in(pc.utf8_slice_codeunits(cores, -1), LATIN).to_numpy(zero_copy_only=False)
        places = np.flatnonzero((size > 0) & (size <= TAIL) & ends)
        found = cores.take(pa.array(places)).dictionary_encode()
        codes = self.codes.of(found.dictionary.to_numpy(zero_copy_only=False))[found.indices.to_numpy()]
        return places, codes, [fresh[i][-n:] for i, n in zip(places.tolist(), size[places].tolist())]

    def learn(self) -> None:
        """Encodes the fresh chunks; size -1 marks those with other white space at an end."""
        fresh, first = self.codes.fresh, self.size.n
        places, cores, tails = self.tailed(fresh)
        self.codes.fresh = []
        chunks = [k if k[:1] == "\n" else " " + k for k in fresh]
        size = np.ones(len(fresh), np.int64)
        lone = np.fromiter(map("\n".__eq__, chunks), bool, len(chunks))
        words = [c[1:] for c in chunks]
        odd = np.fromiter(map(ne, map(str.strip, words), words), bool, len(chunks)) | np.fromiter(map(" ".__eq__, chunks), bool, len(chunks))
        put = np.zeros(len(fresh), bool)
        put[places] = True
        plain = np.flatnonzero(~(odd | lone | put))
        parts = []
        for at in range(0, len(plain), self.GROUP):
            some = plain[at : at + self.GROUP]
            made, size[some] = self.group([chunks[i] for i in some])
            parts.append(made)
        size[odd] = -1
        held, begin = self.flat.n, np.zeros(len(fresh), np.int64)
        begin[plain] = held + np.cumsum(size[plain]) - size[plain]
        if lone.any():
            begin[lone] = held + sum(map(len, parts))
            parts.append(self.whole("\n"))
        for made in parts:
            self.flat.add(made)
        self.begin.add(begin)
        self.size.add(size)
        self.chars.add(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        self.used.add(np.zeros(len(fresh), np.int64))
        if len(places):
            self.put_together(first + places, cores, tails)

    def put_together(self, codes: np.ndarray, cores: np.ndarray, tails: list[str]) -> None:
        """Enters the chunks numbered codes: each has the tokens of the chunk in cores, and then those of its tail."""
        for t in set(tails) - self.tails.keys():
            self.tails[t] = self.whole(t)
        ends = [self.tails[t] for t in tails]
        more = np.fromiter(map(len, ends), np.int64, len(ends))
        held = np.maximum(self.size.data[cores], 0)
        start = np.cumsum(held + more) - held - more
        made = np.empty((int((held + more).sum()), self.width), np.int32)
        made[gathered(start, held)] = self.flat.data[gathered(self.begin.data[cores], held)]
        rest = np.concatenate(ends)
        if self.what == "spans":
            rest = rest + np.repeat(self.chars.data[cores], more)[:, None].astype(np.int32)
        made[gathered(start + held, more)] = rest
        self.begin.data[codes] = self.flat.n + start
        self.size.data[codes] = np.where(self.size.data[cores] < 0, -1, held + more)
        self.flat.add(made)

    def forget(self) -> None:
        """Drops the half of the chunks that was used least."""
        n = len(self.codes)
        keep = np.sort(np.argsort(-self.used.data[:n], kind="stable")[: self.most // 2])
        names = list(self.codes)
        self.codes = Codes()
        for new, old in enumerate(keep.tolist()):
            self.codes[names[old]] = new
        begin, size, chars, flat = self.begin.data[keep], self.size.data[keep], self.chars.data[keep], self.flat
        held = np.maximum(size, 0)
        self.begin, self.size, self.chars, self.used = (Grown(np.int64) for _ in range(4))
        self.flat = Grown(np.int32, self.width)
        self.flat.add(flat.data[gathered(begin, held)])
        self.begin.add(np.cumsum(held) - held)
        self.size.add(size)
        self.chars.add(chars)
        self.used.add(np.zeros(len(keep), np.int64))

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text what the library gives for the whole of it."""
        if len(self.codes) > self.most:
            self.forget()
        regular = [i for i, t in enumerate(texts) if t and not irregular(t) and not any(s in t for s in self.special)]
        # a line break before the text stands for its beginning and is dropped again
        lines = pc.split_pattern(pa.array(["\n" + texts[i].replace("\n", " \n") for i in regular], pa.string()), " ")
        stops = lines.offsets.to_numpy()[1:].tolist()
        keys = lines.values.dictionary_encode()
        codes = self.codes.of(keys.dictionary.to_numpy(zero_copy_only=False))
        if self.codes.fresh:
            self.learn()
        self.used.data[codes] += 1
        codes = codes[keys.indices.to_numpy()]
        size = self.size.data[codes]
        odd = size < 0
        size = np.maximum(size, 0)
        made = self.flat.data.take(gathered(self.begin.data[codes], size), axis=0)
        ends, chars = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(self.chars.data[codes])]
        if self.what == "spans":
            made = made + np.repeat(chars[:-1], size)[:, None].astype(np.int32)
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, low, high in zip(regular, [0, *stops], stops):
            if not odd[low:high].any():
                out[i] = made[ends[low] + 1 : ends[high]] - (int(chars[low]) + 1 if self.what == "spans" else 0)
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self.whole(t) if t else np.zeros((0, self.width), np.int32)
        return [x[:, 0] if self.what == "ids" else x for x in out]


def encoder(path: str, what: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if (path, what) not in _loaded:
        _loaded[path, what] = Encoder(path, what)
    return _loaded[path, what]
