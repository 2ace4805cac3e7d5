"""License scans: lines, paragraphs and runs of words against templates by the Dice coefficient of word bigrams.

Texts are lower-cased and cut to words of letters and digits. A match shares at least
threshold / (2 - threshold) of a template's bigrams, so an index from bigram to templates leaves
most texts no template to compare. For the others every line, every paragraph and every run of
words that can score is compared; runs cross lines and paragraphs and begin and end anywhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from defect_spark.llm.common import pairs_of
from defect_spark.llm.license_texts import TEXTS

# Short public notices of well-known licences, with the whole texts.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "ISC": ("Licensed under the ISC License.",),
}
TEMPLATES = {name: NOTICES.get(name, ()) + TEXTS.get(name, ()) for name in NOTICES | TEXTS}
WORD = re.compile(r"[^\W_]+")
PARAGRAPH = re.compile(r"\n\s*\n")


def bigrams(text: str) -> frozenset:
    words = WORD.findall(text.lower())
    return frozenset(zip(words, words[1:]))


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        self.threshold = threshold
        self.sets = [(name, bigrams(t)) for name, texts in sorted(templates.items()) for t in texts]
        self.index: dict[tuple, list[int]] = {}
        for k, (_, grams) in enumerate(self.sets):
            for g in grams:
                self.index.setdefault(g, []).append(k)
        sizes = [len(s) for _, s in self.sets if s]
        self.ratio = threshold / (2 - threshold)
        self.least, self.most = (self.ratio * min(sizes), max(sizes) / self.ratio) if sizes else (1, 0)
        self.starts = {g[0] for g in self.index}
        self.known = frozenset(self.index)

    def unit(self, text: str) -> tuple[float, str] | None:
        """The best (score, name) at or over the threshold; ties go to the first name."""
        words = WORD.findall(text)
        if len(words) - 1 < self.least or self.starts.isdisjoint(words):
            return None
        grams = set(zip(words, words[1:]))
        if not self.least <= len(grams) <= self.most:
            return None
        shared = Counter(k for g in grams for k in self.index.get(g, ()))
        best = None
        for k in sorted(shared):
            name, own = self.sets[k]
            low, high = sorted((len(own), len(grams)))
            if 2 * low < self.threshold * (low + high):
                continue
            score = 2 * shared[k] / (len(own) + len(grams))
            if score >= self.threshold and (best is None or score > best[0]):
                best = (score, name)
        return best

    def able(self, grams: set) -> list[int]:
        """Templates of which a text with these bigrams holds enough for a match."""
        shared = Counter(k for g in grams & self.known for k in self.index[g])
        return [k for k, n in shared.items() if n >= self.ratio * len(self.sets[k][1]) - 1e-9]

    def runs(self, words: list[str], able: list[int]) -> list[tuple[float, int, int, str]]:
        """(score, begin, end, name) of runs of words that match, disjoint, the best first, in order of place.

        The best run from any word on begins and ends with a bigram of the template. A bigram counts
        where it comes first in the run: where its place before is before the run.
        """
        pairs = list(zip(words, words[1:]))
        last: dict[tuple, int] = {}
        before = np.empty(len(pairs), np.int64)
        for i, g in enumerate(pairs):
            before[i] = last.get(g, -1)
            last[g] = i
        final = np.zeros(len(pairs), bool)
        final[list(last.values())] = True
        found = []
        for k in able:
            name, own = self.sets[k]
            m, hit = len(own), np.fromiter((g in own for g in pairs), bool, len(pairs))
            need, most, places = self.ratio * m - 1e-9, m / self.ratio + 1e-9, np.flatnonzero(hit)
            # different bigrams of the template from each place on
            ahead = np.cumsum((final & hit)[::-1])[::-1]
            for a in places.tolist():
                if ahead[a] < need:
                    break
                # grown until it has more bigrams than a match may have, or all of the template's that are ahead
                size, stop = int(2 * most) + 2, len(pairs)
                while True:
                    new = before[a : a + size] < a
                    grams, shared = np.cumsum(new), np.cumsum(new & hit[a : a + size])
                    if a + size >= stop or grams[-1] > most or shared[-1] == ahead[a]:
                        break
                    size *= 4
                if shared[-1] < need:
                    continue
                score = 2 * shared / (m + grams)
                e = int(np.argmax(score))
                if score[e] >= self.threshold:
                    found.append((float(score[e]), a, a + e + 2, name))
        taken, out = np.zeros(len(words), bool), []
        for one in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
            if not taken[one[1] : one[2]].any():
                taken[one[1] : one[2]] = True
                out.append(one)
        return sorted(out, key=lambda x: x[1])

    def text(self, text: str | None) -> list[dict]:
        """Matches in order: unit kind, its number (of a run: of its first line), name and score."""
        text = (text or "").lower()
        words = WORD.findall(text)
        able = self.able(set(zip(words, words[1:])))
        if not able:
            return []
        out, covered = [], []
        line_of, at = [], 0
        for k, line in enumerate(text.split("\n")):
            n = len(WORD.findall(line))
            line_of += [k] * n
            found = self.unit(line)
            if found:
                out.append({"kind": "line", "at": k, "name": found[1], "score": found[0]})
                covered.append((at, at + n, found[1]))
            at += n
        at = 0
        for k, part in enumerate(PARAGRAPH.split(text)):
            n = len(WORD.findall(part))
            found = self.unit(part) if "\n" in part else None
            if found:
                out.append({"kind": "paragraph", "at": k, "name": found[1], "score": found[0]})
                covered.append((at, at + n, found[1]))
            at += n
        for score, begin, end, name in self.runs(words, able):
            if not any(a < end and begin < b and name == x for a, b, x in covered):
                out.append({"kind": "run", "at": line_of[begin], "name": name, "score": score})
        return out


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, matches): every line, paragraph of several lines and run of words that matches a template.

    Paragraphs end at blank lines. Runs are the best disjoint ones; one that touches a line or
    paragraph matched under the same name is left out. Bigrams are sets, so repeats count once. Null and empty texts
    match nothing; repeated rows are returned each; an empty table gives an empty result; other
    columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    kind = pa.list_(pa.struct([("kind", pa.string()), ("at", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scanner.text(t.as_py()) for t in b.column(1)], kind)], ["doc_id", "matches"])

    docs = pairs_of(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, matches array<struct<kind:string,at:int,name:string,score:double>>")
