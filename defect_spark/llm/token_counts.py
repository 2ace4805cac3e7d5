"""Token counts by section: whole documents are encoded once, token spans are joined to sections.

A section is a line with its line break, so sections tile the text. Each token's code-point span
comes from the encoding of the whole document; a token inside one section counts there. A token
over a boundary is given away by the named rule:

- ``majority``: the section with most of its characters, the earlier one on a tie,
- ``start``: the section with its first character,
- ``split``: each section in proportion to its share of the characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defect_spark.llm.byte_bpe import encoder, gathered
from defect_spark.llm.common import pairs_of

RULES = ("majority", "start", "split")


def section_bounds(text: str, separator: str = "\n") -> np.ndarray:
    """Starts of the sections and the end of the text; one empty section for an empty text."""
    sizes = [len(x) + len(separator) for x in text.split(separator)]
    sizes[-1] -= len(separator)
    return np.r_[0, np.cumsum(sizes)]


def attribute(spans: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section between bounds; sums to the number of spans."""
    sections = len(bounds) - 1
    inner = bounds[1:-1]
    start, end = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    first, last = np.searchsorted(inner, start, "right"), np.searchsorted(inner, end - 1, "right")
    if rule == "start":
        return np.bincount(first, minlength=sections).astype(float)
    out = np.bincount(first[first == last], minlength=sections).astype(float)
    cross = np.flatnonzero(first != last)
    if len(cross):
        # a row for each section that a crossing token touches
        n = last[cross] - first[cross] + 1
        token, touched = np.repeat(cross, n), gathered(first[cross], n)
        shares = np.minimum(bounds[touched + 1], end[token]) - np.maximum(bounds[touched], start[token])
        if rule == "split":
            return out + np.bincount(touched, shares / (end - start)[token], sections)
        most = np.repeat(np.maximum.reduceat(shares, np.cumsum(n) - n), n)
        best = np.flatnonzero(shares == most)
        out += np.bincount(touched[best[np.unique(token[best], return_index=True)[1]]], minlength=sections)
    return out


def token_counts(docs: DataFrame, tokenizer_path: str, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text", separator: str = "\n") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, doc_tokens), a row for each section of each document.

    Sections are numbered from 0; start and end are code points, n_tokens is a double because of
    the split rule, and sums to doc_tokens over a document. A null or empty text has one empty
    section without tokens. Repeated rows are counted each; an empty table gives no rows; other
    columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, "spans")
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                offsets, starts, ends, counts, totals = [0], [], [], [], []
                for text, spans in zip(texts, enc.texts(texts)):
                    bounds = section_bounds(text, separator)
                    starts.append(bounds[:-1])
                    ends.append(bounds[1:])
                    counts.append(attribute(spans.reshape(-1, 2), bounds, rule))
                    totals.append(len(spans))
                    offsets.append(offsets[-1] + len(bounds) - 1)
                cells = pa.StructArray.from_arrays([pa.array(np.concatenate(starts), pa.int64()), pa.array(np.concatenate(ends), pa.int64()), pa.array(np.concatenate(counts), pa.float64())], ["start", "end", "n_tokens"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells), pa.array(totals, pa.int64())], ["doc_id", "sections", "doc_tokens"])

    docs = pairs_of(docs, id_col, text_col)
    made = docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, sections array<struct<start:long,end:long,n_tokens:double>>, doc_tokens long")
    flat = made.select("doc_id", "doc_tokens", F.posexplode("sections").alias("section", "s"))
    return flat.select("doc_id", "section", "s.start", "s.end", "s.n_tokens", "doc_tokens")
