"""Chunks that end in marks are put together from the chunk without them, with the library's tokens."""

import random

import numpy as np
import public_tokenizers
import pytest

from defect_spark.llm.byte_bpe import Encoder
from defect_spark.llm.repair import expansion_lengths

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("what", ["ids", "spans"])
def test_marks_and_letters_of_all_kinds(what):
    rng = random.Random(7)
    signs = ["a", "é", "ß", "7", "²", "ª", "ɐ", "Ā", "中", "٣", "ⅷ", ".", ",", "'", "s", "ll", "$", "_", "…", "!", "-", " ", " ", " ", "\n", " "]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(4000)]
    made = Encoder(PATH, what, memo=500)
    for at in range(0, len(texts), 300):
        for text, got in zip(texts[at : at + 300], made.texts(texts[at : at + 300])):
            want = made.whole(text).reshape(got.shape) if text else got[:0]
            assert np.array_equal(got, want), text


def test_the_library_is_asked_for_a_word_once(monkeypatch):
    made, asked = Encoder(PATH, "ids"), []
    group = made.group
    monkeypatch.setattr(made, "group", lambda chunks: asked.extend(chunks) or group(chunks))
    text = "one word, a word. this word! one (word) word"
    assert made.texts([text])[0].tolist() == made.whole(text)[:, 0].tolist()
    assert sorted(asked) == sorted([" word", " a", " this", " one", " (word", "\none"])


def test_lengths_of_rules_in_any_depth():
    rules = np.array([[5, 6], [100, 7], [101, 100], [8, 102], [103, 103]])
    assert expansion_lengths(rules, 100).tolist() == [2, 3, 5, 6, 12]
    assert expansion_lengths(rules[:0], 100).tolist() == []
