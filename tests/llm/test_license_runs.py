"""Planted licence notices, written here and not taken from the templates."""

from defect_spark.llm import license_texts, licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
GPL = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details."""
ISC = "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
PROSE = " ".join(f"plain{k} prose of a story" for k in range(40))


def test_planted_notices(spark):
    planted = {
        "MIT": f"{PROSE}\n{MIT}\n{PROSE}",
        "GPL-3.0": f"/*\n{GPL}\n */\n{PROSE}",
        "ISC": f"{PROSE} {ISC} {PROSE}",
        "CC-BY-NC-4.0": f"{PROSE}\nLicensed under CC BY-NC 4.0.\n{PROSE}",
        "CC-BY-ND-4.0": f"{PROSE} This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License. {PROSE}",
        "Apache-2.0": f"{PROSE} licensed under the Apache License, Version 2.0. {PROSE}",
        "": f"{PROSE} a licence to tell the story of the software in any form {PROSE}",
    }
    df = spark.createDataFrame(list(planted.items()), "doc_id string, text string")
    got = {r.doc_id: {m.name for m in r.matches} for r in licenses.scan(df).collect()}
    assert got == {name: {name} - {""} for name in planted}


def test_given_template_of_several_paragraphs(spark):
    text = "alpha beta gamma delta\n\nepsilon zeta eta theta\n\niota kappa lamda mu"
    df = spark.createDataFrame([(1, f"x y\n{text}\nz"), (2, text[:40])], "doc_id long, text string")
    got = {r.doc_id: [(m.kind, m.at, m.name, m.score) for m in r.matches] for r in licenses.scan(df, {"T": (text,)}).collect()}
    assert got == {1: [("run", 1, "T", 1.0)], 2: []}


def test_runs_match_all_runs():
    scanner = licenses.Scanner({"A": ("a b c d e f",), "B": ("b a b c a d",)}, 0.8)
    words = "x a b c x d e f b a b c a d x a b b c d e f f".split()
    best = 0.0
    for i in range(len(words)):
        for j in range(i + 2, len(words) + 1):
            g = licenses.bigrams(" ".join(words[i:j]))
            best = max(best, *(2 * len(g & own) / (len(g) + len(own)) for _, own in scanner.sets))
    got = scanner.runs(words, [0, 1])
    assert max(s for s, *_ in got) == best
    for score, i, j, name in got:
        g, own = licenses.bigrams(" ".join(words[i:j])), dict(scanner.sets)[name]
        assert score == 2 * len(g & own) / (len(g) + len(own)) >= 0.8


def test_work_is_linear_in_copies_of_a_whole_licence():
    import time

    body = max(license_texts.TEXTS["GPL-2.0"], key=len)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    took = {}
    for n in (1, 4, 8):
        began = time.time()
        found = scanner.text("\n\n".join([body] * n))
        took[n] = time.time() - began
        assert [m["name"] for m in found if m["kind"] == "run" or m["kind"] == "paragraph"].count("GPL-2.0") >= n
    assert took[8] < 2.5 * took[4] + 0.2
