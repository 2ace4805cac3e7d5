"""Licence paragraphs against every template compared, ties and awkward tables."""

import re

from defect_spark.llm import licenses


def brute(text, templates):
    out = []
    for k, part in enumerate(re.split(r"\n\s*\n", (text or "").lower())):
        own = licenses.bigrams(part)
        if "\n" in part and own:
            scores = [(2 * len(own & licenses.bigrams(t)) / (len(own) + len(licenses.bigrams(t))), name) for name in sorted(templates) for t in templates[name]]
            best = max(s for s, _ in scores)
            if best >= 0.8:
                out.append((k, next(n for s, n in scores if s == best), best))
    return out


def test_paragraphs_match_brute_force(spark):
    # no word is altered so often that nothing matches, and some paragraphs stay under the bound
    texts = {}
    for k, (name, some) in enumerate(sorted(licenses.TEMPLATES.items())):
        for j, t in enumerate(some):
            words = t.split()[:120]
            for step in (0, 7, 15):
                changed = [w if not step or i % step else "other" for i, w in enumerate(words)]
                half = max(1, len(changed) // 2)
                texts[len(texts)] = f"Some text before.\nAnd more.\n\n{' '.join(changed[:half])}\n  {' '.join(changed[half:])}\n \nlast {name} {k} {j}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [(m["at"], m.name, m.score) for m in r.matches if m.kind == "paragraph"] for r in licenses.scan(df).collect()}
    want = {d: brute(t, licenses.TEMPLATES) for d, t in texts.items()}
    assert got == want and sum(map(bool, want.values())) > 20


def test_ties_go_to_the_first_name(spark):
    templates = {"b": ("use it as you like",), "a": ("Use it, as you like!",), "c": ("one",)}
    df = spark.createDataFrame([(1, "use it as you like", 1), (1, "use it as you like", 1), (None, None, 1), (2, "", 1)], "doc_id long, text string, matches int")
    got = sorted((r.doc_id or 0, [(m.kind, m.name) for m in r.matches]) for r in licenses.scan(df, templates).collect())
    assert got == [(0, []), (1, [("line", "a")]), (1, [("line", "a")]), (2, [])]
    assert licenses.scan(df.where("false")).count() == 0
    assert licenses.scan(df, {}).count() == 4
