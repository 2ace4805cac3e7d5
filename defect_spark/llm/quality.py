"""Quality rules: statistics of texts and a learned decision list, in SQL functions only.

Sequential covering grows one conjunction of thresholds at a time by information gain on two
thirds of the labelled statistics, prunes it on the rest and removes what it covers. Each rule
names a kind of bad text; the list becomes one ordered CASE expression, and what no rule covers
is kept.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defect_spark.llm.common import UPPER, bound, pairs_of

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Ratios that the rules compare with thresholds.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_a_word": "n_marks / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words": "double(n_words)",
}


class Test(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] > self.threshold if self.above else values[self.feature] <= self.threshold

    def expression(self) -> Column:
        return F.expr(f"{self.feature} {'>' if self.above else '<='} double('{self.threshold!r}')")


Rule = tuple[Test, ...]


def repeated_words(hashes: Column) -> Column:
    """How many of the words lie in windows that occur twice or more; null or 0 if none."""

    def windows(h: Column) -> Column:
        return F.when(F.size(h) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))

    def places(s: Column) -> Column:
        twice = lambda p, k: F.coalesce(p["x"] == F.get(s, k - 1)["x"], F.lit(False)) | F.coalesce(p["x"] == F.get(s, k + 1)["x"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, twice), lambda p: p["i"]))

    def covered(g: Column) -> Column:
        # only texts with a repeated window sort theirs: equal windows come together, then places
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
        count = bound(ordered, lambda s: F.aggregate(places(s), start, step)["n"])
        return F.when(F.size(g) > F.size(F.array_distinct(g)), count)

    return bound(hashes, lambda h: bound(windows(h), covered))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks, n_distinct).

    Words are runs of anything but ASCII white space. Windows of eight words are compared by the
    64-bit hash of their words' hashes. Null and empty texts have zeros; rows come out as they
    come in, repeats and all; other columns are ignored.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.select("doc_id", "text", F.transform(F.array_remove(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), ""), lambda w: F.xxhash64(w)).alias("h"))
    df = df.withColumn("covered", repeated_words(F.col("h")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES + " ", "") != "")
    bare = F.translate("text", SPACES + " ", "")
    df = df.withColumn("bare", bare).withColumn("lines", lines)
    size = F.length("bare")
    less = lambda chars: (size - F.length(F.translate("bare", chars, ""))).cast("long")
    return df.select(
        "doc_id",
        F.size("h").cast("long").alias("n_words"),
        size.cast("long").alias("word_chars"),
        less(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce("covered", F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        less(UPPER).alias("n_upper"),
        less("!?").alias("n_marks"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
    )


def with_features(stats: DataFrame) -> DataFrame:
    return stats.select("*", *(F.expr(e).alias(n) for n, e in FEATURES.items()))


def best_test(values: dict[str, np.ndarray], bad: np.ndarray) -> Test | None:
    """The threshold test with the highest gain: bad rows covered times bits won."""
    p, n = int(bad.sum()), int((~bad).sum())
    before, best = np.log2(max(p, 1) / max(p + n, 1)), (0.0, None)
    for name, x in values.items():
        for cut in np.unique(np.quantile(x, np.linspace(0.005, 0.995, 100))).tolist():
            for above in (True, False):
                test = Test(name, above, cut)
                hit = test.covers(values)
                p1, all1 = int((hit & bad).sum()), int(hit.sum())
                if p1 and all1 < p + n:
                    gain = p1 * (np.log2(p1 / all1) - before)
                    if gain > best[0] + 1e-9:
                        best = (gain, test)
    return best[1]


def covered_by(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(values.values()))), bool)
    for test in rule:
        out &= test.covers(values)
    return out


def learn(values: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 8, most_tests: int = 4, precision: float = 0.95, support: int = 5) -> list[Rule]:
    """Sequential covering of the bad rows; a rule stays if enough of what it covers is bad in both parts.

    Covering ends after ``most_rules`` rules, or when fewer than ``support`` bad rows are left; a rule
    has at most ``most_tests`` tests. Bad rows that no rule covers by then are kept, so larger
    bounds reject more of what is like them.
    """
    rules: list[Rule] = []
    left = np.arange(len(bad))
    while len(rules) < most_rules and bad[left].sum() >= support:
        grow, prune = left[left % 3 != 0], left[left % 3 == 0]
        rule: Rule = ()
        inside = grow
        while len(rule) < most_tests and not bad[inside].all():
            test = best_test({k: v[inside] for k, v in values.items()}, bad[inside])
            if test is None:
                break
            rule += (test,)
            inside = inside[test.covers({k: v[inside] for k, v in values.items()})]
        if not rule:
            break

        def worth(r: Rule, rows: np.ndarray) -> tuple[float, int]:
            hit = covered_by(r, {k: v[rows] for k, v in values.items()})
            p, n = int((hit & bad[rows]).sum()), int((hit & ~bad[rows]).sum())
            return (p - n) / max(p + n, 1), p

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: worth(r, prune))
        score, found = worth(rule, left)
        if found < support or score < 2 * precision - 1:
            break
        rules.append(rule)
        left = left[~covered_by(rule, {k: v[left] for k, v in values.items()})]
    return rules


def chosen_labels(labels: DataFrame, most_rows: int) -> DataFrame:
    """(doc_id, quality) of at most ``most_rows`` labelled rows, those with the smallest hash of doc_id."""
    return labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most_rows)


def fit(stats: DataFrame, wanted: DataFrame) -> list[Rule]:
    """Rules from the statistics of labelled rows (doc_id, quality), quality 1 for good.

    Without labelled bad rows there are no rules and everything is kept.
    """
    rows = with_features(stats).join(wanted, "doc_id").where("n_words >= 20").select("quality", *FEATURES).collect()
    rows.sort()
    if not rows:
        return []
    order = np.random.default_rng(7).permutation(len(rows))
    values = {n: np.array([r[n] for r in rows], float)[order] for n in FEATURES}
    return learn(values, np.array([r.quality == 0 for r in rows])[order])


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """stats with base_failed, rule (the number of the first that holds, null if none) and kept."""
    verdict = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        both = rule[0].expression()
        for test in rule[1:]:
            both = both & test.expression()
        verdict = F.when(both, F.lit(k)).otherwise(verdict)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = with_features(stats).withColumn("rule", verdict).withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*FEATURES)


def quality(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdicts of all docs by rules learned from at most ``most_rows`` rows of labels.

    labels has (doc_id, quality); null ones are left out. See statistics, fit and apply_rules for
    nulls, repeats and ties; empty docs give no rows; other columns are ignored.
    """
    docs = pairs_of(docs, id_col, text_col)
    wanted = chosen_labels(labels, most_rows)
    some = docs.join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi")  # most_rows ids
    return apply_rules(statistics(docs), fit(statistics(some), wanted))


#: The base columns in DuckDB's SQL, to test statistics by.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n FROM d),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM p) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM t) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(l.n AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
"""
