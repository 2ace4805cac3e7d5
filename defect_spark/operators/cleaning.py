"""Target detection and cleaning. Every fit is one aggregation; every transform a projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, NumericType, StringType

# Target names of the three rules, name endings of the last one, id names, label values.
SERVICE_TARGETS = ("class", "label", "target", "diagnosis", "defect", "bug", "error", "fault", "issue", "vulnerable", "clean")
NOTEBOOK_TARGETS = ("bug", "defects", "class", "defective", "Class")
EVALUATOR_TARGETS = ("bug", "defect", "class", "target", "label", "y", "outcome", "diagnosis")
EVALUATOR_ENDINGS = ("_class", "_label")
MOST_CLASSES = 10
ID_NAMES = ("id", "index", "row_id", "record_id", "sample_id")
YES = ("Y", "yes", "true", "True", "1")
POSITIVE = ("Y", "yes", "true", "True", "1", "positive", "defect", "bug", "M")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def detect_target(df: DataFrame, rule: str = "service") -> str:
    """The target column; the last column if no other is found.

    - ``service``: the first column whose lower-case name is a target's;
    - ``notebook``: the first of the list of names that is a column;
    - ``evaluator``: the first column with a target's name or ending and at most ten values.
    """
    if rule == "notebook":
        return next((n for n in NOTEBOOK_TARGETS if n in df.columns), df.columns[-1])
    if rule == "service":
        return next((c for c in df.columns if c.lower() in SERVICE_TARGETS), df.columns[-1])
    if rule != "evaluator":
        raise ValueError(f"unknown rule {rule}")
    named = [c for c in df.columns if c.lower() in EVALUATOR_TARGETS or c.lower().endswith(EVALUATOR_ENDINGS)]
    if not named:
        return df.columns[-1]
    # at most eleven different values of a column are looked at
    few = [c for c in named if df.select(F.col(f"`{c}`").alias("v")).where("v is not null").distinct().limit(MOST_CLASSES + 1).count() <= MOST_CLASSES]
    return few[0] if few else df.columns[-1]


def drop_duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """Of rows equal in all columns but key, the one with the smallest key stays."""
    data = [c for c in df.columns if c != key]
    return df.groupBy(*data).agg(F.min(key).alias(key)).select(*df.columns)


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """(n_rows, n_kept, n_removed): what drop_duplicate_rows does to df."""
    groups = df.groupBy(*(c for c in df.columns if c != key)).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_kept")).withColumn("n_removed", F.col("n_rows") - F.col("n_kept"))


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    held = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()
    return df.select(*(F.col(f"`{c}`") for c in df.columns if held[c]))


def drop_all_null_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    return df.na.drop(how="all", subset=[c for c in df.columns if c != key])


def drop_id_columns(df: DataFrame, keep: tuple[str, ...] = (), protect_continuous: bool = False) -> DataFrame:
    """Drops columns with an id's name, and those of numbers or text whose values are all different.

    With protect_continuous floating-point columns are only dropped by name. Approximate counts
    decide which columns are counted exactly.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    asked = [c for c in df.columns if c not in keep and c.lower() not in ID_NAMES and isinstance(kinds[c], (NumericType, StringType)) and not (protect_continuous and isinstance(kinds[c], FractionalType))]
    gone = [c for c in df.columns if c not in keep and c.lower() in ID_NAMES]
    if asked:
        near = df.agg(F.count("*").alias("all rows"), *(F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in asked)).first()
        some = [c for c in asked if near["all rows"] and near[c] > 0.8 * near["all rows"]]
        if some:
            exact = df.agg(F.count("*").alias("all rows"), *(F.count_distinct(F.col(f"`{c}`")).alias(c) for c in some)).first()
            gone += [c for c in some if exact[c] == exact["all rows"]]
    return df.drop(*gone)


def exact_medians(df: DataFrame, columns: list[str], most_counts: int = 100_000, cuts: int = 64) -> dict[str, float | None]:
    """The exact median of each column as a double, None without a value; the mean of the middle two where their number is even.

    All columns are narrowed together. A round takes one quantile sketch of each column inside its
    range of values and counts each part of it; the parts with the middle ranks are the next
    range. A part is a single value or what lies between two, so frequent values come out at once.
    When few values are left of every column they are counted, at most ``most_counts`` in all. The
    number of jobs grows with the digits of the row count, not with the columns.
    """
    name = lambda c: F.col(f"`{c}`").cast("double")
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(str(k)) for k, c in enumerate(columns))).first() if columns else []
    out: dict[str, float | None] = {}
    # of each open column: the two middle ranks, how many values are below the range, its bounds
    todo = {k: {"ranks": ((n - 1) // 2, n // 2), "below": 0, "low": None, "high": None, "in": n} for k, n in enumerate(counts) if n}
    out |= {columns[k]: None for k, n in enumerate(counts) if not n}
    few = max(64, most_counts // max(1, len(columns)))

    def inside(k: int) -> Column:
        x, t = name(columns[k]), todo[k]
        from_ = x.isNotNull() if t["low"] is None else x >= t["low"]
        return from_ if t["high"] is None else from_ & (x <= t["high"])

    while wide := [k for k, t in todo.items() if t["in"] > few and t["low"] != t["high"] or t["in"] > few and t["low"] is None]:
        shares = [i / cuts for i in range(cuts + 1)]
        sketch = df.agg(*(F.percentile_approx(F.when(inside(k), name(columns[k])), shares, 1000).alias(str(k)) for k in wide)).first()
        marks = {k: sorted(set(sketch[str(k)])) for k in wide}
        # part 2i + 1 is the i-th mark itself, part 2i what lies before it
        passed = lambda x: lambda a, m: a + (x >= m).cast("int") + (x > m).cast("int")
        part = lambda k: F.aggregate(F.array(*map(F.lit, marks[k])), F.lit(0), passed(name(columns[k])))
        cells = F.explode(F.array(*(F.when(inside(k), F.struct(F.lit(k).alias("k"), part(k).alias("part"))) for k in wide)))
        sizes: dict[int, list] = {k: [] for k in wide}
        for r in df.select(cells.alias("x")).where("x IS NOT NULL").groupBy("x.k", "x.part").agg(F.count("*").alias("n")).orderBy("k", "part").collect():  # twice the marks
            sizes[r.k].append((r.part, r.n))
        for k in wide:
            t, first, below = todo[k], None, todo[k]["below"]
            for p, n in sizes[k]:
                if first is None and t["ranks"][0] < below + n:
                    first, start = p, below
                below += n
                if first is not None and t["ranks"][1] < below:
                    edge = lambda i: marks[k][i] if 0 <= i < len(marks[k]) else None
                    low, high = edge(first // 2) if first % 2 else edge(first // 2 - 1), edge(p // 2)
                    low, high = (t["low"] if low is None else low), (t["high"] if high is None else high)
                    # an open part begins above its mark
                    if not first % 2 and first // 2:
                        low = math.nextafter(low, math.inf)
                    if not p % 2 and p // 2 < len(marks[k]):
                        high = math.nextafter(high, -math.inf)
                    t |= {"below": start, "low": low, "high": high, "in": below - start}
                    break
    if todo:
        cells = F.explode(F.array(*(F.when(inside(k), F.struct(F.lit(k).alias("k"), name(columns[k]).alias("v"))) for k in todo)))
        held: dict[int, list] = {k: [] for k in todo}
        for r in df.select(cells.alias("x")).where("x IS NOT NULL").groupBy("x.k", "x.v").agg(F.count("*").alias("n")).orderBy("k", "v").collect():
            held[r.k].append((r.v, r.n))
        for k, t in todo.items():
            found = []
            for rank in t["ranks"]:
                below = t["below"]
                for v, n in held[k]:
                    below += n
                    if rank < below:
                        found.append(v)
                        break
            out[columns[k]] = sum(found) / 2
    return out


def commonest(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The most frequent value of each column as text, the smallest on a tie; all columns in one count."""
    if not columns:
        return {}
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for k, c in enumerate(columns))))
    counts = df.select(cells.alias("x")).where("x.v IS NOT NULL").groupBy("x.k", "x.v").agg(F.count("*").alias("n"))
    best = {r.k: r.b.v for r in counts.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b")).collect()}  # a row a column
    return {c: best.get(k) for k, c in enumerate(columns)}


def fit_imputer(df: DataFrame, medians: list[str] = (), modes: list[str] = ()) -> dict:
    """The value that fills each column: exact median, or commonest value ('unknown' without any)."""
    return exact_medians(df, list(medians)) | {c: m if m is not None else "unknown" for c, m in commonest(df, list(modes)).items()}


def apply_imputer(df: DataFrame, fitted: dict) -> DataFrame:
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit(fitted[c])).alias(c) if fitted.get(c) is not None else F.col(f"`{c}`") for c in df.columns))


def impute(df: DataFrame, medians: list[str] = (), modes: list[str] = ()) -> DataFrame:
    """Nulls become the column's exact median, or its commonest value (the smallest on a tie; 'unknown' without any)."""
    return apply_imputer(df, fit_imputer(df, medians, modes))


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def binarize(target: Column, rule: str = "yes", values: list[str] = ()) -> Column:
    """1 for defective, 0 for any other value, null for null.

    - ``yes``: one of the yes values;
    - ``not_false``: anything but 'false', lower-cased and trimmed;
    - ``y``: exactly 'Y';
    - ``positive``: the first of the sorted ``values`` that is a positive word, else the second
      value, else the only one; see target_values.
    """
    text = target.cast("string")
    if rule == "positive":
        chosen = next((v for v in sorted(values) if v in POSITIVE), sorted(values)[:2][-1] if values else None)
        made = text == F.lit(chosen)
    else:
        made = {"yes": text.isin(*YES), "not_false": F.lower(F.trim(text)) != "false", "y": text == "Y"}[rule]
    return F.when(target.isNotNull(), made.cast("int"))


def target_values(df: DataFrame, target: str, most: int = 1000) -> list[str]:
    """The different values of a target as text; an error beyond ``most``."""
    found = [r[0] for r in df.select(F.col(f"`{target}`").cast("string").alias("v")).where("v is not null").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{target} has more than {most} values")
    return sorted(found)


def binarize_target(df: DataFrame, target: str, rule: str = "yes") -> DataFrame:
    """Rows with a target, with it as 0 or 1; see binarize."""
    df = drop_null_target(df, target)
    values = target_values(df, target) if rule == "positive" else []
    return df.withColumn(target, binarize(F.col(f"`{target}`"), rule, values))
