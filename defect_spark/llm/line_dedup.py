"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A window is the shortest stretch of lines with ``min_words`` words from a line on, or up to a
line. The line with its smallest hash is its fingerprint, so two copies of a run of that many
words choose the same fingerprints at the same places. Fingerprints are (hash, document, line);
only a hash found at two places or more can begin a match, and the windows around the others are
dropped. The windows around a place extend its match line by line, those from a line on to the
left and those up to a line to the right, and are compared as wholes by 128 bits of hashes. The
first place of a window in (doc_id, text, line) order stays; later ones go, joined to whole runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defect_spark.llm.common import bound, checkpointed, same, text_key

SALTS = 32
SPACES = "\t\x0b\x0c\r"


def trimmed(line: Column) -> Column:
    return F.trim(F.translate(line, SPACES, " " * len(SPACES)))


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, at, h, g, n): number, two hashes and words of each line that has a word; repeats of a row once."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    rows = df.select("doc_id", text_key(F.col("text")).alias("key"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.withColumn("x", trimmed(F.col("line"))).where("x <> ''")
    words = F.size(F.array_remove(F.split("x", " "), "")).cast("long")
    rows = rows.select("doc_id", "key", "at", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("g"), words.alias("n"))
    return rows.repartition("doc_id", "key").dropDuplicates(["doc_id", "key", "at"])


def window_rows(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, key, print, spot, w, v, start, stop): fingerprint and its line, two hashes, first and last line of each window."""
    own = Window.partitionBy("doc_id", "key")
    upto = F.sum("n").over(own.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.select("*", upto.alias("upto"), F.sum("n").over(own).alias("total")).withColumn("before", F.col("upto") - F.col("n"))
    line = F.collect_list(F.struct("h", "at", "g"))
    rows = rows.select("*", line.over(own.orderBy("before").rangeBetween(0, min_words - 1)).alias("ahead"))
    rows = rows.select("*", line.over(own.orderBy("upto").rangeBetween(1 - min_words, 0)).alias("back"))
    whole = F.array(F.when(F.col("total") - F.col("before") >= min_words, F.col("ahead")), F.when(F.col("upto") >= min_words, F.col("back")))
    rows = rows.select("doc_id", "key", F.explode(whole).alias("w")).where("w is not null")
    least = F.array_min("w")
    return rows.select("doc_id", "key", least["h"].alias("print"), least["at"].alias("spot"), F.xxhash64("w.h").alias("w"), F.xxhash64("w.g").alias("v"), F.get("w", F.lit(0))["at"].alias("start"), F.element_at("w", -1)["at"].alias("stop"))


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, runs): the disjoint (start, stop) line numbers to delete, in order, in each document that has any."""
    windows = checkpointed(window_rows(line_rows(docs, id_col, text_col), min_words))
    spot, place = F.struct("doc_id", "key", "spot"), F.struct("doc_id", "key", "start")
    prints = windows.groupBy("print").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("print")
    # a window that very many documents share is dealt over SALTS tasks
    found = windows.join(prints, "print", "left_semi").withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)))
    parts = found.groupBy("w", "v", "salt").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    first = parts.groupBy("w", "v").agg(F.min("a").alias("first"), F.max("b").alias("last"), F.collect_set("salt").alias("salts")).where("first <> last")
    later = found.join(first.select("w", "v", "first", F.explode("salts").alias("salt")), ["w", "v", "salt"]).where(place > F.col("first"))
    ends = later.groupBy("doc_id", "key", "start").agg(F.max("stop").alias("stop"))
    own = Window.partitionBy("doc_id", "key")
    down = own.orderBy("start")
    reach = F.max("stop").over(down.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int")
    numbered = ends.select("*", new.alias("new")).select("*", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    runs = numbered.groupBy("doc_id", "key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def repeated_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, gone): the numbers of the lines to delete in each document that has any."""
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["stop"])))
    return repeated_runs(docs, min_words, id_col, text_col).select("doc_id", "key", gone.alias("gone"))


def without_runs(text: Column, runs: Column) -> Column:
    """The lines of text before, between and after the runs."""

    def kept(lines: Column) -> Column:
        def piece(k: Column) -> Column:
            begin = F.when(k == 0, F.lit(0)).otherwise(F.get(runs, k - 1)["stop"] + 1)
            return F.slice(lines, begin + 1, F.coalesce(F.get(runs, k)["start"], F.size(lines)) - begin)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), piece))

    return F.array_join(bound(F.split(text, "\n"), kept), "\n")


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated runs cut from the text, and n_lines_removed added.

    Lines end at a line feed and are compared without white space at their ends; lines without
    a word belong to no run and go only inside a deleted one. Runs may lie in one text or in two.
    Null texts stay null, texts without repeats stay as they are. Rows equal in id and text are
    one document: each keeps its first occurrences. An empty table gives an empty result. All
    other columns come along; one called n_lines_removed, in any case, is replaced.
    """
    runs = repeated_runs(docs, min_words, id_col, text_col)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"))
    both = rows.alias("a").join(runs.alias("b"), same("doc_id", "key"), "left").select("a.row", "b.runs")
    text = F.when(F.col("runs").isNull(), F.col("row")[text_col]).otherwise(without_runs(F.col("row")[text_col], F.col("runs")))
    columns = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "n_lines_removed"]
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"] + 1)
    return both.select(*columns, F.coalesce(removed, F.lit(0).cast("long")).alias("n_lines_removed"))


def digest(done: DataFrame) -> DataFrame:
    """(doc_id, n_lines_removed, text_sha256, n_chars) of each document."""
    return done.select("doc_id", F.greatest("n_lines_removed", F.lit(0)).alias("n_lines_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
