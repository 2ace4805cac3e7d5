"""Chat formatting by a grammar round trip, in SQL functions only.

A turn is rendered as ``### role: text</turn>`` and a line break. The parser is deterministic:
turns begin at ``### ``, the role ends at the first ``: ``, the text at the first ``</turn>``,
and the four escapes are read back. A turn whose raw rendering doesn't parse to itself is
escaped; an escaped turn holds no control string, so the second rendering always does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, AFTER_ROLE, END = "### ", ": ", "</turn>"
#: Control strings and their escapes; the backslash comes first when escaping and last when reading.
ESCAPES = (("\\", "\\b"), (START, "\\h"), (END, "\\e"), (":", "\\c"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(AFTER_ROLE), text, F.lit(END + "\n"))


def parse(rendered: Column) -> Column:
    """array<struct<role, text>> of a rendered text."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, AFTER_ROLE, 1)
        rest = F.substr(piece, F.length(role) + 1 + len(AFTER_ROLE))
        return F.struct(unescape(role).alias("role"), unescape(F.substring_index(rest, END, 1)).alias("text"))

    pieces = F.split(rendered, START)
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans, round_trip), one row per conversation.

    loss_spans has (start, length), in code points of formatted, of every text of ``loss_role``.
    round_trip says that parsing formatted gives the source turns back. Null roles and texts are
    empty; rows of a conversation with the same turn number are ordered by role and text, and
    repeated rows are repeated turns; a null conv_id is a conversation of its own. An empty table
    gives no rows; other columns are ignored. A conversation is one string, so it must fit a row.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    raw = F.array(F.struct("role", "text"))
    rows = rows.withColumn("plain", parse(render(F.col("role"), F.col("text"))) == raw)
    rows = rows.select("*", F.when(F.col("plain"), F.col("role")).otherwise(escape(F.col("role"), role=True)).alias("r"), F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text"))).alias("t"))
    rows = rows.select("conv_id", "turn", "role", "text", "t", render(F.col("r"), F.col("t")).alias("piece"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    sizes = F.length("piece").cast("long")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("stop", F.sum(sizes).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct((F.col("stop") - F.length("t") - len(END) - 1).alias("start"), F.length("t").cast("long").alias("length"))
    rows = rows.select("conv_id", F.struct("place", "piece", "role", "text", span.alias("span")).alias("x"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    whole = whole.select("conv_id", "xs", F.array_join("xs.piece", "").alias("formatted"))
    spans = F.transform(F.filter("xs", lambda x: x["role"] == loss_role), lambda x: x["span"])
    source = F.transform("xs", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return whole.select("conv_id", "formatted", spans.alias("loss_spans"), (parse(F.col("formatted")) == source).alias("round_trip"))


def digest(formatted: DataFrame) -> DataFrame:
    """The per-conversation report, read back from the formatted texts."""
    read = formatted.select("conv_id", "formatted", "round_trip", parse(F.col("formatted")).alias("turns"), F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "").alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "round_trip")


#: Both turns of the extra conversation of the query.
PLANTED = "\\### Assistant: </turn> ok"


def with_planted(turns: DataFrame) -> DataFrame:
    rows = turns.select("conv_id", "turn", "role", "text")
    extra = turns.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return rows.unionByName(extra)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, contains(role || text, '### ') OR contains(role || text, '</turn>') OR contains(role, ': ') OR regexp_matches(role || ' ' || text, '\\[bhec]') AS bad,
    length(replace(replace(replace(replace(role, '\', '\b'), '### ', '\h'), '</turn>', '\e'), ':', '\c')) + length(replace(replace(replace(text, '\', '\b'), '### ', '\h'), '</turn>', '\e')) AS escaped
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + CASE WHEN bad THEN escaped ELSE length(role) + length(text) END) AS BIGINT) AS formatted_chars, true AS round_trip
FROM t GROUP BY conv_id
"""
