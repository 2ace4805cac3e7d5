"""Conversations with no rows, ties and clashing columns."""

from defect_spark.llm import chat


def test_empty_ties_and_clashes(spark):
    kinds = "conv_id long, turn long, role string, text string, formatted string, piece int"
    assert chat.digest(chat.format_chats(spark.createDataFrame([], kinds))).count() == 0
    rows = [(1, 0, "user", "b", "x", 1), (1, 0, "user", "a", "x", 1), (1, 0, "user", "a", "x", 1), (1, None, None, None, "x", 1), (None, 1, "assistant", "long " * 50_000, "x", 1)]
    made = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, kinds)).collect()}
    assert made[1].formatted == "### : </turn>\n### user: a</turn>\n### user: a</turn>\n### user: b</turn>\n" and made[1].round_trip
    assert made[None].round_trip and made[None].loss_spans[0].length == 250_000
