from datetime import datetime as D

import pytest

from loomgraph.llm import conversations as C

CHAT = "seq bigint, channel string, author string, ts string, text string, reply_to bigint, references array<string>, arrived_at timestamp_ntz, node string, role string"
PEOPLE = "handle string, name string, role string"
FOLK = [("bot", "Bot", "assistant"), ("ann", "Ann", None), ("sys", "Sys", "system")]


def msg(seq, author="ann", text="hello", reply_to=None, channel="c", day=1):
    return (seq, channel, author, None, text, reply_to, None, D(2025, 1, day), "clash", "clash")


def dropped(spark, rows):
    m = C.turns(spark.createDataFrame(rows, CHAT), spark.createDataFrame(FOLK, PEOPLE))
    return sorted(tuple(r) for r in C.dropped(C.conversations(m)[1]).collect())


def test_sound_and_dropped_conversations(spark):
    rows = [
        msg(1), msg(2, "@BOT ", "hi", 1), msg(3, "ann", "thanks", 2),  # sound
        msg(10), msg(11, "ann", "?", 10),  # unanswered
        msg(20, "bot"), msg(21, "nobody", "late question", 20),  # the answer comes before the question
        msg(30, reply_to=29), msg(31, "bot", "x", 29),  # 29 has no row
        msg(40, reply_to=41), msg(41, "bot", "x", 40), msg(42, "bot", "y", 41),  # a circle
        msg(50, text="​  "), msg(51, "bot", "x", 50),  # no user text
        msg(60),  # alone: not listed
        msg(70, reply_to=0), msg(71, "person:bot", "x", 70),
        msg(80), msg(81, "bot", "﻿", 80),  # the answer is blank
        msg(90, reply_to=90),
    ]
    assert dropped(spark, rows) == [("c", 10), ("c", 20), ("c", 30), ("c", 40), ("c", 50), ("c", 80), ("c", 90)]


def test_last_delivery_counts_and_channels_are_cleaned(spark):
    rows = [msg(1, channel="#C"), msg(2, "bot", "", 1, " c", 1), msg(2, "bot", "edited in", 1, "C ", 3), msg(2, "bot", "edited in", 1, "C ", 3)]
    assert dropped(spark, rows) == []
    assert dropped(spark, [*rows, msg(2, "bot", None, 1, "c", 5)]) == [("c", 1)]


def test_nulls_and_empty(spark):
    assert dropped(spark, []) == []
    assert dropped(spark, [msg(None), msg(1, channel=None), msg(2, None, None, 1)]) == [("c", 2)]


def test_long_chain_and_hot_opener(spark):
    rows = [msg(1)] + [msg(i, "bot" if i % 2 else "ann", "t", i - 1) for i in range(2, 200)] + [msg(i, "ann", "t", 1) for i in range(1000, 1400)]
    assert dropped(spark, rows) == []
    t = C.transcripts(spark.createDataFrame(rows, CHAT), spark.createDataFrame(FOLK, PEOPLE)).orderBy("turn").collect()
    assert [r.turn for r in t] == list(range(1, len(rows) + 1)) and [r.seq for r in t] == sorted(r[0] for r in rows)
    assert t[0].role == "user" and t[2].role == "assistant"


@pytest.mark.parametrize("text,said", [("a", True), (" \t\n", False), ("⁠", False), (None, False), ("", False)])
def test_has_text(spark, text, said):
    assert spark.createDataFrame([(text,)], "x string").select(C.has_text(C.F.col("x")).alias("y")).first().y is said
