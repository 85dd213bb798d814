"""Rebuilding conversations from message rows.

Rows are an event log: creates, edits, deletes (a version without text), retries and late deliveries of one message
fold into the version delivered last. Replies then connect the messages, and conversations that are broken, circular
or unanswered are told apart from the sound ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.names import channel_key, handle_key, message_name
from loomgraph.operators.forest import climb, cycles
from loomgraph.operators.records import delivered, latest, ordinals
from loomgraph.plans.session import cut

#: White space (no-break space included) and zero-width characters: a text of these alone is missing.
BLANK = r"\s\x{0b}\x{85}\p{Z}\x{200b}-\x{200d}\x{2060}\x{feff}"


def has_text(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[^{BLANK}]"), F.lit(False))


def roles(people: DataFrame) -> DataFrame:
    """(handle, role) with one row per handle; of several the least role counts, a null role means user."""
    return people.where("handle IS NOT NULL").groupBy("handle").agg(F.min(F.coalesce("role", F.lit("user"))).alias("role"))


def turns(chat: DataFrame, people: DataFrame) -> DataFrame:
    """Final turns: channel, seq, node, up, at (delivery), handle, role, said; narrow rows, to be written once.

    Rows without channel or seq are no messages. reply_to 0 means none. An unknown or null author is a user.
    """
    cols = [handle_key(F.col("author")).alias("handle"), has_text(F.col("text")).alias("said"), F.col("reply_to"), delivered("arrived_at").alias("at")]
    rec = latest(chat, [channel_key(F.col("channel")).alias("channel"), F.col("seq").alias("seq")], "arrived_at", cols)
    node = lambda seq: message_name(F.col("channel"), F.col(seq))
    rec = rec.select("*", node("seq").alias("node"), F.when(F.col("reply_to") != 0, node("reply_to")).alias("up")).drop("reply_to")
    return rec.join(roles(people), "handle", "left").withColumn("role", F.coalesce("role", F.lit("user")))


def conversations(msgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """msgs(node, up, channel, seq, role, said): membership (node, conv) and one row per conversation.

    The second table has conv, channel, root_seq, messages, replies, broken (a reply_to without row), circular, answered.
    """
    links = msgs.where("up IS NOT NULL").select("node", "up")
    done, far = climb(links)
    conv = done.select("node", F.col("root").alias("conv"), F.lit(False).alias("circular"))
    if far is not None:
        _, reach = cycles(links.join(far.select("node"), "node", "left_semi").select("node", F.col("up").alias("parent")), far)
        conv = conv.union(reach.select("node", F.col("cycle").alias("conv"), F.lit(True).alias("circular")))
    own = msgs.join(conv, "node", "left").select("node", "channel", "seq", "role", "said", F.coalesce("conv", "node").alias("conv"), F.coalesce("circular", F.lit(False)).alias("circular"), F.col("up").isNotNull().alias("is_reply"))
    user = F.when((F.col("role") == "user") & F.col("said"), F.col("seq"))
    assistant = F.when((F.col("role") == "assistant") & F.col("said"), F.col("seq"))
    per = own.groupBy("conv").agg(
        F.min("channel").alias("channel"), F.min("seq").alias("root_seq"), F.count(F.lit(1)).alias("messages"), F.count_if("is_reply").alias("replies"),
        F.bool_or(F.col("node") == F.col("conv")).alias("rooted"), F.bool_or("circular").alias("circular"), F.min(user).alias("asked"), F.max(assistant).alias("told"),
    )
    sound = F.coalesce(F.col("told") > F.col("asked"), F.lit(False))
    per = per.select("conv", "channel", "root_seq", "messages", "replies", (~F.col("rooted") & ~F.col("circular")).alias("broken"), "circular", sound.alias("answered"))
    return own.select("node", "conv"), per


def dropped(per: DataFrame) -> DataFrame:
    """(channel, root_seq) of the dropped conversations that have a reply."""
    return per.where("replies > 0 AND (broken OR circular OR NOT answered)").select("channel", "root_seq")


def transcripts(chat: DataFrame, people: DataFrame) -> DataFrame:
    """The surviving conversations' turns in order: channel, root_seq, turn, seq, role, author, ts, text.

    Turns without text are left out of the order; a conversation needs a reply and an answered user to survive. Texts
    are joined at the end, by the delivery that made each surviving turn.
    """
    msgs, _ = cut(turns(chat, people))
    member, per = conversations(msgs)
    keep = per.where("replies > 0 AND NOT broken AND NOT circular AND answered").select("conv", "root_seq")
    kept = msgs.where("said").join(member, "node").join(keep, "conv").select("channel", "root_seq", "seq", "role", F.col("handle").alias("author"), "at")
    rows = chat.select(channel_key(F.col("channel")).alias("channel"), "seq", delivered("arrived_at").alias("at"), "ts", "text")
    # Deliveries of one time are identical.
    said = rows.join(kept.select("channel", "seq", "at"), ["channel", "seq", "at"], "left_semi").groupBy("channel", "seq").agg(F.first(F.struct("ts", "text")).alias("row"))
    return ordinals(kept.drop("at").join(said, ["channel", "seq"]).select("channel", "root_seq", "seq", "role", "author", "row.*"), ["channel", "root_seq"], "seq")
