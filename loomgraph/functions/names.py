"""Cleaning of the names by which records refer to one another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any Unicode white space, in a form that Java's and RE2's patterns share.
SPACE = r"[\s\x{0b}\x{85}\p{Z}]"


def strip(c: Column) -> Column:
    """``c`` without white space of any kind at its ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def slug(c: Column) -> Column:
    """Lower case; each run of other characters than a-z and 0-9 becomes one dash; no outer dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def page_key(c: Column) -> Column:
    """The stem a page name means, null if it names nothing."""
    k = slug(F.regexp_replace(strip(c), "^doc:", ""))
    return F.when(k != "", k)


def ticket_key(c: Column) -> Column:
    """The ticket key a name means, null if it names nothing."""
    k = F.regexp_replace(strip(c), "^ticket:", "")
    return F.when(k != "", k)


def channel_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), rf"^#+{SPACE}*", ""))


def handle_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), "^(@|person:)", "")


def message_name(channel: Column, seq: Column) -> Column:
    """A message's name within the joins: of two in a channel the one with the smaller seq sorts first."""
    s = seq.cast("string")
    return F.concat(channel, F.lit(":"), F.char(F.length(s) + 64), s)


def named(c: Column, key) -> Column:
    """The distinct keys that an array of names means; null arrays, null and blank entries mean nothing."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.array_distinct(F.filter(F.transform(c, key), lambda k: k.isNotNull())), none)
