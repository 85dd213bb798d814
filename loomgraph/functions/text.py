"""Tokens, mentions, cards and citations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never become keywords.
STOPWORDS = (
    "the and for are was were with that this from what which who whom whose when where why how does did has have had not but any all can will would should could about into than then them they their there its you your our out"
).split()

TICKET = r"\b[A-Za-z]{2,}-\d+\b"
HANDLE = r"@([A-Za-z0-9][A-Za-z0-9_-]*)"
WIKILINK = r"\[\[([^\]\n]+)\]\]"
URL = r"https?://[^\s)>\]]+"


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order, repeats kept."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def keywords(c: Column, least: int = 3) -> Column:
    """Typed tokens (ticket keys) verbatim, then other terms of ``least`` letters that are no stopwords.

    A repeat, whatever its case, keeps its first form and place.
    """
    typed = F.regexp_extract_all(c, F.lit(f"({TICKET})"), F.lit(1))
    plain = F.filter(terms(c), lambda t: (F.length(t) >= least) & ~t.isin(STOPWORDS))
    both = F.concat(typed, plain)
    lower = F.transform(both, lambda t: F.lower(t))
    return F.filter(both, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1)


def mentions(c: Column, pattern: str, group: int = 1) -> Column:
    """Distinct matches of a pattern in a text, none for null."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group))), F.array().cast("array<string>"))


def sanitize(c: Column) -> Column:
    """A label or relation name: other characters than letters and digits become one underscore; no leading digit."""
    s = F.regexp_replace(F.regexp_replace(c, "[^0-9A-Za-z]+", "_"), "^_|_$", "")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def relation_type(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_"), "^_|_$", "")


def person_name(c: Column) -> Column:
    """A name for a handle that has none: its dash-separated parts, each with a capital."""
    return F.array_join(F.transform(F.split(c, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), " ")


def clause(word: str, c: Column) -> Column:
    """``word`` and the value, or null so that a joined card leaves it out."""
    return F.when(c != "", F.concat(F.lit(f"{word} "), c))


def citation(node: Column) -> Column:
    """[prefix:local] of a node id."""
    return F.concat(F.lit("["), node, F.lit("]"))


def cited(c: Column) -> Column:
    """The node ids that a text cites."""
    return mentions(c, r"\[([a-z]+:[^\]\s]+)\]")


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines, inner white space collapsed, empties dropped."""
    parts = F.transform(F.split(c, r"\r?\n[ \t]*\r?\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(parts, lambda p: p != "")


def choice_letter(c: Column, n: Column) -> Column:
    """Index of the first standalone letter of a reply, null if there is none or it names no choice."""
    i = F.ascii(F.upper(F.regexp_extract(c, r"\b([A-Za-z])\b", 1))) - 65
    return F.when((i >= 0) & (i < n), i)


def choices_text(c: Column) -> Column:
    """One line per choice, lettered from A."""
    return F.array_join(F.transform(c, lambda x, i: F.concat(F.char(i + 65), F.lit(") "), x)), "\n")


def preview(c: Column, n: int) -> Column:
    """The first ``n`` characters, and an ellipsis if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def json_span(c: Column) -> Column:
    """The object in a reply: from the first brace to the last, within a code fence if there is one; else an empty object."""
    fenced = F.regexp_extract(c, r"(?s)```[a-zA-Z]*\s*(.*?)```", 1)
    span = F.regexp_extract(F.when(fenced != "", fenced).otherwise(c), r"(?s)(\{.*\})", 1)
    return F.when(span != "", span).otherwise("{}")


def names_by_rel(refs: Column) -> Column:
    """refs(rel, targetId, name): a map from each relation to its names, each once, in order of first appearance."""
    rels = F.array_distinct(F.transform(refs, lambda r: r["rel"]))
    of = lambda rel: F.array_distinct(F.transform(F.filter(refs, lambda r: r["rel"] == rel), lambda r: r["name"]))
    return F.map_from_entries(F.transform(rels, lambda rel: F.struct(rel, of(rel))))


def content_hash(parts: Column) -> Column:
    """A hash of an array of texts in order, kept apart by a null character."""
    return F.sha2(F.array_join(parts, "\0"), 256)


def earliest(c: Column, words: list[tuple[str, str]]) -> Column:
    """What the word that stands first in the text, whatever the case, means; null if none does. Ties go by order."""
    low = F.lower(c)
    at = [F.when(F.instr(low, F.lit(w)) > 0, F.struct(F.instr(low, F.lit(w)).alias("at"), F.lit(i).alias("i"), F.lit(t).alias("t"))) for i, (w, t) in enumerate(words)]
    return F.array_min(F.array(*at))["t"]


def first_matches(c: Column, words: list[tuple[str, str]], n: int) -> Column:
    """What the first ``n`` words, by their order in the list, that the text contains mean; each meaning once."""
    low = F.lower(c)
    got = F.array(*[F.when(F.coalesce(low.contains(w), F.lit(False)), F.lit(t)) for w, t in words])
    return F.slice(F.array_distinct(F.array_compact(got)), 1, n)
