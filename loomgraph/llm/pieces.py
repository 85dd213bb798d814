"""Splitting oversized texts at natural boundaries.

A text is parsed into a tree: headings hold what follows them, code fences hold their blocks, then come blocks between
blank lines, list items (nested by indentation), lines, sentences, words. Whole sibling subtrees are merged up to the
limit and only nodes beyond it are descended into; what a node was cut into is never glued to its siblings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a piece, and of what a piece repeats of the one before it.
LIMIT, OVERLAP = 1600, 160

_BLANK = re.compile(r"(?>\r\n|\n|\r)(?:[ \t]*(?>\r\n|\n|\r))+")  # atomic: a \r\n is never two line ends
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
_HEAD = re.compile(r"[ \t]*(#{1,6})[ \t]")
_SENTENCE = re.compile(r".*?(?:[.!?…][\"'»”)\]]*(?:\s+|$)|$)", re.S)
_TOKEN = re.compile(r"\S*\s*")
#: Levels of lists within lists; deeper ones are cut by lines.
_NESTED = 50
_FENCE = re.compile(r"(?:^|(?<=[\r\n]))[ \t]{0,3}(```|~~~)")
_ITEM = re.compile(r"(?:^|(?<=[\r\n]))([ \t]*)(?:[-*+•]|\d{1,9}[.)])[ \t]")
_RUN = re.compile(r"[ \t\r\n]+")

Span = tuple[int, int]


def blocks(text: str) -> list[Span]:
    """The text divided after each run of blank lines; the spans cover it whole."""
    ends = [m.end() for m in _BLANK.finditer(text)]
    edges = [0, *(e for e in ends if e < len(text)), len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def plain(text: str) -> str:
    """Runs of space, tab and line ends as one space, none outside."""
    return _RUN.sub(" ", text).strip(" ")


def _by(pattern: re.Pattern, text: str, a: int, b: int) -> list[Span]:
    out = []
    while a < b:
        m = pattern.match(text, a, b)
        e = m.end() if m and m.end() > a else b
        out.append((a, e))
        a = e
    return out


@dataclass
class Node:
    """A part of the text: [a, b), its children in order, and for blocks their number among the non-empty ones."""

    a: int
    b: int
    kids: list[Node] = field(default_factory=list)
    number: int | None = None
    size: int = 0
    head: bool = False


def _fences(text: str, nodes: list[Node]) -> list[Node]:
    """Blocks that a code fence spans, in one node; a fence that never closes is none."""
    out: list[Node] = []
    held: list[Node] = []
    mark = None
    for n in nodes:
        n.head = mark is None and _HEAD.match(text, n.a, n.b) is not None
        for m in _FENCE.finditer(text[n.a : n.b]):
            mark = m[1] if mark is None else None if mark == m[1] else mark
        held.append(n)
        if mark is None:
            out.append(Node(held[0].a, n.b, held, head=held[0].head) if len(held) > 1 else n)
            held = []
    for n in held:
        n.head = _HEAD.match(text, n.a, n.b) is not None
    return out + held


def tree(text: str) -> Node:
    """The text as a node whose descendants are sections, fences and blocks; finer levels are parsed when needed."""
    nodes, number = [], 0
    for a, b in blocks(text):
        size = len(plain(text[a:b]))
        number += size > 0
        nodes.append(Node(a, b, number=number if size else None, size=size))
    root = Node(0, len(text))
    open_: list[tuple[int, Node]] = [(0, root)]
    for n in _fences(text, nodes):
        if n.head:
            level = len(_HEAD.match(text, n.a, n.b)[1])
            while open_[-1][0] >= level:
                open_.pop()
            section = Node(n.a, n.b, [n])
            open_[-1][1].kids.append(section)
            open_.append((level, section))
        else:
            open_[-1][1].kids.append(n)
        for _, s in open_:
            s.b = n.b
    return root


def _items(text: str, a: int, b: int) -> list[Span]:
    """A list's items at its least indentation, with what stands before the first."""
    found = [(len(m[1]), a + m.start()) for m in _ITEM.finditer(text[a:b]) if m.start()]
    least = min((i for i, _ in found), default=0)
    edges = [a, *(at for i, at in found if i == least), b]
    return list(zip(edges, edges[1:]))


def _finer(text: str, n: Node, room: int, deep: int) -> list[Node]:
    """What a node without children is made of: items, else lines, else sentences, else words, else plain cuts."""
    for spans in (_items(text, n.a, n.b) if deep < _NESTED else [], *(_by(p, text, n.a, n.b) for p in (_LINE, _SENTENCE, _TOKEN))):
        if len(spans) > 1:
            return [Node(a, b) for a, b in spans]
    return [Node(i, min(i + room, n.b)) for i in range(n.a, n.b, room)]


def pack(text: str, n: Node, limit: int, room: int, opened: list[Node], deep: int = 0) -> list[Span]:
    """The pieces of a node: itself if within the limit, else its children's, whole siblings merged up to ``room``.

    A section's heading goes with the first piece of what follows it. Nodes that were descended into are added to ``opened``.
    """
    if n.b - n.a <= limit:
        return [(n.a, n.b)]
    opened.append(n)
    out: list[Span] = []
    joins = False  # the last piece is whole children, or the heading
    for kid in n.kids or _finer(text, n, room, deep):
        got = pack(text, kid, limit, room, opened, deep + 1)
        whole = len(got) == 1
        if joins and (whole or (n.kids and n.kids[0].head and out[-1] == (n.kids[0].a, n.kids[0].b))) and got[0][1] - out[-1][0] <= room:
            got[0] = (out.pop()[0], got[0][1])
        out += got
        joins = whole
    return out


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, opened: list[Node] | None = None) -> list[tuple[int, int, int]]:
    """(start, own, end) of each piece: [start, own) repeats the piece before it, the own parts make up the text.

    A piece that is a node of nearly the limit repeats less than ``overlap``, as much as the limit leaves.
    """
    out = []
    for a, b in pack(text, tree(text), limit, limit - overlap, [] if opened is None else opened) if text else []:
        lo = max(0, a - min(overlap, limit - (b - a)))
        start = a
        if lo < a:
            cut = next((m.end() for m in re.finditer(r"[.!?…]\s+|[\r\n]+", text[lo:a]) if m.end() < a - lo), None)
            cut = cut if cut is not None else next((m.end() for m in re.finditer(r"\s+", text[lo:a]) if m.end() < a - lo), 0)
            start = lo + cut
        out.append((start, a, b))
    return out


def oversized(opened: list[Node], limit: int = LIMIT) -> list[int]:
    """The numbers of the nodes that had to be descended into: 0 for the text, n for its n-th block.

    A block counts by its plain length, so one that is cut for its white space alone is not reported.
    """
    return sorted([*([0] if opened else []), *(n.number for n in opened if n.number and n.size > limit)])


def current(df: DataFrame, src: str, key: str, text: str, at: str, limit: int) -> DataFrame:
    """(src_table, item_key, body) of the records whose latest text is beyond the limit; only these texts are moved."""
    early = F.coalesce(F.col(at).cast("timestamp_ntz"), F.timestamp_micros(F.lit(-(2**55))).cast("timestamp_ntz"))
    rows = df.select(F.col(key).alias("item_key"), early.alias("at"), F.col(text).alias("body")).where("item_key IS NOT NULL")
    last = rows.groupBy("item_key").agg(F.max("at").alias("at"))
    big = rows.where(F.length("body") > limit)
    return big.join(last, ["item_key", "at"]).dropDuplicates(["item_key"]).select(F.lit(src).alias("src_table"), "item_key", "body")


def project_texts(tickets: DataFrame, raw_records: DataFrame, limit: int = LIMIT) -> DataFrame:
    return current(tickets, "tickets", "key", "description", "ingested_at", limit).unionByName(current(raw_records, "raw_records", "id", "body", "loaded_at", limit))


def pieces(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """texts(src_table, item_key, body): every piece, and the tree nodes that had to be descended into.

    Gives src_table, item_key, piece_no (from 1), start, own, stop, content and block_no; a row is a piece (block_no
    null) or an oversized node (piece_no null; 0 the text, n its n-th block). Null and empty texts give nothing.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for src, key, body in zip(pdf["src_table"], pdf["item_key"], pdf["body"]):
                if not body:
                    continue
                opened: list[Node] = []
                out += [(src, key, i, s, o, e, body[s:e], None) for i, (s, o, e) in enumerate(split(body, limit, overlap, opened), 1)]
                out += [(src, key, None, None, None, None, None, n) for n in oversized(opened, limit)]
            if not out:
                continue
            yield pd.DataFrame(out, columns=["src_table", "item_key", "piece_no", "start", "own", "stop", "content", "block_no"]).astype({c: "Int64" for c in ("piece_no", "start", "own", "stop", "block_no")})

    return texts.select("src_table", "item_key", "body").mapInPandas(run, "src_table string, item_key string, piece_no long, start long, own long, stop long, content string, block_no long")
