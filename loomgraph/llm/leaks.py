"""Evaluation texts leaking into training text.

The test items' word n-grams are normalised, hashed and broadcast, in blocks of bounded size; every training text is
scanned window by window, once for all blocks that a task may hold, and each hit is verified word by word. Items of
fewer words than a window share none and are never reported.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.session import cut

#: Words of a window.
SPAN = 13
#: Characters of test items per broadcast block, blocks that one scan holds, characters of texts looked up at a time.
BLOCK_CHARS, HELD, SLICE = 8_000_000, 4, 1_000_000

_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_WORD = re.compile(r"[^\W_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def normal(text: str) -> str:
    """Without soft hyphens and zero-width characters, NFKC, lower case."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).lower()


def words(text: str | None) -> list[str]:
    return _WORD.findall(normal(text)) if text else []


def _windows(ids: np.ndarray, span: int) -> np.ndarray:
    """A hash of each window of ``span`` word ids."""
    n = len(ids) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, u = np.zeros(n, np.uint64), (ids + 2).astype(np.uint64)
    for j in range(span):
        h = h * _PRIME + u[j : j + n]
    return h ^ (h >> np.uint64(29))


class Grams:
    """The n-grams of some test items: a vocabulary, sorted window hashes and where each occurs."""

    def __init__(self, items: list[tuple[str, list[str]]], span: int = SPAN):
        self.span, self.vocab, ids, self.names, owner, at = span, {}, [], [], [], 0
        hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for name, texts in items:
            self.names.append(name)
            for text in texts:
                own = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words(text)], np.int64)
                h = _windows(own, span)
                hashes.append(h)
                places.append(at + np.arange(len(h)))
                ids.append(own)
                owner.append(np.full(len(own), len(self.names) - 1))
                at += len(own)
        h, p = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        self.hashes, self.places = h[order], p[order]
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, item) of every window of ``ids`` that is a test n-gram; -1 is a word no item has."""
        h = _windows(ids, self.span)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        many = hi - lo
        start = np.repeat(at, many)
        place = self.places[np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())] if many.sum() else np.zeros(0, np.int64)
        same = np.ones(len(start), bool)
        for j in range(self.span):  # verified word by word
            same &= ids[start + j] == self.ids[place + j]
        return start[same], self.owner[place[same]]


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, list[str]]]]:
    """The items in blocks that hold about BLOCK_CHARS characters at most."""
    items = items.select("item_id", F.array("passage", "question").alias("texts"), (F.length(F.coalesce("passage", F.lit(""))) + F.length(F.coalesce("question", F.lit("")))).alias("n")).where("item_id IS NOT NULL")
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    for b in range(blocks):
        yield [(r.item_id, [t for t in r.texts if t]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]


def _groups(items: DataFrame, span: int) -> Iterator[list]:
    """The items' n-grams, broadcast: up to HELD blocks (some 300 MB of a task) for each scan."""
    sc, held = items.sparkSession.sparkContext, []
    for block in _blocks(items):
        held.append(sc.broadcast(Grams(block, span)))
        if len(held) == HELD:
            yield held
            held = []
    if held:
        yield held


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of some SLICE characters, of one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= SLICE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _hits(texts: list[str | None], held: list) -> Iterator[tuple[np.ndarray, np.ndarray, Grams, np.ndarray]]:
    """(text's number, word's number, n-grams, item) of the windows that each block of n-grams shares with the texts."""
    for lo, hi in _slices(texts):
        tokens = [words(t) for t in texts[lo:hi]]
        starts = np.cumsum([0, *(len(w) + 1 for w in tokens[:-1])])
        for block in held:
            g, gap, flat = block.value, [-1], []
            get = g.vocab.get
            for w in tokens:
                flat += [get(x, -1) for x in w]
                flat += gap
            start, item = g.hits(np.array(flat, np.int64))
            if len(start):
                doc = np.searchsorted(starts, start, "right") - 1
                yield lo + doc, start - starts[doc], g, item


def leaks(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, item_id, windows): documents that share ``span`` consecutive words with an item's passage or question.

    ``windows`` counts the document's windows found in the item. Null, blank and shorter texts share nothing; a
    document's repeated rows give repeated results; items with equal passages are all reported. Map-only: one scan for
    every HELD blocks of items, that is for 32 million characters of them.
    """
    docs, schema, out = docs.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL"), "doc_id long, item_id string, windows long", None
    for held in _groups(items, span):

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids = pdf["doc_id"].to_numpy()
                for doc, at, g, item in _hits(list(pdf["text"]), held):
                    per = pd.DataFrame({"d": doc, "i": item, "at": at}).drop_duplicates().groupby(["d", "i"], as_index=False).size()
                    yield pd.DataFrame({"doc_id": ids[per["d"]], "item_id": [g.names[k] for k in per["i"]], "windows": per["size"]})

        part = docs.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def word_spans(text: str) -> list[tuple[int, int]] | None:
    """Where in ``text`` each of words(text) stands; None if the characters cannot be traced through NFKC."""
    out, at = [], []
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and (unicodedata.combining(text[j]) or _INVISIBLE.match(text[j])):
            j += 1
        piece = normal(text[i:j])
        out.append(piece)
        at += [(i, j)] * len(piece)
        i = j
    flat = "".join(out)
    if flat != normal(text):
        return None
    return [(at[m.start()][0], at[m.end() - 1][1]) for m in _WORD.finditer(flat)]


def without(text: str, at: list[int], span: int) -> str:
    """``text`` without the windows of ``span`` words that begin at the words ``at``; all of it goes if it cannot be traced."""
    where = word_spans(text)
    if where is None:
        return ""
    keep, last = [], 0
    for a in sorted(at):
        lo, hi = where[a][0], where[a + span - 1][1]
        if lo > last:
            keep.append(text[last:lo])
        last = max(last, hi)
    return "".join([*keep, text[last:]])


def clean(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, text, removed): every row, without the spans it shares with any item.

    ``removed`` counts the characters taken out; a document whose characters cannot be traced loses its whole text.
    Spans are cut where they are found, row by row, so repeated ids and null ids are no matter, nothing is shuffled and
    the corpus is read once. Items beyond HELD blocks add a pass for each HELD more; the places found so far are then
    written along with the texts.
    """
    groups = list(_groups(items, span))
    docs = docs.select("doc_id", "text", F.lit(0).cast("long").alias("removed"), F.array().cast("array<int>").alias("at"))
    for i, held in enumerate(groups):
        last = i == len(groups) - 1

        def run(batches: Iterator[pd.DataFrame], held=held, last=last) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts, places = list(pdf["text"]), [set(x) for x in pdf["at"]]
                for doc, at, _, _ in _hits(texts, held):
                    for d, a in zip(doc.tolist(), at.tolist()):
                        places[d].add(a)
                if last:
                    new = [without(t, p, span) if p else t for t, p in zip(texts, places)]
                    pdf = pdf.assign(text=new, removed=[len(t or "") - len(n or "") for t, n in zip(texts, new)])
                    places = [[]] * len(pdf)
                yield pdf.assign(at=[sorted(p) for p in places])

        docs = docs.mapInPandas(run, "doc_id long, text string, removed long, at array<int>")
        if not last:
            docs, _ = cut(docs)
    return docs.drop("at")
