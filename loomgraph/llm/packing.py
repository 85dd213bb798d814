"""Filling containers of a fixed number of tokens.

Best-two-fit: a container is filled greedily with the largest texts that fit; then its smallest text gives way to two
unpacked ones whose sum fits the widened gap more tightly. Documents are dealt by hash into shards of bounded size,
each packed by its own task, so only the last container of a shard has space to spare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.session import cut

#: A public tokenizer's file, tokens of a container, documents of a shard.
TOKENIZER, CAPACITY, SHARD = "/opt/tokenizers/piece_bpe_32k.model", 2048, 8192


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens): whole texts in tokens of a sentencepiece model; a null text has 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        for pdf in batches:
            out: list[int] = []
            texts = pdf["text"].fillna("").tolist()
            for i in range(0, len(texts), 64):
                out += map(len, sp.encode(texts[i : i + 64], num_threads=1))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": out})

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInPandas(run, "doc_id long, n_tokens long")


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; sizes are 1 to ``capacity``. Equal sizes are taken in the order given."""
    order = np.argsort(sizes, kind="stable")[::-1]
    stock = np.bincount(sizes, minlength=capacity + 1)
    top = np.cumsum(stock[::-1])[::-1]  # order[top[s] - stock[s] : top[s]] are the items of size s
    grid = np.arange(capacity + 1)
    fit = np.maximum.accumulate(np.where(stock > 0, grid, 0))  # the largest size in stock up to each gap
    bins = np.full(len(sizes), -1, np.int64)

    def take(s: int) -> None:
        nonlocal fit
        stock[s] -= 1
        if not stock[s]:
            fit = np.maximum.accumulate(np.where(stock > 0, grid, 0))

    def put(s: int) -> None:
        nonlocal fit
        stock[s] += 1
        if stock[s] == 1:
            fit = np.maximum.accumulate(np.where(stock > 0, grid, 0))

    held: list[list[int]] = []
    while fit[capacity]:
        own, gap = [], capacity
        while s := int(fit[gap]):
            take(s)
            own.append(s)
            gap -= s
        if gap:
            small = own[-1]
            wide = gap + small
            a = grid[1 : wide // 2 + 1]
            a = a[stock[a] > 0]
            if len(a):
                b = fit[wide - a]
                alone = (b == a) & (stock[a] < 2)
                if alone.any():
                    b = np.where(alone, fit[np.maximum(a - 1, 0)], b)
                total = np.where(b > 0, a + b, 0)
                i = int(total.argmax())
                if total[i] > small:
                    put(small)
                    own[-1] = int(a[i])
                    own.append(int(b[i]))
                    take(own[-2])
                    take(own[-1])
        held.append(own)
    nxt = top - np.bincount(sizes, minlength=capacity + 1)
    for k, own in enumerate(held):
        for s in own:
            bins[order[nxt[s]]] = k
            nxt[s] += 1
    return bins


def pack(counts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """counts(doc_id, n_tokens): (container_id, doc_id, part, first_token, n_tokens), every document.

    A document beyond the capacity is cut into full containers (parts from 0) and a rest that is packed like any
    other. Documents without tokens occupy nothing: their container_id is null. Ties go by doc_id.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    counts, n = cut(counts.select("doc_id", "n_tokens"))  # else the texts would be tokenized again
    shards = max(1, -(-n // shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        doc, n, at = pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy(), int(pdf["shard"].iloc[0]) << 40
        full = n // capacity
        rest = n % capacity
        which = np.repeat(np.arange(len(n)), full)
        part = np.arange(len(which)) - np.repeat(np.cumsum(full) - full, full)
        whole = pd.DataFrame({"container_id": at + np.arange(len(which)), "doc_id": doc[which], "part": part, "n_tokens": capacity})
        live = np.flatnonzero(rest)
        packed = pd.DataFrame({"container_id": at + len(which) + best_two_fit(rest[live], capacity), "doc_id": doc[live], "part": full[live], "n_tokens": rest[live]})
        none = np.flatnonzero(n == 0)
        empty = pd.DataFrame({"container_id": pd.array([None] * len(none), "Int64"), "doc_id": doc[none], "part": 0, "n_tokens": 0})
        out = pd.concat([x.astype({"container_id": "Int64"}) for x in (whole, packed, empty) if len(x)])
        out["first_token"] = out["part"] * capacity
        return out[["container_id", "doc_id", "part", "first_token", "n_tokens"]]

    dealt = counts.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInPandas(run, "container_id long, doc_id long, part long, first_token long, n_tokens long")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, texts (parts), tokens, and the share of the containers' space that is used."""
    per = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("k").alias("texts"), F.sum("n").alias("tokens"), F.round(F.sum("n") / (F.count(F.lit(1)) * capacity), 6).alias("used"))
