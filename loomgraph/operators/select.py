"""Analytics over result tables: skylines, running bests, streaks, splits, roll-ups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from loomgraph.operators.records import ordinals
from loomgraph.plans.session import cut


def _undominated(x: np.ndarray, block: int = 2048) -> np.ndarray:
    """Rows of ``x`` that no other row is at least as good as on all axes and better on one; larger is better."""
    x = np.unique(x, axis=0)[::-1]  # whatever dominates a row comes before it
    keep = x[:0]
    for i in range(0, len(x), block):
        part = x[i : i + block]
        for j in range(0, len(keep), block):
            part = part[~(keep[None, j : j + block] >= part[:, None]).all(2).any(1)]
        inside = (part[None, :] >= part[:, None]).all(2)
        keep = np.concatenate([keep, part[~np.tril(inside, -1).any(1)]])
    return keep


def skyline(rows: DataFrame, maximize: list[str], minimize: list[str], fan: int = 8) -> DataFrame:
    """The rows that no other row dominates (as good on every axis, better on one); rows with a null axis are left out.

    Equal rows share a fate. Each task keeps the skyline of its own rows; these are merged ``fan`` at a time, so that
    the last task compares no more than what ``fan`` merged parts could not rule out.
    """
    axes = [F.col(c).cast("double") for c in maximize] + [-F.col(c).cast("double") for c in minimize]
    names = [f"_x{i}" for i in range(len(axes))]
    rows = rows.withColumns(dict(zip(names, axes)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.zeros((0, len(names)))
        for pdf in batches:
            best = _undominated(np.concatenate([best, pdf.to_numpy()]))
        yield pd.DataFrame(best, columns=names)

    schema = ", ".join(f"{n} double" for n in names)
    keep = rows.select(*names).where(reduce(Column.__and__, [F.col(n).isNotNull() for n in names])).mapInPandas(run, schema)
    for parts in (fan * fan, fan, 1):
        keep = keep.repartition(parts).mapInPandas(run, schema)
    return rows.join(keep, names, "left_semi").drop(*names)


#: Numbers of the order that one task holds of a group.
PAGE = 100_000


def _pages(rows: DataFrame, by: str, order: str, page: int) -> tuple[DataFrame, WindowSpec, WindowSpec]:
    """``rows`` with ``_page``; the window of a page's own rows, and that of a group's pages before one."""
    rows = rows.withColumn("_page", F.expr(f"`{order}` div {page}"))
    return rows, Window.partitionBy(by, "_page").orderBy(order), Window.partitionBy(by).orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)


def running_best(rows: DataFrame, by: str, order: str, value: str, page: int = PAGE) -> DataFrame:
    """Adds ``best``, the largest value so far within ``by``, and ``improved``, whether this row raised it.

    ``order`` is a whole number. A group is cut into pages of it, whose maxima are taken first, so that a group with
    a third of all rows is not one task's; ``streaks``, ``deltas`` and ``followed`` do likewise.
    """
    paged, own, pages = _pages(rows, by, order, page)
    per = paged.groupBy(by, "_page").agg(F.max(value).alias("_m")).select(by, "_page", F.max("_m").over(pages).alias("_before"))
    before = F.greatest(F.max(value).over(own.rowsBetween(Window.unboundedPreceding, -1)), "_before")
    best = F.greatest(F.max(value).over(own.rowsBetween(Window.unboundedPreceding, 0)), "_before")
    return paged.join(per, [by, "_page"]).select(*rows.columns, best.alias("best"), (F.col(value) > F.coalesce(before, F.lit(float("-inf")))).alias("improved"))


def streaks(rows: DataFrame, by: str, order: str, progress: Column, page: int = PAGE) -> DataFrame:
    """Adds ``stale``: how many rows in a row, up to this one, made no progress."""
    paged, own, pages = _pages(rows.withColumn("_p", progress.cast("int")), by, order, page)
    last = F.max(F.when(F.col("_p") == 1, F.col(order)))
    per = paged.groupBy(by, "_page").agg(F.count(F.lit(1)).alias("_n"), last.alias("_last"))
    tail = paged.join(per.select(by, "_page", "_last"), [by, "_page"]).where(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).groupBy(by, "_page").agg(F.count(F.lit(1)).alias("_tail"))
    # Rows without progress at the end of the pages before, back to the last progress.
    per = per.join(tail, [by, "_page"], "left").withColumn("_group", F.count("_last").over(pages.rowsBetween(Window.unboundedPreceding, 0)))
    since = Window.partitionBy(by, "_group").orderBy("_page").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_run", F.sum(F.coalesce("_tail", F.lit(0))).over(since))
    per = per.select(by, "_page", F.coalesce(F.lag("_run").over(Window.partitionBy(by).orderBy("_page")), F.lit(0)).alias("_before"))
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    got = paged.withColumn("_g", F.sum("_p").over(upto)).join(per, [by, "_page"])
    stale = F.sum(1 - F.col("_p")).over(Window.partitionBy(by, "_page", "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return got.select(*rows.columns, (stale + F.when(F.col("_g") == 0, F.col("_before")).otherwise(0)).alias("stale"))


def followed(rows: DataFrame, by: str, order: str, value: str, name: str, page: int = PAGE) -> DataFrame:
    """Adds ``name``: the ``value`` of the row before, null for a group's first."""
    paged, own, _ = _pages(rows, by, order, page)
    per = paged.groupBy(by, "_page").agg(F.max_by(F.struct(value), order).alias("_last"))
    per = per.select(by, "_page", F.lag("_last").over(Window.partitionBy(by).orderBy("_page")).alias("_before"))
    inner = F.when(F.row_number().over(own) == 1, F.col("_before")[value]).otherwise(F.lag(value).over(own))
    return paged.join(per, [by, "_page"]).select(*rows.columns, inner.alias(name))


def deltas(rows: DataFrame, by: str, order: str, value: str, page: int = PAGE) -> DataFrame:
    """Adds ``delta``, the change from the row before; the first row's is its value."""
    got = followed(rows, by, order, value, "_was", page)
    return got.select(*rows.columns, (F.col(value) - F.coalesce("_was", F.lit(0))).alias("delta"))


def unique_best(scores: DataFrame, item: str, who: str, value: str) -> DataFrame:
    """(who, wins): on how many items each alone has the largest value above zero."""
    top = scores.groupBy(item).agg(F.max(value).alias("_top")).where(F.col("_top") > 0)
    at = scores.join(top, item).where(F.col(value) == F.col("_top")).groupBy(item).agg(F.count(F.lit(1)).alias("_n"), F.min(who).alias(who)).where("_n = 1")
    return at.groupBy(who).agg(F.count(F.lit(1)).alias("wins"))


def split(ids: DataFrame, key: str, parts: dict[str, int], seed: int = 0) -> DataFrame:
    """Adds ``split`` by an arithmetic hash of a whole-number key: parts are shares of 1000, the rest is 'rest'."""
    h = F.pmod(F.pmod(F.col(key) * 7919 + seed, F.lit(100003)) * 31, F.lit(1000))
    col, at = None, 0
    for name, share in parts.items():
        cond = (h >= at) & (h < at + share)
        col = F.when(cond, name) if col is None else col.when(cond, name)
        at += share
    return ids.withColumn("split", col.otherwise("rest"))


def last_per(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pairs_in_order(rows: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """(by, a, b): neighbours two by two by the whole number ``order``, unique within ``by``; an odd last one has no partner."""
    placed = ordinals(rows, [by], order, "_n")
    return placed.groupBy(by, F.floor((F.col("_n") - 1) / 2).alias("pair")).agg(F.min_by(key, "_n").alias("a"), F.when(F.count(F.lit(1)) > 1, F.max_by(key, "_n")).alias("b"))


def sample(ids: DataFrame, key: str, n: int, seed: int, epoch: int = 0) -> DataFrame:
    """``n`` rows by an arithmetic hash of a whole-number key, the seed and the epoch: the same ones whenever asked.

    With epochs the sample rotates; with another seed it is another one. The hash leaves few ties, which go by key. An
    operator whose feature is the bound; the rows are taken by a distributed top-k.
    """
    h = F.pmod(F.pmod(F.col(key) * 7919 + (seed * 100_003 + epoch) % 1_000_003, F.lit(1_000_003)) * 7877, F.lit(999_983))
    return ids.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def recent(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` keys by ``order``, each with its last row: a log without repeats."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")
    return last.orderBy(F.desc(order), key).limit(n)


def distractors(items: DataFrame, k: int, last: str = "CANNOT_DETERMINE") -> DataFrame:
    """items(item_id, answer): (item_id, options, answer_idx), the answer among ``k`` answers of other items, shuffled, and ``last``.

    The distinct answers stand in a ring by hash; an item takes those that follow its own, fewer if there are fewer. Its
    options are ordered by a hash with its id. Answers are numbered in one window: they are distinct short texts of an
    evaluation suite.
    """
    answers, n = cut(items.where("answer IS NOT NULL").select("answer").distinct())
    ring = answers.withColumn("p", F.row_number().over(Window.orderBy(F.md5("answer"), "answer")) - 1)
    own = items.join(ring, "answer").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(min(k, max(0, n - 1))))))
    asked = own.select("item_id", "answer", ((F.col("p") + F.col("o")) % max(1, n)).alias("p")).join(ring.select(F.col("answer").alias("opt"), "p"), "p")
    per = asked.groupBy("item_id", "answer").agg(F.sort_array(F.collect_list(F.struct(F.md5(F.concat("item_id", "opt")).alias("h"), "opt"))).alias("s"))
    opts = F.transform("s", lambda x: x["opt"])
    return per.select("item_id", F.concat(opts, F.array(F.lit(last))).alias("options"), (F.array_position(opts, F.col("answer")) - 1).alias("answer_idx"))
