"""Parent-child links to full hierarchies.

A table of links is a forest when each node has at most one parent. Subtree sizes are summed upwards; every parent
hands its children consecutive preorder ranges by prefix sums over their sizes, roots likewise over the whole forest;
adding these downwards gives each node its range. The ranges then answer all questions: one sweep over them tells how
many are open at a node (its depth) and which root's is, and a node's descendants are those whose number lies in its
range. Nodes that the upward pass never settles are on a cycle or lead to one. Both passes double the distance
they look, so a chain of n links takes log2(n) rounds of joins, each over the nodes that are still open.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.plans.session import cut, cut_by, joined

#: The looked-up side of every join has one row per node, so its hash tables are as large as its partitions and no
#: hot parent can swell them; sorting the names of both sides would cost more than the join.
BUILD = "shuffle_hash"
#: Children of one parent that one task may order.
SIBLINGS = 50_000
#: Numbers that each part of the roots has; a part holds some SIBLINGS roots and all below them.
SPAN = 2**40
#: Preorder numbers that one task sweeps.
SWEEP = 65_536
#: Links that one task finishes by plain search, some 50 MB; more go on in rounds of joins, to the same result.
LOCAL = 200_000


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def subtree_sizes(links: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """links(node, parent), written and ``n`` of them, parents not null, one row per node.

    Gives (node, size - 1) of every node with descendants, and the links of 2^k steps of the unsettled nodes, or None.
    """
    open_ = links.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"))
    rounds, k, left = [open_], 0, n
    while left:
        # Only nodes with something 2^k below can be looked up.
        above = open_.where(F.col("size") >= 2**k).select(F.col("node").alias("up"), F.col("up").alias("up2"))
        below = open_.groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        nxt = open_.join(above.hint(BUILD), "up").select("node", F.col("up2").alias("up"), "size").join(below.hint(BUILD), "node", "left")
        open_, now = cut(nxt.select("node", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        if now == left:  # depths are contiguous: no node settled, so none of the rest ever will
            break
        rounds, left, k = [*rounds, open_], now, k + 1
    inner = union(rounds).groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("below"))
    return inner, (open_.select("node", "up") if left else None)


def climb(state: DataFrame, total: str | None = None, weight: str | None = None, own: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    """state(node, up[, total][, weight][, own]): follow ``up`` to nodes that have no row.

    Gives (node, root[, total][, weight][, own]), with ``total`` summed along the way, and the open rest (node, up) that runs
    in a circle, or None. ``weight`` is any upper bound of a node's height plus one, ``own`` columns stay as they are.
    """
    spark, own = state.sparkSession, tuple(c for c in (weight, *own) if c)
    extra = [*([total] if total else []), *own]
    open_, left = cut(state.select("node", "up", *extra))
    schema, kept, settled, k = open_.schema, [], [], 0
    look = open_
    while left:
        if weight:
            look = look.where(F.col(weight) > 2**k)
        look = look.select(F.col("node").alias("up"), F.col("up").alias("up2"), *([F.col(total).alias(f"{total}2")] if total else []))
        j = open_.join(look.hint(BUILD), "up", "left")
        cols = [F.col("node"), F.coalesce("up2", "up").alias("up")]
        if total:
            cols.append((F.col(total) + F.coalesce(f"{total}2", F.lit(0))).alias(total))
        cols += [F.col(c) for c in own]
        # Settled nodes too low to be looked up again are kept apart from the rest.
        low = F.col(weight) <= 2 ** (k + 1) if weight else F.lit(False)
        kind = F.when(F.col("up2").isNotNull(), "open").when(low, "low").otherwise("kept")
        parts = cut_by(j.select(*cols, kind.alias("kind")), "kind", ("open", "kept", "low"))
        kept += [parts["kept"][0]] if "kept" in parts else []
        settled += [parts[x][0] for x in ("kept", "low") if x in parts]
        at, now = parts.get("open", ("", 0))
        open_ = joined(spark, [at] if now else [], schema)
        look = joined(spark, [*([at] if now else []), *kept], schema)
        if now == left:
            break
        left, k = now, k + 1
    done = joined(spark, settled, schema)
    return done.select("node", F.col("up").alias("root"), *extra), (open_.select("node", "up") if left else None)


def _circles(up: dict[str, str]) -> dict[str, str]:
    """Each node's circle, by plain search: the least node of the one it is on or leads to; nodes that lead to none are left out."""
    out: dict[str, str | None] = {}
    for start in up:
        path, at = [], start
        while at in up and at not in out:
            out[at] = None
            path.append(at)
            at = up[at]
        name = out.get(at)
        if name is None and at in up and path and at in path:
            name = min(path[path.index(at) :])
        for n in path:
            out[n] = name
    return {n: c for n, c in out.items() if c is not None}


def small_cycles(links: DataFrame) -> DataFrame:
    """``cycles`` in one task: (node, cycle, member)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[str, str] = {}
        for pdf in batches:
            up.update(zip(pdf["node"], pdf["parent"]))
        name = _circles(up)
        on = set()
        for c in set(name.values()):
            at = up[c]
            on.add(c)
            while at != c:
                on.add(at)
                at = up[at]
        yield pd.DataFrame({"node": list(name), "cycle": list(name.values()), "member": [n in on for n in name]})

    return links.select("node", "parent").coalesce(1).mapInPandas(run, "node string, cycle string, member boolean")


def cycles(links: DataFrame, far: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links(node, parent) and far(node, up): the nodes that reach a circle, with a link of 2^k steps each.

    Gives (node, cycle) for the nodes on circles and for all of ``far``; a cycle is named by its least node.
    """
    links, n = cut(links.select("node", "parent"))
    if n <= LOCAL:
        got, _ = cut(small_cycles(links))
        return got.where("member").select("node", "cycle"), got.select("node", "cycle")
    image = far.select("up").distinct().count()
    while True:
        hop = far.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        far, _ = cut(far.join(hop, "up").select("node", F.col("up2").alias("up")))
        now = far.select("up").distinct().count()
        if now == image:
            break
        image = now
    on = far.select(F.col("up").alias("node")).distinct()
    low, _ = cut(links.join(on, "node", "left_semi").select("node", F.col("parent").alias("up"), F.least("node", "parent").alias("cycle")))
    while True:
        hop = low.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("cycle").alias("cycle2"))
        low, _ = cut(low.join(hop, "up").select("node", F.col("up2").alias("up"), F.least("cycle", "cycle2").alias("cycle"), (F.col("cycle2") < F.col("cycle")).alias("moved")))
        moved = low.where("moved").limit(1).count()
        low = low.drop("moved")
        if not moved:
            break
    on = low.select("node", "cycle")
    return on, far.join(on.select(F.col("node").alias("up"), "cycle"), "up").select("node", "cycle")


def sibling_offsets(kids: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """kids(node, parent, size), of ``n`` links and the roots above them (parent null): (node, up, off, size, is_root).

    A child's ``off`` is 1 plus the sizes of the siblings before it (in order of node). Roots are dealt to parts, each with
    a range of SPAN numbers of its own, and follow one another there; ``up`` is empty for them.
    A parent with more than SIBLINGS children has them cut into ranges by hash; the ranges' sums are taken first.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(max(1, n // SIBLINGS)))
    kids = kids.select("node", F.coalesce("parent", F.lit("")).alias("up"), "size", F.col("parent").isNull().alias("is_root"))
    kids = kids.withColumn("part", F.when(F.col("is_root"), part).otherwise(0))
    first = F.when(F.col("is_root"), F.col("part") * SPAN).otherwise(1)
    hot = links.groupBy("parent").count().where(F.col("count") > SIBLINGS).agg(F.max("count")).first()[0] or 0
    s = -(-hot // SIBLINGS)
    if s <= 1:
        w = Window.partitionBy("up", "part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        return kids.withColumn("off", first + F.coalesce(F.sum("size").over(w), F.lit(0))).select("node", "up", "off", "size", "is_root")
    kids = kids.withColumn("slice", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(4 * s)))
    sums = kids.groupBy("up", "part", "slice").agg(F.sum("size").alias("held"))
    w = Window.partitionBy("up", "part").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("up", "part", "slice", F.coalesce(F.sum("held").over(w), F.lit(0)).alias("before"))
    w = Window.partitionBy("up", "part", "slice").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    own = kids.withColumn("own", F.coalesce(F.sum("size").over(w), F.lit(0)))
    return own.join(sums, ["up", "part", "slice"]).select("node", "up", (first + F.col("before") + F.col("own")).alias("off"), "size", "is_root")


def swept(ranges: DataFrame) -> DataFrame:
    """ranges(node, lft, size, is_root), all over one numbering: adds ``depth`` and ``root``, read off the ranges.

    A node's depth is the number of ranges that are open where its own begins, its root the last that began. The numbers
    are cut into pages of SWEEP; what is open where a page begins comes from the pages' sums.
    """
    begin = ranges.select("node", "lft", "size", F.col("lft").alias("at"), (F.col("size") > 1).cast("int").alias("step"), F.when(F.col("is_root"), F.struct("lft", "node")).alias("top"))
    end = ranges.where("size > 1").select(F.lit(None).cast("string").alias("node"), F.lit(None).cast("long").alias("lft"), F.lit(None).cast("long").alias("size"), (F.col("lft") + F.col("size")).alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("struct<lft: bigint, node: string>").alias("top"))
    events = begin.unionByName(end).withColumn("page", F.expr(f"at div {SWEEP}"))
    pages = events.groupBy("page").agg(F.sum("step").alias("sum"), F.max("top").alias("top"))
    w = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # a row for each page
    pages = pages.select("page", F.coalesce(F.sum("sum").over(w), F.lit(0)).alias("before"), F.max("top").over(w).alias("top_before"))
    w = Window.partitionBy("page").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumns({"open": F.sum("step").over(w), "top": F.max("top").over(w)}).where("node IS NOT NULL")
    depth = F.col("open") + F.col("before") - F.when(F.col("size") > 1, 1).otherwise(0)
    return rows.join(pages, "page").select("node", F.coalesce("top", "top_before")["node"].alias("root"), depth.alias("depth"), "lft", "size")


def nested_sets(links: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """links(node, parent), parents not null: the forest as ranges.

    Gives (node, root, depth, lft, size) of the roots (depth 0) and of the settled nodes below them, written (the descendants of a node are
    those with lft in (lft, lft + size)), and far links of the unsettled ones, or None.
    A node's row appears once; null, empty nodes or parents must not occur; an empty table gives empty tables.
    """
    if n is None:  # else they are written already
        links, n = cut(links.select("node", "parent"))
    below, far = subtree_sizes(links, n)
    # A node with descendants but no link is a root.
    tree = links.hint(BUILD).join(below, "node", "full").select("node", "parent", (F.lit(1) + F.coalesce("below", F.lit(0))).alias("size"))
    if far is not None:
        tree = tree.join(far.select("node"), "node", "left_anti")
    off = sibling_offsets(tree, links, n)
    # Roots have no parent's row to look up; below them the numbers add up along the way down.
    done, _ = climb(off, total="off", weight="size", own=("is_root",))
    ranges, _ = cut(swept(done.select("node", F.col("off").alias("lft"), "size", "is_root")))
    return ranges, far


def descendants(ranges: DataFrame, of: DataFrame, page: int = 256) -> DataFrame:
    """All (ancestor, node) pairs below the nodes of ``of``, a subset of nested_sets' rows, by their ranges.

    Preorder numbers are cut into pages and a range is joined with the pages it meets, so work follows the output.
    """
    ask = of.select(F.col("node").alias("ancestor"), F.col("lft").alias("lo"), (F.col("lft") + F.col("size") - 1).alias("hi")).where("hi > lo")
    ask = ask.withColumn("page", F.explode(F.sequence(F.expr(f"lo div {page}"), F.expr(f"hi div {page}"))))
    have = ranges.select("node", "lft", F.expr(f"lft div {page}").alias("page"))
    return ask.join(have, "page").where("lft > lo AND lft <= hi").select("ancestor", "lo", "node")
