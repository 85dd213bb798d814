"""Hierarchies of several parents per node: contraction to the nodes that branch, cycles, longest paths.

Nodes with one parent form a forest whose trees end in nodes that have none or several; nested sets settle it. What
is left is a graph over the branching nodes alone, whose edges carry the length of the chain between them. Cycles and
longest paths are found there and carried back along the trees: by one task's search if that graph has LOCAL edges at
most, else in rounds of joins, as many as it is deep.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.names import channel_key, message_name, named, ticket_key
from loomgraph.operators import forest
from loomgraph.operators.forest import cycles, descendants, nested_sets
from loomgraph.operators.records import latest
from loomgraph.plans.session import cut


def chat_nodes(chat: DataFrame) -> DataFrame:
    """(node, up) of the latest state of each message; up is the node replied to, null on openers.

    Node names sort like (channel, seq). A row without channel or seq is no message.
    """
    name = lambda seq: F.concat(F.lit("c|"), message_name(F.col("ch"), seq))
    rec = latest(chat, [channel_key(F.col("channel")).alias("ch"), F.col("seq").alias("sq")], "arrived_at", [F.col("reply_to").alias("re")])
    return rec.select(name(F.col("sq")).alias("node"), F.when(F.col("re") != 0, name(F.col("re"))).alias("up"))


def ticket_links(tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node) and links (node, parent) from each ticket to every existing ticket it blocks."""
    rec = latest(tickets, [F.col("key").alias("k")], "ingested_at", [F.col("blocks").alias("b")])
    name = lambda k: F.concat(F.lit("t|"), k)
    nodes = rec.select(name(F.col("k")).alias("node"))
    links = rec.select(name(F.col("k")).alias("node"), F.explode(named(F.col("b"), ticket_key)).alias("p")).select("node", name(F.col("p")).alias("parent"))
    return nodes, links.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent")


def strong_components(edges: DataFrame) -> DataFrame:
    """edges(a, b): (node, scc) of the nodes on cycles, scc being the least of the component.

    Nodes that nothing enters or leaves are trimmed round by round; then each node takes the least node it reaches,
    and those a label's own node reaches in turn within the label are a component.
    """

    def trim(e: DataFrame, n: int) -> tuple[DataFrame, int]:
        while n:
            e, now = cut(e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            if now == n:
                break
            n = now
        return e, n

    found, (e, n) = edges.select(F.col("a").alias("node"), F.col("a").alias("scc")).limit(0), trim(*cut(edges.select("a", "b").distinct()))
    while n:
        lab, _ = cut(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("low")))
        while True:
            seen = e.join(lab.select(F.col("node").alias("b"), F.col("low").alias("low2")), "b").groupBy(F.col("a").alias("node")).agg(F.min("low2").alias("low2"))
            lab, _ = cut(lab.join(seen, "node").select("node", F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
            if not lab.where("moved").limit(1).count():
                break
            lab = lab.drop("moved")
        lab = lab.select("node", "low")
        inner = e.join(lab.select(F.col("node").alias("a"), "low"), "a").join(lab.select(F.col("node").alias("b"), F.col("low").alias("low_b")), "b").where("low = low_b").select("a", "b", "low")
        inner, _ = cut(inner)
        comp, m = cut(lab.where("node = low").select("node", F.col("low").alias("scc")))
        while True:
            more = inner.join(comp.select(F.col("node").alias("a"), "scc"), "a").select(F.col("b").alias("node"), F.col("low").alias("scc"))
            comp, now = cut(comp.union(more).distinct())
            if now == m:
                break
            m = now
        loops = inner.where("a = b").select(F.col("a").alias("node"))
        real = comp.join(comp.groupBy("scc").count().where("count > 1").select("scc").union(loops.join(comp, "node").select("scc")).distinct(), "scc", "left_semi").select("node", "scc")
        found, _ = cut(found.union(real))
        gone = comp.select("node")
        e, n = trim(*cut(e.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")))
    return found


def components(up: dict[str, list[str]]) -> tuple[list[str], dict[str, str]]:
    """Nodes in an order in which all that a node can reach comes before it, and the component of each node on a cycle.

    A component is named by its least node. Depth-first search without recursion.
    """
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    order: list[str] = []
    stack: list[str] = []
    on, comp = set(), {}
    for start in up:
        if start in number:
            continue
        work = [(start, iter(up[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        on.add(start)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(up.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    own = []
                    while not own or own[-1] != v:
                        own.append(stack.pop())
                        on.discard(own[-1])
                    if len(own) > 1 or v in up.get(v, ()):
                        comp.update(dict.fromkeys(own, min(own)))
                    order += own
    return order, comp


def search(ends: list[tuple[str, str, int, str | None, bool]]) -> Iterator[tuple[str, str, str, int]]:
    """ends(b, s, w, into, fork): what a graph of branching nodes tells, as (kind, node, key, links).

    'scc': the component of each node on a cycle; 'hit': the components a node is on or reaches; 'into': the chains' own
    cycles it reaches; 'far': the longest path to each root clear of cycles. Memory follows the edges, not the answers.
    """
    up: dict[str, list[str]] = defaultdict(list)
    for b, s, _, into, fork in ends:
        up[b] += [s] if into is None and fork else []
    order, comp = components(up)
    place = {n: i for i, n in enumerate(order)}
    down: dict[str, list[tuple[str, int]]] = defaultdict(list)
    roots, led = set(), defaultdict(set)
    for b, s, w, into, fork in ends:
        if into is not None:
            led[into].add(b)
        else:
            down[s].append((b, w))
            if not fork:
                roots.add(s)

    def below(at: set[str], clear: bool) -> list[str]:
        seen, todo = set(at), list(at)
        while todo:
            for b, _ in down.get(todo.pop(), ()):
                if b not in seen and not (clear and b in comp):
                    seen.add(b)
                    todo.append(b)
        return [n for n in seen if n in place]

    members = defaultdict(set)
    for n, c in comp.items():
        yield "scc", n, c, 0
        members[c].add(n)
    for kind, starts in (("hit", members), ("into", led)):
        for key, at in starts.items():
            for n in below(at, False):
                yield kind, n, key, 0
    for r in roots:
        far = {r: 0}
        for n in [r, *sorted((x for x in below({r}, True) if x != r), key=place.__getitem__)]:
            for b, w in down.get(n, ()):
                if b not in comp:
                    far[b] = max(far.get(b, 0), far[n] + w)
        del far[r]
        for n, k in far.items():
            yield "far", n, r, k


def searched(ends: DataFrame) -> DataFrame:
    """``search`` over a written table of LOCAL rows at most, in one task."""
    kind = "kind string, node string, key string, links long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for pdf in batches for r in zip(pdf["b"], pdf["s"], pdf["w"], pdf["into"].astype(object).where(pdf["into"].notna(), None), pdf["fork"].notna())]
        part = []
        for r in search(rows):
            part.append(r)
            if len(part) == 50_000:
                yield pd.DataFrame(part, columns=["kind", "node", "key", "links"])
                part = []
        yield pd.DataFrame(part, columns=["kind", "node", "key", "links"])

    return ends.select("b", "s", "w", "into", "fork").coalesce(1).mapInPandas(run, kind)


class Hierarchies:
    """All hierarchies of some links, worked out once.

    ``links`` may give a node several parents, ``single`` at most one; they share no node.
    ``ranges``: nested sets of the trees of nodes with one parent (node, root, depth, lft, size), without the roots.
    ``depths``: (node, root, links) with the longest path of links to each root a node has, clear of cycles.
    ``circles``: (node, cycle, member) for nodes on a cycle (member) and nodes that can reach it.
    """

    def __init__(self, links: DataFrame, single: DataFrame | None = None):
        links, _ = cut(links.select("node", "parent").distinct())
        fan = links.groupBy("node").agg(F.count("parent").alias("n"), F.min("parent").alias("parent"))
        chain = fan.where("n = 1").select("node", "parent")
        if single is not None:
            chain = chain.union(single.select("node", "parent"))
        chain, n = cut(chain)
        forks, many = cut(links.join(fan.where("n > 1").select("node"), "node", "left_semi"))
        self.forest, far = nested_sets(chain, n)
        self.ranges = self.forest.where("depth > 0")
        on = reach = None
        if far is not None:
            on, reach = cycles(chain.join(far.select("node"), "node", "left_semi"), far)
        self.depths = self.ranges.select("node", "root", F.col("depth").alias("links"))
        self.circles = self._circles(on, reach)
        if many:
            self._branching(forks, many, on, reach)

    def _circles(self, on: DataFrame | None, reach: DataFrame | None) -> DataFrame:
        if on is None:
            return self.ranges.select("node", F.col("root").alias("cycle"), F.lit(True).alias("member")).limit(0)
        return reach.join(on.select("node", F.lit(True).alias("m")), "node", "left").select("node", "cycle", F.coalesce("m", F.lit(False)).alias("member"))

    def _branching(self, forks: DataFrame, many: int, on: DataFrame | None, reach: DataFrame | None) -> None:
        heads = forks.select("node").distinct()
        via = forks.select(F.col("node").alias("b"), F.col("parent").alias("p"))
        ends = via.join(self.ranges.select(F.col("node").alias("p"), F.col("root").alias("s"), "depth"), "p", "left")
        if reach is not None:
            ends = ends.join(reach.select(F.col("node").alias("p"), F.col("cycle").alias("into")), "p", "left")
        else:
            ends = ends.withColumn("into", F.lit(None).cast("string"))
        ends = ends.select("b", "p", F.coalesce("s", "p").alias("s"), (F.lit(1) + F.coalesce("depth", F.lit(0))).alias("w"), "into")
        ends, _ = cut(ends.join(heads.select(F.col("node").alias("s"), F.lit(True).alias("fork")), "s", "left"))
        forked, _ = cut(self.ranges.join(heads.select(F.col("node").alias("root")), "root", "left_semi").select("node", "root", "depth", "lft", "size"))
        steps = ends.where("into IS NULL AND fork").select("b", "p", "s", "w")
        got = None
        if many <= forest.LOCAL:
            got, _ = cut(searched(ends))
            scc, n_scc = cut(got.where("kind = 'scc'").select("node", F.col("key").alias("scc")))
        else:
            scc, n_scc = cut(strong_components(steps.select(F.col("b").alias("a"), F.col("s").alias("b"))))

        # Names and members of the cycles through branching nodes, with the chain nodes that close them.
        inside = steps.join(scc.select(F.col("node").alias("b"), "scc"), "b").join(scc.select(F.col("node").alias("s"), F.col("scc").alias("scc_s")), "s").where("scc = scc_s").select("p", "s", "scc")
        at = inside.join(forked.select(F.col("node").alias("p"), F.col("lft").alias("at")), "p").select(F.col("s").alias("root"), "scc", "at")
        chain = forked.join(at, "root").where("lft <= at AND at < lft + size").select("node", "scc").distinct()
        member, _ = cut(scc.union(chain).distinct())
        names = member.groupBy("scc").agg(F.min("node").alias("cycle"))
        member, _ = cut(member.join(names, "scc").select("node", "cycle"))

        if got is not None:
            hit = got.where("kind = 'hit'").join(names.withColumnRenamed("scc", "key"), "key").select("node", "cycle").union(got.where("kind = 'into'").select("node", "key")).distinct()
        else:
            hop = ends.where("into IS NULL").select("b", "s").distinct()
            hit, m = cut(member.join(heads, "node", "left_semi").union(ends.where("into IS NOT NULL").select(F.col("b").alias("node"), F.col("into").alias("cycle"))).distinct())
            while m:
                hit, now = cut(hit.union(hop.join(hit.select(F.col("node").alias("s"), "cycle"), "s").select(F.col("b").alias("node"), "cycle")).distinct())
                if now == m:
                    break
                m = now
        led = forked.select("node", F.col("root").alias("s")).join(hit.select(F.col("node").alias("s"), "cycle"), "s").select("node", "cycle")
        reached = hit.union(led).distinct()
        more = reached.join(member.select("node", "cycle", F.lit(True).alias("m")), ["node", "cycle"], "left").select("node", "cycle", F.coalesce("m", F.lit(False)).alias("member"))
        self.circles = self.circles.union(more)

        far_ = got.where("kind = 'far'").select("node", F.col("key").alias("root"), "links") if got is not None else self._longest(ends, scc, n_scc)
        plain = self.ranges.join(heads.select(F.col("node").alias("root")), "root", "left_anti")
        below = forked.join(far_.select(F.col("node").alias("root"), F.col("root").alias("top"), "links"), "root").select("node", F.col("top").alias("root"), (F.col("depth") + F.col("links")).alias("links"))
        self.depths = plain.select("node", "root", F.col("depth").alias("links")).union(below).union(far_)


    def _longest(self, ends: DataFrame, scc: DataFrame, n_scc: int) -> DataFrame:
        """(node, root, links): longest paths over the branching nodes that are on no cycle, a layer a round."""
        clear = ends.where("into IS NULL").select("b", "s", "w", "fork")
        if n_scc:
            clear = clear.join(scc.select(F.col("node").alias("b")), "b", "left_anti").join(scc.select(F.col("node").alias("s")), "s", "left_anti").select("b", "s", "w", "fork")
        clear, _ = cut(clear.groupBy("b", "s", "fork").agg(F.max("w").alias("w")))
        base = clear.where("fork IS NULL").select(F.col("b").alias("node"), F.col("s").alias("root"), F.col("w").alias("links"))
        far_, last = base, None
        while True:
            step = clear.where("fork").join(far_.select(F.col("node").alias("s"), "root", "links"), "s").select(F.col("b").alias("node"), "root", (F.col("w") + F.col("links")).alias("links"))
            far_, n = cut(base.union(step).groupBy("node", "root").agg(F.max("links").alias("links")))
            now = (n, far_.agg(F.sum("links")).first()[0])
            if now == last:
                return far_
            last = now


def node_id(c: str) -> Column:
    """The public id of the node in column ``c``: msg:<channel>:<seq> or ticket:<key>."""
    last = F.substring_index(c, ":", -1)
    channel = F.expr(f"substring({c}, 3, length({c}) - length(substring_index({c}, ':', -1)) - 3)")
    msg = F.concat(F.lit("msg:"), channel, F.lit(":"), F.substring(last, 2, 1000))
    return F.when(F.col(c).startswith("c|"), msg).otherwise(F.concat(F.lit("ticket:"), F.expr(f"substring({c}, 3)")))


def chat_links(chat: DataFrame) -> DataFrame:
    """(node, parent) from each message to the existing message it replies to."""
    msgs, _ = cut(chat_nodes(chat))
    replies = msgs.where("up IS NOT NULL").select("node", F.col("up").alias("parent"))
    return replies.join(msgs.select(F.col("node").alias("parent")).hint("shuffle_hash"), "parent", "left_semi").select("node", "parent")


def outline(links: DataFrame) -> DataFrame:
    """links(node, parent), one parent each: (node, root, depth, lft, size, path) of every root and settled node below one.

    ``path`` holds the nodes from the root to the node itself; a node has ``size`` - 1 descendants. Paths are put
    together from the ranges: a node's ancestors are those in whose range it lies, in order of their numbers.
    """
    ranges, _ = nested_sets(links)
    up = descendants(ranges, ranges.where("size > 1")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("lo", "ancestor"))).alias("up"))
    above = F.coalesce(F.transform("up", lambda x: x["ancestor"]), F.array().cast("array<string>"))
    return ranges.join(up, "node", "left").select("node", "root", "depth", "lft", "size", F.concat(above, F.array("node")).alias("path"))


def public(rows: DataFrame, *cols: str) -> DataFrame:
    """rows(node, root, cols): (hierarchy, node_id, root_id, cols)."""
    return rows.select(F.when(F.col("node").startswith("c|"), "chat").otherwise("tickets").alias("hierarchy"), node_id("node").alias("node_id"), node_id("root").alias("root_id"), *cols)


def found(h: Hierarchies, least: int = 8) -> DataFrame:
    """(hierarchy, node_id, root_id): roots at least ``least`` links up, and the cycles a node is on or reaches."""
    return public(h.depths.where(F.col("links") >= least).select("node", "root").union(h.circles.select("node", F.col("cycle").alias("root"))))
