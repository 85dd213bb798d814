"""The property graph of the project's records: nodes, edges, chunks, and how to walk them.

A graph is two tables, nodes(id, label) and edges(src, rel, dst). An edge exists only between existing nodes, once.
Questions are answered in batches: a start set carries its query id through every join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import text
from loomgraph.functions.names import channel_key, handle_key, named, page_key, slug, ticket_key
from loomgraph.operators.records import latest
from loomgraph.plans.session import cut

#: Relations between owners of texts; the default for walks.
OWNER_RELS = ("REFERENCES", "BLOCKS", "REPLY_TO", "DISCUSSES", "FIXES")
#: The columns that state each relation.
STATED = {"ASSIGNED": "assignee", "REPORTED": "reporter", "ABOUT": "components", "REFERENCES": "references", "BLOCKS": "blocks", "AUTHORED_BY": "author", "REVIEWED_BY": "reviewers", "FIXES": "fixes", "SENT_BY": "author", "REPLY_TO": "reply_to"}
#: Deepest walk.
CEILING = 4
#: Nodes of all questions that a walk broadcasts, and pairs of question and node that one of its tasks works out.
FEW, PAIRS = 1_000_000, 2_000_000


def _person(c: Column) -> Column:
    s = slug(handle_key(c))
    return F.when(s != "", F.concat(F.lit("person:"), s))


def _slugs(c: Column) -> Column:
    def key(x: Column) -> Column:
        s = slug(x)
        return F.when(s != "", s)

    return named(c, key)


def _ids(prefix: str, c: Column) -> Column:
    return F.transform(c, lambda k: F.concat(F.lit(prefix), k))


def _one(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))


@dataclass
class Records:
    """The latest state of each record, with its node id and its links as arrays of node ids by relation."""

    tickets: DataFrame
    prs: DataFrame
    chat: DataFrame
    docs: DataFrame

    @classmethod
    def of(cls, tickets: DataFrame, prs: DataFrame, chat: DataFrame, documents: DataFrame, rels: tuple[str, ...] | None = None) -> Records:
        """All columns; or with ``rels`` only those that state these relations, so that no text is moved to find the latest states."""
        only = None if rels is None else {STATED[r] for r in rels if r in STATED}
        keep = lambda *cols: [c for c in cols if only is None or c in only] or [F.lit(True).alias("_none")]
        t = latest(tickets, [F.col("key").alias("k")], "ingested_at", keep("title", "description", "status", "assignee", "reporter", "components", "references", "blocks"))
        p = latest(prs, [F.col("repo").alias("r"), F.col("number").alias("n")], "ingested_at", keep("title", "description", "state", "author", "reviewers", "fixes", "components", "references"))
        c = latest(chat, [channel_key(F.col("channel")).alias("ch"), F.col("seq").alias("sq")], "arrived_at", keep("author", "ts", "text", "reply_to", "references"))
        d = documents.where("stem IS NOT NULL").groupBy("stem").agg(F.max_by(F.struct(*keep("title", "author", "components", "text")), F.struct("ingested_at", "doc_id")).alias("v")).select("stem", "v.*")
        return cls(t.withColumn("id", F.concat(F.lit("ticket:"), "k")), p.withColumn("id", F.concat(F.lit("pr:"), slug(F.col("r")), F.lit("#"), F.col("n").cast("string"))), c.withColumn("id", F.concat(F.lit("msg:"), "ch", F.lit(":"), F.col("sq").cast("string"))), d.withColumn("id", F.concat(F.lit("doc:"), "stem")))

    def links(self, rels: tuple[str, ...] | None = None) -> DataFrame:
        """(src, rel, dst) as the records state them, of ``rels`` or all: repeats within a record collapse, targets may not exist.

        Only the tables and columns that state one of ``rels`` are read.
        """

        def out(df: DataFrame, of: dict[str, Column]) -> list[DataFrame]:
            pairs = [F.transform(c, _tagger(rel)) for rel, c in of.items() if rels is None or rel in rels]
            return [df.select(F.col("id").alias("src"), F.explode(F.concat(*pairs)).alias("e")).select("src", "e.rel", "e.dst")] if pairs else []

        refs = _ids("doc:", named(F.col("references"), page_key))
        about = _ids("component:", _slugs(F.col("components")))
        t = out(self.tickets, {"ASSIGNED": _one(_person(F.col("assignee"))), "REPORTED": _one(_person(F.col("reporter"))), "ABOUT": about, "REFERENCES": refs, "BLOCKS": _ids("ticket:", named(F.col("blocks"), ticket_key))})
        p = out(self.prs, {"AUTHORED_BY": _one(_person(F.col("author"))), "REVIEWED_BY": F.array_distinct(F.filter(F.transform(F.coalesce("reviewers", F.array().cast("array<string>")), _person), lambda x: x.isNotNull())), "FIXES": _ids("ticket:", named(F.col("fixes"), ticket_key)), "ABOUT": about, "REFERENCES": refs})
        to = F.when(F.col("reply_to") != 0, F.concat(F.lit("msg:"), "ch", F.lit(":"), F.col("reply_to").cast("string")))
        c = out(self.chat, {"SENT_BY": _one(_person(F.col("author"))), "REPLY_TO": _one(to), "REFERENCES": refs})
        d = out(self.docs, {"AUTHORED_BY": _one(_person(F.col("author"))), "ABOUT": about})
        return reduce(DataFrame.unionByName, [*t, *p, *c, *d])

    def edges(self, rels: tuple[str, ...] | None = None) -> DataFrame:
        """The distinct links of ``rels`` whose target exists; people and components exist by being named."""
        links = self.links(rels).distinct()
        have = {"REFERENCES": self.docs, "BLOCKS": self.tickets, "FIXES": self.tickets, "REPLY_TO": self.chat}
        ends = {id(df): df for rel, df in have.items() if rels is None or rel in rels}
        if not ends:
            return links
        ids = reduce(DataFrame.unionByName, [df.select(F.col("id").alias("dst")) for df in ends.values()]).distinct().withColumn("to", F.lit(True))
        return links.join(ids, "dst", "left").where("to OR dst LIKE 'person:%' OR dst LIKE 'component:%'").select("src", "rel", "dst")

    def nodes(self, links: DataFrame) -> DataFrame:
        """(id, label): a node per record, and one per person and component that some record names."""
        own = [df.select("id", F.lit(label).alias("label")) for df, label in ((self.tickets, "Ticket"), (self.prs, "PullRequest"), (self.chat, "Message"), (self.docs, "Document"))]
        named_ = links.where("dst LIKE 'person:%' OR dst LIKE 'component:%'").select(F.col("dst").alias("id"), F.when(F.col("dst").startswith("person:"), "Person").otherwise("Component").alias("label")).distinct()
        return reduce(DataFrame.unionByName, [*own, named_])

    def cards(self) -> DataFrame:
        """(owner_id, idx, content): each record's card as chunk 0, its body's paragraphs from 1; empty chunks left out."""
        blank = F.lit("")
        t = self.tickets.select("id", F.concat_ws(". ", F.concat_ws(" ", F.lit("Ticket"), "k", F.nullif(F.trim("title"), blank)), text.clause("Status", F.trim("status")), text.clause("Assignee", F.trim("assignee")), text.clause("Reporter", F.trim("reporter"))).alias("card"), F.col("description").alias("body"))
        p = self.prs.select("id", F.concat_ws(". ", F.concat_ws(" ", F.lit("Pull request"), F.nullif(F.trim("title"), blank)), text.clause("State", F.trim("state")), text.clause("Author", F.trim("author"))).alias("card"), F.col("description").alias("body"))
        c = self.chat.select("id", F.trim(F.regexp_replace(F.coalesce("text", blank), r"\s+", " ")).alias("card"), F.lit(None).cast("string").alias("body"))
        d = self.docs.select("id", F.coalesce(F.trim("title"), blank).alias("card"), F.col("text").alias("body"))
        all_ = reduce(DataFrame.unionByName, [t, p, c, d])
        parts = F.concat(F.array("card"), F.coalesce(text.paragraphs(F.col("body")), F.array().cast("array<string>")))
        return all_.select(F.col("id").alias("owner_id"), F.posexplode(parts).alias("idx", "content")).where("content <> ''")


def _tagger(rel: str):
    return lambda k: F.struct(F.lit(rel).alias("rel"), k.alias("dst"))


def connect(links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, dangling): the distinct links both of whose ends exist, and the distinct rest."""
    have = nodes.select("id").distinct()
    ends = links.distinct().join(have.select(F.col("id").alias("dst"), F.lit(True).alias("to")), "dst", "left").join(have.select(F.col("id").alias("src"), F.lit(True).alias("from")), "src", "left")
    ok = F.col("to").isNotNull() & F.col("from").isNotNull()
    return ends.where(ok).select("src", "rel", "dst"), ends.where(~ok).select("src", "rel", "dst")


def project_graph(tickets: DataFrame, prs: DataFrame, chat: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), written once."""
    rec = Records.of(tickets, prs, chat, documents, tuple(STATED))
    links, _ = cut(rec.links())
    nodes, _ = cut(rec.nodes(links))
    edges, _ = cut(rec.edges())
    return nodes, edges


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, rel, b, out): each edge seen from either end; a self-loop once."""
    back = edges.where("src <> dst").select(F.col("dst").alias("a"), "rel", F.col("src").alias("b"), F.lit(False).alias("out"))
    return edges.select(F.col("src").alias("a"), "rel", F.col("dst").alias("b"), F.lit(True).alias("out")).unionByName(back)


def neighbours(start: DataFrame, edges: DataFrame, direction: str = "out", rels: tuple[str, ...] | None = None, cap: int | None = None) -> DataFrame:
    """start(q, id): distinct (q, id, rel, neighbour) over edges going out, in or both ways.

    With ``cap``, the first of each (q, id) by relation and neighbour: a hub cannot starve the others.
    """
    if rels:
        edges = edges.where(F.col("rel").isin(*rels))
    step = {"out": edges.select(F.col("src").alias("id"), "rel", F.col("dst").alias("neighbour")), "in": edges.select(F.col("dst").alias("id"), "rel", F.col("src").alias("neighbour"))}
    step["both"] = step["out"].union(step["in"])
    out = start.join(step[direction], "id").select("q", "id", "rel", "neighbour").distinct()
    if cap is None:
        return out
    return out.withColumn("n", F.row_number().over(Window.partitionBy("q", "id").orderBy("rel", "neighbour"))).where(F.col("n") <= cap).drop("n")


def walk(start: DataFrame, edges: DataFrame, depth: int, rels: tuple[str, ...] | None = OWNER_RELS, directed: bool = False) -> DataFrame:
    """start(q, id): (q, id, hops), every node within ``depth`` (1 to CEILING) steps and its least number of steps.

    Each step extends only the nodes that the last one added; what was seen before is taken off by an anti join. While the nodes to
    extend are few, they come to the edges, which are dealt by where they lead: what all reach is not moved.
    """
    depth = max(1, min(depth, CEILING))
    if rels:
        edges = edges.where(F.col("rel").isin(*rels))
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"))
    if not directed:
        step = step.union(edges.select(F.col("dst").alias("id"), F.col("src").alias("to")))
    step = step.distinct()
    seen = front = start.select("q", "id", F.lit(0).alias("hops")).distinct()
    n = most = None
    for hop in range(1, depth + 1):
        if n is not None and most <= FEW:
            pairs = step.join(F.broadcast(front.groupBy("id").agg(F.count(F.lit(1)).alias("n"))), "id").agg(F.sum("n")).first()[0] or 0
            dealt = step.repartition(max(int(step.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS)), "to")
            new = dealt.join(F.broadcast(front), "id").select("q", F.col("to").alias("id")).distinct()
            new = new.join(F.broadcast(seen.select("q", "id")), ["q", "id"], "left_anti")
        else:
            new = front.join(step, "id").select("q", F.col("to").alias("id")).distinct().join(seen.select("q", "id"), ["q", "id"], "left_anti")
        front = new.withColumn("hops", F.lit(hop))
        if hop < depth:
            if hop == 1:
                seen, most = cut(seen)
            front, n = cut(front)
            most += n
        seen = seen.unionByName(front)
    return seen


def met(start: DataFrame, goals: DataFrame, edges: DataFrame, rels: tuple[str, ...] | None = None) -> DataFrame:
    """start(q, id), goals(q, id): the distinct goals within two steps of their question's start.

    A step from either side: what only the starts reach is never listed.
    """
    if rels:
        edges = edges.where(F.col("rel").isin(*rels))
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("mid")).union(edges.select(F.col("dst").alias("id"), F.col("src").alias("mid"))).distinct()
    start = start.select("q", "id").distinct()
    near, _ = cut(start.join(step, "id").select("q", "mid").union(start.select("q", F.col("id").alias("mid"))).distinct())
    goals = goals.select("q", "id").distinct()
    back = goals.join(step, "id").select("q", "id", "mid").union(goals.select("q", "id", F.col("id").alias("mid")))
    return back.join(near, ["q", "mid"], "left_semi").select("q", "id").distinct()


def first_by_hops(walked: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` nodes of each query by (hops, id)."""
    n = F.row_number().over(Window.partitionBy("q").orderBy("hops", "id"))
    return walked.withColumn("n", n).where(F.col("n") <= limit).drop("n")


def reaches(start: DataFrame, goals: DataFrame, edges: DataFrame, depth: int = 3, rels: tuple[str, ...] | None = None) -> DataFrame:
    """start(q, id), goals(q, goal): (q, goal, hops) with hops null where no path of ``depth`` steps exists."""
    got = walk(start, edges, depth, rels).groupBy("q", F.col("id").alias("goal")).agg(F.min("hops").alias("hops"))
    return goals.select("q", "goal").distinct().join(got, ["q", "goal"], "left")


def connectivity(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """anchors(q, id): (q, id, anchors), non-anchors and how many distinct anchors each touches."""
    near = neighbours(anchors, edges, "both").select("q", F.col("neighbour").alias("id"), F.col("id").alias("anchor"))
    return near.groupBy("q", "id").agg(F.count_distinct("anchor").alias("anchors")).join(anchors.select("q", "id"), ["q", "id"], "left_anti")


def second_hop(anchors: DataFrame, edges: DataFrame, rels: tuple[str, ...] | None = None) -> DataFrame:
    """anchors(q, id): (q, id, paths), nodes two steps away and by how many paths; anchors and their neighbours left out."""
    if rels:
        edges = edges.where(F.col("rel").isin(*rels))
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).union(edges.select(F.col("dst").alias("id"), F.col("src").alias("to")))
    front = anchors.join(step, "id").select("q", F.col("to").alias("id")).distinct().join(anchors, ["q", "id"], "left_anti")
    count = front.join(step, "id").groupBy("q", F.col("to").alias("id")).agg(F.count(F.lit(1)).alias("paths"))
    return count.join(front.union(anchors.select("q", "id")).distinct(), ["q", "id"], "left_anti")


def in_all(parts: DataFrame) -> DataFrame:
    """parts(q, part, id): the ids that every part of a query has, for queries of two parts or more."""
    need = parts.groupBy("q").agg(F.count_distinct("part").alias("need")).where("need > 1")
    return parts.groupBy("q", "id").agg(F.count_distinct("part").alias("n")).join(need, "q").where("n = need").select("q", "id")


def shared_traits(edges: DataFrame, partner: str, trait: str) -> DataFrame:
    """(a, b, traits): partners by one relation that also share targets of another; only existing partners are paired."""
    pairs = edges.where(F.col("rel") == partner).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    has = edges.where(F.col("rel") == trait)
    both = pairs.join(has.select(F.col("src").alias("a"), F.col("dst").alias("t")), "a").join(has.select(F.col("src").alias("b"), F.col("dst").alias("t")), ["b", "t"])
    return both.groupBy("a", "b").agg(F.count_distinct("t").alias("traits"))


def hydrate(nodes: DataFrame, edges: DataFrame, label: str, rels: tuple[str, ...]) -> DataFrame:
    """(id, rel, n, targets) of each node of a label and each relation: the sorted target ids, joined by commas."""
    roots = nodes.where(F.col("label") == label).select("id").withColumn("rel", F.explode(F.array(*map(F.lit, rels))))
    got = edges.groupBy(F.col("src").alias("id"), "rel").agg(F.count_distinct("dst").alias("n"), F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("targets"))
    return roots.join(got, ["id", "rel"], "left").select("id", "rel", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("targets", F.lit("")).alias("targets"))


def nest(roots: DataFrame, edges: DataFrame, rels: tuple[str, ...]) -> DataFrame:
    """roots(id): (id, kids), along a path of relations: an array of struct(id, kids) per level, of ids on the last.

    Nodes already on the way from the root are left out, so cycles end. Arrays are sorted by id and empty where nothing
    follows. An array holds a node's own targets; work and size follow the nested result.
    """
    rows = roots.select(F.col("id").alias("n0"))
    for i, rel in enumerate(rels, 1):
        step = edges.where(F.col("rel") == rel).select(F.col("src").alias(f"n{i - 1}"), F.col("dst").alias(f"n{i}"))
        on_way = reduce(Column.__or__, [F.col(f"n{i}") == F.col(f"n{j}") for j in range(i)])
        # A target on the way is taken for none; the row stays for its root.
        rows = rows.join(step, f"n{i - 1}", "left").withColumn(f"n{i}", F.when(~F.coalesce(on_way, F.lit(False)), F.col(f"n{i}")))
    last = len(rels)
    rows = rows.groupBy(*[f"n{i}" for i in range(last)]).agg(F.sort_array(F.collect_set(f"n{last}")).alias("kids"))
    for i in range(last - 1, 0, -1):
        item = F.when(F.col(f"n{i}").isNotNull(), F.struct(F.col(f"n{i}").alias("id"), "kids"))
        rows = rows.groupBy(*[f"n{j}" for j in range(i)]).agg(F.sort_array(F.collect_list(item)).alias("kids"))
    return rows.select(F.col("n0").alias("id"), "kids")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id, label): (id, label, degree), the number of edges at each node; a self-loop counts once."""
    per = both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(per, "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    touched = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(touched, "id", "left_anti")


def gazetteer_hits(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """texts(id, text), vocabulary(term, target): distinct (id, target) whose term stands in the text as words.

    A term is bounded by other characters than a-z, 0-9 and dash. Texts and terms are cut there into words, and a text's
    runs of as many words as some term has are joined with the terms, so that neither texts nor products are moved.
    """
    cut_ = lambda c: F.split(F.regexp_replace(F.lower(c), "[^a-z0-9-]", " "), " ")
    v = vocabulary.where("term <> ''").select(F.array_join(cut_(F.col("term")), " ").alias("gram"), "target").distinct()
    sizes = sorted(r[0] for r in v.select(F.size(F.split("gram", " "))).distinct().collect())  # the lengths of terms in words
    if not sizes:
        return texts.select("id", F.lit(None).cast("string").alias("target")).limit(0)
    words = texts.where("text IS NOT NULL").select("id", cut_(F.col("text")).alias("ts"))

    def grams(n: int) -> Column:
        runs = F.col("ts") if n == 1 else F.transform(F.sequence(F.lit(1), F.size("ts") - n + 1), lambda i: F.array_join(F.slice("ts", i, n), " "))
        return F.when(F.size("ts") >= n, runs).otherwise(F.array().cast("array<string>"))

    runs = words.select("id", F.explode(F.array_distinct(F.concat(*map(grams, sizes)))).alias("gram"))
    return runs.join(v, "gram").select("id", "target").distinct()
