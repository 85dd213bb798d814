"""Chunks of the records and what they mention: HAS_CHUNK and MENTIONS edges, and the entities they bring.

A record's chunks are its card (number 0) and its body's paragraphs. What the record's text mentions hangs off the card:
known people and components (a gazetteer), handles, tickets that exist, and URLs, which become entities of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.functions.names import slug
from loomgraph.operators.graph import Records, gazetteer_hits


def chunk_id(owner: str = "owner_id", idx: str = "idx"):
    return F.concat(F.col(owner), F.lit("#c"), F.col(idx).cast("string"))


def has_chunk(cards: DataFrame) -> DataFrame:
    """cards(owner_id, idx, content): (src, rel, dst, index) from each owner to its chunks."""
    return cards.select(F.col("owner_id").alias("src"), F.lit("HAS_CHUNK").alias("rel"), chunk_id().alias("dst"), F.col("idx").alias("index"))


def record_texts(rec: Records) -> DataFrame:
    """(id, text): what a record says of itself; its mentions are looked for there."""
    both = F.concat_ws("\n", "title", "description")
    parts = [(rec.tickets, both), (rec.prs, both), (rec.chat, F.col("text")), (rec.docs, F.col("title"))]
    return reduce(DataFrame.unionByName, [df.select("id", c.alias("text")) for df, c in parts])


def vocabulary(named: DataFrame, people: DataFrame) -> DataFrame:
    """named(id), people and components that have a node: (term, target), by their slugs and by the people's names."""
    known = named.select("id").distinct()
    own = known.select(F.expr("substring(id, instr(id, ':') + 1)").alias("term"), F.col("id").alias("target"))
    names = people.select(F.concat(F.lit("person:"), slug(F.col("handle"))).alias("id"), F.lower("name").alias("term")).join(known, "id")
    return own.union(names.select("term", F.col("id").alias("target"))).where("term <> ''").distinct()


def mentions(texts: DataFrame, vocab: DataFrame, cards: DataFrame, tickets: DataFrame) -> DataFrame:
    """(src, rel, dst): from each record's card to what its text mentions; no record mentions itself.

    ``tickets`` (id) are those that exist. A record without a card (blank) mentions nothing.
    """
    some = lambda pattern, group, make: texts.select("id", F.explode(F.transform(text.mentions(F.col("text"), pattern, group), make)).alias("target"))
    prefixed = lambda p: lambda x: F.concat(F.lit(p), F.nullif(slug(x), F.lit("")))
    found = gazetteer_hits(texts, vocab).unionByName(some(text.HANDLE, 1, prefixed("person:"))).unionByName(some(f"({text.URL})", 1, prefixed("entity:")))
    named = some(f"({text.TICKET})", 1, lambda x: F.concat(F.lit("ticket:"), x)).join(tickets.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
    rows = found.unionByName(named.select("id", "target")).where("target IS NOT NULL AND target <> id").distinct()
    cards = cards.where("idx = 0").select(F.col("owner_id").alias("id")).distinct()
    return rows.join(cards, "id", "left_semi").select(F.concat("id", F.lit("#c0")).alias("src"), F.lit("MENTIONS").alias("rel"), F.col("target").alias("dst"))


def label_of(c: str):
    """The label that an id's prefix means."""
    names = {"ticket": "Ticket", "pr": "PullRequest", "msg": "Message", "doc": "Document", "person": "Person", "component": "Component", "entity": "Entity", "meeting": "Meeting"}
    return F.when(F.col(c).rlike("#c[0-9]+$"), "Chunk").otherwise(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.substring_index(c, ":", 1)])


def with_chunks(nodes: DataFrame, edges: DataFrame, cards: DataFrame, said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with its chunks, their edges, and the people and entities that only mentions name."""
    new = said.where("dst LIKE 'person:%' OR dst LIKE 'entity:%'").select(F.col("dst").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti").select("id", label_of("id").alias("label"))
    nodes = nodes.unionByName(cards.select(chunk_id().alias("id"), F.lit("Chunk").alias("label"))).unionByName(new)
    return nodes, edges.unionByName(has_chunk(cards).select("src", "rel", "dst")).unionByName(said)


def orphan_chunks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks (id) that no edge HAS_CHUNK comes in to."""
    return nodes.where("label = 'Chunk'").select("id").join(edges.where("rel = 'HAS_CHUNK'").select(F.col("dst").alias("id")), "id", "left_anti")


def build_errors(records: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """records(id): (id, error) of those without a node, or without any chunk; empty for a sound build."""
    has = nodes.select("id", F.lit(True).alias("node")).distinct()
    held = edges.where("rel = 'HAS_CHUNK'").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("chunks"))
    got = records.select("id").distinct().join(has, "id", "left").join(held, "id", "left")
    return got.select("id", F.when(F.col("node").isNull(), "no node").when(F.col("chunks").isNull(), "no chunk").alias("error")).where("error IS NOT NULL")


def provenance(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(id): (id, chunk, owner), the chunks that mention a node and the records that hold them."""
    said = edges.where("rel = 'MENTIONS'").select(F.col("dst").alias("id"), F.col("src").alias("chunk"))
    held = edges.where("rel = 'HAS_CHUNK'").select(F.col("dst").alias("chunk"), F.col("src").alias("owner"))
    return said.join(targets.select("id").distinct(), "id", "left_semi").join(held, "chunk").select("id", "chunk", "owner")


def first_pair(said: DataFrame) -> DataFrame:
    """The stand-in for a model that reads relations off a text: (src, rel, dst, source), its two first mentions, related."""
    per = said.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("d")).where("size(d) > 1")
    return per.select(F.element_at("d", 1).alias("src"), F.lit("RELATED").alias("rel"), F.element_at("d", 2).alias("dst"), F.substring_index("src", "#c", 1).alias("source"))


def extracted(said: DataFrame, extract=first_pair) -> DataFrame:
    """(src, rel, dst, sources): relations that ``extract`` found; each names every record it was found in, once."""
    return extract(said).groupBy("src", "rel", "dst").agg(F.sort_array(F.collect_set("source")).alias("sources"))
