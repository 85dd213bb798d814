"""Queries over chunks, mentions, nested records, validation and samples, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.graph_queries import _CARDS, _G, _SEEDS, _STEP, _doomed, _edges, _graph, _seeds, _slug, _tables
from loomgraph.operators import chunks, graph, metrics, mutate, select
from loomgraph.operators.records import latest
from loomgraph.plans import schema
from loomgraph.plans.session import cut, new_path, table
from loomgraph.queries import SQL, query
from loomgraph.queries import _CHANNEL as CHANNEL
from loomgraph.search_queries import _METRICS, recall_hit_mrr
from loomgraph.sources import loaders

#: Relations whose targets are people and components.
_NAMING = ("ASSIGNED", "REPORTED", "ABOUT", "AUTHORED_BY", "REVIEWED_BY", "SENT_BY")


def _said(spark: SparkSession, d: str) -> tuple[graph.Records, DataFrame, DataFrame]:
    """The records, their chunks (owner_id, idx) and the edges MENTIONS, both written."""
    rec = graph.Records.of(*_tables(spark, d))
    cards, _ = cut(rec.cards().select("owner_id", "idx"))
    named = rec.links(_NAMING).select(F.col("dst").alias("id"))
    said, _ = cut(chunks.mentions(chunks.record_texts(rec), chunks.vocabulary(named, table(spark, d, "people")), cards, rec.tickets))
    return rec, cards, said


_MEN = rf"""{_CARDS},
mt AS (SELECT id, concat_ws(chr(10), title, description) x FROM t UNION ALL SELECT id, concat_ws(chr(10), title, description) FROM p UNION ALL SELECT id, txt FROM c UNION ALL SELECT id, title FROM dd),
pn AS (SELECT id FROM nodes WHERE label IN ('Person', 'Component')),
vocab AS (SELECT substring(id, strpos(id, ':') + 1) term, id target FROM pn UNION SELECT lower(name), 'person:' || {_slug("handle")} FROM people WHERE 'person:' || {_slug("handle")} IN (SELECT id FROM pn)),
nt AS (SELECT id, ' ' || regexp_replace(lower(x), '[^a-z0-9-]', ' ', 'g') || ' ' x FROM mt),
hits AS (SELECT nt.id, target FROM nt JOIN vocab ON contains(nt.x, ' ' || regexp_replace(term, '[^a-z0-9-]', ' ', 'g') || ' ')
  UNION SELECT id, 'person:' || nullif({_slug("h")}, '') FROM (SELECT id, unnest(regexp_extract_all(x, '@([A-Za-z0-9][A-Za-z0-9_-]*)', 1)) h FROM mt)
  UNION SELECT id, 'entity:' || nullif({_slug("u")}, '') FROM (SELECT id, unnest(regexp_extract_all(x, 'https?://[^\s)>\]]+')) u FROM mt)
  UNION SELECT id, 'ticket:' || k FROM (SELECT id, unnest(regexp_extract_all(x, '\b[A-Za-z]{{2,}}-\d+\b')) k FROM mt) WHERE 'ticket:' || k IN (SELECT id FROM t)),
said AS (SELECT id || '#c0' src, 'MENTIONS' rel, target dst FROM hits WHERE target IS NOT NULL AND target <> id AND id IN (SELECT owner_id FROM chunks WHERE idx = 0)),
held AS (SELECT owner_id src, 'HAS_CHUNK' rel, owner_id || '#c' || idx dst FROM chunks),
nodes2 AS (SELECT * FROM nodes UNION ALL SELECT dst, 'Chunk' FROM held UNION ALL SELECT DISTINCT dst, CASE WHEN dst LIKE 'person:%' THEN 'Person' ELSE 'Entity' END FROM said WHERE (dst LIKE 'person:%' OR dst LIKE 'entity:%') AND dst NOT IN (SELECT id FROM nodes)),
edges2 AS (SELECT * FROM edges UNION ALL SELECT * FROM held UNION ALL SELECT * FROM said)"""


@query
def mentions_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges MENTIONS by the kinds of record and target."""
    said = _said(spark, d)[2].select(F.substring_index("src", ":", 1).alias("kind"), F.substring_index("dst", ":", 1).alias("target"), "dst")
    return said.groupBy("kind", "target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("targets"))


SQL["mentions_edges"] = f"{_G}, {_MEN} SELECT split_part(src, ':', 1) kind, split_part(dst, ':', 1) target, count(*) n, count(DISTINCT dst) targets FROM said GROUP BY ALL"


@query
def mention_sources(spark: SparkSession, d: str) -> DataFrame:
    """Of each component: the chunks that mention it, and the records that hold them."""
    _, cards, said = _said(spark, d)
    edges = chunks.has_chunk(cards).select("src", "rel", "dst").unionByName(said)
    got = chunks.provenance(edges, said.where("dst LIKE 'component:%'").select(F.col("dst").alias("id")))
    return got.groupBy("id").agg(F.count_distinct("chunk").alias("chunks"), F.count_distinct("owner").alias("owners"))


SQL["mention_sources"] = f"{_G}, {_MEN} SELECT s.dst id, count(DISTINCT s.src) chunks, count(DISTINCT h.src) owners FROM said s JOIN held h ON h.dst = s.src WHERE s.dst LIKE 'component:%' GROUP BY 1"


@query
def owner_without_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Records without any chunk: what the check after a build reports."""
    rec = graph.Records.of(*_tables(spark, d))
    own = chunks.reduce(DataFrame.unionByName, [x.select("id") for x in (rec.tickets, rec.prs, rec.chat, rec.docs)])
    return chunks.build_errors(own, own, chunks.has_chunk(rec.cards()))


SQL["owner_without_chunk"] = f"{_G}, {_CARDS} SELECT DISTINCT id, 'no chunk' error FROM cards WHERE id NOT IN (SELECT owner_id FROM chunks)"


@query
def orphan_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks left without an owner if pages whose stem ends in a digit were deleted, and nothing else."""
    rec = graph.Records.of(*_tables(spark, d))
    cards, _ = cut(rec.cards().select("owner_id", "idx"))
    gone = _doomed(rec.docs.select("id", F.lit("Document").alias("label")))
    edges = chunks.has_chunk(cards).join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
    return chunks.orphan_chunks(cards.select(chunks.chunk_id().alias("id"), F.lit("Chunk").alias("label")), edges)


SQL["orphan_chunks"] = f"{_G}, {_CARDS} SELECT owner_id || '#c' || idx id FROM chunks WHERE owner_id LIKE 'doc:%' AND owner_id ~ '.*[0-9]$'"


@query
def cascade_delete_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges left, by label and relation, when every page whose stem ends in a digit goes with its chunks and the entities only they mention."""
    nodes, edges = _graph(spark, d)
    _, cards, said = _said(spark, d)
    nodes, edges = map(lambda df: cut(df)[0], chunks.with_chunks(nodes, edges, cards, said))
    n, e = mutate.cascade_delete(nodes, edges, _doomed(nodes), ("HAS_CHUNK",), ("MENTIONS",), ("Entity",))
    return n.groupBy(F.col("label").alias("kind")).agg(F.count(F.lit(1)).alias("n")).union(e.groupBy("rel").agg(F.count(F.lit(1)).alias("n")))


SQL["cascade_delete_chunks"] = f"""{_G}, {_MEN}, doomed AS (SELECT id FROM nodes WHERE label = 'Document' AND id ~ '.*[0-9]$'), gone AS (SELECT id FROM doomed UNION SELECT dst FROM held WHERE src IN (SELECT id FROM doomed)),
lft AS (SELECT * FROM edges2 WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)),
orphan AS (SELECT dst id FROM said WHERE dst LIKE 'entity:%' AND src IN (SELECT id FROM gone) EXCEPT (SELECT src FROM lft UNION SELECT dst FROM lft))
SELECT label AS kind, count(*) n FROM nodes2 WHERE id NOT IN (SELECT id FROM gone UNION SELECT id FROM orphan) GROUP BY 1 UNION ALL SELECT rel, count(*) FROM lft GROUP BY 1"""


@query
def related_entities(spark: SparkSession, d: str) -> DataFrame:
    """Relations that the stand-in extractor reads off the cards, with their sources, less the pages whose stem ends in a digit."""
    rec, _, said = _said(spark, d)
    gone = _doomed(rec.docs.select("id", F.lit("Document").alias("label")))
    return mutate.strip_sources(chunks.extracted(said), gone).select("src", "rel", "dst", F.array_join("sources", ",").alias("sources"))


SQL["related_entities"] = f"""{_G}, {_MEN}, pr2 AS (SELECT regexp_replace(src, '#c0$', '') source, list_sort(list(DISTINCT dst)) l FROM said GROUP BY src HAVING count(DISTINCT dst) > 1)
SELECT l[1] src, 'RELATED' rel, l[2] dst, string_agg(DISTINCT source, ',' ORDER BY source) sources FROM pr2 WHERE NOT (source LIKE 'doc:%' AND source ~ '.*[0-9]$') GROUP BY ALL"""


@query
def nested_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each seed ticket with its chunks, and each chunk with what it mentions, as nested arrays."""
    rec, cards, said = _said(spark, d)
    edges = chunks.has_chunk(cards).select("src", "rel", "dst").unionByName(said)
    seeds = _seeds(rec.tickets.select("id", F.lit("Ticket").alias("label")))
    return graph.nest(seeds, edges, ("HAS_CHUNK", "MENTIONS")).select("id", F.to_json("kids").alias("kids"))


SQL["nested_chunks"] = f"""{_G}, {_SEEDS}, {_MEN}, lv AS (SELECT h.src, h.dst id, coalesce(list(s.dst ORDER BY s.dst) FILTER (s.dst IS NOT NULL), []) kids FROM held h LEFT JOIN said s ON s.src = h.dst WHERE h.src IN (SELECT id FROM seeds) GROUP BY ALL)
SELECT seeds.id, coalesce(to_json(list({{'id': lv.id, 'kids': lv.kids}} ORDER BY lv.id) FILTER (lv.id IS NOT NULL))::VARCHAR, '[]') kids FROM seeds LEFT JOIN lv ON lv.src = seeds.id GROUP BY seeds.id"""


@query
def nested_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each seed ticket with the tickets it blocks and those they block, none twice on a way."""
    rec = graph.Records.of(*_tables(spark, d))
    edges, _ = cut(rec.edges(("BLOCKS",)))
    return graph.nest(_seeds(rec.tickets.select("id", F.lit("Ticket").alias("label"))), edges, ("BLOCKS", "BLOCKS")).select("id", F.to_json("kids").alias("kids"))


SQL["nested_blocks"] = f"""{_G}, {_SEEDS}, e1 AS (SELECT s.id a, e.dst b FROM seeds s JOIN edges e ON e.src = s.id AND rel = 'BLOCKS' AND dst <> src),
lv AS (SELECT a, b, coalesce(list(e.dst ORDER BY e.dst) FILTER (e.dst IS NOT NULL), []) kids FROM e1 LEFT JOIN edges e ON e.src = b AND e.rel = 'BLOCKS' AND e.dst <> a AND e.dst <> b GROUP BY ALL)
SELECT seeds.id, coalesce(to_json(list({{'id': b, 'kids': kids}} ORDER BY b) FILTER (b IS NOT NULL))::VARCHAR, '[]') kids FROM seeds LEFT JOIN lv ON lv.a = seeds.id GROUP BY seeds.id"""


@query
def entity_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """What is next to each seed ticket and is neither a page nor a chunk."""
    rec = graph.Records.of(*_tables(spark, d))
    near = graph.neighbours(_seeds(rec.tickets.select("id", F.lit("Ticket").alias("label"))), _edges(spark, d), "both")
    return near.where(~chunks.label_of("neighbour").isin("Document", "Chunk"))


SQL["entity_neighbours"] = f"{_G}, {_SEEDS}, {_STEP} SELECT DISTINCT q, id, rel, nxt AS neighbour FROM seeds JOIN s2 USING (id) WHERE nxt NOT LIKE 'doc:%'"


@query
def documents_of_component(spark: SparkSession, d: str) -> DataFrame:
    """Pages next to each component, by relation."""
    edges = _edges(spark, d, ("ABOUT",))
    start = edges.where("dst LIKE 'component:%'").select(F.col("dst").alias("q"), F.col("dst").alias("id")).distinct()
    near = graph.neighbours(start, edges, "both").where(chunks.label_of("neighbour") == "Document")
    return near.groupBy("id", "rel").agg(F.count_distinct("neighbour").alias("documents"))


SQL["documents_of_component"] = f"{_G} SELECT dst id, rel, count(DISTINCT src) documents FROM edges WHERE rel = 'ABOUT' AND src LIKE 'doc:%' GROUP BY ALL"


@query
def triplets_found(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of edges that occur, how often, and whether the schema declares them."""
    e = _edges(spark, d).groupBy(chunks.label_of("src").alias("source"), "rel", chunks.label_of("dst").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame(schema.CORPUS.triplets(), "source string, rel string, target string").withColumn("declared", F.lit(True))
    return e.join(F.broadcast(known), ["source", "rel", "target"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))


_DECLARED = ", ".join(map(repr, schema.CORPUS.triplets()))
SQL["triplets_found"] = f"{_G} SELECT a.label source, rel, b.label target, count(*) n, (a.label, rel, b.label) IN ({_DECLARED}) declared FROM edges JOIN (SELECT DISTINCT id, label FROM nodes) a ON a.id = src JOIN (SELECT DISTINCT id, label FROM nodes) b ON b.id = dst GROUP BY ALL"


@query
def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    """All violations of the declared kinds, counted."""
    return schema.violations(schema.CORPUS, *_graph(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


SQL["schema_violations"] = f"""{_G}, v AS (SELECT 'cardinality' kind FROM (SELECT n.id FROM nodes n
JOIN (VALUES ('Ticket','ASSIGNED',0,1), ('Ticket','REPORTED',0,1), ('PullRequest','AUTHORED_BY',0,1), ('PullRequest','REVIEWED_BY',1,NULL), ('Message','SENT_BY',1,1), ('Message','REPLY_TO',0,1), ('Document','AUTHORED_BY',0,1)) r(label, rel, lo, hi) ON r.label = n.label
LEFT JOIN edges e ON e.src = n.id AND e.rel = r.rel GROUP BY n.id, r.rel, lo, hi HAVING count(e.dst) < lo OR count(e.dst) > hi)
UNION ALL SELECT 'unique' FROM (SELECT label, id FROM nodes GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'relation' FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE (a.label, rel, b.label) NOT IN ({_DECLARED}))
SELECT kind, count(*) n FROM v GROUP BY 1"""


def _raw(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest(table(spark, d, "raw_records"), ["id"], "loaded_at", list(cols))


_RAW = "r AS (SELECT id, v.* FROM (SELECT id, max_by(struct_pack(kind := kind, label := label, props := props, refs := refs), loaded_at) v FROM raw_records WHERE id IS NOT NULL GROUP BY id))"


@query
def property_type_violations(spark: SparkSession, d: str) -> DataFrame:
    """Properties of messages and of raw records that do not look like their type."""
    chat = graph.Records.of(*_tables(spark, d)).chat
    props = F.create_map(F.lit("channel"), "ch", F.lit("seq"), F.col("sq").cast("string"), F.lit("ts"), "ts")
    return schema.wrong_types(_raw(spark, d, "label", "props").unionByName(chat.select("id", F.lit("Message").alias("label"), props.alias("props"))))


_TYPED = ", ".join(f"('{label}', '{p}', '{t}', '{schema.PATTERNS[t]}')" for label, of in schema.TYPES.items() for p, t in of.items())
SQL["property_type_violations"] = f"""{_G}, {_RAW}, e AS (SELECT id, label, x.key AS property, x.value actual FROM (SELECT id, label, unnest(map_entries(props)) x FROM r)
  UNION ALL SELECT 'msg:' || ch || ':' || seq, 'Message', 'ts', ts FROM (SELECT {CHANNEL} ch, seq, max_by(struct_pack(ts := ts), arrived_at).ts ts FROM chat WHERE channel IS NOT NULL AND seq IS NOT NULL GROUP BY ALL))
SELECT id, e.property, expected, actual FROM e JOIN (VALUES {_TYPED}) k(label, property, expected, pat) ON e.label = k.label AND e.property = k.property WHERE actual IS NOT NULL AND NOT regexp_matches(actual, pat)"""


@query
def edge_property_violations(spark: SparkSession, d: str) -> DataFrame:
    """References that tickets state without naming anything."""
    t = graph.Records.of(*_tables(spark, d)).tickets
    refs = t.select(F.col("id").alias("src"), F.lit("REFERENCES").alias("rel"), F.posexplode("references").alias("place", "name")).select("src", "rel", graph.page_key(F.col("name")).alias("dst"), "place", "name")
    return schema.edge_violations(refs, ("place", "name")).select("src", "rel", "property")


SQL["edge_property_violations"] = f"""{_G} SELECT id src, 'REFERENCES' rel, 'name' property FROM (SELECT id, unnest(refs) x FROM t) WHERE coalesce(trim(x, ' '), '') = ''"""


@query
def names_by_rel(spark: SparkSession, d: str) -> DataFrame:
    """Of each raw record: the names of its references by relation, each once, in order."""
    return _raw(spark, d, "refs").select("id", F.explode(text.names_by_rel(F.col("refs"))).alias("rel", "names")).select("id", "rel", F.array_join("names", "|").alias("names"))


SQL["names_by_rel"] = f"""WITH {_RAW}, e AS (SELECT id, refs[i].rel rel, refs[i].name "name", i FROM (SELECT id, refs, unnest(generate_series(1, len(refs))) i FROM r)), f AS (SELECT id, rel, "name", min(i) i FROM e GROUP BY ALL)
SELECT id, rel, coalesce(string_agg("name", '|' ORDER BY i), '') "names" FROM f GROUP BY ALL"""


@query
def properties_merged(spark: SparkSession, d: str) -> DataFrame:
    """Properties of each raw record: its first state's, laid over by its last's."""
    r = table(spark, d, "raw_records").where("id IS NOT NULL").groupBy("id")
    old, new = r.agg(F.min_by("props", "loaded_at").alias("props")), r.agg(F.max_by("props", "loaded_at").alias("props"))
    return mutate.merge_properties(old, new).select("id", F.explode("props").alias("key", "value"))


SQL["properties_merged"] = "SELECT id, e.key AS key, e.value AS \"value\" FROM (SELECT id, unnest(map_entries(map_concat(min_by(props, loaded_at), max_by(props, loaded_at)))) e FROM raw_records WHERE id IS NOT NULL GROUP BY id)"


@query
def loader_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that the loaders make of tickets and pull requests, by kind and relation."""
    t, p, _, _ = _tables(spark, d)
    t = latest(t, ["key"], "ingested_at", ["title", "description", "status", "assignee", "reporter", "components", "references", "blocks"])
    p = latest(p, ["repo", "number"], "ingested_at", ["title", "description", "state", "author", "reviewers", "fixes", "components", "references"])
    got = loaders.links(loaders.tickets(t).unionByName(loaders.pull_requests(p)))
    return got.groupBy(F.substring_index("src", ":", 1).alias("kind"), "rel").agg(F.count(F.lit(1)).alias("n"))


SQL["loader_links"] = f"{_G} SELECT split_part(src, ':', 1) kind, rel, count(*) n FROM links WHERE src LIKE 'ticket:%' OR src LIKE 'pr:%' GROUP BY ALL"


@query
def snapshot_report(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by label and edges by relation of a snapshot that was written and read again."""
    folder = new_path(spark)
    loaders.write_snapshot(*_graph(spark, d), folder)
    return loaders.report(*loaders.read_snapshot(spark, folder))


SQL["snapshot_report"] = f"{_G} SELECT 'nodes' what, label AS kind, count(*) n FROM nodes GROUP BY ALL UNION ALL SELECT 'edges', rel, count(*) FROM edges GROUP BY ALL"


@query
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """A hash of each owner's chunks in order."""
    c = graph.Records.of(*_tables(spark, d)).cards()
    per = c.groupBy("owner_id").agg(F.sort_array(F.collect_list(F.struct("idx", "content"))).alias("c"))
    return per.select("owner_id", text.content_hash(F.transform("c", lambda x: x["content"])).alias("sha"))


SQL["content_hashes"] = f"{_G}, {_CARDS} SELECT owner_id, sha256(string_agg(content, chr(0) ORDER BY idx)) sha FROM chunks GROUP BY 1"


@query
def previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.preview(F.col("text"), 300).alias("preview"))


SQL["previews"] = "SELECT doc_id, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '…' ELSE text END preview FROM documents"


@query
def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events as a model would return them, in a fence and with words around, read again and summed by type."""
    e = table(spark, d, "events").select("event_type", F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone.")).alias("reply"))
    k = F.from_json(text.json_span(F.col("reply")), "k BIGINT")["k"]
    return e.groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


SQL["tolerant_json"] = "SELECT event_type, count((props->>'k')::BIGINT) n, sum((props->>'k')::BIGINT)::BIGINT total FROM events GROUP BY 1"

#: The entity types, by the words that name them.
TYPE_WORDS = [("component", "component"), ("dataset", "dataset"), ("decision", "decision"), ("incident", "incident"), ("outage", "incident"), ("metric", "metric"), ("policy", "policy"), ("release", "release"), ("runbook", "runbook"), ("service", "service"), ("team", "team"), ("owners", "team")]
#: Relations, by parts of words that hint at them, in order of preference.
RELATION_WORDS = [("block", "BLOCKS"), ("depend", "BLOCKS"), ("fix", "FIXES"), ("repair", "FIXES"), ("refer", "REFERENCES"), ("see ", "REFERENCES"), ("assign", "ASSIGNED"), ("report", "REPORTED"), ("review", "REVIEWED_BY"), ("wrote", "AUTHORED_BY"), ("repl", "REPLY_TO")]


@query
def infer_type(spark: SparkSession, d: str) -> DataFrame:
    """The type whose word stands first in each document."""
    return table(spark, d, "documents").select("doc_id", text.earliest(F.col("text"), TYPE_WORDS).alias("type"))


_TW = ", ".join(f"({i}, '{w}', '{t}')" for i, (w, t) in enumerate(TYPE_WORDS))
SQL["infer_type"] = f"SELECT doc_id, min_by(t, (strpos(lower(text), w), i)) FILTER (strpos(lower(text), w) > 0) AS \"type\" FROM documents, (VALUES {_TW}) k(i, w, t) GROUP BY 1"


@query
def relation_hints(spark: SparkSession, d: str) -> DataFrame:
    """The first two relations that each document's words hint at."""
    return table(spark, d, "documents").select("doc_id", F.array_join(text.first_matches(F.col("text"), RELATION_WORDS, 2), ",").alias("rels"))


_RW = ", ".join(f"({i}, '{w}', '{t}')" for i, (w, t) in enumerate(RELATION_WORDS))
SQL["relation_hints"] = f"""WITH h AS (SELECT doc_id, t, min(i) i FROM documents, (VALUES {_RW}) k(i, w, t) WHERE contains(lower(text), w) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) n FROM h)
SELECT doc_id, coalesce(string_agg(t, ',' ORDER BY i) FILTER (n <= 2), '') rels FROM documents LEFT JOIN r USING (doc_id) GROUP BY 1"""


@query
def rotating_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred orders by hash: the frozen sample (epoch 0) and two rotated ones."""
    o = table(spark, d, "orders").select("o_orderkey")
    return chunks.reduce(DataFrame.unionByName, [select.sample(o, "o_orderkey", 100, 17, e).withColumn("epoch", F.lit(e)) for e in range(3)])


SQL["rotating_sample"] = "SELECT o_orderkey, epoch FROM (SELECT o_orderkey, epoch, row_number() OVER (PARTITION BY epoch ORDER BY (o_orderkey * 7919 + (17 * 100003 + epoch) % 1000003) % 1000003 * 7877 % 999983, o_orderkey) n FROM orders, (VALUES (0), (1), (2)) e(epoch)) WHERE n <= 100"


@query
def distractors(spark: SparkSession, d: str) -> DataFrame:
    """Each eval item's answer among three answers of other items, and the place of the right one."""
    items = table(spark, d, "eval_items").select("item_id", F.col("choices")[F.col("answer_idx")].alias("answer"))
    return select.distractors(items, 3).select("item_id", F.array_join("options", " | ").alias("options"), "answer_idx")


SQL["distractors"] = """WITH i AS (SELECT item_id, choices[answer_idx + 1] answer FROM eval_items), a AS (SELECT answer, row_number() OVER (ORDER BY md5(answer), answer) - 1 p, count(*) OVER () n FROM (SELECT DISTINCT answer FROM i)),
o AS (SELECT item_id, i.answer, b.answer opt FROM i JOIN a ON a.answer = i.answer, (VALUES (0), (1), (2), (3)) k(o) JOIN a b ON b.p = (a.p + o) % a.n WHERE o < a.n),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY md5(item_id || opt), opt) - 1 place FROM o)
SELECT item_id, string_agg(opt, ' | ' ORDER BY place) || ' | CANNOT_DETERMINE' options, max(place) FILTER (opt = answer) answer_idx FROM r GROUP BY item_id"""


@query
def eval_log(spark: SparkSession, d: str) -> DataFrame:
    """Eval items flattened for a log: flags as numbers, long texts as previews; items that need no context are dropped."""
    e = table(spark, d, "eval_items").where("NOT coalesce(closedbook_correct, false)")
    return e.select("item_id", "lang", F.coalesce("hops", F.lit(0)).alias("hops"), F.col("closedbook_correct").cast("int").alias("closedbook"), text.preview(F.col("passage"), 300).alias("passage"))


SQL["eval_log"] = "SELECT item_id, lang, coalesce(hops, 0) hops, closedbook_correct::INT closedbook, CASE WHEN length(passage) > 300 THEN substring(passage, 1, 300) || '…' ELSE passage END passage FROM eval_items WHERE NOT coalesce(closedbook_correct, false)"


@query
def answers_parsed(spark: SparkSession, d: str) -> DataFrame:
    """The choice that a reply in words names."""
    e = table(spark, d, "eval_items")
    reply = F.concat(F.lit("Answer: "), F.char(F.col("answer_idx") + 65), F.lit(") "), F.col("choices")[F.col("answer_idx")])
    return e.select("item_id", text.choice_letter(reply, F.size("choices") - 1).alias("chosen"))


SQL["answers_parsed"] = "SELECT item_id, CASE WHEN answer_idx < len(choices) - 1 THEN answer_idx END chosen FROM eval_items"


@query
def recent_log(spark: SparkSession, d: str) -> DataFrame:
    """The last 20 kinds of events by user (each once, its last), of all and of those that were purchases."""
    e = table(spark, d, "events").select("event_id", F.concat_ws("|", F.lower("event_type"), "user_id").alias("key"), (F.col("event_type") == "purchase").alias("accepted"))
    pick = lambda rows, what: select.recent(rows, "key", "event_id", 20).select(F.lit(what).alias("what"), "key", "event_id")
    return pick(e, "recent").union(pick(e.where("accepted"), "accepted"))


SQL["recent_log"] = """WITH k AS (SELECT lower(event_type) || '|' || user_id AS key, max(event_id) event_id FROM events GROUP BY 1)
SELECT * FROM (SELECT 'recent' what, key, event_id FROM k ORDER BY event_id DESC LIMIT 20) UNION ALL SELECT * FROM (SELECT 'accepted', key, event_id FROM k WHERE key LIKE 'purchase|%' ORDER BY event_id DESC LIMIT 20)"""


@query
def predictions_checked(spark: SparkSession, d: str) -> DataFrame:
    """Predictions given as text, by what is wrong with them: here page names and numbers as ids, amounts as scores."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("q"), F.coalesce("stem", F.col("doc_id").cast("string")).alias("id"), F.when(F.col("n_chars") > 0, F.col("n_chars").cast("string")).otherwise("nan").alias("score"))
    return metrics.checked_predictions(rows).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


SQL["predictions_checked"] = "SELECT CASE WHEN stem IS NOT NULL AND try_cast(stem AS BIGINT) IS NULL THEN 'id' WHEN n_chars > 0 THEN 'none' ELSE 'score' END error, count(*) n FROM documents GROUP BY 1"


@query
def results_reattached(spark: SparkSession, d: str) -> DataFrame:
    """Tickets and what is known by their status as text; those of a status nobody is assigned to, or of none, get an error."""
    t = latest(table(spark, d, "tickets"), ["key"], "ingested_at", ["status", "assignee"])
    known = t.where("assignee IS NOT NULL AND status IS NOT NULL").groupBy(F.col("status").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.reattached(t.select(F.col("key").alias("q"), F.col("status").alias("text")), known.where("n > 20"))


SQL["results_reattached"] = """WITH t AS (SELECT key, v.* FROM (SELECT key, max_by(struct_pack(s := status, a := assignee), ingested_at) v FROM tickets WHERE key IS NOT NULL GROUP BY key)), k AS (SELECT s AS text, count(*) n FROM t WHERE s IS NOT NULL AND a IS NOT NULL GROUP BY 1 HAVING n > 20)
SELECT key AS q, s AS text, n, n IS NULL error FROM t LEFT JOIN k ON s = k.text"""


@query
def failures_per_parent(spark: SparkSession, d: str) -> DataFrame:
    """Of each ticket: the tickets it blocks that nobody is assigned to."""
    rec = graph.Records.of(*_tables(spark, d))
    none = rec.tickets.where("assignee IS NULL OR trim(assignee) = ''").select(F.col("id").alias("dst"))
    return rec.edges(("BLOCKS",)).join(none, "dst").groupBy(F.col("src").alias("parent")).agg(F.count_distinct("dst").alias("n"), F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("failed"))


SQL["failures_per_parent"] = f"{_G} SELECT src parent, count(DISTINCT dst) n, string_agg(DISTINCT dst, ',' ORDER BY dst) failed FROM edges JOIN t ON t.id = dst WHERE rel = 'BLOCKS' AND coalesce(trim(assignee, ' '), '') = '' GROUP BY 1"


@query
def worst_first(spark: SparkSession, d: str) -> DataFrame:
    return metrics.worst_first(recall_hit_mrr(spark, d), 20)


SQL["worst_first"] = f"""WITH {_METRICS}, k AS (SELECT *, CASE WHEN recall_20 < 1 THEN 'missed' WHEN hit_1 < 1 THEN 'misranked' ELSE 'won' END kind FROM per),
r AS (SELECT kind, q, row_number() OVER (PARTITION BY kind ORDER BY CASE kind WHEN 'missed' THEN recall_20 ELSE 0 END, CASE kind WHEN 'won' THEN 0 ELSE mrr END, q) place FROM k)
SELECT kind, place, q FROM r WHERE place <= CASE kind WHEN 'won' THEN 3 ELSE 10 END"""
