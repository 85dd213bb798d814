"""Queries over the property graph of the project's records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import agentic, graph, mutate
from loomgraph.plans import schema
from loomgraph.plans.session import cut, table
from loomgraph.queries import SQL, _trim, query
from loomgraph.queries import _CHANNEL as CHANNEL
from loomgraph.queries import _PAGE as PAGE
from loomgraph.queries import _TICKET as TICKET


def _tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("tickets", "github_prs", "chat", "documents")]


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.project_graph(*_tables(spark, d))


def _edges(spark: SparkSession, d: str, rels: tuple[str, ...] | None = None) -> DataFrame:
    """The edges of ``rels``, written; only the tables and columns that state them are read."""
    return cut(graph.Records.of(*_tables(spark, d), rels or tuple(graph.STATED)).edges(rels))[0]


def _tickets(spark: SparkSession, d: str) -> DataFrame:
    """(id, label) of the tickets."""
    return table(spark, d, "tickets").where("key IS NOT NULL").select(F.concat(F.lit("ticket:"), "key").alias("id"), F.lit("Ticket").alias("label")).distinct()


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


def _person(x: str) -> str:
    return "'person:' || nullif(" + _slug(f"regexp_replace(lower({_trim(x)}), '^(@|person:)', '')") + ", '')"


_REC = rf"""
t AS (SELECT key AS k, 'ticket:' || key AS id, v.* FROM (SELECT key, max_by(struct_pack(title := title, description := description, status := status, assignee := assignee, reporter := reporter, components := components, refs := "references", blocks := blocks), ingested_at) v FROM tickets WHERE key IS NOT NULL GROUP BY key)),
p AS (SELECT 'pr:' || {_slug("repo")} || '#' || number AS id, v.* FROM (SELECT repo, number, max_by(struct_pack(title := title, description := description, state := state, author := author, reviewers := reviewers, fixes := fixes, components := components, refs := "references"), ingested_at) v FROM github_prs GROUP BY ALL)),
c AS (SELECT ch, seq, 'msg:' || ch || ':' || seq AS id, v.* FROM (SELECT {CHANNEL} ch, seq, max_by(struct_pack(author := author, txt := text, reply_to := reply_to, refs := "references"), arrived_at) v FROM chat GROUP BY ALL)),
dd AS (SELECT 'doc:' || stem AS id, title, author, components, text AS txt FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY ingested_at DESC, doc_id DESC) n FROM documents WHERE stem IS NOT NULL) WHERE n = 1)"""
_LINKS = rf"""
named AS (SELECT id src, 'REFERENCES' rel, 'doc:' || nullif({PAGE}, '') dst FROM (SELECT id, unnest(refs) x FROM t UNION ALL SELECT id, unnest(refs) FROM p UNION ALL SELECT id, unnest(refs) FROM c)
  UNION ALL SELECT id, rel, 'ticket:' || nullif({TICKET}, '') FROM (SELECT id, 'BLOCKS' rel, unnest(blocks) x FROM t UNION ALL SELECT id, 'FIXES', unnest(fixes) FROM p)
  UNION ALL SELECT id, 'ABOUT', 'component:' || nullif({_slug("x")}, '') FROM (SELECT id, unnest(components) x FROM t UNION ALL SELECT id, unnest(components) FROM p UNION ALL SELECT id, unnest(components) FROM dd)
  UNION ALL SELECT id, rel, {_person("x")} FROM (SELECT id, 'ASSIGNED' rel, assignee x FROM t UNION ALL SELECT id, 'REPORTED', reporter FROM t UNION ALL SELECT id, 'AUTHORED_BY', author FROM p UNION ALL SELECT id, 'AUTHORED_BY', author FROM dd UNION ALL SELECT id, 'REVIEWED_BY', unnest(reviewers) FROM p UNION ALL SELECT id, 'SENT_BY', author FROM c)
  UNION ALL SELECT id, 'REPLY_TO', 'msg:' || ch || ':' || nullif(reply_to, 0) FROM c),
links AS (SELECT DISTINCT * FROM named WHERE dst IS NOT NULL),
nodes AS (SELECT id, 'Ticket' label FROM t UNION ALL SELECT id, 'PullRequest' FROM p UNION ALL SELECT id, 'Message' FROM c UNION ALL SELECT id, 'Document' FROM dd
  UNION ALL SELECT DISTINCT dst, CASE WHEN dst LIKE 'person:%' THEN 'Person' ELSE 'Component' END FROM links WHERE dst LIKE 'person:%' OR dst LIKE 'component:%'),
edges AS (SELECT * FROM links WHERE dst IN (SELECT id FROM nodes))"""
_G = "WITH RECURSIVE " + _REC + "," + _LINKS


@query
def node_counts_by_label(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0].groupBy("label").agg(F.count(F.lit(1)).alias("n"))


SQL["node_counts_by_label"] = _G + " SELECT label, count(*) n FROM nodes GROUP BY 1"


@query
def edge_counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1].groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


SQL["edge_counts_by_type"] = _G + " SELECT rel, count(*) n FROM edges GROUP BY 1"


@query
def dangling_edges_dropped(spark: SparkSession, d: str) -> DataFrame:
    rec = graph.Records.of(*_tables(spark, d), tuple(graph.STATED))
    links = rec.links()
    return graph.connect(links, rec.nodes(links))[1]


SQL["dangling_edges_dropped"] = _G + " SELECT src, rel, dst FROM links WHERE dst NOT IN (SELECT id FROM nodes)"


@query
def merge_edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of the spellings by which tickets block one another, how many edges each pair collapses to, by number of spellings."""
    rows = table(spark, d, "tickets").select("key", F.explode("blocks").alias("x")).select("key", graph.ticket_key(F.col("x")).alias("dst")).where("dst IS NOT NULL")
    return rows.groupBy("key", "dst").agg(F.count(F.lit(1)).alias("spellings")).groupBy("spellings").agg(F.count(F.lit(1)).alias("edges"))


SQL["merge_edge_dedup"] = rf"""SELECT spellings, count(*) edges FROM (SELECT key, nullif({TICKET}, '') dst, count(*) spellings FROM (SELECT key, unnest(blocks) x FROM tickets) GROUP BY ALL HAVING dst IS NOT NULL) GROUP BY 1"""


@query
def merge_node_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The tickets' first states, laid over by their last: null values of the last do not erase."""
    t = table(spark, d, "tickets").where("key IS NOT NULL")
    old = t.groupBy("key").agg(F.min_by(F.struct("title", "status", "assignee"), "ingested_at").alias("v")).select("key", "v.*")
    new = t.groupBy("key").agg(F.max_by(F.struct("title", "status", "assignee"), "ingested_at").alias("v")).select("key", "v.*")
    return mutate.upsert(old, new, "key")


SQL["merge_node_last_wins"] = """SELECT key, coalesce(b.title, a.title) title, coalesce(b.status, a.status) status, coalesce(b.assignee, a.assignee) assignee
FROM (SELECT key, min_by(struct_pack(title := title, status := status, assignee := assignee), ingested_at) a, max_by(struct_pack(title := title, status := status, assignee := assignee), ingested_at) b FROM tickets WHERE key IS NOT NULL GROUP BY key)"""


@query
def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", graph.slug(F.col("title")).alias("slug"))


SQL["slug_ids"] = f"SELECT doc_id, {_slug('title')} slug FROM documents"


@query
def sanitize_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("ntype", "label").distinct().select("ntype", "label", text.sanitize(F.col("label")).alias("name"), text.relation_type(F.col("ntype")).alias("rel"))


SQL["sanitize_labels"] = r"""SELECT ntype, label, CASE WHEN s ~ '^[0-9].*' THEN '_' || s ELSE s END AS name, regexp_replace(regexp_replace(upper(ntype), '[^A-Z0-9]+', '_', 'g'), '^_|_$', '', 'g') rel
FROM (SELECT DISTINCT ntype, label, regexp_replace(regexp_replace(label, '[^0-9A-Za-z]+', '_', 'g'), '^_|_$', '', 'g') s FROM entities)"""


@query
def degree_classes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by label and number of edges, 5 standing for more; 0 are the isolated ones."""
    nodes, edges = _graph(spark, d)
    return graph.degrees(nodes, edges).groupBy("label", F.least("degree", F.lit(5)).alias("degree")).agg(F.count(F.lit(1)).alias("n"))


SQL["degree_classes"] = _G + " SELECT label, least(coalesce(k, 0), 5) AS degree, count(*) n FROM nodes LEFT JOIN (SELECT id, count(*) k FROM (SELECT src id FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst) GROUP BY 1) USING (id) GROUP BY ALL"


@query
def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.isolated(*_graph(spark, d))


SQL["isolated_nodes"] = _G + " SELECT id, label FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)"


def _seeds(nodes: DataFrame) -> DataFrame:
    """Every ticket whose number is divisible by 50, as a query of its own."""
    n = F.regexp_extract("id", "-([0-9]+)$", 1).try_cast("bigint")
    return nodes.where((F.col("label") == "Ticket") & (n % 50 == 0)).select(F.col("id").alias("q"), "id")


_SEEDS = "seeds AS (SELECT id q, id FROM nodes WHERE label = 'Ticket' AND TRY_CAST(regexp_extract(id, '-([0-9]+)$', 1) AS BIGINT) % 50 = 0)"
_STEP = "s2 AS (SELECT src id, dst AS nxt, rel FROM edges UNION SELECT dst, src, rel FROM edges)"


def _neighbours(direction: str, cap: int | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return graph.neighbours(_seeds(_tickets(spark, d)), _edges(spark, d), direction, cap=cap)

    return run


for _name, _dir, _cap, _sql in (
    ("neighbors_out", "out", None, "SELECT q, s.id, rel, dst AS neighbour FROM seeds s JOIN edges ON src = s.id"),
    ("neighbors_in", "in", None, "SELECT q, s.id, rel, src AS neighbour FROM seeds s JOIN edges ON dst = s.id"),
    ("neighbors_both", "both", None, "SELECT DISTINCT q, id, rel, nxt AS neighbour FROM seeds JOIN s2 USING (id)"),
    ("neighbors_capped_per_source", "both", 3, "SELECT q, id, rel, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY q, id ORDER BY rel, neighbour) n FROM (SELECT DISTINCT q, id, rel, nxt AS neighbour FROM seeds JOIN s2 USING (id))) WHERE n <= 3"),
):
    _f = _neighbours(_dir, _cap)
    _f.__name__ = _name
    query(_f)
    SQL[_name] = f"{_G}, {_SEEDS}, {_STEP} {_sql}"


def _walk_sql(depth: int, rels: tuple[str, ...] | None = graph.OWNER_RELS) -> str:
    only = f" WHERE rel IN ({', '.join(repr(r) for r in rels)})" if rels else ""
    return f"{_G}, {_SEEDS}, {_STEP}, st AS (SELECT DISTINCT id, nxt FROM s2{only}), w AS (SELECT q, id, 0 hops FROM seeds UNION SELECT q, nxt, hops + 1 FROM w JOIN st USING (id) WHERE hops < {depth}), walked AS (SELECT q, id, min(hops) hops FROM w GROUP BY ALL)"


def _walk(depth: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return graph.walk(_seeds(_tickets(spark, d)), _edges(spark, d, graph.OWNER_RELS), depth)

    return run


for _depth in (1, 2, 3):
    _f = _walk(_depth)
    _f.__name__ = f"bounded_walk_d{_depth}"
    query(_f)
    SQL[_f.__name__] = _walk_sql(_depth) + " SELECT * FROM walked"


@query
def inspector_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Everything within 2 steps of a seed by any relation, without the seed."""
    return graph.walk(_seeds(_tickets(spark, d)), _edges(spark, d), 2, None).where("hops > 0")


SQL["inspector_neighbours"] = _walk_sql(2, None) + " SELECT * FROM walked WHERE hops > 0"


@query
def bfs_typed_recall(spark: SparkSession, d: str) -> DataFrame:
    """The first 5 documents within 2 steps of any relation but those of persons, by hops and id."""
    rels = (*graph.OWNER_RELS, "ABOUT")
    got = graph.walk(_seeds(_tickets(spark, d)), _edges(spark, d, rels), 2, rels).where("id LIKE 'doc:%'")
    return graph.first_by_hops(got, 5)


SQL["bfs_typed_recall"] = _walk_sql(2, (*graph.OWNER_RELS, "ABOUT")) + " SELECT q, id, hops FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hops, id) n FROM walked WHERE id LIKE 'doc:%') WHERE n <= 5"


@query
def path_exists_seed_gold(spark: SparkSession, d: str) -> DataFrame:
    """From each seed to the tickets that the seed's own pull requests fix and those they block: is there a path of 3?"""
    edges, seeds = _edges(spark, d, ("BLOCKS", "REFERENCES", "FIXES")), _seeds(_tickets(spark, d))
    goals = seeds.select("q").join(edges.where("rel = 'BLOCKS'").select(F.col("dst").alias("q"), F.col("src").alias("goal")), "q")
    return graph.reaches(seeds, goals, edges, 3, ("REFERENCES", "FIXES"))


SQL["path_exists_seed_gold"] = _walk_sql(3, ("REFERENCES", "FIXES")) + " SELECT g.q, goal, hops FROM (SELECT q, src goal FROM seeds JOIN edges ON rel = 'BLOCKS' AND dst = q) g LEFT JOIN walked w ON g.q = w.q AND g.goal = w.id"


@query
def anchor_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that touch at least two of the tickets a seed's neighbourhood holds."""
    edges = _edges(spark, d, ("BLOCKS", "REFERENCES", "FIXES"))
    near = graph.walk(_seeds(_tickets(spark, d)), edges, 1, ("BLOCKS", "REFERENCES")).select("q", "id")
    return graph.connectivity(near, edges.where("rel IN ('BLOCKS', 'REFERENCES', 'FIXES')")).where("anchors > 1")


SQL["anchor_connectivity"] = _walk_sql(1, ("BLOCKS", "REFERENCES")) + " SELECT q, nxt id, count(DISTINCT id) anchors FROM walked JOIN s2 USING (id) WHERE rel IN ('BLOCKS', 'REFERENCES', 'FIXES') AND (q, nxt) NOT IN (SELECT (q, id) FROM walked) GROUP BY ALL HAVING anchors > 1"


@query
def hop2_frequency(spark: SparkSession, d: str) -> DataFrame:
    return graph.second_hop(_seeds(_tickets(spark, d)), _edges(spark, d, graph.OWNER_RELS), graph.OWNER_RELS)


SQL["hop2_frequency"] = f"""{_G}, {_SEEDS}, st AS (SELECT src id, dst AS nxt FROM edges WHERE rel IN {graph.OWNER_RELS} UNION ALL SELECT dst, src FROM edges WHERE rel IN {graph.OWNER_RELS}),
f AS (SELECT DISTINCT q, nxt AS id FROM seeds JOIN st USING (id) EXCEPT SELECT q, id FROM seeds)
SELECT q, nxt AS id, count(*) paths FROM f JOIN st USING (id) WHERE (q, nxt) NOT IN (SELECT (q, id) FROM f UNION SELECT (q, id) FROM seeds) GROUP BY ALL"""


@query
def keyword_bridge_intersection(spark: SparkSession, d: str) -> DataFrame:
    """What all references of a seed have in common: nodes one step from each page the seed names."""
    edges = _edges(spark, d, ("REFERENCES", "ABOUT", "AUTHORED_BY"))
    refs = _seeds(_tickets(spark, d)).join(edges.where("rel = 'REFERENCES'").select(F.col("src").alias("id"), F.col("dst").alias("page")), "id").select("q", F.col("page").alias("id"))
    step = graph.neighbours(refs, edges, "both", ("REFERENCES", "ABOUT", "AUTHORED_BY")).select("q", F.col("id").alias("part"), F.col("neighbour").alias("id")).distinct()
    return graph.in_all(step)


SQL["keyword_bridge_intersection"] = f"""{_G}, {_SEEDS}, {_STEP}, parts AS (SELECT DISTINCT q, e.dst part, s2.nxt AS id FROM seeds s JOIN edges e ON e.src = s.id AND e.rel = 'REFERENCES' JOIN s2 ON s2.id = e.dst AND s2.rel IN ('REFERENCES', 'ABOUT', 'AUTHORED_BY'))
SELECT q, id FROM parts GROUP BY q, id HAVING count(DISTINCT part) = (SELECT count(DISTINCT part) FROM parts x WHERE x.q = parts.q) AND count(DISTINCT part) > 1"""


@query
def shared_trait_intersection(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_traits(_edges(spark, d, ("BLOCKS", "ABOUT")), "BLOCKS", "ABOUT")


SQL["shared_trait_intersection"] = _G + " SELECT e.src a, e.dst b, count(DISTINCT x.dst) traits FROM edges e JOIN edges x ON x.src = e.src AND x.rel = 'ABOUT' JOIN edges y ON y.src = e.dst AND y.rel = 'ABOUT' AND y.dst = x.dst WHERE e.rel = 'BLOCKS' GROUP BY ALL"


@query
def hydrate_nested(spark: SparkSession, d: str) -> DataFrame:
    return graph.hydrate(_tickets(spark, d), _edges(spark, d, ("BLOCKS", "REFERENCES", "ABOUT")), "Ticket", ("BLOCKS", "REFERENCES", "ABOUT"))


SQL["hydrate_nested"] = _G + """ SELECT n.id, r.rel, count(e.dst) n, coalesce(string_agg(e.dst, ',' ORDER BY e.dst), '') targets FROM nodes n, (VALUES ('BLOCKS'), ('REFERENCES'), ('ABOUT')) r(rel) LEFT JOIN edges e ON e.src = n.id AND e.rel = r.rel WHERE n.label = 'Ticket' GROUP BY ALL"""


@query
def cardinality_violations(spark: SparkSession, d: str) -> DataFrame:
    return schema.cardinality_violations(schema.CORPUS, *_graph(spark, d))


SQL["cardinality_violations"] = _G + """ SELECT n.id, n.label, r.rel, r.expected, count(e.dst) actual FROM nodes n
JOIN (VALUES ('Ticket','ASSIGNED','0..1',0,1), ('Ticket','REPORTED','0..1',0,1), ('PullRequest','AUTHORED_BY','0..1',0,1), ('PullRequest','REVIEWED_BY','1..n',1,NULL), ('Message','SENT_BY','1',1,1), ('Message','REPLY_TO','0..1',0,1), ('Document','AUTHORED_BY','0..1',0,1)) r(label, rel, expected, lo, hi) ON r.label = n.label
LEFT JOIN edges e ON e.src = n.id AND e.rel = r.rel GROUP BY n.id, n.label, r.rel, r.expected, lo, hi HAVING count(e.dst) < lo OR count(e.dst) > hi"""


@query
def required_property_violations(spark: SparkSession, d: str) -> DataFrame:
    rec = graph.Records.of(*_tables(spark, d))
    return schema.missing_properties(schema.CORPUS, "Ticket", rec.tickets).union(schema.missing_properties(schema.CORPUS, "PullRequest", rec.prs)).union(schema.missing_properties(schema.CORPUS, "Message", rec.chat)).union(schema.missing_properties(schema.CORPUS, "Document", rec.docs))


SQL["required_property_violations"] = _G + """ SELECT id, property FROM (SELECT id, 'title' property, title v FROM t UNION ALL SELECT id, 'status', status FROM t UNION ALL SELECT id, 'title', title FROM p UNION ALL SELECT id, 'state', state FROM p UNION ALL SELECT id, 'text', txt FROM c UNION ALL SELECT id, 'title', title FROM dd) WHERE coalesce(trim(v, ' '), '') = ''"""


def _doomed(nodes: DataFrame) -> DataFrame:
    return nodes.where("label = 'Document' AND id RLIKE '[0-9]$'").select("id")


@query
def cascade_delete_document(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges left, by label and relation, when every page whose stem ends in a digit goes with its components."""
    nodes, edges = _graph(spark, d)
    n, e = mutate.cascade_delete(nodes, edges, _doomed(nodes), (), ("ABOUT", "AUTHORED_BY"))
    return n.groupBy(F.col("label").alias("kind")).agg(F.count(F.lit(1)).alias("n")).union(e.groupBy("rel").agg(F.count(F.lit(1)).alias("n")))


SQL["cascade_delete_document"] = _G + """, gone AS (SELECT id FROM nodes WHERE label = 'Document' AND id ~ '.*[0-9]$'), lft AS (SELECT * FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)),
orphan AS (SELECT dst id FROM edges WHERE rel IN ('ABOUT', 'AUTHORED_BY') AND src IN (SELECT id FROM gone) EXCEPT (SELECT src FROM lft UNION SELECT dst FROM lft))
SELECT label AS kind, count(*) n FROM nodes WHERE id NOT IN (SELECT id FROM gone UNION SELECT id FROM orphan) GROUP BY 1 UNION ALL SELECT rel, count(*) FROM lft GROUP BY 1"""


@query
def participants_replace(spark: SparkSession, d: str) -> DataFrame:
    """Every pull request's reviewers replaced by its author alone, where it has one."""
    edges = _edges(spark, d, ("AUTHORED_BY", "REVIEWED_BY"))
    new = edges.where("rel = 'AUTHORED_BY' AND src LIKE 'pr:%'").select("src", "dst")
    return mutate.replace_targets(edges, "REVIEWED_BY", new, edges.select(F.col("dst").alias("id")).distinct()).where("rel = 'REVIEWED_BY'")


SQL["participants_replace"] = _G + """, au AS (SELECT src, dst FROM edges WHERE rel = 'AUTHORED_BY' AND src LIKE 'pr:%') SELECT * FROM edges WHERE rel = 'REVIEWED_BY' AND src NOT IN (SELECT src FROM au) UNION ALL SELECT src, 'REVIEWED_BY', dst FROM au"""


@query
def chunk_cards(spark: SparkSession, d: str) -> DataFrame:
    """Per label: chunks, characters and the most chunks of one owner."""
    c = graph.Records.of(*_tables(spark, d)).cards().withColumn("kind", F.substring_index("owner_id", ":", 1))
    per = c.groupBy("kind", "owner_id").agg(F.count(F.lit(1)).alias("k"), F.sum(F.length("content")).alias("chars"))
    return per.groupBy("kind").agg(F.count(F.lit(1)).alias("owners"), F.sum("k").alias("chunks"), F.sum("chars").cast("bigint").alias("chars"), F.max("k").alias("most"))


_CARDS = r"""cards AS (SELECT id, concat_ws('. ', concat_ws(' ', 'Ticket', k, nullif(trim(title, ' '), '')), 'Status ' || nullif(trim(status, ' '), ''), 'Assignee ' || nullif(trim(assignee, ' '), ''), 'Reporter ' || nullif(trim(reporter, ' '), '')) card, description body FROM t
  UNION ALL SELECT id, concat_ws('. ', concat_ws(' ', 'Pull request', nullif(trim(title, ' '), '')), 'State ' || nullif(trim(state, ' '), ''), 'Author ' || nullif(trim(author, ' '), '')), description FROM p
  UNION ALL SELECT id, trim(regexp_replace(coalesce(txt, ''), '[\s\x{0b}]+', ' ', 'g'), ' '), NULL FROM c UNION ALL SELECT id, coalesce(trim(title, ' '), ''), txt FROM dd),
parts AS (SELECT id, list_concat([card], list_filter(list_transform(coalesce(regexp_split_to_array(body, '\r?\n[ \t]*\r?\n'), []), lambda x: trim(regexp_replace(x, '[\s\x{0b}]+', ' ', 'g'), ' ')), lambda x: x <> '')) l FROM cards),
chunks AS (SELECT id owner_id, i - 1 idx, l[i] content FROM (SELECT *, unnest(generate_series(1, len(l))) i FROM parts) WHERE l[i] <> '')"""
SQL["chunk_cards"] = f"""{_G}, {_CARDS} SELECT kind, count(*) owners, sum(k)::BIGINT chunks, sum(chars)::BIGINT chars, max(k) most FROM (SELECT split_part(owner_id, ':', 1) kind, owner_id, count(*) k, sum(length(content)) chars FROM chunks GROUP BY ALL) GROUP BY 1"""


@query
def typed_token_extract(spark: SparkSession, d: str) -> DataFrame:
    """How often each kind of typed token stands in the documents."""
    x = table(spark, d, "documents").select("source", *[F.size(text.mentions(F.col("text"), p, g)).alias(n) for n, p, g in (("tickets", f"({text.TICKET})", 1), ("handles", text.HANDLE, 1), ("links", text.WIKILINK, 1), ("urls", f"({text.URL})", 1))])
    return x.groupBy("source").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tickets", "handles", "links", "urls")])


SQL["typed_token_extract"] = r"""SELECT source, sum(coalesce(len(list_distinct(regexp_extract_all(text, '\b[A-Za-z]{2,}-\d+\b'))), 0))::BIGINT tickets, sum(coalesce(len(list_distinct(regexp_extract_all(text, '@([A-Za-z0-9][A-Za-z0-9_-]*)', 1))), 0))::BIGINT handles,
sum(coalesce(len(list_distinct(regexp_extract_all(text, '\[\[([^\]\n]+)\]\]', 1))), 0))::BIGINT links, sum(coalesce(len(list_distinct(regexp_extract_all(text, 'https?://[^\s)>\]]+'))), 0))::BIGINT urls FROM documents GROUP BY 1"""


@query
def handle_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Who is mentioned in chat, and in how many final messages."""
    c = graph.Records.of(*_tables(spark, d)).chat
    return c.select("id", F.explode(text.mentions(F.col("text"), text.HANDLE)).alias("h")).select("id", graph.slug(F.col("h")).alias("handle")).distinct().groupBy("handle").agg(F.count(F.lit(1)).alias("messages"))


SQL["handle_mentions"] = _G + f" SELECT handle, count(DISTINCT id) messages FROM (SELECT id, {_slug('h')} handle FROM (SELECT id, unnest(regexp_extract_all(txt, '@([A-Za-z0-9][A-Za-z0-9_-]*)', 1)) h FROM c)) GROUP BY 1"


@query
def gazetteer_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Components named in ticket texts, by component."""
    rec = graph.Records.of(*_tables(spark, d))
    vocab = rec.links().where("dst LIKE 'component:%'").select(F.expr("substring(dst, 11)").alias("term"), F.col("dst").alias("target")).distinct()
    return graph.gazetteer_hits(rec.tickets.select("id", F.col("description").alias("text")), vocab).groupBy("target").agg(F.count(F.lit(1)).alias("tickets"))


SQL["gazetteer_mentions"] = _G + """ SELECT target, count(*) tickets FROM (SELECT t.id, v.id target FROM t JOIN (SELECT id, substring(id, 11) term FROM nodes WHERE label = 'Component') v ON contains(' ' || regexp_replace(lower(description), '[^a-z0-9-]', ' ', 'g') || ' ', ' ' || term || ' ')) GROUP BY 1"""


@query
def wikilink_references(spark: SparkSession, d: str) -> DataFrame:
    """Pages that documents link to in double brackets: distinct (doc_id, target) and whether the target exists."""
    docs = table(spark, d, "documents")
    links = docs.select("doc_id", F.explode(text.mentions(F.col("text"), text.WIKILINK)).alias("x")).select("doc_id", graph.page_key(F.col("x")).alias("target")).where("target IS NOT NULL").distinct()
    return links.join(docs.select(F.col("stem").alias("target"), F.lit(True).alias("found")).where("target IS NOT NULL").distinct(), "target", "left").select("doc_id", "target", F.coalesce("found", F.lit(False)).alias("found"))


SQL["wikilink_references"] = rf"SELECT DISTINCT doc_id, k target, k IN (SELECT stem FROM documents WHERE stem IS NOT NULL) found FROM (SELECT doc_id, nullif({PAGE}, '') k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\[\[([^\]\n]+)\]\]', 1)) x FROM documents)) WHERE k IS NOT NULL"


@query
def agentic_loop_stub(spark: SparkSession, d: str) -> DataFrame:
    """From each seed ticket, step by step to the first 5 unseen neighbours, until a page has been visited."""
    return agentic.explore(_seeds(_tickets(spark, d)), _edges(spark, d), lambda seen: seen.where("id LIKE 'doc:%'").select("q").distinct())


def _steps_sql(n: int) -> str:
    out = "v0 AS (SELECT q, id, 0 step FROM seeds), f0 AS (SELECT q, id FROM seeds)"
    for i in range(1, n + 1):
        out += f""", f{i} AS (SELECT q, id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY id) n FROM (SELECT DISTINCT q, nxt AS id FROM f{i - 1} JOIN s2 USING (id) WHERE q NOT IN (SELECT q FROM v{i - 1} WHERE id LIKE 'doc:%') AND (q, nxt) NOT IN (SELECT (q, id) FROM v{i - 1}))) WHERE n <= 5),
v{i} AS (SELECT * FROM v{i - 1} UNION ALL SELECT q, id, {i} FROM f{i})"""
    return out


SQL["agentic_loop_stub"] = f"{_G}, {_SEEDS}, {_STEP}, {_steps_sql(3)} SELECT * FROM v3"
