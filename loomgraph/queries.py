"""The registered queries of the core and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import hierarchy, orphans
from loomgraph.plans.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "tickets"), table(spark, d, "github_prs"), table(spark, d, "documents"))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "src_key", "field", "target_key", "period")


@query
def p1_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, d))


def _hierarchies(spark: SparkSession, d: str) -> hierarchy.Hierarchies:
    return hierarchy.Hierarchies(hierarchy.ticket_links(table(spark, d, "tickets"))[1], hierarchy.chat_links(table(spark, d, "chat")))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.found(_hierarchies(spark, d))


@query
def p4_outline(spark: SparkSession, d: str) -> DataFrame:
    """Every opener and every reply below one: its root, depth, number of descendants and path of seqs."""
    seq = F.expr("array_join(transform(path, x -> substring(substring_index(x, ':', -1), 2)), '/')")
    rows = hierarchy.outline(hierarchy.chat_links(table(spark, d, "chat")))
    return rows.select(hierarchy.node_id("node").alias("node_id"), hierarchy.node_id("root").alias("root_id"), "depth", (F.col("size") - 1).alias("descendants"), seq.alias("path"))


@query
def p4_depths(spark: SparkSession, d: str) -> DataFrame:
    """Every message and ticket below a root: the most links to each of its roots, clear of cycles."""
    return hierarchy.public(_hierarchies(spark, d).depths, "links")


@query
def p4_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Every message and ticket on a cycle (member) or leading to one; root_id names the cycle."""
    return hierarchy.public(_hierarchies(spark, d).circles.withColumnRenamed("cycle", "root"), "member")


_SPACE = r"[\s\x{0b}\x{85}\p{Z}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_PAGE = rf"regexp_replace(regexp_replace(lower(regexp_replace({_trim('x')}, '^doc:', '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_TICKET = rf"regexp_replace({_trim('x')}, '^ticket:', '')"
_ORPHANS = rf"""
WITH t AS (SELECT key, max_by("references", ingested_at) refs, max_by(blocks, ingested_at) blocks, min(ingested_at) arrival
           FROM tickets WHERE key IS NOT NULL GROUP BY key),
p AS (SELECT repo || '#' || number AS key, max_by(fixes, ingested_at) fixes, min(ingested_at) arrival
      FROM github_prs WHERE repo IS NOT NULL AND number IS NOT NULL GROUP BY 1),
named AS (SELECT 'tickets' src_table, key src_key, 'references' field, 'documents' target_table, {_PAGE} target_key, arrival FROM (SELECT key, unnest(refs) x, arrival FROM t)
  UNION SELECT 'tickets', key, 'blocks', 'tickets', {_TICKET}, arrival FROM (SELECT key, unnest(blocks) x, arrival FROM t)
  UNION SELECT 'github_prs', key, 'fixes', 'tickets', {_TICKET}, arrival FROM (SELECT key, unnest(fixes) x, arrival FROM p)),
have AS (SELECT 'documents' target_table, stem target_key, min(ingested_at) seen, bool_or(deleted_at IS NOT NULL) gone FROM documents WHERE stem IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'tickets', key, min(ingested_at), bool_or(deleted_at IS NOT NULL) FROM tickets WHERE key IS NOT NULL GROUP BY 2),
found AS (SELECT n.*, CASE WHEN h.target_key IS NULL THEN 'missing' WHEN gone THEN 'deleted' ELSE 'late' END why, strftime(arrival, '%Y-%m') period
  FROM named n LEFT JOIN have h USING (target_table, target_key)
  WHERE n.target_key <> '' AND (h.target_key IS NULL OR gone OR seen > arrival))
"""
SQL["p1_found"] = _ORPHANS + "SELECT src_table, src_key, field, target_key, period FROM found"
SQL["p1_orphan_counts"] = _ORPHANS + "SELECT src_table, field, why, period, count(*) orphans FROM found GROUP BY ALL"
_CHANNEL = rf"lower(regexp_replace({_trim('channel')}, '^#+{_SPACE}*', ''))"
_FOREST = rf"""
WITH RECURSIVE m AS (SELECT {_CHANNEL} ch, seq, max_by(nullif(coalesce(reply_to, 0), 0), arrived_at) up FROM chat WHERE channel IS NOT NULL AND seq IS NOT NULL GROUP BY ALL),
ml AS (SELECT a.ch, a.seq, a.up FROM m a JOIN m b ON a.ch = b.ch AND a.up = b.seq),
t AS (SELECT key, max_by(blocks, ingested_at) blocks FROM tickets GROUP BY key),
links AS (SELECT 'chat' h, ch || ':' || lpad(seq::VARCHAR, 19, '0') a, ch || ':' || lpad(up::VARCHAR, 19, '0') b FROM ml
  UNION SELECT 'tickets', key, {_TICKET} FROM (SELECT key, unnest(blocks) x FROM t) WHERE {_TICKET} IN (SELECT key FROM t)),
reach AS (SELECT h, a, b FROM links UNION SELECT r.h, r.a, l.b FROM reach r JOIN links l ON r.h = l.h AND r.b = l.a),
cyc AS (SELECT r.h, r.a, least(r.a, min(r.b)) c FROM reach r JOIN reach q ON r.h = q.h AND r.a = q.b AND r.b = q.a GROUP BY r.h, r.a),
free AS (SELECT l.* FROM links l LEFT JOIN cyc x ON l.h = x.h AND l.a = x.a LEFT JOIN cyc y ON l.h = y.h AND l.b = y.a WHERE x.a IS NULL AND y.a IS NULL),
walk AS (SELECT h, a, b, 1 n FROM free UNION SELECT w.h, w.a, l.b, n + 1 FROM walk w JOIN free l ON w.h = l.h AND w.b = l.a),
top AS (SELECT h, a, b, n FROM walk w WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.h = w.h AND l.a = w.b)),
led AS (SELECT h, a, c, true AS member FROM cyc UNION SELECT r.h, r.a, x.c, y.c IS NOT NULL FROM reach r JOIN cyc x ON r.h = x.h AND r.b = x.a LEFT JOIN cyc y ON y.h = r.h AND y.a = r.a AND y.c = x.c)
"""


def _ids(*rest: str) -> str:
    node = r"CASE h WHEN 'chat' THEN 'msg:' || regexp_replace({0}, ':0*([0-9]+)$', ':\1') ELSE 'ticket:' || {0} END"
    return ", ".join(["h AS hierarchy", node.format("a") + " node_id", node.format("b") + " root_id", *rest])


SQL["p4_found"] = f"{_FOREST} SELECT DISTINCT {_ids()} FROM (SELECT h, a, b FROM top WHERE n >= 8 UNION SELECT h, a, c FROM led)"
SQL["p4_depths"] = f"{_FOREST} SELECT {_ids('n AS links')} FROM (SELECT h, a, b, max(n)::BIGINT n FROM top GROUP BY ALL)"
SQL["p4_cycles"] = f"{_FOREST} SELECT {_ids('member')} FROM (SELECT DISTINCT h, a, c b, member FROM led)"
SQL["p4_outline"] = rf"""
WITH RECURSIVE m AS (SELECT {_CHANNEL} ch, seq, max_by(nullif(coalesce(reply_to, 0), 0), arrived_at) up FROM chat WHERE channel IS NOT NULL AND seq IS NOT NULL GROUP BY ALL),
l AS (SELECT a.ch, a.seq a, a.up b FROM m a JOIN m b ON a.ch = b.ch AND a.up = b.seq),
w AS (SELECT ch, a, b, 1::BIGINT n, [b, a] p FROM l UNION ALL SELECT w.ch, w.a, l.b, n + 1, list_prepend(l.b, p) FROM w JOIN l ON w.ch = l.ch AND w.b = l.a WHERE NOT list_contains(p, l.b)),
top AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.ch = w.ch AND l.a = w.b)),
sub AS (SELECT ch, b, count(*) k FROM w WHERE EXISTS (SELECT 1 FROM top t WHERE t.ch = w.ch AND t.a = w.a) GROUP BY ALL)
SELECT 'msg:' || ch || ':' || a node_id, 'msg:' || ch || ':' || top.b root_id, n AS depth, coalesce(k, 0) descendants, array_to_string(p, '/') "path" FROM top LEFT JOIN (SELECT ch, b AS a, k FROM sub) USING (ch, a)
UNION ALL SELECT 'msg:' || ch || ':' || b, 'msg:' || ch || ':' || b, 0, k, b::VARCHAR FROM sub WHERE b IN (SELECT t.b FROM top t WHERE t.ch = sub.ch)
"""
