"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import conversations, languages, leaks, neighbours, packing, pieces
from loomgraph.plans.session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(neighbours.neighbours(table(spark, d, "entities")))


@query
def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbours(table(spark, d, "entities"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    msgs, _ = cut(conversations.turns(table(spark, d, "chat"), table(spark, d, "people")))
    return conversations.dropped(conversations.conversations(msgs)[1])


@query
def p3_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return conversations.transcripts(table(spark, d, "chat"), table(spark, d, "people"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = pieces.pieces(pieces.project_texts(table(spark, d, "tickets"), table(spark, d, "raw_records")))
    return out.where("block_no IS NOT NULL").select("src_table", "item_key", "block_no")


@query
def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    out = pieces.pieces(pieces.project_texts(table(spark, d, "tickets"), table(spark, d, "raw_records")))
    return out.where("piece_no IS NOT NULL").drop("block_no")


@query
def p5_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Of each oversized text: a hash of its pieces' own parts put together, and whether every piece is within the limit."""
    own = F.expr("substring(content, cast(own - start + 1 as int))")
    per = p5_pieces(spark, d).groupBy("src_table", "item_key").agg(F.sort_array(F.collect_list(F.struct("piece_no", own.alias("x")))).alias("parts"), F.bool_and(F.length("content") <= pieces.LIMIT).alias("within"))
    return per.select("src_table", "item_key", F.md5(F.array_join(F.transform("parts", lambda p: p["x"]), "")).alias("text_md5"), "within")


@query
def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents")))


@query
def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """Of each document: how often its first part is placed, parts with tokens but no container, and its containers beyond the capacity."""
    packed, _ = cut(p6_containers(spark, d))
    over = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > packing.CAPACITY).select("container_id", F.lit(1).alias("over"))
    lost = F.col("container_id").isNull() & (F.col("n_tokens") > 0)
    return packed.join(over, "container_id", "left").groupBy("doc_id").agg(F.count_if(F.col("part") == 0).alias("firsts"), F.count_if(lost).alias("lost"), F.count("over").alias("too_full"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@query
def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return leaks.clean(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return languages.mislabelled(languages.languages(docs, languages.fit(docs)))


@query
def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return languages.segments(docs, languages.fit(docs))


_SPACE = r"[\s\x{0b}\x{85}\p{Z}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_CONV = rf"""
WITH RECURSIVE m AS (SELECT lower(regexp_replace({_trim("channel")}, '^#+{_SPACE}*', '')) ch, seq, max_by(struct_pack(a := author, x := text, r := reply_to, ts := ts), arrived_at) v
  FROM chat WHERE channel IS NOT NULL AND seq IS NOT NULL GROUP BY ALL),
p AS (SELECT handle, min(coalesce(role, 'user')) "role" FROM people GROUP BY 1),
t AS (SELECT ch, seq, nullif(v.r, 0) up, v.x AS x, v.ts AS ts, h AS handle, coalesce(p."role", 'user') "role", coalesce(regexp_matches(v.x, '[^\s\x{{0b}}\x{{85}}\p{{Z}}\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]'), false) said
  FROM (SELECT *, regexp_replace(lower({_trim("v.a")}), '^(@|person:)', '') h FROM m) LEFT JOIN p ON h = p.handle),
links AS (SELECT ch, seq a, up b FROM t WHERE up IS NOT NULL),
reach AS (SELECT ch, a, b FROM links UNION SELECT r.ch, r.a, l.b FROM reach r JOIN links l ON r.ch = l.ch AND r.b = l.a),
cyc AS (SELECT ch, a FROM reach WHERE a = b),
top AS (SELECT r.ch, r.a, min(r.b) AS top, bool_or(c.a IS NOT NULL) circ FROM reach r LEFT JOIN cyc c ON r.ch = c.ch AND r.b = c.a
  WHERE c.a IS NOT NULL OR NOT EXISTS (SELECT 1 FROM links l WHERE l.ch = r.ch AND l.a = r.b) GROUP BY ALL),
own AS (SELECT t.*, coalesce(top, seq) conv, coalesce(circ, false) circ FROM t LEFT JOIN top ON t.ch = top.ch AND t.seq = top.a),
per AS (SELECT ch, conv, min(seq) root_seq, count(up) replies, bool_or(circ) circ, bool_or(seq = conv) rooted,
  coalesce(max(seq) FILTER (said AND "role" = 'assistant') > min(seq) FILTER (said AND "role" = 'user'), false) told FROM own GROUP BY ALL)
"""
SQL["p3_found"] = _CONV + "SELECT ch AS channel, root_seq FROM per WHERE replies > 0 AND (circ OR NOT rooted OR NOT told)"
SQL["p3_transcripts"] = _CONV + """
SELECT ch AS channel, root_seq, seq, "role", handle AS author, ts, x AS text, row_number() OVER (PARTITION BY ch, root_seq ORDER BY seq) turn
FROM own JOIN per USING (ch, conv) WHERE said AND replies > 0 AND NOT per.circ AND rooted AND told"""
SQL["p5_found"] = r"""
WITH r AS (SELECT 'tickets' src_table, key item_key, max_by(struct_pack(x := description), ingested_at).x x FROM tickets GROUP BY 2
  UNION ALL SELECT 'raw_records', id, max_by(struct_pack(x := body), loaded_at).x FROM raw_records GROUP BY 2),
big AS (SELECT * FROM r WHERE length(x) > 1600),
b AS (SELECT src_table, item_key, trim(regexp_replace(u.b, '[ \t\r\n]+', ' ', 'g'), ' ') b, u.i FROM big,
  LATERAL (SELECT unnest(l) b, generate_subscripts(l, 1) i FROM (SELECT regexp_split_to_array(regexp_replace(x, '\r\n?', chr(10), 'g'), '\n([ \t]*\n)+') l)) u),
n AS (SELECT *, row_number() OVER (PARTITION BY src_table, item_key ORDER BY i) block_no FROM b WHERE b <> '')
SELECT src_table, item_key, 0::BIGINT block_no FROM big UNION ALL SELECT src_table, item_key, block_no FROM n WHERE length(b) > 1600
"""
SQL["p5_rebuilt"] = r"""
WITH r AS (SELECT 'tickets' src_table, key item_key, max_by(struct_pack(x := description), ingested_at).x x FROM tickets GROUP BY 2
  UNION ALL SELECT 'raw_records', id, max_by(struct_pack(x := body), loaded_at).x FROM raw_records GROUP BY 2)
SELECT src_table, item_key, md5(x) text_md5, true AS "within" FROM r WHERE length(x) > 1600"""
SQL["p6_kept"] = "SELECT doc_id, 1::BIGINT firsts, 0::BIGINT lost, 0::BIGINT too_full FROM documents"
