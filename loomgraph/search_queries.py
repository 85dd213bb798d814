"""Retrieval, evaluation and table analytics: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.graph_queries import _CARDS, _G, _edges, _graph, _tables
from loomgraph.operators import graph, metrics, search, select
from loomgraph.operators.records import latest
from loomgraph.plans.session import cut, new_path, table
from loomgraph.queries import SQL, query

_TERMS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _t(x: str) -> str:
    return _TERMS.format(x)


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Titles of the documents whose id is divisible by 50 as questions (q, text), and (q, id) of all documents so titled."""
    docs = table(spark, d, "documents")
    q = docs.where("doc_id % 50 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("q"), F.col("title").alias("text"))
    gold = q.join(docs.select("doc_id", "title"), F.col("text") == F.col("title")).select("q", F.col("doc_id").alias("id"))
    return q, gold


def _bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    """(q, id, score, rank) of the ``k`` best documents for each asked title."""
    return search.bm25_topk(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _asked(spark, d)[0], k)


_BM25 = f"""ask AS (SELECT DISTINCT doc_id q, unnest({_t("title")}) term FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
tok AS (SELECT doc_id id, {_t("text")} ts FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) FILTER (len(ts) > 0) n, sum(len(ts)) / count(*) FILTER (len(ts) > 0) av FROM tok),
post AS (SELECT id, term, count(*) tf, dl FROM (SELECT id, len(ts) dl, unnest(ts) term FROM tok) WHERE term IN (SELECT term FROM ask) GROUP BY id, term, dl), df AS (SELECT term, count(*) df FROM post GROUP BY 1),
bm AS (SELECT q, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 4) score FROM post JOIN df USING (term) JOIN ask USING (term), st GROUP BY q, id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rnk FROM bm)"""
_GOLD = "gold AS (SELECT a.doc_id q, b.doc_id id FROM documents a JOIN documents b ON a.title = b.title WHERE a.doc_id % 50 = 0)"


@query
def query_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", F.array_join(text.keywords(F.col("question")), " ").alias("keywords"))


SQL["query_keywords"] = f"""WITH a AS (SELECT item_id, list_concat(regexp_extract_all(question, '\\b[A-Za-z]{{2,}}-\\d+\\b'), list_filter({_t("question")}, lambda x: length(x) >= 3 AND NOT list_contains({text.STOPWORDS!r}, x))) l FROM eval_items)
SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), ' ') keywords FROM a"""


@query
def bm25_seed_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, 10)


SQL["bm25_seed_topk"] = f'WITH {_BM25} SELECT q, id, score, rnk AS "rank" FROM bmr WHERE rnk <= 10'


@query
def recall_hit_mrr(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ranking_metrics(_bm25(spark, d, 100), _asked(spark, d)[1])


_METRICS = f"""{_BM25}, {_GOLD}, per AS (SELECT q, round(count(*) FILTER (rnk <= 20) / count(*), 6) recall_20, round(count(*) FILTER (rnk <= 100) / count(*), 6) recall_100, coalesce(min(rnk) <= 1, false)::INT::DOUBLE hit_1, coalesce(min(rnk) <= 5, false)::INT::DOUBLE hit_5, round(coalesce(1 / min(rnk), 0), 6) mrr
FROM gold LEFT JOIN (SELECT * FROM bmr WHERE rnk <= 100) USING (q, id) GROUP BY q)"""
SQL["recall_hit_mrr"] = f"WITH {_METRICS} SELECT * FROM per"


@query
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(recall_hit_mrr(spark, d))


SQL["metric_summary"] = f"WITH {_METRICS} SELECT count(*) queries, round(avg(recall_20), 6) recall_20, round(avg(recall_100), 6) recall_100, round(avg(hit_1), 6) hit_1, round(avg(hit_5), 6) hit_5, round(avg(mrr), 6) mrr FROM per"


@query
def gold_ranks(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gold_ranks(_bm25(spark, d, 100), _asked(spark, d)[1])


SQL["gold_ranks"] = f'WITH {_BM25}, {_GOLD} SELECT DISTINCT q, id, rnk AS "rank", score FROM gold JOIN bmr USING (q, id) WHERE rnk <= 100'


@query
def reflection_records(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.reflection(_bm25(spark, d, 100), _asked(spark, d)[1])
    return got.select("q", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("missed", "wrong", "ranks")])


SQL["reflection_records"] = f"""WITH {_BM25}, {_GOLD}, j AS (SELECT coalesce(g.q, r.q) q, coalesce(g.id, r.id) id, g.q IS NOT NULL gold, rnk FROM (SELECT DISTINCT * FROM gold) g FULL JOIN (SELECT * FROM bmr WHERE rnk <= 100) r ON g.q = r.q AND g.id = r.id),
a AS (SELECT q, list(id ORDER BY id) FILTER (gold AND coalesce(rnk, 999) > 20) m, list(id ORDER BY rnk) FILTER (NOT gold AND rnk <= 20) w, list(rnk ORDER BY rnk) FILTER (gold AND rnk IS NOT NULL) r FROM j GROUP BY q)
SELECT q, array_to_string(m[1:5], ',') missed, coalesce(array_to_string(w[1:5], ','), '') wrong, coalesce(array_to_string(r[1:5], ','), '') ranks FROM a WHERE len(m) > 0"""


@query
def failure_mix(spark: SparkSession, d: str) -> DataFrame:
    per = recall_hit_mrr(spark, d)
    return per.select(F.coalesce(metrics.miss_kind(F.col("recall_20"), F.col("recall_100")), F.lit("FOUND")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


SQL["failure_mix"] = f"WITH {_METRICS} SELECT CASE WHEN recall_20 >= 1 THEN 'FOUND' WHEN recall_100 >= 0.999 THEN 'RANKING' WHEN recall_100 > recall_20 + 1e-9 THEN 'MIXED' ELSE 'GENERATION' END kind, count(*) n FROM per GROUP BY 1"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Usable vectors (id, embedding, ntype) of the latest entities, and those whose id is divisible by 50 as questions."""
    e = latest(table(spark, d, "entities"), ["id"], "ingested_at", ["embedding", "ntype"])
    ok = e.where("size(embedding) = 64 AND NOT exists(embedding, x -> x IS NULL OR isnan(x)) AND exists(embedding, x -> x <> 0)")
    ok, _ = cut(ok)
    return ok, ok.where("id % 50 = 0").select(F.col("id").alias("q"), "embedding")


_VEC = """e AS (SELECT id, max_by(struct_pack(v := embedding, t := ntype), ingested_at) x FROM entities GROUP BY id), v AS (SELECT id, x.t ntype, x.v::DOUBLE[] v FROM e WHERE len(x.v) = 64 AND len(list_filter(x.v, lambda y: y IS NULL OR isnan(y))) = 0 AND len(list_filter(x.v, lambda y: y <> 0)) > 0),
vs AS (SELECT a.id q, b.id id, b.ntype, round(list_cosine_similarity(a.v, b.v), 4) score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0)"""


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.vector_topk(*_vectors(spark, d), 10)


SQL["vector_topk"] = f'WITH {_VEC} SELECT * FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS "rank" FROM vs) WHERE "rank" <= 10'


@query
def vector_topk_typed(spark: SparkSession, d: str) -> DataFrame:
    v, asked = _vectors(spark, d)
    return search.vector_topk(v.where("ntype = 'service'"), asked, 5)


SQL["vector_topk_typed"] = f"""WITH {_VEC} SELECT * FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS "rank" FROM vs WHERE ntype = 'service') WHERE "rank" <= 5"""


@query
def vector_topk_per_label_merge(spark: SparkSession, d: str) -> DataFrame:
    """The 10 best of each type, merged and cut at 10: as many per type as in the end, so that none of the true 10 is lost."""
    v, asked = _vectors(spark, d)
    return search.ranked(search.vector_topk_by_group(v, asked, "ntype", 10).drop("rank"), 10)


SQL["vector_topk_per_label_merge"] = f"""WITH {_VEC}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, ntype ORDER BY score DESC, id) k FROM vs) WHERE k <= 10)
SELECT * FROM (SELECT q, id, score, ntype, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS "rank" FROM l) WHERE "rank" <= 10"""


@query
def rank_by_text(spark: SparkSession, d: str) -> DataFrame:
    """Of the 10 best of each type, the 5 best by exact cosine."""
    v, asked = _vectors(spark, d)
    return search.rerank(search.vector_topk_by_group(v, asked, "ntype", 10), v, asked, 5)


SQL["rank_by_text"] = f"""WITH {_VEC}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, ntype ORDER BY score DESC, id) k FROM vs) WHERE k <= 10)
SELECT * FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS "rank" FROM l) WHERE "rank" <= 5"""


def _label_ranking(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """For each asked entity, the ``k`` others that share most terms with its text, by BM25."""
    e = latest(table(spark, d, "entities"), ["id"], "ingested_at", ["text"])
    e, _ = cut(e)
    return search.bm25_topk(e, e.where("id % 50 = 0 AND text IS NOT NULL").select(F.col("id").alias("q"), "text"), k, itself=False)


_ELAB = f"""lt AS (SELECT id, max_by(struct_pack(x := text), ingested_at).x x FROM entities GROUP BY id), ask AS (SELECT DISTINCT id q, unnest({_t("x")}) term FROM lt WHERE id % 50 = 0),
tok AS (SELECT id, {_t("x")} ts FROM lt WHERE x IS NOT NULL), st AS (SELECT count(*) FILTER (len(ts) > 0) n, sum(len(ts)) / count(*) FILTER (len(ts) > 0) av FROM tok),
post AS (SELECT id, term, count(*) tf, dl FROM (SELECT id, len(ts) dl, unnest(ts) term FROM tok) WHERE term IN (SELECT term FROM ask) GROUP BY id, term, dl), df AS (SELECT term, count(*) df FROM post GROUP BY 1),
bm AS (SELECT q, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 4) score FROM post JOIN df USING (term) JOIN ask USING (term), st WHERE q <> id GROUP BY q, id),
sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rnk FROM bm) WHERE rnk <= 100),
de AS (SELECT * FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rnk FROM vs) WHERE rnk <= 100)"""


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 by vector and the first 100 by text, fused: 20 are kept."""
    dense = search.vector_topk(*_vectors(spark, d), 100)
    return search.ranked(search.rrf(dense, _label_ranking(spark, d, 100)), 20)


SQL["rrf_fusion"] = f"""WITH {_VEC}, {_ELAB} SELECT * FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS "rank" FROM (SELECT q, id, round(sum(1 / (60 + rnk)), 6) score FROM (SELECT q, id, rnk FROM sp UNION ALL SELECT q, id, rnk FROM de) GROUP BY ALL)) WHERE "rank" <= 20"""


@query
def evidence_union_scores(spark: SparkSession, d: str) -> DataFrame:
    """Vector hits at 0.3, text hits at 0.35 of a tenth, and entities of the asked one's type at 0.6 when found by either."""
    v, asked = _vectors(spark, d)
    dense, _ = cut(search.vector_topk(v, asked, 50))
    sparse, _ = cut(_label_ranking(spark, d).withColumn("score", F.col("score") / 10))
    either = dense.select("q", "id").union(sparse.select("q", "id")).distinct()
    e = latest(table(spark, d, "entities"), ["id"], "ingested_at", ["ntype"])
    typed = either.join(e, "id").join(e.select(F.col("id").alias("q"), F.col("ntype").alias("want")), "q").where("ntype = want").select("q", "id", F.lit(1.0).alias("score"))
    return search.ranked(search.evidence((dense, 0.3), (sparse, 0.35), (typed, 0.6)), 20)


SQL["evidence_union_scores"] = f"""WITH {_VEC}, {_ELAB}, ty AS (SELECT id, max_by(ntype, ingested_at) t FROM entities GROUP BY id),
de5 AS (SELECT * FROM de WHERE rnk <= 50), sp5 AS (SELECT * FROM sp WHERE rnk <= 50),
ev AS (SELECT q, id, score * 0.3 w, 0 b FROM de5 UNION ALL SELECT q, id, score / 10 * 0.35, 1 FROM sp5 UNION ALL SELECT q, x.id, 0.6, 2 FROM (SELECT q, id FROM de5 UNION SELECT q, id FROM sp5) x JOIN ty a ON a.id = x.id JOIN ty c ON c.id = x.q AND a.t = c.t)
SELECT * FROM (SELECT q, id, score, branches, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS "rank" FROM (SELECT q, id, sum(round(w * 1e8)::BIGINT)::BIGINT / 1e8 score, count(DISTINCT b) branches FROM ev GROUP BY ALL)) WHERE "rank" <= 20"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of pages (owner_id, idx, content), written."""
    return cut(graph.Records.of(*_tables(spark, d)).cards().where("owner_id LIKE 'doc:%'"))[0]


def _owners(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    """For each asked title its pages of the 3 best chunks, with their rank."""
    got = search.bm25_topk(chunks.select(F.concat_ws("#c", "owner_id", "idx").alias("id"), F.col("content").alias("text")), _asked(spark, d)[0], 3)
    best = got.select("q", F.substring_index("id", "#c", 1).alias("id"), "rank")
    return best.groupBy("q", "id").agg(F.min("rank").alias("rank"))


_OWN = f"""{_CARDS}, dc AS (SELECT owner_id || '#c' || idx id, owner_id, idx, content FROM chunks WHERE owner_id LIKE 'doc:%'),
ask AS (SELECT DISTINCT doc_id q, unnest({_t("title")}) term FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
tok AS (SELECT id, {_t("content")} ts FROM dc), st AS (SELECT count(*) FILTER (len(ts) > 0) n, sum(len(ts)) / count(*) FILTER (len(ts) > 0) av FROM tok),
post AS (SELECT id, term, count(*) tf, dl FROM (SELECT id, len(ts) dl, unnest(ts) term FROM tok) WHERE term IN (SELECT term FROM ask) GROUP BY id, term, dl), df AS (SELECT term, count(*) df FROM post GROUP BY 1),
bm AS (SELECT q, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 4) score FROM post JOIN df USING (term) JOIN ask USING (term), st GROUP BY q, id),
own AS (SELECT q, owner_id id, min(rnk) rnk FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) rnk FROM bm) JOIN dc USING (id) WHERE rnk <= 3 GROUP BY ALL)"""


@query
def owner_of_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _owners(spark, d, _chunks(spark, d))


SQL["owner_of_chunks"] = f'{_G}, {_OWN} SELECT q, id, rnk AS "rank" FROM own'


@query
def context_assembly_budget(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of 2,000 characters from the 3 best pages; questions without any page stay, with an empty context."""
    chunks = _chunks(spark, d)
    ctx = search.contexts(search.context_rows(_owners(spark, d, chunks), chunks, 2000))
    return _asked(spark, d)[0].select("q").join(ctx, "q", "left").select("q", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("citations", F.lit("")).alias("citations"))


_CTX = f"""{_G}, {_OWN}, cx AS (SELECT q, o.id, rnk, idx, content, coalesce(sum(length(content) + 1) OVER (PARTITION BY q ORDER BY rnk, o.id, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT pos FROM own o JOIN dc ON dc.owner_id = o.id),
kept AS (SELECT q, id, rnk, idx, substring(content, 1, 2000 - pos) content FROM cx WHERE pos < 2000),
ctx AS (SELECT q, string_agg(content, chr(10) ORDER BY rnk, id, idx) context, (SELECT string_agg('[' || id || ']', ' ' ORDER BY rnk, id) FROM (SELECT DISTINCT k2.id, k2.rnk FROM kept k2 WHERE k2.q = kept.q)) citations FROM kept GROUP BY q)"""
SQL["context_assembly_budget"] = _CTX + " SELECT a.doc_id q, coalesce(context, '') context, coalesce(citations, '') citations FROM documents a LEFT JOIN ctx ON a.doc_id = ctx.q WHERE a.doc_id % 50 = 0 AND a.title IS NOT NULL"


@query
def citations(spark: SparkSession, d: str) -> DataFrame:
    """How often each page is cited by the assembled contexts."""
    c = context_assembly_budget(spark, d).select("q", F.explode(text.cited(F.col("citations"))).alias("id"))
    return c.groupBy("id").agg(F.count_distinct("q").alias("questions"))


SQL["citations"] = _CTX + " SELECT id, count(DISTINCT q) questions FROM kept GROUP BY 1"


@query
def retrieval_hit_all_gold(spark: SparkSession, d: str) -> DataFrame:
    """Whether a question's context holds every word of the question."""
    ctx = context_assembly_budget(spark, d)
    rows = ctx.join(_asked(spark, d)[0], "q").select("q", "context", text.terms(F.col("text")).alias("needles"))
    return metrics.all_in_context(rows)


SQL["retrieval_hit_all_gold"] = _CTX + f" SELECT doc_id q, len({_t('title')}) > 0 AND len(list_filter({_t('title')}, lambda x: NOT contains(lower(coalesce(context, '')), x))) = 0 hit FROM documents LEFT JOIN ctx ON doc_id = ctx.q WHERE doc_id % 50 = 0 AND title IS NOT NULL"


@query
def miss_attribution(spark: SparkSession, d: str) -> DataFrame:
    """For the pages that share an asked title: in the 3 best, within 2 steps of them, elsewhere, or no node at all."""
    nodes, edges = _graph(spark, d)
    owners, _ = cut(_owners(spark, d, _chunks(spark, d)))
    docs = table(spark, d, "documents")
    q, gold = _asked(spark, d)
    named = gold.join(docs.select(F.col("doc_id").alias("id"), "stem"), "id").select("q", F.concat(F.lit("doc:"), F.coalesce("stem", F.concat(F.lit("none-"), "id"))).alias("id"))
    near = graph.met(owners, named, edges, ("REFERENCES", "ABOUT"))
    out = metrics.attribution(named, owners, nodes, near)
    return out.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


SQL["miss_attribution"] = f"""{_G}, {_OWN}, st2 AS (SELECT src id, dst AS nxt FROM edges WHERE rel IN ('REFERENCES', 'ABOUT') UNION SELECT dst, src FROM edges WHERE rel IN ('REFERENCES', 'ABOUT')),
n1 AS (SELECT q, id FROM own UNION SELECT q, nxt FROM own JOIN st2 USING (id)), near AS (SELECT q, id FROM n1 UNION SELECT q, nxt FROM n1 JOIN st2 USING (id)),
g AS (SELECT DISTINCT a.doc_id q, 'doc:' || coalesce(b.stem, 'none-' || b.doc_id) id FROM documents a JOIN documents b ON a.title = b.title WHERE a.doc_id % 50 = 0)
SELECT CASE WHEN id NOT IN (SELECT id FROM nodes) THEN 'NOT_INGESTED' WHEN (q, id) IN (SELECT (q, id) FROM own) THEN 'RANKING' WHEN (q, id) IN (SELECT (q, id) FROM near) THEN 'UNREACHABLE' ELSE 'ORPHANED' END bucket, count(*) n FROM g GROUP BY 1"""


def _eval_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("q"), F.col("question").alias("text"))


@query
def answer_search(spark: SparkSession, d: str) -> DataFrame:
    """From each eval question to its context of up to 20,000 characters: chunks of all records, a step from their owners."""
    chunks, _ = cut(graph.Records.of(*_tables(spark, d)).cards())
    got = search.answer(_eval_questions(spark, d), chunks, _edges(spark, d, graph.OWNER_RELS))
    return got.select("q", "nodes", F.length("context").alias("chars"), F.md5("context").alias("context_md5"), "citations")


_KW = f"""kw AS (SELECT item_id q, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i) ks FROM (SELECT item_id, list_concat(regexp_extract_all(question, '\\b[A-Za-z]{{2,}}-\\d+\\b'), list_filter({_t("question")}, lambda x: length(x) >= 3 AND NOT list_contains({text.STOPWORDS!r}, x))) l FROM eval_items))"""


def _ranked_sql(name: str, ask: str, post: str = "post") -> str:
    """(a, id, score) of the asks (a, term) by BM25."""
    return f"{name} AS (SELECT a, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 4) score FROM {post} JOIN df USING (term) JOIN {ask} USING (term), st GROUP BY a, id)"


SQL["answer_search"] = f"""{_G}, {_CARDS}, {_KW}, ask AS (SELECT DISTINCT q a, unnest({_t("array_to_string(ks, ' ')")}) term FROM kw),
tok AS (SELECT owner_id || '#c' || idx id, {_t("content")} ts FROM chunks), st AS (SELECT count(*) FILTER (len(ts) > 0) n, sum(len(ts)) / count(*) FILTER (len(ts) > 0) av FROM tok),
post AS (SELECT id, term, count(*) tf, dl FROM (SELECT id, len(ts) dl, unnest(ts) term FROM tok) WHERE term IN (SELECT term FROM ask) GROUP BY id, term, dl), df AS (SELECT term, count(*) df FROM post GROUP BY 1), {_ranked_sql("bm", "ask")},
own AS (SELECT a q, regexp_replace(id, '#c[0-9]+$', '') id, min(rnk) rnk FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) rnk FROM bm) WHERE rnk <= 5 GROUP BY ALL),
st2 AS (SELECT src id, dst AS nxt FROM edges WHERE rel IN {graph.OWNER_RELS} UNION SELECT dst, src FROM edges WHERE rel IN {graph.OWNER_RELS}),
near AS (SELECT q, id, min(h) hops FROM (SELECT q, id, 0 h FROM own UNION SELECT q, nxt, 1 FROM own JOIN st2 USING (id)) GROUP BY ALL),
pl AS (SELECT * FROM (SELECT near.q, near.id, row_number() OVER (PARTITION BY near.q ORDER BY hops, rnk NULLS LAST, near.id) place FROM near LEFT JOIN own ON own.q = near.q AND own.id = near.id) WHERE place <= 5),
cx AS (SELECT q, id, place, idx, content, coalesce(sum(length(content) + 1) OVER (PARTITION BY q ORDER BY place, id, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT pos FROM pl JOIN chunks ON owner_id = id),
kept AS (SELECT q, id, place, idx, substring(content, 1, 20000 - pos) content FROM cx WHERE pos < 20000), ct AS (SELECT q, string_agg(content, chr(10) ORDER BY place, id, idx) context FROM kept GROUP BY q),
ci AS (SELECT q, string_agg('[' || id || ']', ' ' ORDER BY place) citations FROM (SELECT DISTINCT q, id, place FROM kept) GROUP BY q)
SELECT item_id q, coalesce((SELECT count(*) FROM pl WHERE pl.q = item_id), 0) nodes, length(coalesce(context, '')) chars, md5(coalesce(context, '')) context_md5, coalesce(citations, '') citations FROM eval_items LEFT JOIN ct ON ct.q = item_id LEFT JOIN ci ON ci.q = item_id"""


@query
def service_search(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best pages and tickets for each eval question by all branches of evidence.

    Stand-ins for what a model would extract: pages answer, tickets are the anchors, along BLOCKS and REFERENCES, with
    the first three keywords; a weak question is rewritten as its keywords and the text of its best card.
    """
    rec = graph.Records.of(*_tables(spark, d))
    label = F.when(F.col("owner_id").startswith("ticket:"), "Ticket").otherwise("Document")
    cards, _ = cut(rec.cards().where("idx = 0 AND (owner_id LIKE 'ticket:%' OR owner_id LIKE 'doc:%')").select(F.col("owner_id").alias("id"), label.alias("label"), F.col("content").alias("text")))
    q, _ = cut(_eval_questions(spark, d).select("q", "text", F.lit("Document").alias("answer"), F.lit("Ticket").alias("anchor")))
    rels = q.select("q", F.explode(F.array(F.lit("BLOCKS"), F.lit("REFERENCES"))).alias("rel"))
    words = q.select("q", F.slice(text.keywords(F.col("text")), 1, 3).alias("k")).where("size(k) > 1").select("q", F.posexplode("k").alias("part", "text"))

    def rewrite(weak, hits):
        best = hits.where("rank = 1").join(cards.select("id", F.col("text").alias("card")), "id").select("q", "card")
        return weak.join(best, "q").select("q", F.concat_ws(" ", F.array_join(text.keywords(F.col("text")), " "), "card").alias("text"))

    got = search.service(q, rels, words, cards, _edges(spark, d, ("BLOCKS", "REFERENCES")), search.text_find(cards), search.overlap_score(cards, q), rewrite)
    return search.ranked(got, 20)


def _find_sql(name: str, ask: str, label: str | None, k: int) -> str:
    only = f" WHERE id LIKE '{label}:%'" if label else ""
    return f"{_ranked_sql(name + '0', ask)}, {name} AS (SELECT * FROM (SELECT a, id, round(score / (score + 10), 6) sim, row_number() OVER (PARTITION BY a ORDER BY round(score / (score + 10), 6) DESC, id) rnk FROM {name}0{only}) WHERE rnk <= {k})"


def _along_sql(name: str, start: str) -> str:
    return f"{name} AS (SELECT a, id FROM (SELECT DISTINCT a, nxt AS id, row_number() OVER (PARTITION BY a ORDER BY nxt) n FROM (SELECT DISTINCT a, nxt FROM (SELECT a, rel, nxt, row_number() OVER (PARTITION BY a, rel ORDER BY id, nxt) m FROM (SELECT DISTINCT a, rel, {start}.id, nxt FROM {start} JOIN s3 ON s3.id = {start}.id)) WHERE m <= 50 AND nxt LIKE 'doc:%' AND nxt IN (SELECT id FROM cd))) WHERE n <= 100)"


def _score_sql(name: str, cand: str) -> str:
    return f"{name} AS (SELECT a, id, round(len(list_intersect(list_transform(ks, lambda x: lower(x)), list_distinct(ts))) / greatest(1, len(ks)), 4) s FROM {cand} JOIN kw ON kw.q = a JOIN tok USING (id))"


def _sum_sql(name: str, *parts: str) -> str:
    return f"{name} AS (SELECT a, id, sum(w)::BIGINT / 1e8 score, count(DISTINCT b) branches FROM ({' UNION ALL '.join(f'SELECT a, id, round({w} * 1e8)::BIGINT w, {i} b FROM {t}' for i, (t, w) in enumerate(p.split('|') for p in parts))}) GROUP BY ALL)"


_EV = ("hits|sim * 0.3", "rer|s * 1.0", "direct|0.6", "broad|0.25", "sets|0.3", "meet|0.9")
SQL["service_search"] = f"""{_G}, {_CARDS}, {_KW}, cd AS (SELECT owner_id id, content FROM chunks WHERE idx = 0 AND (owner_id LIKE 'ticket:%' OR owner_id LIKE 'doc:%')),
tok AS (SELECT id, {_t("content")} ts FROM cd), st AS (SELECT count(*) FILTER (len(ts) > 0) n, sum(len(ts)) / count(*) FILTER (len(ts) > 0) av FROM tok), post AS (SELECT id, term, count(*) tf, dl FROM (SELECT id, len(ts) dl, unnest(ts) term FROM tok) GROUP BY id, term, dl), df AS (SELECT term, count(*) df FROM post GROUP BY 1),
s3 AS (SELECT src id, rel, dst AS nxt FROM edges WHERE rel IN ('BLOCKS', 'REFERENCES') UNION SELECT dst, rel, src FROM edges WHERE rel IN ('BLOCKS', 'REFERENCES')),
ask AS (SELECT DISTINCT item_id a, unnest({_t("question")}) term FROM eval_items), {_find_sql("hits", "ask", "doc", 50)}, {_find_sql("anc", "ask", "ticket", 5)},
pool AS (SELECT a, id FROM hits WHERE rnk <= 30), {_score_sql("rer", "pool")}, {_along_sql("direct", "anc")},
lost AS (SELECT a, id FROM anc WHERE a NOT IN (SELECT a FROM direct)), h1 AS (SELECT a, id, 0 h FROM lost UNION SELECT a, nxt, 1 FROM lost JOIN s3 USING (id)), h2 AS (SELECT a, id, min(h) h FROM (SELECT * FROM h1 UNION SELECT a, nxt, 2 FROM h1 JOIN s3 USING (id)) GROUP BY ALL),
broad AS (SELECT a, id FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY id) m FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY h, id) n FROM h2) WHERE n <= 120 AND id LIKE 'doc:%' AND id IN (SELECT id FROM cd)) WHERE m <= 100),
kask AS (SELECT DISTINCT q || chr(9) || (i - 1) a, unnest({_t("ks[i]")}) term FROM (SELECT q, ks, unnest(generate_series(1, least(3, len(ks)))) i FROM kw WHERE len(ks) > 1)), {_find_sql("kh", "kask", None, 3)}, {_along_sql("ksets", "kh")},
sets AS (SELECT split_part(a, chr(9), 1) a, id, a part FROM ksets), meet AS (SELECT s.a, id FROM sets s JOIN (SELECT a, count(DISTINCT part) k FROM sets GROUP BY 1 HAVING k > 1) n ON n.a = s.a GROUP BY s.a, id, k HAVING count(DISTINCT part) = k),
poor AS (SELECT q a FROM kw WHERE q NOT IN (SELECT a FROM rer WHERE s >= 0.5)),
rask AS (SELECT DISTINCT a, unnest({_t("array_to_string(ks, ' ') || ' ' || content")}) term FROM poor JOIN kw ON kw.q = a JOIN hits USING (a) JOIN cd USING (id) WHERE rnk = 1), {_find_sql("fresh", "rask", "doc", 30)},
newc AS (SELECT a, id FROM (SELECT a, id, row_number() OVER (PARTITION BY a ORDER BY rnk) n FROM fresh WHERE (a, id) NOT IN (SELECT (a, id) FROM pool)) WHERE n <= 20), {_score_sql("news", "newc")},
{_sum_sql("sofar", *_EV)}, top AS (SELECT a, id FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) n, count(*) OVER (PARTITION BY a) k FROM sofar WHERE a NOT IN (SELECT a FROM poor)) WHERE n <= 20 AND k > 1), {_score_sql("tops", "top")},
{_sum_sql("total", *_EV, "fresh|sim * 0.5", "news|s * 1.0", "tops|s * 1.0")}
SELECT * FROM (SELECT a q, id, score, branches, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS "rank" FROM total) WHERE "rank" <= 20"""


@query
def extract_first_search(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best tickets for each eval question by similarity and by what is next to the best; relations as in service_search."""
    rec = graph.Records.of(*_tables(spark, d))
    label = F.when(F.col("owner_id").startswith("ticket:"), "Ticket").otherwise("Document")
    cards, _ = cut(rec.cards().where("idx = 0 AND (owner_id LIKE 'ticket:%' OR owner_id LIKE 'doc:%')").select(F.col("owner_id").alias("id"), label.alias("label"), F.col("content").alias("text")))
    q, _ = cut(_eval_questions(spark, d).withColumn("answer", F.lit("Ticket")))
    rels = q.select("q", F.explode(F.array(F.lit("BLOCKS"), F.lit("REFERENCES"))).alias("rel"))
    got = search.extract_first(q, rels, cards, _edges(spark, d, ("BLOCKS", "REFERENCES")), search.text_find(cards), search.overlap_score(cards, q))
    return search.ranked(got, 20)


SQL["extract_first_search"] = f"""{_G}, {_CARDS}, {_KW}, cd AS (SELECT owner_id id, content FROM chunks WHERE idx = 0 AND (owner_id LIKE 'ticket:%' OR owner_id LIKE 'doc:%')),
tok AS (SELECT id, {_t("content")} ts FROM cd), st AS (SELECT count(*) FILTER (len(ts) > 0) n, sum(len(ts)) / count(*) FILTER (len(ts) > 0) av FROM tok), post AS (SELECT id, term, count(*) tf, dl FROM (SELECT id, len(ts) dl, unnest(ts) term FROM tok) GROUP BY id, term, dl), df AS (SELECT term, count(*) df FROM post GROUP BY 1),
s3 AS (SELECT src id, rel, dst AS nxt FROM edges WHERE rel IN ('BLOCKS', 'REFERENCES') UNION SELECT dst, rel, src FROM edges WHERE rel IN ('BLOCKS', 'REFERENCES')),
ask AS (SELECT DISTINCT item_id a, unnest({_t("question")}) term FROM eval_items), {_find_sql("hits", "ask", "ticket", 60)},
fresh AS (SELECT DISTINCT a, nxt AS id FROM (SELECT *, row_number() OVER (PARTITION BY a, rel ORDER BY id, nxt) m FROM (SELECT DISTINCT a, rel, hits.id, nxt FROM hits JOIN s3 ON s3.id = hits.id WHERE rnk <= 10)) WHERE m <= 80 AND (a, nxt) NOT IN (SELECT (a, id) FROM hits) AND nxt IN (SELECT id FROM cd)),
few AS (SELECT a, id FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY id) n FROM fresh) WHERE n <= 200), {_score_sql("rk", "few")}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, id) n FROM rk) WHERE n <= 40 AND id LIKE 'ticket:%'),
{_sum_sql("total", "hits|sim * 1.0", "best|s * 0.9")}
SELECT * FROM (SELECT a q, id, score, branches, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS "rank" FROM total) WHERE "rank" <= 20"""


@query
def embedded_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 5 pages most like each asked title by the stand-in embeddings, which are kept and read again."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("title").alias("text"))
    v = search.embeddings(docs, search.hashed(), new_path(spark), "hashed", 256)
    return search.vector_topk(v, v.where("id % 50 = 0").select(F.col("id").alias("q"), "embedding"), 5)


SQL["embedded_topk"] = f"""WITH e AS (SELECT id, b, count(*)::DOUBLE c FROM (SELECT doc_id id, ('0x' || substr(md5(t), 1, 7))::BIGINT % 256 b FROM (SELECT doc_id, unnest({_t("title")}) t FROM documents)) GROUP BY ALL), n AS (SELECT id, sqrt(sum(c * c)) n FROM e GROUP BY 1),
s AS (SELECT x.id q, y.id id, sum(x.c * y.c) d FROM e x JOIN e y ON x.b = y.b AND x.id <> y.id WHERE x.id % 50 = 0 GROUP BY ALL), v AS (SELECT a.id q, b.id, round(coalesce(d, 0) / a.n / b.n, 4) score FROM n a JOIN n b ON a.id <> b.id LEFT JOIN s ON s.q = a.id AND s.id = b.id WHERE a.id % 50 = 0)
SELECT * FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS "rank" FROM v) WHERE "rank" <= 5"""


def _mcq(spark: SparkSession, d: str) -> DataFrame:
    """Eval items, answered by the stub from the best page for their question."""
    items = table(spark, d, "eval_items")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    best = search.ranked(search.bm25(docs, items.select(F.col("item_id").alias("q"), F.col("question").alias("text"))), 1)
    ctx = best.join(docs, "id").select("q", F.col("text").alias("context"))
    rows = items.select(F.col("item_id").alias("q"), "choices", "answer_idx", "lang", F.col("closedbook_correct").alias("closedbook")).join(ctx, "q", "left")
    return rows.select("q", "lang", "closedbook").join(metrics.overlap_answers(rows.select("q", "context", "choices", "answer_idx")), "q")


_MCQ = f"""ask AS (SELECT DISTINCT item_id q, unnest({_t("question")}) term FROM eval_items), tok AS (SELECT doc_id id, {_t("text")} ts FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) FILTER (len(ts) > 0) n, sum(len(ts)) / count(*) FILTER (len(ts) > 0) av FROM tok),
post AS (SELECT id, term, count(*) tf, dl FROM (SELECT id, len(ts) dl, unnest(ts) term FROM tok) WHERE term IN (SELECT term FROM ask) GROUP BY id, term, dl), df AS (SELECT term, count(*) df FROM post GROUP BY 1),
bm AS (SELECT q, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 4) score FROM post JOIN df USING (term) JOIN ask USING (term), st GROUP BY q, id),
best AS (SELECT q, max_by(id, struct_pack(s := score, i := -id)) id FROM bm GROUP BY q),
sc AS (SELECT item_id q, lang, closedbook_correct cb, answer_idx, coalesce(len(ts), 0) n, list_transform(choices, lambda x: len(list_intersect(list_distinct({_t("x")}), coalesce(ts, [])))) s FROM eval_items LEFT JOIN best ON item_id = q LEFT JOIN tok ON tok.id = best.id),
mc AS (SELECT q, lang, cb, CASE WHEN n > 0 AND len(s) > 0 THEN list_position(s, list_max(s))::INT - 1 END chosen, coalesce(chosen = answer_idx, false) correct FROM sc)"""


@query
def stub_answerer(spark: SparkSession, d: str) -> DataFrame:
    return _mcq(spark, d).select("q", "chosen", "correct")


SQL["stub_answerer"] = f"WITH {_MCQ} SELECT q, chosen, correct FROM mc"


@query
def mcq_adjusted_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.adjusted_accuracy(_mcq(spark, d), ["lang"])


SQL["mcq_adjusted_accuracy"] = f"WITH {_MCQ} SELECT lang, count(*) items, round(avg(correct::INT), 6) open, round(avg(cb::INT), 6) closed, round(avg(correct::INT - cb::INT), 6) adjusted FROM mc GROUP BY 1"


@query
def choices_rendered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", text.choices_text(F.col("choices")).alias("rendered"))


SQL["choices_rendered"] = "SELECT item_id, array_to_string(list_transform(choices, lambda x, i: chr((64 + i)::INT) || ') ' || x), chr(10)) rendered FROM eval_items"


# Table analytics: events stand in for the steps of runs, one run per user.


@query
def pareto_skyline(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no other part beats in size (more) and price (less)."""
    return select.skyline(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size"], ["p_retailprice"])


SQL["pareto_skyline"] = "SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))"


@query
def running_best(spark: SparkSession, d: str) -> DataFrame:
    return select.running_best(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


SQL["running_best"] = "SELECT *, coalesce(value > coalesce(max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE), NULL) improved FROM (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) best FROM events)"


@query
def stale_islands(spark: SparkSession, d: str) -> DataFrame:
    """For each user, how many events in a row were no purchase."""
    return select.streaks(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "purchase")


SQL["stale_islands"] = "SELECT user_id, event_id, event_type, (count(*) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) - (CASE WHEN g > 0 THEN 1 ELSE 0 END))::BIGINT stale FROM (SELECT user_id, event_id, event_type, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) g FROM events)"


@query
def step_delta(spark: SparkSession, d: str) -> DataFrame:
    return select.deltas(table(spark, d, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents")), "user_id", "event_id", "cents")


SQL["step_delta"] = "SELECT *, cents - coalesce(lag(cents) OVER (PARTITION BY user_id ORDER BY event_id), 0) delta FROM (SELECT user_id, event_id, round(value * 100)::BIGINT cents FROM events)"


@query
def sole_best_counts(spark: SparkSession, d: str) -> DataFrame:
    """On how many parts each supplier alone has the largest line price."""
    rows = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("price"))
    return select.unique_best(rows, "l_partkey", "l_suppkey", "price")


SQL["sole_best_counts"] = "WITH r AS (SELECT l_partkey, l_suppkey, max(l_extendedprice) price FROM lineitem GROUP BY ALL), w AS (SELECT l_partkey, min(l_suppkey) l_suppkey FROM r WHERE price > 0 AND price = (SELECT max(price) FROM r x WHERE x.l_partkey = r.l_partkey) GROUP BY 1 HAVING count(*) = 1) SELECT l_suppkey, count(*) wins FROM w GROUP BY 1"


@query
def split_partition(spark: SparkSession, d: str) -> DataFrame:
    """Orders dealt into train, gate and test by an arithmetic hash of their key, counted."""
    s = select.split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", {"gate": 100, "test": 200}, 17)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


SQL["split_partition"] = "SELECT CASE WHEN h < 100 THEN 'gate' WHEN h < 300 THEN 'test' ELSE 'rest' END split, count(*) n, sum(o_orderkey)::BIGINT key_sum FROM (SELECT o_orderkey, ((o_orderkey * 7919 + 17) % 100003) * 31 % 1000 h FROM orders) GROUP BY 1"


@query
def usage_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Running totals of events and value by type and month."""
    e = table(spark, d, "events").select("event_type", F.date_format("ts", "yyyy-MM").alias("month"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    per = e.groupBy("event_type", "month").agg(F.count(F.lit(1)).alias("requests"), F.sum("cents").alias("cents"))
    w = F.sum("cents").over(select.Window.partitionBy("event_type").orderBy("month").rowsBetween(select.Window.unboundedPreceding, 0))
    return per.withColumn("total", w)


SQL["usage_by_model"] = "SELECT event_type, month, requests, cents, (sum(cents) OVER (PARTITION BY event_type ORDER BY month ROWS UNBOUNDED PRECEDING))::BIGINT total FROM (SELECT event_type, strftime(ts, '%Y-%m') \"month\", count(*) requests, sum(round(value * 100)::BIGINT)::BIGINT cents FROM events GROUP BY ALL)"


@query
def rollup_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's last order, or none."""
    last = select.last_per(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate"), ["c_custkey"], ["o_orderdate", "o_orderkey"])
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(last, "c_custkey", "left")


SQL["rollup_left_join"] = "SELECT c_custkey, c_mktsegment, o_orderkey, o_orderdate FROM customer LEFT JOIN (SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) n FROM orders) WHERE n = 1) ON c_custkey = o_custkey"


@query
def tournament_pairs(spark: SparkSession, d: str) -> DataFrame:
    return select.pairs_in_order(table(spark, d, "customer").select("c_nationkey", "c_acctbal", "c_custkey"), "c_nationkey", "c_custkey", "c_custkey")


SQL["tournament_pairs"] = "SELECT c_nationkey, n // 2 pair, min(c_custkey) a, CASE WHEN count(*) > 1 THEN max(c_custkey) END b FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 n FROM customer) GROUP BY ALL"


@query
def lineage_edges(spark: SparkSession, d: str) -> DataFrame:
    """From state to state: how often a user's event of one type was followed by one of another."""
    e = select.followed(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", "parent")
    return e.where("parent IS NOT NULL").groupBy("parent", F.col("event_type").alias("child")).agg(F.count(F.lit(1)).alias("n"))


SQL["lineage_edges"] = "SELECT parent, event_type child, count(*) n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) parent FROM events) WHERE parent IS NOT NULL GROUP BY ALL"


@query
def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per kind and property of the raw records: rows that have it, and rows whose text holds its value."""
    r = table(spark, d, "raw_records").select("kind", "text", F.explode("props").alias("key", "value"))
    return r.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("have"), F.count_if(F.contains("text", "value")).alias("reflected"))


SQL["field_coverage"] = "SELECT kind, e.key AS key, count(*) have, count(*) FILTER (contains(text, e.value)) reflected FROM (SELECT kind, text, unnest(map_entries(props)) e FROM raw_records) GROUP BY ALL"


@query
def raw_record_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links of the latest raw records by kind and relation, and how many point to records of the table."""
    r = latest(table(spark, d, "raw_records"), ["id"], "loaded_at", ["kind", "refs"])
    e = r.select("kind", "id", F.explode("refs").alias("r")).select("kind", "r.rel", F.col("r.targetId").alias("target"), "id").distinct()
    j = e.join(r.select(F.col("id").alias("target"), F.lit(True).alias("found")), "target", "left")
    return j.groupBy("kind", "rel").agg(F.count(F.lit(1)).alias("links"), F.count("found").alias("resolved"))


SQL["raw_record_edges"] = "WITH r AS (SELECT id, max_by(struct_pack(kind := kind, refs := refs), loaded_at) v FROM raw_records GROUP BY id), e AS (SELECT DISTINCT kind, id, x.rel rel, x.targetId target FROM (SELECT id, v.kind kind, unnest(v.refs) x FROM r)) SELECT kind, rel, count(*) links, count(*) FILTER (target IN (SELECT id FROM r)) resolved FROM e GROUP BY ALL"
