"""What grows with questions times records isn't made, moved or kept."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import graph_queries, search_queries
from loomgraph.operators import agentic, graph, search

AT = datetime(2025, 1, 1)
TICKET = "key string, title string, description string, status string, assignee string, reporter string, components array<string>, references array<string>, blocks array<string>, ingested_at timestamp_ntz"
PR = "repo string, number bigint, title string, description string, state string, author string, reviewers array<string>, fixes array<string>, components array<string>, references array<string>, ingested_at timestamp_ntz"
CHAT = "seq bigint, channel string, author string, ts string, text string, reply_to bigint, references array<string>, arrived_at timestamp_ntz"
DOC = "doc_id bigint, text string, stem string, title string, author string, components array<string>, ingested_at timestamp_ntz"


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    """Pages 50 and 100 ask; page 3 names both words of the first title."""
    at = tmp_path_factory.mktemp("records")
    text = {50: "nothing", 100: "gamma", 3: "alpha beta", 4: "alpha", 5: "beta beta"}
    title = {50: "alpha beta", 100: "gamma", 3: "alpha beta", 4: "other", 5: None}
    docs = [(i, text[i], f"p{i}", title[i], None, ["c"], AT) for i in text]
    spark.createDataFrame(docs, DOC).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(f"T-{i}", None, None, None, None, None, ["c"], [], [], AT) for i in range(1, 101)], TICKET).write.parquet(f"{at}/tickets.parquet")
    spark.createDataFrame([], PR).write.parquet(f"{at}/github_prs.parquet")
    spark.createDataFrame([], CHAT).write.parquet(f"{at}/chat.parquet")
    return str(at)


@pytest.fixture
def no_pairs(monkeypatch):
    def made(*_, **__):
        raise AssertionError("all pairs of question and text are made")

    monkeypatch.setattr(search, "bm25", made)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_hubs_neighbours_are_not_listed_for_each_question(spark, monkeypatch):
    """agentic_loop_stub: of a hub's 3,000 neighbours a question takes 5 that it hasn't seen."""
    ids = spark.range(3000).select(F.format_string("t%04d", "id").alias("src"), F.lit("ABOUT").alias("rel"), F.lit("hub").alias("dst"))
    moved = []
    cut = agentic.cut
    monkeypatch.setattr(agentic, "cut", lambda df: (moved.append(df), cut(df))[1])
    start = spark.createDataFrame([(f"t{i:04}", f"t{i:04}") for i in range(0, 3000, 50)], "q string, id string")
    got = rows(agentic.explore(start, ids, lambda seen: seen.where("false").select("q").distinct(), steps=2))
    assert [r for r in got if r[0] == "t0000"] == [("t0000", "hub", 1), ("t0000", "t0000", 0), *[("t0000", f"t{i:04}", 2) for i in range(1, 6)]]
    assert "row_number() windowspecdefinition(id#" in moved[-1]._jdf.queryExecution().analyzed().toString()


def test_what_a_walk_reaches_is_not_moved(spark):
    """inspector_neighbours: after the first step only edges are dealt, the pairs of question and node stay in their task."""
    edges = spark.range(200).select(F.format_string("t%03d", "id").alias("src"), F.lit("ABOUT").alias("rel"), F.concat(F.lit("c"), F.col("id") % 3).alias("dst"))
    start = spark.createDataFrame([("t000", "t000"), ("t001", "t001")], "q string, id string")
    got = graph.walk(start, edges, 2, None)
    assert {(r.q, r.id, r.hops) for r in got.where("hops > 0").collect()} == {(f"t00{k}", f"c{k}", 1) for k in (0, 1)} | {(f"t00{k}", f"t{i:03}", 2) for k in (0, 1) for i in range(200) if i % 3 == k and i != k}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(q#" not in plan and "hashpartitioning(to#" in plan


@pytest.mark.parametrize("itself", [True, False])
@pytest.mark.parametrize("rows_at_a_time", [16384, 3])
def test_best_texts_are_those_of_all_pairs(spark, monkeypatch, itself, rows_at_a_time):
    """bm25_topk against bm25: equal questions, ties, empty and null texts, blocks of a few rows."""
    monkeypatch.setattr(search, "ASKED", 4)
    monkeypatch.setattr(search, "ROWS", rows_at_a_time)
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(r.choice(words, r.integers(1, 9)))) for i in range(300)] + [(300, None), (301, "")]
    asked = [(i, " ".join(r.choice([*words, "none"], r.integers(1, 4)))) for i in range(0, 300, 15)] + [(900, "w1 w2"), (901, "W2 w1 w1"), (902, None)]
    t, q = spark.createDataFrame(texts, "id bigint, text string"), spark.createDataFrame(asked, "q bigint, text string")
    pairs = search.bm25(t, q)
    want = search.ranked(pairs if itself else pairs.where("q <> id"), 6).select("q", "id", "score", "rank")
    assert rows(search.bm25_topk(t, q, 6, itself)) == rows(want)


def test_scores_of_texts_of_one_id_are_added(spark):
    """As in the SQL, which counts terms by id and length."""
    q = spark.createDataFrame([(1, "w1 w2")], "q bigint, text string")
    of = lambda ids: {r.id: r.score for r in search.bm25_topk(spark.createDataFrame(list(zip(ids, ("w1 x", "w1 w2 w2", "w2"))), "id bigint, text string"), q, 5).collect()}
    apart, one = of([7, 8, 9]), of([7, 7, 9])
    assert one == {7: pytest.approx(apart[7] + apart[8], abs=1e-4), 9: apart[9]}


def test_bm25_seed_topk_makes_no_pairs(spark, records, no_pairs):
    got = search_queries.bm25_seed_topk(spark, records).orderBy("q", "rank").collect()
    assert [(r.q, r.id) for r in got] == [(50, 3), (50, 5), (50, 4), (100, 100)]


def test_recall_hit_mrr_makes_no_pairs(spark, records, no_pairs):
    assert rows(search_queries.recall_hit_mrr(spark, records)) == [(50, 0.5, 0.5, 1.0, 1.0, 1.0), (100, 1.0, 1.0, 1.0, 1.0, 1.0)]


def test_failure_mix_makes_no_pairs(spark, records, no_pairs):
    assert rows(search_queries.failure_mix(spark, records)) == [("FOUND", 1), ("GENERATION", 1)]


def test_metric_summary_makes_no_pairs(spark, records, no_pairs):
    assert rows(search_queries.metric_summary(spark, records)) == [(2, 0.75, 0.75, 1.0, 1.0, 1.0)]


def test_reflection_records_makes_no_pairs(spark, records, no_pairs):
    assert rows(search_queries.reflection_records(spark, records)) == [(50, "50", "5,4", "1")]


def test_gold_ranks_makes_no_pairs(spark, records, no_pairs):
    assert [r[:3] for r in rows(search_queries.gold_ranks(spark, records))] == [(50, 3, 1), (100, 100, 1)]


def test_owner_of_chunks_makes_no_pairs(spark, records, no_pairs):
    assert rows(search_queries.owner_of_chunks(spark, records)) == [(50, "doc:p3", 1), (50, "doc:p50", 3), (100, "doc:p100", 1)]


def test_context_assembly_budget_makes_no_pairs(spark, records, no_pairs):
    assert rows(search_queries.context_assembly_budget(spark, records)) == [(50, "alpha beta\nalpha beta\nalpha beta\nnothing", "[doc:p3] [doc:p50]"), (100, "gamma\ngamma", "[doc:p100]")]


def test_citations_makes_no_pairs(spark, records, no_pairs):
    assert rows(search_queries.citations(spark, records)) == [("doc:p100", 1), ("doc:p3", 1), ("doc:p50", 1)]


def test_retrieval_hit_all_gold_makes_no_pairs(spark, records, no_pairs):
    assert rows(search_queries.retrieval_hit_all_gold(spark, records)) == [(50, True), (100, True)]


def test_goals_are_met_from_both_sides(spark):
    """miss_attribution: within two steps as by a walk, without listing what a shared component leads to."""
    edges = spark.createDataFrame([("a", "ABOUT", "c"), ("b", "ABOUT", "c"), ("b", "REFERENCES", "d"), ("e", "SENT_BY", "c"), ("a", "REFERENCES", "a")], "src string, rel string, dst string")
    start = spark.createDataFrame([("q", "a"), ("r", "d")], "q string, id string")
    goals = spark.createDataFrame([(q, i) for q in "qrs" for i in "abcdez"], "q string, id string")
    rels = ("REFERENCES", "ABOUT")
    walked = graph.walk(start, edges, 2, rels).select("q", "id").join(goals, ["q", "id"])
    assert rows(graph.met(start, goals, edges, rels)) == rows(walked) == [("q", "a"), ("q", "b"), ("q", "c"), ("r", "b"), ("r", "c"), ("r", "d")]


def test_miss_attribution_makes_no_pairs(spark, records, no_pairs):
    assert rows(search_queries.miss_attribution(spark, records)) == [("RANKING", 3)]


def test_vectors_are_kept_by_task_not_by_batch(spark):
    """evidence_union_scores, rrf_fusion: the best as by brute force, and no more than these from each task."""
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 8)).round(1).astype(np.float32)
    v = spark.createDataFrame([(i, [float(a) for a in x[i]]) for i in range(300)], "id bigint, embedding array<float>").coalesce(2).cache()
    asked = v.where("id % 50 = 0").select(F.col("id").alias("q"), "embedding")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert search.vector_scores(v, asked, 5).count() <= 2 * 5 * 6
        got = {(t.q, t.id, t.score) for t in search.vector_topk(v, asked, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = set()
    for q in range(0, 300, 50):
        s = np.round(n @ n[q], 4)
        want |= {(q, i, float(s[i])) for i in sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]}
    assert got == want


def test_rrf_fusion_makes_no_pairs(spark, tmp_path, no_pairs):
    vec = lambda a: [1.0, a] + [0.0] * 62
    e = [(50, "a", "alpha beta", vec(0.0), AT), (1, "a", "alpha", vec(0.1), AT), (2, "a", "none", vec(0.2), AT)]
    spark.createDataFrame(e, "id bigint, ntype string, text string, embedding array<float>, ingested_at timestamp_ntz").write.parquet(f"{tmp_path}/entities.parquet")
    assert rows(search_queries.rrf_fusion(spark, str(tmp_path))) == [(50, 1, round(2 / 61, 6), 1), (50, 2, round(1 / 62, 6), 2)]
