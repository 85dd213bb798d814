import pytest
from pyspark.sql import functions as F

from loomgraph.operators import agentic, graph, metrics, mutate, search, select
from loomgraph.plans import schema

E = [("a", "REFERENCES", "b"), ("b", "REFERENCES", "c"), ("c", "BLOCKS", "d"), ("x", "ABOUT", "c"), ("d", "FIXES", "d")]


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


@pytest.fixture()
def edges(spark):
    return frame(spark, E, "src string, rel string, dst string")


@pytest.fixture()
def start(spark):
    return frame(spark, [("q", "a")], "q string, id string")


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_walk_is_monotone_and_counts_least_hops(edges, start):
    assert rows(graph.walk(start, edges, 1)) == {("q", "a", 0), ("q", "b", 1)}
    assert rows(graph.walk(start, edges, 3)) == {("q", "a", 0), ("q", "b", 1), ("q", "c", 2), ("q", "d", 3)}
    assert rows(graph.walk(start, edges, 99)) >= rows(graph.walk(start, edges, 3))
    assert ("q", "x", 3) in rows(graph.walk(start, edges, 3, None))
    assert rows(graph.first_by_hops(graph.walk(start, edges, 3), 2)) == {("q", "a", 0), ("q", "b", 1)}


def test_neighbours_and_cap(spark, edges):
    s = frame(spark, [("q", "c")], "q string, id string")
    assert rows(graph.neighbours(s, edges, "out")) == {("q", "c", "BLOCKS", "d")}
    assert rows(graph.neighbours(s, edges, "in")) == {("q", "c", "REFERENCES", "b"), ("q", "c", "ABOUT", "x")}
    assert rows(graph.neighbours(s, edges, "both", cap=1)) == {("q", "c", "ABOUT", "x")}


def test_connect_drops_dangling(spark, edges):
    nodes = frame(spark, [("a", "N"), ("b", "N"), ("c", "N")], "id string, label string")
    ok, dangling = graph.connect(edges.union(edges), nodes)
    assert rows(ok) == {("a", "REFERENCES", "b"), ("b", "REFERENCES", "c")} and ok.count() == 2
    assert dangling.count() == 3


def test_reaches_second_hop_in_all(spark, edges, start):
    goals = frame(spark, [("q", "d"), ("q", "zz")], "q string, goal string")
    assert rows(graph.reaches(start, goals, edges, 3)) == {("q", "d", 3), ("q", "zz", None)}
    assert rows(graph.second_hop(start, edges)) == {("q", "c", 1)}
    parts = frame(spark, [("q", "1", "m"), ("q", "2", "m"), ("q", "2", "n"), ("r", "1", "m")], "q string, part string, id string")
    assert rows(graph.in_all(parts)) == {("q", "m")}


def test_gazetteer_needs_word_bounds(spark):
    t = frame(spark, [("1", "this touches Billing only"), ("2", "search-index-design"), ("3", None), ("4", "the search index, again")], "id string, text string")
    v = frame(spark, [("billing", "c:b"), ("search-index", "c:s"), ("search index", "c:t")], "term string, target string")
    assert rows(graph.gazetteer_hits(t, v)) == {("1", "c:b"), ("4", "c:t")}


def test_cascade_delete_keeps_shared_nodes(spark):
    e = frame(spark, [("docA", "HAS_CHUNK", "cA0"), ("cA0", "MENTIONS", "eShared"), ("cA0", "MENTIONS", "eOnlyA"), ("docB", "HAS_CHUNK", "cB0"), ("cB0", "MENTIONS", "eShared"), ("cB0", "MENTIONS", "eOnlyB")], "src string, rel string, dst string")
    n = frame(spark, [(x, "N") for x in ("docA", "cA0", "docB", "cB0", "eShared", "eOnlyA", "eOnlyB", "alone")], "id string, label string")
    n2, e2 = mutate.cascade_delete(n, e, frame(spark, [("docA",)], "id string"), ("HAS_CHUNK",), ("MENTIONS",))
    assert {r.id for r in n2.collect()} == {"docB", "cB0", "eShared", "eOnlyB", "alone"}
    assert e2.count() == 3


def test_upsert_replace_and_sources(spark, edges):
    old, new = frame(spark, [("k", "1", "x"), ("m", "2", None)], "key string, a string, b string"), frame(spark, [("k", None, "y"), ("n", "3", None)], "key string, a string, b string")
    assert rows(mutate.upsert(old, new, "key")) == {("k", "1", "y"), ("m", "2", None), ("n", "3", None)}
    nodes = frame(spark, [(x, "N") for x in "abcdx"], "id string, label string")
    got = mutate.replace_targets(edges, "REFERENCES", frame(spark, [("a", "c"), ("a", "d")], "src string, dst string"), nodes)
    assert {r for r in rows(got) if r[0] == "a"} == {("a", "REFERENCES", "c"), ("a", "REFERENCES", "d")}
    with pytest.raises(ValueError):
        mutate.replace_targets(edges, "REFERENCES", frame(spark, [("a", "nope")], "src string, dst string"), nodes)
    s = frame(spark, [("a", "R", "b", ["d1"]), ("a", "R", "c", ["d1", "d2"])], "src string, rel string, dst string, sources array<string>")
    assert [(r.dst, r.sources) for r in mutate.strip_source(s, "d1").collect()] == [("c", ["d2"])]


def test_schema_violations(spark):
    nodes = frame(spark, [("m1", "Message"), ("m2", "Message"), ("p", "Person"), ("p", "Person"), ("c", "Component")], "id string, label string")
    edges = frame(spark, [("m1", "SENT_BY", "p"), ("m1", "SENT_BY", "c")], "src string, rel string, dst string")
    got = rows(schema.cardinality_violations(schema.CORPUS, nodes, edges))
    assert got == {("m1", "Message", "SENT_BY", "1", 2), ("m2", "Message", "SENT_BY", "1", 0)}
    assert rows(schema.duplicate_ids(nodes)) == {("Person", "p", 2)}
    assert ("m1", "SENT_BY", "c", "Message", "Component") in rows(schema.wrong_ends(schema.CORPUS, nodes, edges))
    assert schema.violations(schema.CORPUS, nodes, edges).count() == 4


def test_bm25_and_context(spark):
    t = frame(spark, [(1, "alpha beta"), (2, "alpha alpha gamma delta"), (3, None), (4, "")], "id bigint, text string")
    q = frame(spark, [(9, "alpha gamma")], "q bigint, text string")
    got = search.ranked(search.bm25(t, q)).collect()
    assert [r.id for r in got] == [2, 1] and got[0].score > got[1].score
    owners = frame(spark, [("q", "o1", 1), ("q", "o2", 2)], "q string, id string, rank int")
    chunks = frame(spark, [("o1", 0, "12345"), ("o2", 1, "xyz"), ("o2", 0, "678")], "owner_id string, idx int, content string")
    ctx = search.contexts(search.context_rows(owners, chunks, 8)).first()
    assert ctx.context == "12345\n67" and ctx.citations == "[o1] [o2]"


def test_vector_topk_ties_by_id(spark):
    v = frame(spark, [(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "y"), (3, [0.0, 1.0], "x"), (4, [3.0, 0.0], "x")], "id bigint, embedding array<float>, g string")
    asked = v.where("id = 4").select(F.col("id").alias("q"), "embedding")
    assert [(r.id, r.score) for r in search.vector_topk(v, asked, 2).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]
    assert {(r.id, r.g) for r in search.vector_topk_by_group(v, asked, "g", 1).collect()} == {(1, "x"), (2, "y")}


def test_metrics(spark):
    ranking = frame(spark, [("q", 1, 1, 0.9), ("q", 2, 2, 0.8), ("q", 3, 30, 0.1)], "q string, id bigint, rank int, score double")
    gold = frame(spark, [("q", 2), ("q", 3), ("r", 5)], "q string, id bigint")
    got = {r.q: r for r in metrics.ranking_metrics(ranking, gold).collect()}
    assert (got["q"].recall_20, got["q"].recall_100, got["q"].hit_1, got["q"].hit_5, got["q"].mrr) == (0.5, 1.0, 0.0, 1.0, 0.5)
    assert got["r"].mrr == 0.0
    items = frame(spark, [("a", "red fox runs", ["blue", "red fox", "fox red"], 1), ("b", None, ["x"], 0)], "q string, context string, choices array<string>, answer_idx int")
    assert rows(metrics.overlap_answers(items)) == {("a", 1, True), ("b", None, False)}
    ctx = frame(spark, [("a", "see ACME report", ["acme"]), ("b", "nope", ["ZZZ"]), ("c", "x", [])], "q string, context string, needles array<string>")
    assert rows(metrics.all_in_context(ctx)) == {("a", True), ("b", False), ("c", False)}


def test_attribution(spark):
    gold = frame(spark, [("q", "absent"), ("q", "got"), ("q", "far"), ("q", "near")], "q string, id string")
    nodes = frame(spark, [("got",), ("far",), ("near",)], "id string")
    f = lambda x: frame(spark, [("q", x)], "q string, id string")
    assert rows(metrics.attribution(gold, f("got"), nodes, f("near"))) == {("q", "absent", "NOT_INGESTED"), ("q", "got", "RANKING"), ("q", "far", "ORPHANED"), ("q", "near", "UNREACHABLE")}


def test_skyline_streaks_pairs(spark):
    r = frame(spark, [(1, 3, 5.0), (2, 3, 4.0), (3, 1, 1.0), (4, 1, 2.0), (5, None, 0.0), (6, 3, 4.0)], "id int, size int, price double")
    assert {x.id for x in select.skyline(r, ["size"], ["price"]).collect()} == {2, 3, 6}
    s = frame(spark, [("u", 1, False), ("u", 2, False), ("u", 3, True), ("u", 4, False)], "u string, n int, ok boolean")
    assert [x.stale for x in select.streaks(s, "u", "n", F.col("ok")).orderBy("n").collect()] == [1, 2, 0, 1]
    p = frame(spark, [("g", i) for i in (1, 2, 3)], "g string, k int")
    assert rows(select.pairs_in_order(p, "g", "k", "k").select("a", "b")) == {(1, 2), (3, None)}


def test_explore_stops_when_enough(edges, start):
    got = rows(agentic.explore(start, edges, lambda seen: seen.where("id = 'b'").select("q").distinct()))
    assert got == {("q", "a", 0), ("q", "b", 1)}
    got = rows(agentic.explore(start, edges, lambda seen: seen.where("false").select("q")))
    assert max(r[2] for r in got) == 3


def test_ordered_windows_by_pages(spark):
    import random

    rnd = random.Random(3)
    data = [(rnd.choice("uvw"), i, rnd.choice([None, 1, 2, 3, 4]), rnd.random() < 0.2) for i in rnd.sample(range(400), 150)]
    df = frame(spark, data, "u string, n bigint, v bigint, ok boolean")
    want: dict = {}
    for u in "uvw":
        best, last, stale = None, None, 0
        for _, n, v, ok in sorted(r for r in data if r[0] == u):
            up = None if v is None else best is None or v > best
            best = v if best is None else best if v is None else max(best, v)
            stale = 0 if ok else stale + 1
            want[u, n], last = (best, up, stale, last), v
    for page in (7, 100, 10_000):
        a = {(r.u, r.n): (r.best, r.improved) for r in select.running_best(df, "u", "n", "v", page).collect()}
        b = {(r.u, r.n): r.stale for r in select.streaks(df, "u", "n", F.col("ok"), page).collect()}
        c = {(r.u, r.n): r.was for r in select.followed(df, "u", "n", "v", "was", page).collect()}
        assert {k: (*a[k], b[k], c[k]) for k in a} == want


def test_skyline_is_merged_over_exchanges(spark, capsys):
    import numpy as np

    x = np.random.default_rng(1).dirichlet(np.ones(3), 4000).round(3)
    pts = frame(spark, [(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double").repartition(6)
    got = select.skyline(pts, ["a", "b"], ["c"])
    best = {i for i, r in enumerate(x) if not ((x[:, 0] >= r[0]) & (x[:, 1] >= r[1]) & (x[:, 2] <= r[2]) & ((x != r).any(1))).any()}
    assert {r.id for r in got.collect()} == best and len(best) > 100
    got.explain()
    assert capsys.readouterr().out.count("RoundRobinPartitioning") + 1 >= 3


def test_sample_is_stable_and_rotates(spark):
    ids = spark.range(1000).withColumnRenamed("id", "k")
    a, b, c = ({r.k for r in select.sample(ids, "k", 50, 7, e).collect()} for e in (0, 0, 1))
    assert a == b and len(a) == 50 and a != c


def test_written_tables_are_cleared(spark):
    import os

    from loomgraph.plans import session

    session.cut(spark.range(3))
    at = session._written[-1].removeprefix("file://")
    assert os.path.isdir(at) and session.clear(spark) >= 1 and not os.path.exists(at)
