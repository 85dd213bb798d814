import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import chunks, graph, metrics, mutate, search, select
from loomgraph.plans import schema

EDGE = "src string, rel string, dst string"


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture()
def said(spark):
    cards = spark.createDataFrame([("ticket:PR-1", 0), ("ticket:PR-1", 1), ("doc:x", 0), ("msg:eng:1", 1)], "owner_id string, idx int")
    texts = spark.createDataFrame(
        [("ticket:PR-1", "Ada Lovelace (@new-one) broke search-index; see PR-1, PR-2, QR-9 and https://x.org/a?b"), ("doc:x", "Search index and search-index-design"), ("msg:eng:1", "search-index"), ("msg:eng:2", None)], "id string, text string"
    )
    vocab = chunks.vocabulary(spark.createDataFrame([("person:ada",), ("component:search-index",)], "id string"), spark.createDataFrame([("ada", "Ada Lovelace"), ("bob", "Bob")], "handle string, name string"))
    tickets = spark.createDataFrame([("ticket:PR-1", 1), ("ticket:PR-2", 1)], "id string, clash int")
    return cards, chunks.mentions(texts, vocab, cards, tickets)


def test_mentions_hang_off_the_card(said):
    assert rows(said[1].select("src", "dst")) == {("ticket:PR-1#c0", x) for x in ("person:ada", "person:new-one", "component:search-index", "ticket:PR-2", "entity:https-x-org-a-b")}


def test_graph_with_chunks_and_its_checks(spark, said):
    cards, m = said
    nodes = spark.createDataFrame([("ticket:PR-1", "Ticket"), ("ticket:PR-2", "Ticket"), ("doc:x", "Document"), ("msg:eng:1", "Message"), ("person:ada", "Person"), ("component:search-index", "Component")], "id string, label string")
    n, e = chunks.with_chunks(nodes, spark.createDataFrame([], EDGE), cards, m)
    assert rows(n.where("label IN ('Person', 'Entity')")) == {("person:ada", "Person"), ("person:new-one", "Person"), ("entity:https-x-org-a-b", "Entity")}
    assert rows(chunks.build_errors(nodes.where("label <> 'Person' AND label <> 'Component'"), nodes.where("id <> 'doc:x'"), e)) == {("doc:x", "no node"), ("ticket:PR-2", "no chunk")}
    assert chunks.orphan_chunks(n, e).count() == 0
    assert rows(chunks.orphan_chunks(n, e.where("src <> 'doc:x'"))) == {("doc:x#c0",)}
    assert rows(chunks.provenance(e, n.where("label = 'Component'"))) == {("component:search-index", "ticket:PR-1#c0", "ticket:PR-1")}
    rel = chunks.extracted(m)
    assert rel.first().sources == ["ticket:PR-1"] and mutate.strip_sources(rel, nodes.where("id = 'ticket:PR-1'")).count() == 0
    n2, e2 = mutate.cascade_delete(n, e, spark.createDataFrame([("ticket:PR-1",)], "id string"), ("HAS_CHUNK",), ("MENTIONS",), ("Entity",))
    assert {r.id for r in n2.collect()} == {"ticket:PR-2", "doc:x", "msg:eng:1", "person:ada", "person:new-one", "component:search-index", "doc:x#c0", "msg:eng:1#c1"}
    with pytest.raises(ValueError):
        mutate.cascade_delete(n, e, spark.createDataFrame([("ticket:none",)], "id string"), ("HAS_CHUNK",), ("MENTIONS",))


def test_owned_closure_is_deep_and_ends_on_circles(spark):
    e = spark.createDataFrame([("chat", "HAS", "m1"), ("m1", "HAS", "a1"), ("a1", "HAS", "m1"), ("m1", "SEES", "x")], EDGE)
    assert rows(mutate.owned(e, spark.createDataFrame([("chat",)], "id string"), ("HAS",))) == {("chat",), ("m1",), ("a1",)}


def test_nested_records(spark):
    e = spark.createDataFrame([("a", "R", "b"), ("a", "R", "c"), ("b", "R", "a"), ("b", "R", "d"), ("z", "R", "z")], EDGE)
    got = graph.nest(spark.createDataFrame([("a",), ("z",), ("q",)], "id string"), e, ("R", "R")).select("id", F.to_json("kids").alias("k"))
    assert {r.id: json.loads(r.k) for r in got.collect()} == {"a": [{"id": "b", "kids": ["d"]}, {"id": "c", "kids": []}], "z": [], "q": []}


def test_types_and_edge_properties(spark):
    r = spark.createDataFrame([("m", "Message", {"ts": "2025-01-02T03:04:05Z", "seq": "1"}), ("n", "Message", {"ts": "yesterday", "seq": "x1"}), ("o", "Other", {"seq": "x"}), ("p", "Message", None)], "id string, label string, props map<string,string>")
    assert rows(schema.wrong_types(r)) == {("n", "ts", "timestamp", "yesterday"), ("n", "seq", "integer", "x1")}
    e = spark.createDataFrame([("a", "R", "b", 0, "x"), ("a", "R", "c", None, " ")], EDGE + ", index int, name string")
    assert rows(schema.edge_violations(e, ("index", "name"))) == {("a", "R", "c", "index"), ("a", "R", "c", "name")}


def test_text_helpers(spark):
    df = spark.createDataFrame([("```json\n{\"a\": {\"b\": 1}}\n``` bye",), ("no object",), ("x {\"k\": 2} y",), (None,)], "t string")
    assert [r[0] for r in df.select(text.json_span(F.col("t"))).collect()] == ['{"a": {"b": 1}}', "{}", '{"k": 2}', "{}"]
    words = [("team", "T"), ("metric", "M"), ("tea", "X")]
    d = spark.createDataFrame([("a Metric of a team",), ("teams",), ("none",), (None,)], "t string")
    assert [r[0] for r in d.select(text.earliest(F.col("t"), words)).collect()] == ["M", "T", None, None]
    assert [r[0] for r in d.select(text.first_matches(F.col("t"), words, 2)).collect()] == [["T", "M"], ["T", "X"], [], []]
    assert [r[0] for r in d.select(text.preview(F.col("t"), 4)).collect()] == ["a Me…", "team…", "none", None]


def test_logs_predictions_and_reflection(spark):
    log = spark.createDataFrame([("k1", 1, "a"), ("k2", 2, "b"), ("k1", 3, "c")], "key string, step int, note string")
    assert [tuple(r) for r in select.recent(log, "key", "step", 1).collect()] == [("k1", 3, "c")]
    p = spark.createDataFrame([("q", "7", "0.5"), ("q", "x", "1"), ("q", "8", "nan"), ("q", None, None)], "q string, id string, score string")
    assert [(r.id, r.error) for r in metrics.checked_predictions(p).collect()] == [(7, None), (None, "id"), (8, "score"), (None, "id")]
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "q int, text string")
    assert rows(metrics.reattached(a, spark.createDataFrame([("x", 9)], "text string, n int")).select("q", "n", "error")) == {(1, 9, False), (2, 9, False), (3, None, True), (4, None, True)}
    ranking = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 30), ("r", 5, 1)], "q string, id int, rank int")
    gold = spark.createDataFrame([("q", 2), ("q", 3), ("q", 9), ("r", 5)], "q string, id int")
    assert [tuple(r) for r in metrics.reflection(ranking, gold).collect()] == [("q", [3, 9], [1], [2, 30])]
    per = spark.createDataFrame([("a", 0.5, 0.0, 0.1), ("b", 0.0, 0.0, 0.0), ("c", 1.0, 0.0, 0.5), ("d", 1.0, 1.0, 1.0)], "q string, recall_20 double, hit_1 double, mrr double")
    assert rows(metrics.worst_first(per, 2)) == {("missed", 1, "b"), ("misranked", 1, "c"), ("won", 1, "d")}


def test_distractors(spark):
    items = spark.createDataFrame([(f"i{k}", a) for k, a in enumerate(["x", "y", "z", "y", "w", None])], "item_id string, answer string")
    got = {r.item_id: r for r in select.distractors(items, 2).collect()}
    assert set(got) == {"i0", "i1", "i2", "i3", "i4"}
    for k, a in enumerate(["x", "y", "z", "y", "w"]):
        r = got[f"i{k}"]
        assert r.options[r.answer_idx] == a and r.options[-1] == "CANNOT_DETERMINE" and len(set(r.options)) == 4
    alone = select.distractors(items.where("answer = 'x'"), 2).first()
    assert alone.options == ["x", "CANNOT_DETERMINE"] and alone.answer_idx == 0


def test_answer_and_embeddings(spark, tmp_path):
    q = spark.createDataFrame([("q1", "What about alpha beta?"), ("q2", "of the"), ("q3", "zzz nothing")], "q string, text string")
    c = spark.createDataFrame([("a", 0, "alpha beta"), ("a", 1, "more of it"), ("b", 0, "gamma delta"), ("c", 0, "other")], "owner_id string, idx int, content string")
    e = spark.createDataFrame([("a", "REFERENCES", "b")], EDGE)
    got = {r.q: r for r in search.answer(q, c, e).collect()}
    assert (got["q1"].context, got["q1"].citations, got["q1"].nodes) == ("alpha beta\nmore of it\ngamma delta", "[a] [b]", 2)
    assert got["q2"].context == got["q3"].context == "" and got["q3"].nodes == 0
    more = search.answer(q, c, e, expand=lambda w: w.where("q = 'q3'").select("q", F.lit("other").alias("more")))
    assert {r.q: r.citations for r in more.collect()}["q3"] == "[c]"
    t = spark.createDataFrame([(1, "a b"), (2, None), (3, "..."), (4, "b")], "id bigint, text string")
    for _ in range(2):
        v = search.embeddings(t, search.hashed(8), str(tmp_path), "hashed", 8)
        assert sorted(r.id for r in v.collect()) == [1, 4]
