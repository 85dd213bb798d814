import json
from datetime import datetime as D

from loomgraph.operators.records import latest, ordinals
from loomgraph.sources import loaders
from loomgraph.streaming import ingest


def test_corpus_of_all_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "Auth Plan.md").write_text("---\ntitle: \"Auth\"\nauthor: Tim\ncomponents: [auth, 'billing']\n---\n\nSee [[Other Page]] and [[Auth Plan]].\n")
    (tmp_path / "docs" / "plain.MD").write_text("no front matter")
    (tmp_path / "chat.json").write_text(json.dumps([{"seq": 2, "channel": "#Eng", "author": "@tim", "text": "hi [[Auth Plan]]", "reply_to": 1}]))
    (tmp_path / "tickets.json").write_text(json.dumps([{"key": "P-1", "title": "T", "blocks": ["ticket:P-2", "P-2"], "references": ["Auth Plan"], "components": None}]))
    (tmp_path / "meetings.json").write_text(json.dumps([{"project": "Big One", "date": "2025-01-02", "title": "M", "attendees": ["a"], "transcript": [{"speaker": "jane-doe", "text": "Hello"}, {"speaker": "tim", "text": "Yes"}]}]))
    rec = {r.id: r for r in loaders.corpus(spark, str(tmp_path)).collect()}
    assert set(rec) == {"doc:auth-plan", "doc:plain", "msg:eng:2", "ticket:P-1", "meeting:big-one:2025-01-02"}
    refs = lambda i: {(r.rel, r.targetId) for r in rec[i].refs}
    assert refs("doc:auth-plan") == {("AUTHORED_BY", "person:tim"), ("ABOUT", "component:auth"), ("ABOUT", "component:billing"), ("REFERENCES", "doc:other-page")}
    assert rec["doc:auth-plan"].props["title"] == "Auth" and rec["doc:plain"].body == "no front matter"
    assert refs("msg:eng:2") == {("SENT_BY", "person:tim"), ("REPLY_TO", "msg:eng:1"), ("REFERENCES", "doc:auth-plan")}
    assert refs("ticket:P-1") == {("REFERENCES", "doc:auth-plan"), ("BLOCKS", "ticket:P-2")}
    assert rec["meeting:big-one:2025-01-02"].body == "Jane Doe: Hello\n\nTim: Yes"
    assert ("ABOUT", "component:big-one") in refs("meeting:big-one:2025-01-02")


def test_snapshot_round_trip_and_vocabulary(spark, tmp_path):
    n = spark.createDataFrame([("a", "X"), ("b", "Y")], "id string, label string")
    e = spark.createDataFrame([("a", "R", "b")], "src string, rel string, dst string")
    loaders.write_snapshot(n, e, str(tmp_path / "g"))
    n2, e2 = loaders.read_snapshot(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in loaders.report(n2, e2).collect()} == {("nodes", "X", 1), ("nodes", "Y", 1), ("edges", "R", 1)}
    base, more = (spark.createDataFrame(x, "slug string, name string") for x in ([("a", "A")], [("a", "Z"), ("b", "B"), ("b", "C")]))
    assert {tuple(r) for r in loaders.vocabulary(base, more, "slug").collect()} == {("a", "A"), ("b", "B")}


def test_latest_and_ordinals(spark):
    t = spark.createDataFrame([("k", 1, D(2025, 1, 1)), ("k", 2, D(2025, 1, 2)), ("k", 3, None), (None, 4, D(2025, 1, 1))], "key string, v int, at timestamp_ntz")
    assert [tuple(r) for r in latest(t, ["key"], "at", ["v"], "arrival").collect()] == [("k", 2, D(2025, 1, 1))]
    o = spark.createDataFrame([("g", i * 3) for i in range(50)], "g string, n bigint")
    assert [r.turn for r in ordinals(o, ["g"], "n", page=10).orderBy("n").collect()] == list(range(1, 51))


def test_stream_folds_deliveries_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    kind = "key string, v int, at timestamp_ntz"
    write = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
    write([("a", 1, D(2025, 1, 1)), ("b", 1, D(2025, 1, 1))])
    run = lambda: ingest.fold_batches(spark.readStream.schema(kind).parquet(src), ["key"], "at", out, ck).awaitTermination()
    run()
    write([("a", 2, D(2025, 1, 2)), ("a", 2, D(2025, 1, 2)), ("b", 0, D(2024, 1, 1))])
    run()
    run()
    assert {(r.key, r.v) for r in ingest.current(spark, out).collect()} == {("a", 2), ("b", 1)}
    was = ingest._manifest(spark, out)
    write([("c", 5, D(2025, 1, 3)), (None, 6, D(2025, 1, 3))])
    run()
    assert {(r.key, r.v) for r in ingest.current(spark, out).collect()} == {("a", 2), ("b", 1), ("c", 5)}
    new = ingest._manifest(spark, out)
    assert sum(was.get(b) != v for b, v in new.items()) == 1  # the other parts stay as they are
    ev = spark.createDataFrame([(D(2025, 1, 1, 0, 5), "x"), (D(2025, 1, 1, 0, 50), "x"), (D(2025, 1, 1, 1, 1), "x")], "ts timestamp, kind string")
    assert sorted(r.n for r in ingest.windowed_counts(ev, "ts", "kind").collect()) == [1, 2]


def test_log_with_torn_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"step": 1, "sha": "a"}\n\n{"step": 2, "sh\n{"step": 3, "sha": "b"}\n')
    assert {tuple(r) for r in loaders.read_log(spark, str(tmp_path / "log.jsonl"), "step int, sha string").collect()} == {(1, "a"), (3, "b")}
    (tmp_path / "chat.json").write_text('{"seq": 1, "channel": "x"}\n{"seq": 2, "channel": "x"}\n')
    assert loaders.read_json(spark, str(tmp_path / "chat.json"), "chat", lines=True).count() == 2
