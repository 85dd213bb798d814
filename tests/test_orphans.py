from datetime import datetime as D

from loomgraph.operators.orphans import orphan_counts, orphan_references

T = "key string, references array<string>, blocks array<string>, ingested_at timestamp_ntz, deleted_at timestamp_ntz, arrival string, _row int"
P = "repo string, number bigint, fixes array<string>, ingested_at timestamp_ntz"
DOC = "stem string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"


def run(spark, t, p, d):
    out = orphan_references(spark.createDataFrame(t, T), spark.createDataFrame(p, P), spark.createDataFrame(d, DOC))
    return sorted(tuple(r) for r in out.collect())


def day(n):
    return D(2025, 1, n)


def test_missing_deleted_late_and_sound(spark):
    t = [
        ("A-1", ["doc:Page One", " gone page", "late", None, " "], ["ticket:A-2", "A-9", "a-2"], day(5), None, "x", 1),
        ("A-2", None, [], day(1), None, "x", 1),
    ]
    d = [("page-one", day(2), None), ("gone-page", day(1), None), ("gone-page", day(3), day(4)), ("late", day(6), None), (None, day(1), None)]
    got = run(spark, t, [("r", 1, ["A-1", "X-1"], day(9))], d)
    assert got == [
        ("github_prs", "r#1", "fixes", "tickets", "X-1", "missing", "2025-01"),
        ("tickets", "A-1", "blocks", "tickets", "A-9", "missing", "2025-01"),
        ("tickets", "A-1", "blocks", "tickets", "a-2", "missing", "2025-01"),
        ("tickets", "A-1", "references", "documents", "gone-page", "deleted", "2025-01"),
        ("tickets", "A-1", "references", "documents", "late", "late", "2025-01"),
    ]


def test_latest_state_counts_and_arrival_is_the_first_delivery(spark):
    t = [("A-1", ["old"], None, day(1), None, "", 0), ("A-1", ["new", "new"], None, day(8), None, "", 0), ("A-1", ["new", "new"], None, day(8), None, "", 0)]
    assert run(spark, t, [], [("new", day(2), None)]) == [("tickets", "A-1", "references", "documents", "new", "late", "2025-01")]


def test_null_keys_and_empty_tables(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [(None, ["x"], ["y"], day(1), None, "", 0)], [(None, 1, ["z"], day(1)), ("r", None, ["z"], day(1))], []) == []


def test_hot_target_and_counts(spark):
    t = [(f"A-{i}", ["nowhere"], None, day(1 + i % 20), None, "", 0) for i in range(400)]
    out = orphan_references(spark.createDataFrame(t, T), spark.createDataFrame([], P), spark.createDataFrame([], DOC))
    assert [tuple(r) for r in orphan_counts(out).collect()] == [("tickets", "references", "missing", "2025-01", 400)]
