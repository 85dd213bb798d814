from __future__ import annotations

import random
from collections import defaultdict

import pytest

from loomgraph.operators import forest, hierarchy


def brute(links: set[tuple[str, str]]):
    """Longest cycle-free path per (node, root), and (node, cycle name) reached, by plain search."""
    up = defaultdict(set)
    nodes = set()
    for a, b in links:
        up[a].add(b)
        nodes |= {a, b}

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for y in up[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    r = {n: reach(n) for n in nodes}
    on = {n for n in nodes if n in r[n]}
    name = {n: min(m for m in on if m in r[n] and n in r[m]) for n in on}
    memo: dict[str, dict[str, int]] = {}

    def longest(a):
        if a not in memo:
            out: dict[str, int] = {}
            for b in up[a]:
                if b in on:
                    continue
                if not up[b]:
                    out[b] = max(out.get(b, 0), 1)
                for root, n in longest(b).items():
                    out[root] = max(out.get(root, 0), n + 1)
            memo[a] = out
        return memo[a]

    depths = {(n, root, k) for n in nodes if n not in on for root, k in longest(n).items()}
    circles = {(n, name[m], n in on and name[n] == name[m]) for n in nodes for m in (r[n] | {n}) & on}
    return depths, circles


def run(spark, links, single=()):
    kind = "node string, parent string"
    h = hierarchy.Hierarchies(spark.createDataFrame(sorted(links), kind), spark.createDataFrame(sorted(single), kind) if single else None)
    return h, {tuple(r) for r in h.depths.collect()}, {tuple(r) for r in h.circles.collect()}


@pytest.mark.parametrize("seed, local", [(0, 200_000), (1, 200_000), (2, 200_000), (2, 0)])
def test_random_graphs_against_search(spark, seed, local, monkeypatch):
    monkeypatch.setattr(forest, "LOCAL", local)
    rnd = random.Random(seed)
    n = 60
    links = {(f"n{i:03}", f"n{rnd.randrange(max(1, i)):03}") for i in range(1, n) if rnd.random() < 0.9}
    links |= {(f"n{rnd.randrange(n):03}", f"n{rnd.randrange(n):03}") for _ in range((2, 8, 25)[seed])}
    depths, circles = brute(links)
    _, d, c = run(spark, links)
    assert d == depths
    assert c == circles


def test_long_chain_with_side_branches_and_self_loop(spark):
    links = {(f"c{i:04}", f"c{i - 1:04}") for i in range(1, 300)} | {(f"d{i}", "c0150") for i in range(5)} | {("s", "s"), ("t", "s")}
    depths, circles = brute(links)
    h, d, c = run(spark, links)
    assert d == depths and c == circles
    rows = {r.node: r for r in h.ranges.collect()}
    assert rows["c0299"].depth == 299 and rows["c0001"].size == 304
    below = {(r.ancestor, r.node) for r in forest.descendants(h.ranges, h.ranges.where("node IN ('c0149', 'd1')"), page=16).collect()}
    assert {n for a, n in below if a == "c0149"} == {f"c{i:04}" for i in range(150, 300)} | {f"d{i}" for i in range(5)}
    assert not [1 for a, _ in below if a == "d1"]


def test_paths(spark):
    kind = "node string, parent string"
    out = hierarchy.outline(spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "b"), ("y", "x"), ("s", "s"), ("t", "s")], kind)).collect()
    assert {r.node: (r.root, r.depth, r.size, r.path) for r in out} == {
        "a": ("a", 0, 5, ["a"]), "b": ("a", 1, 4, ["a", "b"]), "c": ("a", 2, 2, ["a", "b", "c"]), "d": ("a", 3, 1, ["a", "b", "c", "d"]), "e": ("a", 2, 1, ["a", "b", "e"]),
        "x": ("x", 0, 2, ["x"]), "y": ("x", 1, 1, ["x", "y"]),
    }


def test_sweep_over_pages(spark, monkeypatch):
    monkeypatch.setattr(forest, "SWEEP", 7)
    rnd = random.Random(5)
    up = {i: rnd.randrange(max(0, i - 6), i) for i in range(1, 200) if i % 23}
    links = {(f"n{a:03}", f"n{b:03}") for a, b in up.items()}
    ranges, far = forest.nested_sets(spark.createDataFrame(sorted(links), "node string, parent string"))

    def path(i):
        return [i] if i not in up else [*path(up[i]), i]

    assert far is None
    rows = {r.node: (r.root, r.depth) for r in ranges.collect()}
    assert rows == {f"n{i:03}": (f"n{path(i)[0]:03}", len(path(i)) - 1) for i in {*up, *up.values()}}


def test_many_siblings_are_ordered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(forest, "SIBLINGS", 7)
    h, d, _ = run(spark, {(f"k{i:02}", "root") for i in range(50)} | {("g", "k07"), ("h", "k07")})
    rows = {r.node: r for r in h.ranges.collect()}
    spans = sorted((r.lft, r.lft + r.size) for r in rows.values() if r.depth == 1)
    assert spans[0][0] == 1 and spans[-1][1] == 53 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert rows["k07"].lft < rows["g"].lft < rows["k07"].lft + 3


def test_ladder_takes_few_rounds(spark, monkeypatch):
    rounds, cut = [], forest.cut
    for m in (forest, hierarchy):
        monkeypatch.setattr(m, "cut", lambda df: rounds.append(1) or cut(df))
    links = {(f"a{i + 1:02}", f"{x}{i:02}") for i in range(24) for x in "ab"} | {(f"b{i + 1:02}", f"{x}{i:02}") for i in range(24) for x in "ab"}
    _, d, c = run(spark, links)
    assert (d, c) == brute(links) and len(rounds) < 20


def test_empty_links(spark):
    _, d, c = run(spark, set())
    assert d == set() and c == set()


CHAT = "channel string, seq bigint, reply_to bigint, arrived_at timestamp_ntz, node string, up string"


def test_chat_links_clean_names_and_skip_missing_targets(spark):
    from datetime import datetime as D

    rows = [("#Eng ", 1, None, D(2025, 1, 1), "", ""), ("eng", 2, 1, D(2025, 1, 1), "", ""), ("ENG", 3, 99, D(2025, 1, 1), "", ""), ("eng", 4, 0, D(2025, 1, 1), "", ""), (None, 5, 1, D(2025, 1, 1), "", ""), ("eng", None, 1, None, "", "")]
    got = hierarchy.chat_links(spark.createDataFrame(rows, CHAT)).collect()
    assert [(r.node[-1], r.parent[-1]) for r in got] == [("2", "1")]
