from datetime import datetime as D

import numpy as np
import pytest

from loomgraph.llm import neighbours as N

KIND = "id bigint, embedding array<float>, ingested_at timestamp_ntz, cell int, other int"


def clusters(rng, n, size, spread):
    centres = rng.standard_normal((n, N.DIM))
    x = np.repeat(centres, size, 0) + spread * rng.standard_normal((n * size, N.DIM))
    return x.astype(np.float32)


def brute(ids, x, k=10, floor=0.85):
    s = np.round(N.unit(x) @ N.unit(x).T, 6)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if s[i, j] >= floor}
    return out


def run(spark, rows):
    return {tuple(r) for r in N.close_pairs(N.neighbours(spark.createDataFrame([(i, None if v is None else [None if y is None else float(y) for y in v], at, 1, 1) for i, v, at in rows], KIND))).collect()}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([clusters(rng, 40, 20, 0.3), clusters(rng, 4, 150, 0.35), rng.standard_normal((100, N.DIM)).astype(np.float32)])
    ids = list(range(5, 5 + len(x)))
    got, true = run(spark, [(i, v, D(2025, 1, 1)) for i, v in zip(ids, x)]), brute(ids, x)
    assert len(got & true) / len(true) >= 0.97 and len(got & true) / len(got) >= 0.97


def test_copies_rank_by_id_and_unusable_vectors_are_left_out(spark):
    rng = np.random.default_rng(3)
    a, b = clusters(rng, 2, 1, 0)
    ids = list(range(100, 140))
    rows = [(i, a, D(2025, 1, 1)) for i in ids] + [(7, b, D(2025, 1, 1)), (8, b * 3, D(2025, 1, 1)), (9, a, D(2025, 1, 1)), (9, b, D(2025, 1, 2)), (9, b, D(2025, 1, 2))]
    nan = np.full(64, np.nan)
    rows += [(1, None, None), (2, [], None), (3, [0.0] * 64, None), (4, nan, None), (5, [1.0] * 63, None), (None, a, None), (6, [None] + [1.0] * 63, None), (10, [float("inf")] * 64, None)]
    all_ = [(i, a) for i in ids] + [(7, b), (8, b * 3), (9, b)]
    assert run(spark, rows) == brute([i for i, _ in all_], np.array([v for _, v in all_], np.float32))


def test_equal_unusable_vectors_are_no_copies(spark):
    rng = np.random.default_rng(6)
    a = clusters(rng, 1, 1, 0)[0]
    nan, inf, null, tiny = [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1e-45] * 64
    rows = [(1, a), (2, a), (11, [0.0] * 64), (12, [0.0] * 64), (13, [-0.0] * 64), (21, nan), (22, nan), (31, inf), (32, inf), (41, null), (42, null), (51, tiny), (52, tiny)]
    assert run(spark, [(i, v, D(2025, 1, 1)) for i, v in rows]) == {(1, 2), (51, 52)}


def test_dense_cell_is_cut_in_pages(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = clusters(rng, 1, 300, 0.35)
    whole = run(spark, [(i, v, D(2025, 1, 1)) for i, v in enumerate(x)])
    monkeypatch.setattr(N, "PAGE", 64)
    monkeypatch.setattr(N, "ASKERS", 250)
    assert len(run(spark, [(i, v, D(2025, 1, 1)) for i, v in enumerate(x)]) ^ whole) <= 0.01 * len(whole)


def test_empty_and_single(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, np.ones(64), D(2025, 1, 1))]) == set()


@pytest.mark.parametrize("width", [0.1, 0.5, 3.0])
@pytest.mark.parametrize("n", [1, 63, 200, 1000])
def test_windows_of_sorted_projections_count_collisions(width, n):
    rng = np.random.default_rng(5)
    x = N.unit(rng.standard_normal((n, N.DIM))).astype(np.float32)
    t = N.Tables(x)
    q = x[:20]
    rank = np.array([np.searchsorted(t.sorted[j], (x @ t.lines)[:, j]) for j in range(N.TABLES)])
    lo = np.array([np.searchsorted(t.sorted[j], (q @ t.lines)[:, j] - width) // t.step for j in range(N.TABLES)])
    hi = np.array([-(-np.searchsorted(t.sorted[j], (q @ t.lines)[:, j] + width, "right") // t.step) for j in range(N.TABLES)])
    part = rank // t.step
    count = ((part[:, None, :] >= lo[:, :, None]) & (part[:, None, :] < hi[:, :, None])).sum(0)
    for need in (1, 7, 30, 64):
        got = np.zeros(count.shape, bool)
        got[t.candidates(q, width, need)] = True
        assert (got != (count >= need)).mean() <= 0.001  # equal projections may sort either way


@pytest.mark.parametrize("floor", [0.85, 0.5])
def test_recall_at_any_floor_and_pairs_left_unverified(spark, floor):
    rng = np.random.default_rng(8)
    x = np.concatenate([clusters(rng, 60, 15, s) for s in (0.2, 0.5, 0.9)] + [rng.standard_normal((300, N.DIM)).astype(np.float32)])
    ids = list(range(len(x)))
    got = {tuple(r) for r in N.close_pairs(N.neighbours(spark.createDataFrame([(i, [float(y) for y in v], D(2025, 1, 1), 1, 1) for i, v in zip(ids, x)], KIND), floor=floor)).collect()}
    true = brute(ids, x, floor=floor)
    assert len(got & true) / len(true) >= 0.99 and len(got & true) / len(got) >= 0.99
    u = N.unit(x).astype(np.float32)
    t = N.Tables(u)
    share = [len(t.candidates(u[:256], N.WIDTH * level * N.radius(floor))[0]) / 256 / len(x) for level in N.LEVELS]
    assert share[0] < 0.05 and share[1] < 0.1 and share[2] < (0.05 if floor == 0.85 else 0.5)


def test_pages_and_slots_are_even_whatever_the_stride():
    for ids in (np.arange(0, 40_000, 4), np.arange(10_000) * 4096, np.arange(10_000)):
        page, slot = N.dealt(ids)
        for parts in (4, 7):
            assert np.bincount(page % parts, minlength=parts).max() < 1.1 * len(ids) / parts
            assert np.bincount(page % parts * parts + slot % parts, minlength=parts * parts).max() < 1.4 * len(ids) / parts**2


def test_two_levels_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([clusters(rng, 50, 20, 0.3), clusters(rng, 2, 100, 0.3)])
    monkeypatch.setattr(N, "PER_CELL", 20)
    monkeypatch.setattr(N, "CELLS", 12)
    cells = N.Cells(N.unit(x).astype(np.float32), len(x))
    assert cells.coarse.shape[0] == 12 and cells.fine.shape[0] == 5 and abs(cells.share.sum() - 1) < 1e-9
    ids = list(range(len(x)))
    got, true = run(spark, [(i, v, D(2025, 1, 1)) for i, v in zip(ids, x)]), brute(ids, x)
    assert len(got & true) / len(true) >= 0.97


def test_floor_must_be_between_0_and_1(spark):
    with pytest.raises(ValueError):
        N.neighbours(spark.createDataFrame([], KIND), floor=0.0)
