from datetime import datetime

import numpy as np
import pytest

from loomgraph import search_queries as Q

KIND = "id bigint, ntype string, text string, embedding array<float>, ingested_at timestamp_ntz"


def entities(spark, path, rows):
    """rows(id, ntype, text, angle): vectors in one plane, nearer to the asked one the smaller their angle."""
    vec = lambda a: [float(np.cos(a)), float(np.sin(a))] + [0.0] * 62
    spark.createDataFrame([(i, t, x, vec(a), datetime(2025, 1, 1)) for i, t, x, a in rows], KIND).write.parquet(f"{path}/entities.parquet")
    return str(path)


@pytest.mark.parametrize("name, k", [("vector_topk_per_label_merge", 10), ("rank_by_text", 5)])
def test_near_vectors_of_one_type_are_all_kept(spark, tmp_path, name, k):
    rows = [(50, "a", "", 0.0)] + [(100 + i, "a", "", 0.02 * i) for i in range(1, 13)] + [(200 + i, "b", "", 1 + 0.02 * i) for i in range(1, 13)]
    got = getattr(Q, name)(spark, entities(spark, tmp_path, rows)).orderBy("rank").select("q", "id").collect()
    assert [tuple(r) for r in got] == [(50, 100 + i) for i in range(1, k + 1)]


def test_fusion_takes_hits_beyond_the_fiftieth_of_both_lists(spark, tmp_path):
    """Entity 1055 is 55th in both lists; the 54 before it in one have no place in the other."""
    ids = lambda at, n: [i for i in range(at, at + 2 * n) if i % 50][:n]
    rows = [(50, "a", "alpha", 0.0), (1055, "a", "alpha beta", 0.5)]
    rows += [(i, "a", "beta beta", 0.005 * (j + 1)) for j, i in enumerate(ids(2001, 54))] + [(i, "a", "beta beta", 1 + 0.005 * j) for j, i in enumerate(ids(4001, 60))]
    rows += [(i, "a", "alpha alpha", 2.0) for i in ids(3001, 54)]
    first = Q.rrf_fusion(spark, entities(spark, tmp_path, rows)).orderBy("rank").first()
    assert (first.q, first.id, first.score) == (50, 1055, round(2 / 115, 6))
