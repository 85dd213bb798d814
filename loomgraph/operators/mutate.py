"""Graph changes as functions from snapshots to snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.session import cut


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` lay their non-null values over the row of ``old`` with the same key; other rows stay or come."""
    cols = [c for c in old.columns if c != key]
    all_ = old.select(key, *cols, F.lit(0).alias("_v")).unionByName(new.select(key, *cols, F.lit(1).alias("_v")))
    return all_.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_v"))).alias(c) for c in cols])


def merge_properties(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, props MAP): later keys overwrite, others stay."""
    j = old.select("id", F.col("props").alias("a")).join(new.select("id", F.col("props").alias("b")), "id", "full")
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    return j.select("id", F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b).alias("props"))


def owned(edges: DataFrame, roots: DataFrame, owns: tuple[str, ...]) -> DataFrame:
    """roots(id) and all that they own, however deep: the closure over ``owns``, a round a level; circles end it."""
    step = edges.where(F.col("rel").isin(*owns)).select(F.col("src").alias("id"), F.col("dst").alias("to"))
    seen, n = cut(roots.select("id").distinct())
    front = seen
    while n and owns:
        front, n = cut(front.join(step, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.union(front)
    return seen


def cascade_delete(nodes: DataFrame, edges: DataFrame, roots: DataFrame, owns: tuple[str, ...], shared: tuple[str, ...], labels: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Delete ``roots`` (id), all they own, and what was only theirs among the nodes they name by ``shared`` relations.

    A node that a deleted node named through ``shared`` goes if no edge is left to it, if of one of ``labels``;
    any other node stays, orphaned or not. A root that is no node raises an error. Gives the new (nodes, edges).
    """
    if roots.select("id").join(nodes, "id", "left_anti").limit(1).count():
        raise ValueError("a root to be deleted does not exist")
    gone = owned(edges, roots, owns)
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "rel", "dst")
    named = edges.where(F.col("rel").isin(*shared)).join(gone.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    if labels:
        named = named.join(nodes.where(F.col("label").isin(*labels)).select("id"), "id", "left_semi")
    touched = left.select(F.col("src").alias("id")).union(left.select(F.col("dst").alias("id"))).distinct()
    orphaned = named.join(touched, "id", "left_anti")
    return nodes.join(gone.union(orphaned).distinct(), "id", "left_anti"), left


def replace_targets(edges: DataFrame, rel: str, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """new(src, dst): each src named there has exactly these targets of ``rel``; targets without a node raise an error."""
    missing = new.select(F.col("dst").alias("id")).join(nodes, "id", "left_anti").limit(1).count()
    if missing:
        raise ValueError(f"{rel}: a target does not exist")
    kept = edges.join(new.select("src").distinct().withColumn("rel", F.lit(rel)), ["src", "rel"], "left_anti").select("src", "rel", "dst")
    return kept.unionByName(new.select("src", F.lit(rel).alias("rel"), "dst").distinct())


def strip_source(edges: DataFrame, source: str) -> DataFrame:
    """edges(src, rel, dst, sources): ``source`` taken off; edges left without any go."""
    return edges.withColumn("sources", F.array_remove("sources", source)).where(F.size("sources") > 0)


def strip_sources(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges(src, rel, dst, sources), gone(id): the sources that are gone taken off; edges left without any go."""
    each = edges.select("src", "rel", "dst", F.explode("sources").alias("id")).join(gone.select("id").distinct(), "id", "left_anti")
    return each.groupBy("src", "rel", "dst").agg(F.sort_array(F.collect_set("id")).alias("sources"))
