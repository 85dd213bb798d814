"""Records out of at-least-once deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def delivered(at: str) -> Column:
    """A delivery time that compares; a null one is earlier than any other."""
    return F.coalesce(F.col(at).cast("timestamp_ntz"), F.timestamp_micros(F.lit(-(2**55))).cast("timestamp_ntz"))


def latest(df: DataFrame, keys: list[str | Column], at: str, cols: list[str | Column], arrival: str | None = None) -> DataFrame:
    """One row per key: ``cols`` of the row delivered last, and its earliest delivery as ``arrival``.

    Rows of one key with equal delivery time are identical by contract; if not, any of them is taken. A null delivery
    time is earlier than any other. Rows whose key has a null part are no record and are left out. The aggregation is
    partial before the shuffle, so a key delivered very often costs one row per task.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    src = df.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*cols).alias("_row"), F.col(at).alias("_at"))
    src = src.where(" AND ".join(f"_k{i} IS NOT NULL" for i in range(len(keys))))
    extra = [F.min("_at").alias("_first")] if arrival else []
    out = src.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.max_by("_row", delivered("_at")).alias("_row"), *extra)
    names = df.select(*keys).columns
    return out.select(*[F.col(f"_k{i}").alias(n) for i, n in enumerate(names)], "_row.*", *([F.col("_first").alias(arrival)] if arrival else []))


def ordinals(df: DataFrame, group: list[str], order: str, name: str = "turn", page: int = 10_000) -> DataFrame:
    """Adds each row's place (from 1) within ``group`` by the whole number ``order``, unique within the group.

    A group is cut into pages of consecutive numbers; the pages' counts are summed first, so no task holds more of a
    group than one page.
    """
    paged = df.withColumn("_page", F.expr(f"`{order}` div {page}"))
    counts = paged.groupBy(*group, "_page").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*group, "_page").orderBy(order))
    return paged.withColumn("_own", place).join(counts.select(*group, "_page", before.alias("_before")), [*group, "_page"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_page", "_own", "_before")
