"""References to records that do not exist.

Parent and child keys are put into one long table, tagged; grouping it by parent table and key shows which keys have
no parent, a deleted one, or one that came later than the child. Counts add up by period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.names import named, page_key, ticket_key
from loomgraph.operators.records import latest

CHILD = ["src_table", "src_key", "field", "target_table", "target_key", "arrival"]


def children(tickets: DataFrame, prs: DataFrame) -> DataFrame:
    """Every distinct reference of every record: CHILD columns."""

    def entry(field: str, to: str):
        return lambda k: F.struct(F.lit(field).alias("field"), F.lit(to).alias("target_table"), k.alias("target_key"))

    def refs(rec: DataFrame, src: str, fields: dict) -> DataFrame:
        each = [F.transform(named(F.col(f"_{f}"), key), entry(f, to)) for f, (to, key) in fields.items()]
        return rec.select(F.lit(src).alias("src_table"), F.col("src_key"), "arrival", F.explode(F.concat(*each)).alias("r")).select("src_table", "src_key", "r.*", "arrival")

    t = latest(tickets, [F.col("key").alias("src_key")], "ingested_at", [F.col("references").alias("_references"), F.col("blocks").alias("_blocks")], "arrival")
    p = latest(prs, [F.concat("repo", F.lit("#"), F.col("number").cast("string")).alias("src_key")], "ingested_at", [F.col("fixes").alias("_fixes")], "arrival")
    out = refs(t, "tickets", {"references": ("documents", page_key), "blocks": ("tickets", ticket_key)})
    return out.unionByName(refs(p, "github_prs", {"fixes": ("tickets", ticket_key)})).select(*CHILD)


def parents(tickets: DataFrame, documents: DataFrame) -> DataFrame:
    """(target_table, target_key, first_seen, deleted) of every row that can be referred to."""

    def rows(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.select(F.lit(name).alias("target_table"), F.col(key).alias("target_key"), F.col("ingested_at").alias("first_seen"), F.col("deleted_at").isNotNull().alias("deleted")).where(F.col(key).isNotNull())

    return rows(tickets, "tickets", "key").unionByName(rows(documents, "documents", "stem"))


def orphans(kids: DataFrame, folks: DataFrame) -> DataFrame:
    """The rows of ``kids`` whose target has no row, has a deleted row, or first came after the child's arrival.

    A hot key costs one row per task in the grouping; the join back has one row per key on its other side, which
    adaptive execution splits if a key is skewed. A target whose first delivery is unknown (null) counts as present.
    """
    long = folks.select("target_table", "target_key", "first_seen", "deleted", F.lit(True).alias("is_parent"), F.lit(None).cast("timestamp_ntz").alias("asked")).unionByName(
        kids.select("target_table", "target_key", F.lit(None).cast("timestamp_ntz").alias("first_seen"), F.lit(False).alias("deleted"), F.lit(False).alias("is_parent"), F.col("arrival").alias("asked"))
    )
    keys = long.groupBy("target_table", "target_key").agg(F.bool_or("is_parent").alias("has_parent"), F.bool_or("deleted").alias("gone"), F.min("first_seen").alias("first_seen"), F.min("asked").alias("asked"))
    lacking = keys.where("asked IS NOT NULL AND (NOT has_parent OR gone OR first_seen > asked)")
    return kids.join(lacking.drop("asked"), ["target_table", "target_key"]).where("NOT has_parent OR gone OR first_seen > arrival")


def orphan_references(tickets: DataFrame, prs: DataFrame, documents: DataFrame) -> DataFrame:
    """src_table, src_key, field, target_table, target_key, why (missing, deleted or late) and period (yyyy-MM)."""
    why = F.when(~F.col("has_parent"), "missing").when(F.col("gone"), "deleted").otherwise("late")
    found = orphans(children(tickets, prs), parents(tickets, documents))
    return found.select("src_table", "src_key", "field", "target_table", "target_key", why.alias("why"), F.date_format("arrival", "yyyy-MM").alias("period"))


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, field, cause and period."""
    return found.groupBy("src_table", "field", "why", "period").agg(F.count(F.lit(1)).alias("orphans"))
