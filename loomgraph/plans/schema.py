"""Declared node kinds and relations, and the frames of what violates them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CARDINALITIES = {"1": (1, 1), "0..1": (0, 1), "1..n": (1, None), "0..n": (0, None)}


@dataclass(frozen=True)
class Relation:
    name: str
    source: str
    target: str
    cardinality: str = "0..n"


@dataclass(frozen=True)
class Schema:
    """Labels with their required properties, and relations between labels."""

    required: dict[str, tuple[str, ...]] = field(default_factory=dict)
    relations: tuple[Relation, ...] = ()

    def merged(self, other: Schema) -> Schema:
        return Schema(self.required | other.required, tuple(dict.fromkeys(self.relations + other.relations)))

    def triplets(self) -> list[tuple[str, str, str]]:
        return sorted({(r.source, r.name, r.target) for r in self.relations})


#: The corpus' own kinds.
CORPUS = Schema(
    {"Ticket": ("title", "status"), "PullRequest": ("title", "state"), "Message": ("text",), "Document": ("title",)},
    (
        Relation("ASSIGNED", "Ticket", "Person", "0..1"), Relation("REPORTED", "Ticket", "Person", "0..1"), Relation("ABOUT", "Ticket", "Component"), Relation("BLOCKS", "Ticket", "Ticket"), Relation("REFERENCES", "Ticket", "Document"),
        Relation("AUTHORED_BY", "PullRequest", "Person", "0..1"), Relation("REVIEWED_BY", "PullRequest", "Person", "1..n"), Relation("FIXES", "PullRequest", "Ticket"), Relation("ABOUT", "PullRequest", "Component"), Relation("REFERENCES", "PullRequest", "Document"),
        Relation("SENT_BY", "Message", "Person", "1"), Relation("REPLY_TO", "Message", "Message", "0..1"), Relation("REFERENCES", "Message", "Document"),
        Relation("AUTHORED_BY", "Document", "Person", "0..1"), Relation("ABOUT", "Document", "Component"),
    ),
)


def cardinality_violations(schema: Schema, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, rel, expected, actual): sources with too few or too many distinct targets; only rel.source is checked."""
    rules = [(r.source, r.name, r.cardinality, *CARDINALITIES[r.cardinality]) for r in schema.relations if r.cardinality != "0..n"]
    rule = nodes.sparkSession.createDataFrame(rules, "label string, rel string, expected string, lo int, hi int")
    count = edges.groupBy(F.col("src").alias("id"), "rel").agg(F.count_distinct("dst").alias("actual"))
    got = nodes.join(F.broadcast(rule), "label").join(count, ["id", "rel"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return got.where("actual < lo OR actual > hi").select("id", "label", "rel", "expected", "actual")


def missing_properties(schema: Schema, label: str, rows: DataFrame) -> DataFrame:
    """rows(id, properties...): (id, property) of required properties that are null or blank."""
    props = schema.required[label]
    return rows.select("id", F.explode(F.array(*[F.when(F.coalesce(F.trim(p), F.lit("")) == "", F.lit(p)) for p in props])).alias("property")).where("property IS NOT NULL")


#: How a text that holds a value of a type looks.
PATTERNS = {
    "integer": r"^-?[0-9]+$",
    "number": r"^-?[0-9]+(\.[0-9]+)?$",
    "boolean": "^(true|false)$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$",
    "string": r"[^\s]",
}
#: Types of the raw records' properties by label.
TYPES = {
    "Message": {"seq": "integer", "ts": "timestamp", "channel": "string"},
    "PullRequest": {"number": "integer", "state": "string", "title": "string"},
    "Ticket": {"key": "string", "status": "string"},
    "Document": {"title": "string"},
}


def wrong_types(rows: DataFrame, types: dict[str, dict[str, str]] = TYPES) -> DataFrame:
    """rows(id, label, props MAP): (id, property, expected, actual) of properties that are there but not of their type."""
    rules = F.create_map(*[x for label, of in types.items() for p, t in of.items() for x in (F.lit(f"{label}/{p}"), F.lit(t))])
    looks = F.create_map(*[x for kv in PATTERNS.items() for x in map(F.lit, kv)])
    each = rows.select("id", "label", F.explode("props").alias("property", "actual")).withColumn("expected", rules[F.concat("label", F.lit("/"), "property")])
    return each.where(F.col("expected").isNotNull() & F.col("actual").isNotNull() & ~F.coalesce(F.regexp_like("actual", looks[F.col("expected")]), F.lit(False))).select("id", "property", "expected", "actual")


def edge_violations(edges: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """edges(src, rel, dst, properties...): (src, rel, dst, property) of required properties that are null or blank."""
    lacking = F.array(*[F.when(F.coalesce(F.trim(F.col(p).cast("string")), F.lit("")) == "", F.lit(p)) for p in required])
    return edges.select("src", "rel", "dst", F.explode(lacking).alias("property")).where("property IS NOT NULL")


def wrong_ends(schema: Schema, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose labels and relation the schema does not have."""
    ok = nodes.sparkSession.createDataFrame(schema.triplets(), "source string, rel string, target string")
    e = edges.join(nodes.select(F.col("id").alias("src"), F.col("label").alias("source")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("target")), "dst")
    return e.join(F.broadcast(ok), ["source", "rel", "target"], "left_anti").select("src", "rel", "dst", "source", "target")


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """(label, id, n) of ids that a label has more than once."""
    return nodes.groupBy("label", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(schema: Schema, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, kind, expected, actual) of all of the above but properties; an empty frame allows publishing."""
    parts = [
        cardinality_violations(schema, nodes, edges).select(F.concat_ws("/", "id", "rel").alias("path"), F.lit("cardinality").alias("kind"), "expected", F.col("actual").cast("string").alias("actual")),
        duplicate_ids(nodes).select(F.concat_ws("/", "label", "id").alias("path"), F.lit("unique").alias("kind"), F.lit("1").alias("expected"), F.col("n").cast("string").alias("actual")),
        wrong_ends(schema, nodes, edges).select(F.concat_ws("/", "src", "rel", "dst").alias("path"), F.lit("relation").alias("kind"), F.lit("declared").alias("expected"), F.concat_ws("-", "source", "target").alias("actual")),
    ]
    return reduce(DataFrame.unionByName, parts)
