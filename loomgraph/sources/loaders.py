"""Readers of the five record sources into one shape, and the graph snapshot sink.

A raw record has kind, id, label, props (map), refs (relation, target id, name), text and body. Loaders are
projections; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.functions.names import channel_key, handle_key, named, page_key, slug, strip, ticket_key

SCHEMAS = {
    "chat": "seq BIGINT, channel STRING, author STRING, ts STRING, text STRING, reply_to BIGINT, references ARRAY<STRING>",
    "tickets": "key STRING, title STRING, description STRING, status STRING, assignee STRING, reporter STRING, components ARRAY<STRING>, references ARRAY<STRING>, blocks ARRAY<STRING>",
    "github": "repo STRING, number BIGINT, title STRING, description STRING, state STRING, author STRING, reviewers ARRAY<STRING>, fixes ARRAY<STRING>, components ARRAY<STRING>, references ARRAY<STRING>",
    "meetings": "project STRING, date STRING, title STRING, attendees ARRAY<STRING>, discusses ARRAY<STRING>, components ARRAY<STRING>, references ARRAY<STRING>, transcript ARRAY<STRUCT<speaker: STRING, text: STRING>>",
}
COLUMNS = ["kind", "id", "label", "props", "refs", "text", "body"]


def _refs(rel: str, prefix: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(rel).alias("rel"), F.concat(F.lit(prefix), k).alias("targetId"), k.alias("name")))


def _people(c: Column) -> Column:
    def key(x: Column) -> Column:
        s = slug(handle_key(x))
        return F.when(s != "", s)

    return named(c, key)


def _slugs(c: Column) -> Column:
    def key(x: Column) -> Column:
        s = slug(x)
        return F.when(s != "", s)

    return named(c, key)


def _pages(refs: Column, body: Column) -> Column:
    """Named pages and those linked in the text, each once."""
    return named(F.concat(F.coalesce(refs, F.array().cast("array<string>")), text.mentions(body, text.WIKILINK)), page_key)


def _props(**cols: Column) -> Column:
    pairs = [x for k, c in cols.items() for x in (F.lit(k), c.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _record(df: DataFrame, kind: str, label: str, id_: Column, props: Column, refs: list[Column], text_: Column, body: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), id_.alias("id"), F.lit(label).alias("label"), props.alias("props"), F.concat(*refs).alias("refs"), text_.alias("text"), body.alias("body"))


def tickets(df: DataFrame) -> DataFrame:
    c = F.col
    refs = [_refs("ASSIGNED", "person:", _people(F.array("assignee"))), _refs("REPORTED", "person:", _people(F.array("reporter"))), _refs("ABOUT", "component:", _slugs(c("components"))), _refs("REFERENCES", "doc:", named(c("references"), page_key)), _refs("BLOCKS", "ticket:", named(c("blocks"), ticket_key))]
    return _record(df, "jira", "Ticket", F.concat(F.lit("ticket:"), ticket_key(c("key"))), _props(key=c("key"), title=c("title"), status=c("status")), refs, c("title"), c("description"))


def chat(df: DataFrame) -> DataFrame:
    c, ch = F.col, channel_key(F.col("channel"))
    mid = lambda s: F.concat(F.lit("msg:"), ch, F.lit(":"), s.cast("string"))
    reply = F.when(F.coalesce(c("reply_to"), F.lit(0)) != 0, F.array(F.struct(F.lit("REPLY_TO").alias("rel"), mid(c("reply_to")).alias("targetId"), F.concat(F.lit("message "), c("reply_to").cast("string")).alias("name"))))
    refs = [_refs("SENT_BY", "person:", _people(F.array("author"))), F.coalesce(reply, _refs("", "", F.array().cast("array<string>"))), _refs("REFERENCES", "doc:", _pages(c("references"), c("text")))]
    return _record(df, "chat", "Message", mid(c("seq")), _props(channel=ch, seq=c("seq"), ts=c("ts")), refs, c("text"), F.lit(None).cast("string"))


def pull_requests(df: DataFrame) -> DataFrame:
    c = F.col
    refs = [_refs("AUTHORED_BY", "person:", _people(F.array("author"))), _refs("REVIEWED_BY", "person:", _people(c("reviewers"))), _refs("FIXES", "ticket:", named(c("fixes"), ticket_key)), _refs("ABOUT", "component:", _slugs(c("components"))), _refs("REFERENCES", "doc:", named(c("references"), page_key))]
    return _record(df, "github", "PullRequest", F.concat(F.lit("pr:"), slug(c("repo")), F.lit("#"), c("number").cast("string")), _props(repo=c("repo"), number=c("number"), title=c("title"), state=c("state")), refs, F.concat_ws("\n", "title", "description"), F.lit(None).cast("string"))


def meetings(df: DataFrame) -> DataFrame:
    """A meeting without components is about its project; the body is the transcript, one paragraph per turn."""
    c = F.col
    about = _slugs(c("components"))
    about = F.when(F.size(about) == 0, F.array(slug(c("project")))).otherwise(about)
    body = F.array_join(F.transform("transcript", lambda t: F.concat(text.person_name(slug(handle_key(t["speaker"]))), F.lit(": "), t["text"])), "\n\n")
    refs = [_refs("ATTENDED", "person:", _people(c("attendees"))), _refs("DISCUSSES", "ticket:", named(c("discusses"), ticket_key)), _refs("ABOUT", "component:", about), _refs("REFERENCES", "doc:", named(c("references"), page_key))]
    return _record(df, "meeting", "Meeting", F.concat(F.lit("meeting:"), slug(c("project")), F.lit(":"), c("date")), _props(project=c("project"), date=c("date"), title=c("title")), refs, c("title"), body)


def front_matter(raw: DataFrame) -> DataFrame:
    """raw(stem, value): stem, meta (map) and body. Without a closed block the whole text is body; values are unquoted."""
    v = F.regexp_replace("value", "^\ufeff", "")
    block = F.regexp_extract(v, r"^---[ \t]*\r?\n(?s:(.*?))\r?\n---[ \t]*(?:\r?\n|$)", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.contains(":"))
    unquote = lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), unquote(F.regexp_replace(x, "^[^:]*:", ""))))
    # Of a key given twice the first counts.
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["col1"]), p["col1"]) == i + 1)
    return raw.select("stem", F.map_from_entries(first).alias("meta"), F.regexp_replace(v, r"^---[ \t]*\r?\n(?s:.*?)\r?\n---[ \t]*(?:\r?\n|$)", "").alias("body"))


def _list(c: Column) -> Column:
    return F.coalesce(F.transform(F.split(F.regexp_replace(c, r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), F.array().cast("array<string>"))


def markdown(raw: DataFrame) -> DataFrame:
    """raw(stem, value): documents; the id is the front matter's or the file's, links to itself are dropped."""
    m = front_matter(raw)
    key = page_key(F.coalesce(m["meta"]["id"], m["stem"]))
    pages = F.filter(_pages(F.lit(None).cast("array<string>"), m["body"]), lambda k: k != key)
    refs = [_refs("AUTHORED_BY", "person:", _people(F.array(m["meta"]["author"]))), _refs("ABOUT", "component:", _slugs(_list(m["meta"]["components"]))), _refs("REFERENCES", "doc:", pages)]
    title = F.coalesce(m["meta"]["title"], m["stem"])
    return _record(m, "doc", "Document", F.concat(F.lit("doc:"), key), _props(title=title), refs, title, strip(m["body"]))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", "*.[mM][dD]").text(path, wholetext=True)
    stem = F.regexp_replace(F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)$", 1), r"\.[mM][dD]$", "")
    return markdown(raw.select(stem.alias("stem"), "value"))


def read_json(spark: SparkSession, path: str, source: str, lines: bool = False) -> DataFrame:
    """One of SCHEMAS from a file that holds a JSON array, or with ``lines`` an object per line.

    Spark cannot split a file that is one array: one task reads it. Large sources should come as lines, or as many files.
    """
    return spark.read.schema(SCHEMAS[source]).json(path, multiLine=not lines)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON objects, one per line; blank and torn lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


LOADERS = {"chat": chat, "tickets": tickets, "github": pull_requests, "meetings": meetings}


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The records of whichever sources the folder has: docs/*.md and <source>.json."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}"))
    parts = [f(read_json(spark, f"{folder}/{s}.json", s)) for s, f in LOADERS.items() if there(f"{s}.json")]
    if there("docs"):
        parts.append(read_markdown(spark, f"{folder}/docs"))
    if not parts:
        raise FileNotFoundError(f"{folder} holds no known source")
    return reduce(DataFrame.unionByName, parts)


def vocabulary(defaults: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Defaults, and the rows whose key they lack; of several such rows the least."""
    new = rows.join(defaults.select(key), key, "left_anti").groupBy(key).agg(*[F.min(c).alias(c) for c in defaults.columns if c != key])
    return defaults.unionByName(new.select(*defaults.columns))


def links(records: DataFrame) -> DataFrame:
    """(src, rel, dst) of raw records."""
    return records.select(F.col("id").alias("src"), F.explode("refs").alias("r")).select("src", "r.rel", F.col("r.targetId").alias("dst")).distinct()


def write_snapshot(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A graph snapshot: nodes by label, edges by relation; scans of one kind then read one folder."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{folder}/edges")


def read_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges").select("src", "rel", "dst")


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes by label, edges by relation."""
    return nodes.groupBy(F.col("label").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("what"), "kind", "n").union(edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges"), "rel", "n"))
