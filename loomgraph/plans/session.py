"""Session defaults and the written tables that cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Settings the jobs are tuned for; a session that the caller made keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(master).appName("loomgraph").config("spark.driver.memory", memory)
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions)} | extra).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder of its own; on a cluster that is an error, since no folder
    of one machine is shared.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-loomgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Folders written by this driver and not yet removed.
_written: list[str] = []


def new_path(spark: SparkSession) -> str:
    """A folder of its own within the shared one, which ``clear`` removes."""
    _written.append(f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}")
    return _written[-1]


def clear(spark: SparkSession) -> int:
    """Remove the tables that ``cut`` wrote; for when the results that read them are consumed. Gives their number."""
    jvm, n = spark.sparkContext._jvm, len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame) -> tuple[DataFrame, int]:
    """Write ``df`` to the shared folder and read it back: (table, row count).

    Used where a result is read more than once or where an iteration would let its plan grow. The files outlive the
    loss of any executor.
    """
    path, seen = new_path(df.sparkSession), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), int(seen.get["n"] or 0)


def cut_by(df: DataFrame, by: str, values: tuple[str, ...]) -> dict[str, tuple[str, int]]:
    """Write ``df`` with its rows kept apart by ``by``: the folder and row count of each of ``values`` that occurs."""
    path, seen = new_path(df.sparkSession), Observation()
    df.observe(seen, *[F.count_if(F.col(by) == v).alias(f"n{i}") for i, v in enumerate(values)]).write.partitionBy(by).parquet(path)
    got = {v: int(seen.get[f"n{i}"] or 0) for i, v in enumerate(values)}
    return {v: (f"{path}/{by}={v}", n) for v, n in got.items() if n}


def joined(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """Several written folders as one table: one scan, however many there are."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` written and, if it has at most ``most`` rows, marked for broadcast; larger ones are joined by shuffle.

    For tables of a few plain columns: a million rows of two numbers are some 30 MB.
    """
    out, n = cut(df)
    return F.broadcast(out) if n <= most else out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
