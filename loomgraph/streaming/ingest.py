"""Deliveries as streams: an extension, the reference has none.

A stream of record rows is folded batch by batch into a table of latest states; a stream of events is counted in
windows with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.records import latest


#: Parts of the state; a batch rewrites those that its keys fall into.
BUCKETS = 64


def fold_batches(rows: DataFrame, keys: list[str], at: str, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the latest state of every key seen so far in ``folder``: each batch writes new versions of the parts it touches.

    A key belongs to one of ``buckets`` parts by hash. ``folder``/manifest/<batch> names the version of every part and is
    written last, so that readers (``current``) see a batch whole or not at all. A batch that is run again after a failure starts from
    the same manifest and overwrites its own result, so every delivery counts once. Rows with a null key are left out.
    """
    schema = rows.schema
    part = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, n: int) -> None:
        spark, batch = batch.sparkSession, batch.dropna(subset=keys).persist()
        try:
            now = _manifest(spark, folder, n)
            touched = [r[0] for r in batch.select(part).distinct().collect()]  # ``buckets`` numbers at most
            old = [f"{folder}/v{now[b]}/_part={b}" for b in touched if b in now]
            all_ = batch.unionByName(spark.read.schema(schema).parquet(*old)) if old else batch
            cols = [c for c in schema.names if c not in keys]
            latest(all_, keys, at, cols).select(*schema.names, part.alias("_part")).write.mode("overwrite").partitionBy("_part").parquet(f"{folder}/v{n}")
            new = sorted((now | dict.fromkeys(touched, n)).items())
            spark.createDataFrame(new, "part int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/{n}")
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _manifest(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, int]:
    """The newest manifest, of a batch before ``before``: the version of each part."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(f.getPath().getParent().getName()) for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/*/_SUCCESS")) or []] if fs.exists(at) else []
    done = [n for n in done if before is None or n < before]
    return {r.part: r.version for r in spark.read.parquet(f"{folder}/manifest/{max(done)}").collect()} if done else {}


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The state after the newest batch that ``fold_batches`` has finished, None before the first."""
    parts = _manifest(spark, folder)
    if not parts:
        return None
    return spark.read.parquet(*[f"{folder}/v{v}/_part={b}" for b, v in parts.items()])


def windowed_counts(events: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by kind in tumbling windows; rows later than ``late`` behind the newest are left out when streamed."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
