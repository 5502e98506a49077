"""Continuous upkeep of the chunk table (an extension: the batch form is operators.store.Sync).

Files of changed documents arrive in a folder. Each micro-batch chunks its documents, compares the hashes
with the current snapshot and writes the next one. Chunks are keyed and hashed, and a batch that is
replayed finds its own snapshot, so a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docweft.operators import chunking, store

SCHEMA = "source string, title string, customer string, content string, updated_at timestamp, deleted_at timestamp"


def hashed_chunks(docs: DataFrame) -> DataFrame:
    """Search chunks of live documents with body_hash."""
    chunks = chunking.search_chunks(docs.filter("deleted_at is null"))
    return chunks.withColumn("body_hash", F.sha2("body", 256))


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath() for s in fs.listStatus(where) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("batch=")) for p in names if p.getName().startswith("batch="))


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last whole snapshot below `path` (of those before batch `before`), if there is one."""
    known = [n for n in _snapshots(spark, path) if before is None or n < before]
    return spark.read.parquet(f"{path}/batch={known[-1]}") if known else None


def apply_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes snapshot `batch` from the one before and the batch's documents.

    Of several versions of a document in a batch, the latest counts. Only chunks of the batch's documents are
    compared; deleted documents lose theirs.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy("source").agg(F.max_by(F.struct(*batch.columns), F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp"))).alias("d")).select("d.*")
        new = hashed_chunks(latest)
        old = current(spark, path, number)
        if old is None:
            out = new
        else:
            touched = latest.select("source")
            inside = old.join(touched, "source", "left_semi").select(*old.columns)
            out = old.join(touched, "source", "left_anti").select(*old.columns).unionByName(store.Sync(inside, new).result)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def ingest(spark: SparkSession, arrivals: str, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream from JSON files below `arrivals` into snapshots below `path`; start() it with a trigger."""
    docs = spark.readStream.schema(SCHEMA).json(arrivals)
    return docs.writeStream.foreachBatch(apply_batch(path)).option("checkpointLocation", checkpoint)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type) per window and type; rows later than `late` after the latest are dropped with their state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
