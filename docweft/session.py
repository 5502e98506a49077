"""Session-level helpers shared by every operator: table access, staging, parallelism."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings under which the library is developed and tested. All of them hold at any scale;
#: the number of shuffle partitions is left to the cluster and to adaptive execution.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table `name` below `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (`spark.checkpoint.dir`).

    Only where it is unset, as in local tests, a folder of this machine stands in for it.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="docweft-")
        spark.conf.set("spark.checkpoint.dir", where)
        sc.setCheckpointDir(where)
    return where


_STAGED: list[tuple[SparkSession, str]] = []
#: What is staged in this context; that of the process unless staging() has opened one of its own.
_HERE: ContextVar[list[tuple[SparkSession, str]]] = ContextVar("staged", default=_STAGED)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` once as parquet into the shared folder and reads it back.

    It cuts lineage and keeps expensive rows from being computed once per branch. The files outlive
    executors, and their sizes give the planner real statistics. They go when the process ends, or at the end
    of the staging() that they are written in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/docweft-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _HERE.get().append((spark, path))
    return spark.read.schema(schema).parquet(path)


def stage_all(*parts: tuple[DataFrame, str]) -> list[DataFrame]:
    """stage() of several frames that do not depend on each other, at the same time."""
    with ThreadPoolExecutor(len(parts)) as pool:
        return [x.result() for x in [pool.submit(copy_context().run, stage, *part) for part in parts]]


def _dropped(staged: list[tuple[SparkSession, str]]) -> None:
    while staged:
        spark, path = staged.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


@contextmanager
def staging() -> Iterator[None]:
    """Deletes at its end what is staged within it: for services, around one request whose results are then stored or collected.

    Frames made inside can't be used any more; those of other threads and requests stay.
    """
    own: list[tuple[SparkSession, str]] = []
    token = _HERE.set(own)
    try:
        yield
    finally:
        _HERE.reset(token)
        _dropped(own)


@atexit.register
def drop_staged() -> None:
    """Deletes what stage() has written so far; frames that read it can't be used any more.

    Runs when the process ends; a long session may call it once its results are stored.
    """
    _dropped(_STAGED)


def once(df: DataFrame, key: str, most: int = 1_000_000, latest: Sequence[str] = ()) -> DataFrame:
    """One row of each `key`, null being one too, without a shuffle of the rows whose key is not repeated.

    The repeated keys are found from the key column alone. Up to `most` of them are broadcast, so only their own
    rows move; of more, all rows are shuffled by key. The row that stays is the one with the greatest values in
    `latest`; which of several it is, or without them, is not fixed.
    """

    def one(rows: DataFrame) -> DataFrame:
        if not latest:
            return rows.dropDuplicates([key])
        return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), F.struct(*latest)).alias("_row")).select("_row.*")

    again = stage(df.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_again")), "again")
    if again.limit(most + 1).count() > most:
        return one(df)
    on = F.col(key).eqNullSafe(F.col("_again"))
    return df.join(F.broadcast(again), on, "left_anti").unionByName(one(df.join(F.broadcast(again), on, "left_semi")))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """`df` with its rows' places in `order`, from 0, in column `name`.

    Rows are sorted in ranges and numbered within each; the ranges' sizes, one number for each task, give the
    offsets. So no task has all rows, nor all of one value if `order` ends in a unique key.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", inside), "numbered")
    sizes = sorted((r._part, r["count"]) for r in placed.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(offsets, "_part int, _start bigint")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def bounded_sample(df: DataFrame, key: str, rows: int, most: int) -> DataFrame:
    """At most `most` of the `rows` rows of `df`: those of the least hash of `key`, the same on every run.

    Of many rows only about twice as many are looked at, so that no task sends on `most` rows of its own.
    """
    digest = F.xxhash64(key)
    if rows > 2 * most:
        df = df.filter(digest < F.lit(-(1 << 63) + int((1 << 64) * 2 * most / rows)))
    return df.orderBy(digest, key).limit(most)


def spread(scan: DataFrame) -> DataFrame:
    """Splits a scan that comes in fewer partitions than the session has cores.

    For use directly on scans ahead of CPU-heavy work; large inputs have many splits and pass unchanged.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
