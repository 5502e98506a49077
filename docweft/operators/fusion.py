"""Fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, score: str, key: str = "chunk_id", by: str = "query_id") -> DataFrame:
    """`df` with rank from 1 by score; equal scores (to 9 places) go by key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.round(score, 9).desc(), key)))


def reciprocal_rank(runs: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = 60, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, via, ranks): the sum over runs of weight / (k + rank).

    Runs have query_id, `key` and rank. via names the runs that found the row, ranks maps each to its rank.
    """
    weights = weights or {}
    all_runs = [df.select("query_id", key, F.lit(name).alias("run"), F.col("rank").cast("int").alias("rank"), F.lit(float(weights.get(name, 1.0))).alias("w")) for name, df in runs.items()]
    rows = reduce(lambda a, b: a.unionByName(b), all_runs)
    fused = rows.groupBy("query_id", key).agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), F.array_sort(F.collect_list(F.struct("run", "rank"))).alias("found"))
    return fused.select("query_id", key, "score", F.array_join(F.transform("found", lambda x: x["run"]), "+").alias("via"), F.map_from_entries("found").alias("ranks"))


def with_provenance(runs: dict[str, DataFrame], key: str = "chunk_id") -> DataFrame:
    """(query_id, key, sources): which of the runs have the row."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select("query_id", key, F.lit(name).alias("run")) for name, df in runs.items()])
    return rows.groupBy("query_id", key).agg(F.array_sort(F.collect_set("run")).alias("sources"))
