"""Quality of ranked results against cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(ranked: DataFrame, matches: Column, by: str = "query_id") -> DataFrame:
    """(query_id, first_rank) of the queries with a matching result; `matches` is a condition on its columns."""
    return ranked.filter(matches).groupBy(by).agg(F.min("rank").alias("first_rank"))


def metrics(cases: DataFrame, first: DataFrame, cuts: tuple[int, ...] = (1, 3, 5), by: str = "query_id") -> DataFrame:
    """(n, hit_1, hit_3, hit_5, mrr): shares of cases found within the cuts, and the mean reciprocal rank."""
    rows = cases.select(by).distinct().join(first, by, "left")
    shares = [F.coalesce(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"hit_{k}") for k in cuts]
    return rows.agg(F.count("*").alias("n"), *shares, F.coalesce(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def compared(cases: DataFrame, runs: dict[str, DataFrame], matches: Column, cuts: tuple[int, ...] = (1, 3, 5), by: str = "query_id") -> DataFrame:
    """(mode, n, hits, mrr): metrics() of each of several runs; `matches` is a condition on columns of run and case."""
    parts = [metrics(cases, first_match(run.join(cases, by), matches, by), cuts, by).withColumn("mode", F.lit(name)) for name, run in runs.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def recall(cases: DataFrame, ranked: DataFrame, k: int, by: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """(recall): mean over cases (query_id, `key`) of the share of their relevant rows among the first `k`."""
    hit = cases.join(ranked.filter(F.col("rank") <= k).select(by, key, F.lit(1).alias("_hit")), [by, key], "left")
    return hit.groupBy(by).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("r")).agg(F.avg("r").alias("recall"))


def keyword_match(text: Column, keywords: Column) -> Column:
    """Whether any keyword stands in the text, without regard to case and blanks."""
    dense = F.lower(F.regexp_replace(text, r"\s+", ""))
    return F.exists(keywords, lambda k: F.contains(dense, F.lower(F.regexp_replace(k, r"\s+", ""))))


def complement(solved_a: DataFrame, solved_b: DataFrame, by: str = "query_id") -> DataFrame:
    """(query_id, solved_by): a only, b only or both."""
    both = solved_a.select(by, F.lit(True).alias("a")).distinct().join(solved_b.select(by, F.lit(True).alias("b")).distinct(), by, "full")
    return both.select(by, F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "a only").otherwise("b only").alias("solved_by"))
