"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweft.plans import csv_queries, graph_queries, more_queries, search_queries, store_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = [text_queries, search_queries, graph_queries, store_queries, csv_queries, more_queries]


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
