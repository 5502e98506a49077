"""Ticket CSV files, read strictly: a file that is not as agreed is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators.csv_repair import TICKET_COLUMNS, _typed


def read_tickets(spark: SparkSession, path: str, columns: dict[str, str] = TICKET_COLUMNS) -> DataFrame:
    """Typed tickets of CSV files with headers, in any order of columns; blank records are left out.

    A missing column, or an idx that is no number, is an error. Lenient loading with reasons is
    docweft.operators.csv_repair.
    """
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("encoding", "UTF-8").csv(path)
    plain = rows.toDF(*[c.replace("﻿", "").strip() for c in rows.columns])
    missing = [c for c in columns if c not in plain.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    full = plain.select(*columns).filter(F.length(F.trim(F.concat_ws("", *columns))) > 0)
    typed = full.select(*[_typed(F.col(c), kind).alias(c) for c, kind in columns.items()], F.col("idx").alias("_idx"))
    checked = F.when(F.col("idx").isNull(), F.raise_error(F.concat(F.lit("idx is no number: "), F.coalesce("_idx", F.lit("")))).cast(columns["idx"])).otherwise(F.col("idx"))
    return typed.withColumn("idx", checked).drop("_idx")
