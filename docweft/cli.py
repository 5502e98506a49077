"""Batch jobs from the command line: python -m docweft.cli JOB ... (spark-submit docweft/cli.py JOB ...)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators import chunking, csv_repair, store, terms
from docweft.operators import graph as gr
from docweft.session import SESSION_CONF
from docweft.sources import converters, files, ticket_csv


def _save(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def load_tree(spark: SparkSession, a: argparse.Namespace) -> None:
    """Markdown files below SOURCE into a document table."""
    docs = files.markdown_tree(spark, a.source)
    stamp = F.current_timestamp()
    _save(docs.withColumns({"created_at": stamp, "updated_at": stamp, "deleted_at": F.lit(None).cast("timestamp")}), a.out)


def load_files(spark: SparkSession, a: argparse.Namespace) -> None:
    """Office and text files below SOURCE into markdown; files that fail come out with their error."""
    _save(converters.converted(files.import_files(spark, a.source)), a.out)


def load_tickets(spark: SparkSession, a: argparse.Namespace) -> None:
    """Ticket CSV files, read strictly."""
    _save(ticket_csv.read_tickets(spark, a.source), a.out)


def load_records(spark: SparkSession, a: argparse.Namespace) -> None:
    """Raw ticket records: valid ones typed into OUT/tickets, the others with reasons and edits into OUT/rejected."""
    parsed = csv_repair.parse_records(spark.read.parquet(a.source).filter("record_no > 1"), "raw_id", "raw_record")
    _save(csv_repair.typed_rows(parsed, "raw_id"), f"{a.out}/tickets")
    _save(parsed.filter(F.size("reasons") > 0), f"{a.out}/rejected")


def build_index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Chunks of the live documents of SOURCE; with --old, only changed ones are made anew."""
    docs = spark.read.parquet(a.source).filter("deleted_at is null").dropDuplicates(["source"])
    new = chunking.search_chunks(docs).withColumn("body_hash", F.sha2("body", 256))
    if not a.old:
        _save(new, a.out)
        return
    run = store.Sync(spark.read.parquet(a.old), new, force=a.force)
    _save(run.result, a.out)
    print(run.report.first().asDict())


def mine_terms(spark: SparkSession, a: argparse.Namespace) -> None:
    """Candidates for the domain dictionary from the documents of SOURCE."""
    _save(terms.mine(gr.graph_documents(spark.read.parquet(a.source)), top=a.top), a.out)


JOBS = {f.__name__.replace("_", "-"): f for f in (load_tree, load_files, load_tickets, load_records, build_index, mine_terms)}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        p = jobs.add_parser(name, help=job.__doc__)
        p.add_argument("source")
        p.add_argument("out")
        if name == "build-index":
            p.add_argument("--old")
            p.add_argument("--force", action="store_true")
        if name == "mine-terms":
            p.add_argument("--top", type=int, default=120)
    a = parser.parse_args(arguments)
    JOBS[a.job](spark or SparkSession.builder.config(map=SESSION_CONF).getOrCreate(), a)


if __name__ == "__main__":
    main()
