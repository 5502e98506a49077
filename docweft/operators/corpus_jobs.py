"""Batch jobs over whole corpora: counts, inventories, cleaning and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as tx
from docweft.functions.casts import strip


def docs_per_folder(docs: DataFrame, folders: DataFrame) -> DataFrame:
    """(name, doc_count): live documents by customer, system documents left out; folders without any count 0."""
    live = docs.filter("deleted_at is null").dropDuplicates(["source"]).filter(~tx.is_system_document(F.col("source")))
    counts = live.groupBy(F.coalesce("customer", F.lit("")).alias("name")).agg(F.count("*").alias("doc_count"))
    return counts.join(folders.select("name").distinct(), "name", "full").select("name", F.coalesce("doc_count", F.lit(0)).cast("bigint").alias("doc_count"))


def corpus_totals(docs: DataFrame, chunks: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(documents, customers, chunks, bytes, assets, asset_bytes): live documents, their chunks, live assets; 0 where there are none.

    assets have path, size_bytes and deleted_at.
    """
    live = docs.filter("deleted_at is null").dropDuplicates(["source"])
    own = live.agg(F.count("*").alias("documents"), F.countDistinct("customer").alias("customers"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("bigint").alias("bytes"))
    cut = chunks.join(live.select("source"), "source", "left_semi").agg(F.count("*").alias("chunks"))
    if assets is None:
        held = docs.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("assets"), F.lit(0).cast("bigint").alias("asset_bytes"))
    else:
        held = assets.filter("deleted_at is null").agg(F.count("*").alias("assets"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("asset_bytes"))
    return own.join(F.broadcast(cut)).join(F.broadcast(held))  # one row each


def content_status(before: DataFrame, after: DataFrame, key: str = "source", text: str = "content") -> DataFrame:
    """(key, status): same, changed, added or removed, by hash of the text."""
    a = before.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("_a"))
    b = after.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("_b"))
    return a.join(b, key, "full").select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "same").otherwise("changed").alias("status"))


def cleaned(docs: DataFrame) -> DataFrame:
    """`docs` with content made readable, and status: changed, same, or refused where visible characters would change."""
    visible = lambda c: F.regexp_replace(c, r"(?U)[\s﻿]+", "")
    new = tx.readable(F.col("content"))
    status = F.when(F.col("content").isNull(), "same").when(visible(F.col("content")) != visible(new), "refused").when(F.col("content") == new, "same").otherwise("changed")
    return docs.withColumn("status", status).withColumn("content", F.when(F.col("status") == "changed", new).otherwise(F.col("content")))


def inventory(files: DataFrame) -> DataFrame:
    """(kind, n, bytes) of files (path, size) by their ending."""
    kind = F.lower(tx.suffix(F.col("path")))
    return files.groupBy(F.when(kind == "", "(none)").otherwise(kind).alias("kind")).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def classified(docs: DataFrame) -> DataFrame:
    """(source, kind) of documents by their keywords."""
    return docs.select("source", tx.document_kind(tx.stem(F.col("source")), F.col("content")).alias("kind"))


def company_of(path: str, marker: str, unsorted: str = "99_기타_미분류"):
    """Company of a document from its path: the folder after the part `marker`, or the name of a file right in it."""
    parts = F.split(F.col(path), "/")
    at = F.array_position(parts, marker)
    part = F.get(parts, at.cast("int"))
    name = F.regexp_replace(F.regexp_replace(part, r"\.[^.]*$", ""), r"[_\s]+", " ")
    return F.when((at > 0) & (F.size(parts) > at), strip(name)).otherwise(unsorted)


def import_summary(rows: DataFrame, stored: DataFrame, key: str = "source", text: str = "content") -> DataFrame:
    """(created, updated, skipped): rows that are new, differ from what is stored, or do not."""
    own = rows.join(stored.select(key, F.col(text).alias("_old"), F.lit(True).alias("_had")), key, "left")
    return own.agg(F.count_if(F.col("_had").isNull()).alias("created"), F.count_if(F.col("_had") & ~F.col(text).eqNullSafe(F.col("_old"))).alias("updated"), F.count_if(F.col("_had") & F.col(text).eqNullSafe(F.col("_old"))).alias("skipped"))


def asset_matches(wanted: DataFrame, assets: DataFrame) -> DataFrame:
    """(source, ref, path): the stored asset for each image reference of a document, by the first way that finds one.

    1 the path itself, 2 the same file name anywhere, 3 a numbered image of the document's images folder,
    4 there a file whose name holds the reference's. Of several, the first path.
    """
    name = F.regexp_replace(F.col("ref"), r"^.*/", "")
    folder = tx.dirname(F.col("source"))
    doc = F.regexp_replace(tx.stem(F.col("source")), r"_\d{8}$", "")
    asked = wanted.select("source", "ref", F.when(folder != "", F.concat(folder, F.lit("/"), F.col("ref"))).otherwise(F.col("ref")).alias("direct"), name.alias("name"), F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), F.lit("images")).alias("folder"), doc.alias("doc"), F.regexp_extract(name, r"(?i)^image(?:\s+(\d+))?\.[A-Za-z0-9]+$", 1).alias("number"), name.rlike(r"(?i)^image(?:\s+\d+)?\.[A-Za-z0-9]+$").alias("numbered"), F.replace(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(" "), F.lit("_")).alias("stem"))
    held = assets.select("path", tx.basename(F.col("path")).alias("file"), tx.dirname(F.col("path")).alias("folder"))
    exact = asked.join(held, asked["direct"] == held["path"]).select("source", "ref", "path", F.lit(1).alias("way"))
    named = asked.join(held, asked["name"] == held["file"]).select("source", "ref", "path", F.lit(2).alias("way"))
    near = asked.join(held.withColumnRenamed("folder", "_f"), F.col("_f") == F.col("folder"))
    tag = F.when(F.col("number") != "", F.concat(F.lit("image_"), F.col("number"), F.lit("_"))).otherwise("image_")
    numbered = near.filter(F.col("numbered") & (F.contains("file", F.concat(F.col("doc"), F.lit("_"), tag)) | F.contains("file", tag))).select("source", "ref", "path", F.lit(3).alias("way"))
    held_in = near.filter((F.col("stem") != "") & F.contains(F.regexp_replace("file", r"\.[^.]*$", ""), F.col("stem"))).select("source", "ref", "path", F.lit(4).alias("way"))
    every = exact.unionByName(named).unionByName(numbered).unionByName(held_in)
    first = F.row_number().over(Window.partitionBy("source", "ref").orderBy("way", "path"))
    return every.withColumn("n", first).filter("n = 1").select("source", "ref", "path")


def canonical_customer(names: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(name, canonical): by the alias map, else without a bracketed ending by the map, else blanks as underscores."""
    known = names.sparkSession.createDataFrame(list(aliases.items()) or [("", "")], "_a string, _c string")
    bare = F.regexp_replace("name", r"\s*\([^()]*\)\s*$", "")
    own = names.select("name").distinct().withColumn("_b", bare)
    one = own.join(F.broadcast(known), own["name"] == F.col("_a"), "left").drop("_a").withColumnRenamed("_c", "_c1")
    two = one.join(F.broadcast(known), F.col("_b") == F.col("_a"), "left").drop("_a")
    return two.select("name", F.coalesce("_c1", "_c", F.replace("_b", F.lit(" "), F.lit("_"))).alias("canonical"))


def organised(docs: DataFrame, marker: str, folders: dict[str, str]) -> DataFrame:
    """(source, company, kind, target): where each document belongs, by company, kind and a name of its own.

    `folders` maps kinds to folder names; a kind without one keeps its own name. Targets are unique.
    """
    from docweft.operators.store import unique_names

    named = docs.select("source", company_of("source", marker).alias("company"), tx.document_kind(tx.stem(F.col("source")), F.col("content")).alias("kind"))
    folder = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in folders.items() for x in pair]), F.col("kind")), F.col("kind")) if folders else F.col("kind")
    target = F.concat_ws("/", tx.safe_name(F.col("company")), folder, F.concat(tx.safe_name(tx.stem(F.col("source"))), F.lower(tx.suffix(F.col("source")))))
    return unique_names(named.withColumn("target", target), docs.sparkSession.createDataFrame([], "target string"), "target", ["source"])


def simplified(docs: DataFrame, stamp: str, default: str, images: tuple[str, str]) -> DataFrame:
    """`docs` (source, customer, content) with target and content for a flat layout: short names, links to `images[1]`."""
    kinds = (*tx.DOCUMENT_KINDS, tx.DEFAULT_KIND)
    name = tx.simplified_name(F.col("source"), F.col("customer"), kinds, stamp, default)
    return docs.withColumn("target", F.concat_ws("/", "customer", name)).withColumn("content", tx.relinked(F.col("content"), *images))


def handbook_blocks(handbooks: DataFrame, text: str, aliases: dict[str, str]) -> DataFrame:
    """`handbooks` cut into blocks, each with the canonical name of the customer it is about."""
    from docweft.operators.chunking import customer_blocks

    blocks = customer_blocks(handbooks, text)
    names = canonical_customer(blocks.select(F.col("customer").alias("name")), aliases)
    return blocks.join(names.withColumnRenamed("name", "customer"), "customer").drop("customer").withColumnRenamed("canonical", "customer")
