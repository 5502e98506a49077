"""Document trees, images and case files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import text as tx

IMAGE_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp"}


def relative_path(root: str) -> Column:
    """Path below `root` of the file a row comes from."""
    base = root.split("://", 1)[-1].rstrip("/")
    path = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^" + "".join("\\" + c if c in ".[]()*+?{}|^$\\" else c for c in base) + "/", "")


def decoded(content: Column) -> Column:
    """Text of UTF-8 bytes; bytes that are not UTF-8 come out as replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def markdown_tree(spark: SparkSession, root: str, skipped_folders: tuple[str, ...] = (), skipped_files: tuple[str, ...] = ()) -> DataFrame:
    """(source, title, customer, content) of all .md files below `root`; title is the stem, customer the first folder.

    Files of `skipped_folders` at the top and those named in `skipped_files` are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    rows = files.select(relative_path(root).alias("source"), decoded(F.col("content")).alias("content"))
    kept = rows.filter(~F.substring_index("source", "/", 1).isin(*skipped_folders or ("",)) & ~F.col("source").isin(*skipped_files or ("",)))
    first = F.when(F.contains("source", F.lit("/")), F.substring_index("source", "/", 1)).otherwise("")
    return kept.select("source", tx.stem(F.col("source")).alias("title"), first.alias("customer"), "content")


def image_assets(spark: SparkSession, root: str) -> DataFrame:
    """(path, mime_type, size_bytes, content) of the images below `root`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(relative_path(root).alias("path"), F.col("length").alias("size_bytes"), "content")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in IMAGE_TYPES.items() for x in pair]), F.lower(tx.suffix(F.col("path"))))
    return rows.select("path", kind.alias("mime_type"), "size_bytes", "content").filter("mime_type is not null")


def import_files(spark: SparkSession, root: str, endings: tuple[str, ...] = (".md", ".txt", ".docx", ".pdf", ".xlsx")) -> DataFrame:
    """(path, ending, content) of files to import, hidden ones left out, by path without regard to case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(relative_path(root).alias("path"), "content").withColumn("ending", F.lower(tx.suffix(F.col("path"))))
    return rows.filter(F.col("ending").isin(*endings) & tx.is_safe_path(F.col("path"))).select("path", "ending", "content").orderBy(F.lower("path"), "path")


def documents(spark: SparkSession, where: str, stored: bool) -> DataFrame:
    """Live documents (source, title, customer, content): of a stored table, or of a tree of files."""
    if not stored:
        return markdown_tree(spark, where)
    return spark.read.parquet(where).filter("deleted_at is null").select("source", "title", "customer", "content")


def document_index(docs: DataFrame) -> DataFrame:
    """Live documents without their contents, by source; the scan reads only these columns."""
    return docs.filter("deleted_at is null").select("source", "title", "customer", "updated_at").orderBy("source")


def cases_json(spark: SparkSession, path: str) -> DataFrame:
    """(query, expected_keywords, expected_document_ids) of a JSON list of cases."""
    schema = "query string, expected_keywords array<string>, expected_document_ids array<string>, question string, expected_source string, expected_title string"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.withColumn("query", F.coalesce("query", "question")).filter("query is not null and trim(query) != ''").drop("question")


def cases_csv(spark: SparkSession, path: str) -> DataFrame:
    """(question, expected_source, expected_title) of a CSV file with these headers."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return rows.select("question", "expected_source", "expected_title").filter("question is not null and trim(question) != ''")
