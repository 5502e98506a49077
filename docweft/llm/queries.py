"""The pN_ queries of this subpackage: (spark, folder of the tables) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import near_duplicates, packing, pii, quality, splitting, term_frequency, tokenizer
from docweft.session import once, table

Query = Callable[[SparkSession, str], DataFrame]


def _terms(spark: SparkSession, root: str) -> DataFrame:
    live = table(spark, root, "maintenance_docs").filter("deleted_at is null")
    return term_frequency.term_frequencies(live, "doc_pk", "content")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return _terms(spark, root).filter("mark is not null").select("term", "mark")


def p1_counts(spark: SparkSession, root: str) -> DataFrame:
    return _terms(spark, root).select("term", "occurrences", "doc_freq", "n_docs", "mark")


def _duplicates(spark: SparkSession, root: str) -> near_duplicates.NearDuplicates:
    return near_duplicates.NearDuplicates(near_duplicates.records_of({"maintenance_docs": (table(spark, root, "maintenance_docs"), "doc_pk"), "maintenance_requests": (table(spark, root, "maintenance_requests"), "idx")}))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _duplicates(spark, root).pairs()


def p2_groups(spark: SparkSession, root: str) -> DataFrame:
    return _duplicates(spark, root).groups()


def _masked(spark: SparkSession, root: str) -> DataFrame:
    docs = pii.mask_fields(table(spark, root, "maintenance_docs"), "doc_pk", ["content"])
    tickets = pii.mask_fields(table(spark, root, "maintenance_requests"), "idx", ["content", "notes"])
    parts = ((docs, "doc_pk", "maintenance_docs"), (tickets, "idx", "maintenance_requests"))
    first, second = (df.select(F.lit(name).alias("tbl"), F.col(key).alias("rec_id"), "fld", "masked", "types", "n_items") for df, key, name in parts)
    return first.unionByName(second)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return _masked(spark, root).select("tbl", "rec_id", "fld", F.explode("types").alias("pii_type")).distinct()


def p4_masked(spark: SparkSession, root: str) -> DataFrame:
    return _masked(spark, root).select("tbl", "rec_id", "fld", "masked", "n_items")


def _pieces(spark: SparkSession, root: str) -> DataFrame:
    docs = splitting.split_texts(once(table(spark, root, "maintenance_docs"), "doc_pk"), ["source"], "content")
    chunks = splitting.split_texts(table(spark, root, "chunks"), ["chunk_id"], "body")
    return docs.withColumnRenamed("source", "item_id").withColumn("tbl", F.lit("maintenance_docs")).unionByName(chunks.withColumnRenamed("chunk_id", "item_id").withColumn("tbl", F.lit("chunks")))


def p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    return _pieces(spark, root)


def p5_joined(spark: SparkSession, root: str) -> DataFrame:
    """The texts that the pieces make when put together without their overlaps, and the pieces' faults."""
    made = _pieces(spark, root).withColumn("new", F.expr("substring(piece, fresh - start + 1)"))
    wrong = F.when((F.length("piece") > 1200) | (F.length("piece") != F.col("end") - F.col("start")) | ((F.col("piece_no") > 0) & (F.col("fresh") - F.col("start") != 150)), 1).otherwise(0)
    joined = made.groupBy("tbl", "item_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "new"))).alias("all"), F.sum(wrong).alias("faults"), F.max("n_pieces").alias("n"), F.count("*").alias("pieces"))
    return joined.select("tbl", "item_id", F.md5(F.array_join("all.new", "")).alias("text_md5"), "faults", (F.col("n") == F.col("pieces")).alias("counted"), (F.col("n") > 1).alias("divided"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    docs = splitting.split_texts(table(spark, root, "maintenance_docs"), ["source"], "content")
    chunks = splitting.split_texts(table(spark, root, "chunks"), ["chunk_id"], "body")
    cut = docs.withColumn("tbl", F.lit("maintenance_docs")).withColumnRenamed("source", "item_id").unionByName(chunks.withColumn("tbl", F.lit("chunks")).withColumnRenamed("chunk_id", "item_id"))
    return cut.filter("n_pieces > 1 and piece_no = 0").select("tbl", "item_id").distinct()


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, root, "documents"))


def p6_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """The texts that the ids stand for."""
    return tokenizer.decode_corpus(p6_ids(spark, root)).select("doc_id", F.md5("text").alias("text_md5"))


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill_containers(table(spark, root, "documents"))


def p7_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Of each document, faults of its pieces; as one more row, under no id, those of the containers."""
    made = p7_containers(spark, root)
    of_docs = made.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("pieces"), F.max(F.col("start") + F.col("n_tokens")).alias("reach"), F.countDistinct("piece_no").alias("numbers"))
    wrong = (F.col("reach") != F.col("size")) | (F.col("numbers") != F.col("pieces")) | (F.col("pieces") != F.ceil(F.col("size") / 8192))
    over = made.groupBy("container_id").agg(F.sum("n_tokens").alias("load")).agg(F.count(F.when(F.col("load") > 8192, 1)).alias("faults"))
    return of_docs.select("doc_id", F.when(wrong, 1).otherwise(0).cast("bigint").alias("faults")).unionByName(over.select(F.lit(None).cast("bigint").alias("doc_id"), "faults"))


def p8_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality.text_quality(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "common_words"))


def p8_statistics(spark: SparkSession, root: str) -> DataFrame:
    names = "n_chars n_lines n_words mean_word_length symbol_ratio punctuation_line_share bullet_line_share common_word_share repeated_line_share".split()
    return p8_quality(spark, root).select("doc_id", *names)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return quality.unfit(p8_quality(spark, root), "doc_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_groups, p4_found, p4_masked, p5_found, p5_pieces, p5_joined, p6_ids, p6_round_trip, p7_containers, p7_coverage, p8_found, p8_quality, p8_statistics)}
