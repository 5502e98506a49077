"""Candidates for a domain dictionary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as tx

#: Words that are never dictionary terms.
STOP = ("있습니다", "합니다", "입니다", "합니다만", "때문", "경우", "관련", "대한", "위한", "통해", "이후", "이전", "내용", "확인", "가능", "사용", "진행", "처리", "필요", "해당", "다음", "아래", "위의", "그리고", "하지만", "또한", "등을", "등의", "http", "https", "www", "com", "kr", "co", "html", "php", "index", "추가", "작업", "요약", "보고서", "작성", "수정", "방법", "고객사", "직접", "매뉴얼", "출처", "원문", "유의사항", "정보", "설명", "기준", "이용", "제공", "아니오", "네", "예시", "참고", "문서", "항목", "부분", "이것", "그것")


def term_statistics(docs: DataFrame) -> DataFrame:
    """(term, doc_freq, customers) over documents (content, customer): a term counts once in a document."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit("([가-힣]{2,}|[a-z][a-z0-9._-]{1,})")))
    rows = docs.select("customer", F.explode(terms).alias("term")).filter(~F.col("term").isin(*STOP))
    # Two steps: the first adds up by term and customer, so that no term's rows have to meet in one place.
    by_customer = rows.groupBy("term", "customer").agg(F.count("*").alias("n"))
    return by_customer.groupBy("term").agg(F.sum("n").alias("doc_freq"), F.count("customer").alias("customers"))


def mine(docs: DataFrame, known: Sequence[str] = (), top: int = 80, min_docs: int = 3, max_share: float = 0.35, customers: DataFrame | None = None) -> DataFrame:
    """(term, doc_freq, share, customers, score): the `top` terms that are frequent, not general, and kept to few customers.

    Known terms, inflected words and pieces of names are left out. Equal scores go by term. `customers` has one row
    with n_customers, the number of all customers there are, such as those of the graph; else those of `docs` count.
    """
    if customers is None:
        customers = docs.agg(F.countDistinct("customer").alias("n_customers"))
    total = docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_docs")).join(F.broadcast(customers.select(F.greatest("n_customers", F.lit(1)).alias("n_customers"))))  # one row each
    rows = term_statistics(docs).filter((F.col("doc_freq") >= min_docs) & ~F.col("term").isin(*known or ("",)) & ~tx.is_noise_term(F.col("term"))).join(F.broadcast(total))
    share = F.col("doc_freq") / F.col("n_docs")
    focus = 1.0 - F.least(F.col("customers") / F.col("n_customers"), F.lit(1.0))
    scored = rows.withColumn("raw", share).filter(F.col("raw") <= max_share).select("term", "doc_freq", F.round("raw", 4).alias("share"), "customers", F.round(F.col("doc_freq") * (1.0 - F.col("raw")) * (0.3 + 0.7 * focus), 2).alias("score"))
    return scored.orderBy(F.desc("score"), "term").limit(top)
