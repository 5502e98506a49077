"""Tickets: texts made of them, search, and their way into the graph."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docweft.functions import text as tx
from docweft.functions.casts import strip
from docweft.session import once

#: Fields of a ticket's search text, and those of its summary with their labels.
SEARCH_FIELDS = ("idx", "user_id", "contact_person", "manager_id", "worker_id", "type_id", "status_id", "title", "report_title", "content", "issues", "progress_status", "notes", "request_date", "expected_date", "completed_date", "created_at", "updated_at")
SUMMARY = {"접수번호": "idx", "고객사": "user_id", "제목": "title", "보고서 제목": "report_title", "상태 ID": "status_id", "유형 ID": "type_id", "담당자 ID": "manager_id", "작업자 ID": "worker_id", "요청일": "request_date", "예정일": "expected_date", "완료일": "completed_date", "긴급": "is_urgent", "진행률": "progress_rate", "진행상태": "progress_status"}


@F.pandas_udf(StringType())
def _unescaped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references resolved; the JVM has no function for them."""
    for texts in batches:
        yield texts.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def without_markup(text: Column) -> Column:
    """HTML without tags: breaks and ends of blocks as line feeds, runs of blanks as one."""
    lines = F.regexp_replace(F.regexp_replace(text, r"(?i)<\s*br\s*/?>", "\n"), r"(?i)</\s*(p|div|li|tr|h[1-6])\s*>", "\n")
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, r"<[^>]+>", ""), r"[ \t\r\f\x0B]+", " "), r"\n{3,}", "\n\n"))


def html_to_text(text: Column) -> Column:
    """Text of HTML or plain contents; character references are resolved first, so tags written as such go too."""
    return without_markup(_unescaped(F.replace(F.coalesce(text, F.lit("")), F.lit("&nbsp;"), F.lit(" "))))


def ticket_title() -> Column:
    idx = F.col("idx").cast("string")
    title = strip(F.coalesce(F.nullif("title", F.lit("")), F.nullif("report_title", F.lit("")), F.concat(F.lit("접수 "), idx)))
    return F.concat(F.lit("["), idx, F.lit("] "), title)


def ticket_source(folder: str) -> Column:
    return F.concat(F.lit(f"{folder}/접수_"), F.col("idx").cast("string"), F.lit(".md"))


def search_text(plain_content: Column) -> Column:
    """All fields of a ticket as one line; `plain_content` is its content without markup."""
    parts = [plain_content if f == "content" else F.col(f).cast("string") for f in SEARCH_FIELDS]
    named = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in SEARCH_FIELDS]
    return tx.collapsed(F.concat_ws("\n", *[F.when(p != "", p) for p in parts], *named))


def markdown(columns: list[str]) -> Column:
    """A ticket as a document: title, summary, content, issues, notes and a table of all fields."""
    urgent = F.when(F.col("is_urgent"), "예").otherwise("아니오")
    value = {label: urgent if f == "is_urgent" else F.col(f).cast("string") for label, f in SUMMARY.items()}
    lines = [F.when(strip(F.coalesce(v, F.lit(""))) != "", F.concat(F.lit(f"- {label}: "), tx.markdown_value(v))) for label, v in value.items()]
    body = html_to_text(F.col("content"))
    sections = [F.when(body != "", F.concat(F.lit("\n## 요청 내용\n\n"), F.replace(tx.markdown_value(body), F.lit("<br>"), F.lit("\n"))))]
    sections += [F.when(strip(F.coalesce(f, F.lit(""))) != "", F.concat(F.lit(f"\n## {name}\n\n"), tx.markdown_value(F.col(f)))) for name, f in (("이슈", "issues"), ("메모", "notes"))]
    table = [F.concat(F.lit(f"| `{c}` | "), tx.markdown_value(F.col(c)), F.lit(" |")) for c in columns]
    return F.concat(F.concat_ws("\n", F.concat(F.lit("# "), ticket_title()), F.lit(""), F.lit("## 접수 요약"), F.lit(""), *lines, *sections, F.lit("\n## CSV 원본 필드\n\n| field | value |\n|---|---|"), *table), F.lit("\n"))


def unique_tickets(tickets: DataFrame) -> DataFrame:
    """One row per idx: of those that came again, the last import."""
    return once(tickets, "idx", latest=("imported_at", "last_import_id"))


def graph_tickets(tickets: DataFrame, limit: int | None = 4000) -> DataFrame:
    """Tickets as the graph takes them, latest first; `limit` (1 to 20,000) keeps the first."""
    rows = tickets.select("idx", strip(F.coalesce("user_id", F.lit(""))).alias("customer"), "manager_id", "worker_id", "type_id", "status_id", strip(F.coalesce("title", F.lit(""))).alias("title"), "request_date", "completed_date", F.coalesce("is_urgent", F.lit(False)).alias("is_urgent"), "source")
    return rows.orderBy(F.desc_nulls_last("request_date"), F.desc("idx")).limit(max(1, min(limit, 20_000))) if limit is not None else rows


def search(tickets: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Tickets (with search_text) that match all words, rescored, best first.

    In matching, % and _ of a word stand for any text and any character; in scoring they are themselves. The
    latest min(max(10 * limit, 100), 500) matches are scored: number 100, whole query in the title 20 or else in the
    text 10, and each word in title 5, customer 3, text 1. Equal scores go by latest change, then by number.
    """
    query, limit = query.strip(), max(1, min(limit, 50))
    terms = query.split()
    matched = tickets
    for t in terms:
        matched = matched.filter(F.col("search_text").ilike(f"%{t}%"))
    latest = matched.orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("request_date"), F.desc("idx")).limit(min(max(limit * 10, 100), 500))
    title, user, text = (F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "user_id", "search_text"))
    score = F.lit(0)
    if query:
        whole = F.lit(query.lower())
        score = F.when(F.col("idx").cast("string") == query, 100).otherwise(0) + F.when(F.contains(title, whole), 20).when(F.contains(text, whole), 10).otherwise(0)
    for t in terms:
        for field, weight in ((title, 5), (user, 3), (text, 1)):
            score = score + F.when(F.contains(field, F.lit(t.lower())), weight).otherwise(0)
    scored = latest.withColumn("score", score)
    return scored.orderBy(F.desc("score"), F.desc_nulls_last("updated_at"), F.desc("idx")).limit(limit).withColumn("snippet", tx.snippet(F.lit(query), F.col("search_text")))


def row_hash(columns: list[str]) -> Column:
    """Hash of a row's values under their names, in the order of names."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(columns)])), 256)
