"""Excerpts and contexts from ranked chunks (query_id, rank, source, title, body, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as tx

# ---- Fixed values: words that make a sentence worth more, and the wording of answers ----------------------
IMPORTANT = ("id", "pw", "password", "vpn", "ftp", "host", "http", "https", "접속", "계정", "경로", "서버", "관리자", "주의")
NOTHING_FOUND = "관련 문서를 찾지 못했습니다. 고객사명이나 기능명을 더 구체적으로 입력해 주세요."
ANSWER_HEAD, GROUNDS_HEAD, SOURCES_HEAD = "## 검색 기반 답변", "### 핵심 근거", "### 참고 문서"
ANSWER_BEST = "질문과 가장 관련도가 높은 문서는 `%s`입니다."
SECTION, BULLET, SOURCE = "%d. `%s`", "   - ", "- `%s` / %s / score=%.3f"
START_CHARS = 220
# ------------------------------------------------------------------------------------------------------------


def sentence_scores(ranked: DataFrame, query: Column) -> DataFrame:
    """`ranked` with a row per sentence: place, sentence and value (query words in it, half for important words)."""
    rows = ranked.withColumn("_terms", F.array_distinct(tx.field_tokens(query))).select("*", F.posexplode(tx.sentences(F.col("body"))).alias("place", "sentence"))
    low = F.lower("sentence")
    hits = F.size(F.filter("_terms", lambda t: F.contains(low, t)))
    bonus = sum((F.when(F.contains(low, F.lit(w)), 0.5).otherwise(0.0) for w in IMPORTANT), F.lit(0.0))
    return rows.withColumn("value", hits + bonus).drop("_terms")


def cards(ranked: DataFrame, query: Column, most: int = 2500, per_chunk: int = 2, least: int = 15, least_rest: int = 80) -> DataFrame:
    """(query_id, rank, source, title, score, text): the best sentences of each chunk within `most` characters.

    A card takes the first `per_chunk` that are new among twice as many of the highest value, or else the first new
    one of the chunk; new is what no earlier card of the query has, and at least `least` characters long. The card
    that would go beyond `most` is cut, and left out with all after it if fewer than `least_rest` characters remain.
    Which sentences a card may take depends on the cards before, so a query's few chunks are folded in rank order.
    """
    one = F.struct((-F.col("value")).alias("worth"), "place", "sentence", F.trim(F.regexp_replace("sentence", r"(?U)\s+", " ")).alias("flat"))
    chunks = sentence_scores(ranked, query).groupBy("query_id", "rank", "source", "title", "score").agg(F.array_sort(F.collect_list(one)).alias("said"))
    whole = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "title", "score", "said"))).alias("chunks"))
    card = "array<struct<rank:bigint,source:string,title:string,score:double,text:string>>"
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast(card).alias("cards"), F.lit(most).alias("rest"))

    def fold(state: Column, chunk: Column) -> Column:
        new = lambda xs: F.filter(xs, lambda x, i: (F.length(x["flat"]) >= least) & ~F.array_contains(state["taken"], x["flat"]) & ~F.exists(F.slice(xs, F.lit(1), i), lambda y: y["flat"] == x["flat"]))
        best = F.slice(new(F.slice(chunk["said"], 1, 2 * per_chunk)), 1, per_chunk)
        by_place = F.array_sort(F.transform(chunk["said"], lambda x: F.struct(x["place"].alias("place"), x["sentence"].alias("sentence"), x["flat"].alias("flat"))))
        own = F.when(F.size(best) > 0, F.transform(best, lambda x: F.struct(x["place"].alias("place"), x["sentence"].alias("sentence"), x["flat"].alias("flat")))).otherwise(F.slice(new(by_place), 1, 1))

        def put(own: Column) -> Column:
            text = F.concat(F.lit("["), F.coalesce(chunk["source"], F.lit("")), F.lit(" / "), F.coalesce(chunk["title"], F.lit("")), F.lit("]\n"), F.array_join(F.transform(own, lambda x: x["sentence"]), "\n"))
            ends = (F.length(text) > state["rest"]) & (state["rest"] < least_rest)
            made = F.array(F.struct(chunk["rank"].cast("bigint").alias("rank"), chunk["source"].alias("source"), chunk["title"].alias("title"), chunk["score"].cast("double").alias("score"), F.substring(text, F.lit(1), state["rest"]).alias("text"))).cast(card)
            grown = F.struct(F.concat(state["taken"], F.transform(own, lambda x: x["flat"])).alias("taken"), F.concat(state["cards"], made).alias("cards"), F.greatest(state["rest"] - F.length(text), F.lit(0)).alias("rest"))
            return F.when(F.size(own) == 0, state).when(ends, F.struct(state["taken"].alias("taken"), state["cards"].alias("cards"), F.lit(0).alias("rest"))).otherwise(grown)

        return tx.let(own, put)

    folded = whole.select("query_id", F.inline(F.aggregate("chunks", start, fold, lambda s: s["cards"])))
    return folded.select("query_id", "rank", "source", "title", "score", "text")


def context(ranked: DataFrame, most: int = 5200) -> DataFrame:
    """(query_id, context): whole chunks in rank order, up to the first that would go beyond `most` characters."""
    item = F.concat(F.lit("[근거 "), F.col("rank").cast("string"), F.lit("] score="), F.format_string("%.3f", F.col("score")), F.lit("\n파일: "), F.col("source"), F.lit("\n섹션: "), F.col("title"), F.lit("\n"), F.col("body"), F.lit("\n"))
    so_far = F.sum(F.length("item")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    # Lengths are positive, so the running sum passes the limit once and stays beyond it.
    kept = ranked.withColumn("item", item).withColumn("so_far", so_far).filter(F.col("so_far") <= most)
    listed = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("items"))
    return listed.select("query_id", F.array_join(F.transform("items", lambda x: x["item"]), "\n---\n").alias("context"))


def budgeted(ranked: DataFrame, length: Column, most: int) -> DataFrame:
    """The ranked rows whose lengths add up to at most `most`, in rank order, with their running sum in used."""
    used = F.sum(length).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", used).filter(F.col("used") <= most)


def answers(ranked: DataFrame, bullets: int = 6, chunks: int = 3) -> DataFrame:
    """(query_id, answer): a markdown answer for each query, with statements of its first chunks and the list of sources."""
    # Of the chunks after the first few only the names are shown.
    first = F.col("rank") <= chunks
    said = F.when(first, F.slice(tx.readable_bullets(F.col("body")), 1, bullets)).otherwise(F.array().cast("array<string>"))
    start = F.when(first, F.substring(tx.collapsed(F.coalesce("body", F.lit(""))), 1, START_CHARS)).otherwise("")
    own = ranked.select("query_id", "rank", "source", "title", F.coalesce(F.nullif(F.transform(said, lambda b: F.concat(F.lit(BULLET), b)), F.array().cast("array<string>")), F.when(start != "", F.array(F.concat(F.lit(BULLET), start))), F.array().cast("array<string>")).alias("points"), F.format_string(SOURCE, "source", "title", "score").alias("line"))
    listed = own.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "title", "points", "line"))).alias("all"))
    parts = F.flatten(F.transform(F.slice("all", 1, chunks), lambda c: F.concat(F.array(F.format_string(SECTION, c["rank"], c["title"])), c["points"])))
    sources = F.transform(F.filter("all", lambda c, i: ~F.exists(F.slice(F.col("all"), F.lit(1), i), lambda d: (d["source"] == c["source"]) & (d["title"] == c["title"]))), lambda c: c["line"])
    head = F.array(F.lit(ANSWER_HEAD), F.lit(""), F.format_string(ANSWER_BEST, F.col("all")[0]["source"]), F.lit(""), F.lit(GROUNDS_HEAD))
    return listed.select("query_id", F.array_join(F.concat(head, parts, F.array(F.lit(""), F.lit(SOURCES_HEAD)), sources), "\n").alias("answer"))


def without_noise(ranked: DataFrame, query: Column) -> DataFrame:
    """Ranked chunks without those whose title says nothing for the query, ranks closed up; where none is left, the first."""
    kept = ranked.withColumn("_noise", tx.is_noise_title(query, F.col("title")))
    own = Window.partitionBy("query_id")
    some = kept.withColumn("_some", F.max(~F.col("_noise")).over(own)).filter(F.when(F.col("_some"), ~F.col("_noise")).otherwise(F.col("rank") == 1))
    return some.withColumn("rank", F.row_number().over(own.orderBy("rank")).cast(ranked.schema["rank"].dataType)).drop("_noise", "_some")


def extractive_answer(ranked: DataFrame, bullets: int = 6, chunks: int = 3) -> str:
    """answers() of the one query of `ranked`, or that nothing was found."""
    found = answers(ranked, bullets, chunks).first()
    return found.answer if found else NOTHING_FOUND
