"""Searches for many by scans: the results of joins, without a row for each pair of query and chunk."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.functions import text as tx
from docweft.operators import lexical, scan
from docweft.plans import search_queries

SMOKE = "/root/testdata/sf0.001"
SCHEMA = "chunk_id string, source string, title string, filename string, folder string, heading string, body string, updated_at timestamp"
WORDS = ["배수펌프", "점검", "요청", "공조패널", "교체", "vpn", "접속안내", "12층", "누수", "센서"]


@pytest.fixture(scope="module")
def chunks(spark):
    texts = [" ".join(WORDS[(i * j + j) % len(WORDS)] for j in range(1, 2 + i % 5)) for i in range(300)]
    rows = [(f"c{i:03}", f"s{i % 7}", t.split()[0] if i % 3 else None, "f.md", "자료", None, None if i % 50 == 0 else t, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    return lexical.query_frame(spark, "배수펌프 점검 요청", "점검 요청 점검", "점검 점검 요청", "공조패널 교체", "없는말", "", "vpn 접속안내 12층 센서", "누수")


def rows(df, *columns):
    return sorted((*[r[c] for c in columns], round(r.score, 6), r["rank"]) for r in df.collect())


def no_pairs(*_, **__):
    raise AssertionError("pairs of query and chunk as rows")


@pytest.mark.parametrize("repeated", [True, False])
@pytest.mark.parametrize("k", [1, 7, 400])
def test_scanned_is_top_k_of_scores(chunks, asked, k, repeated):
    index = lexical.TermIndex(chunks, tokens=tx.lemma_tokens)
    own = index.scanned(asked, k, 1.2, tokens=tx.lemma_tokens, repeated=repeated)
    assert rows(own, "query_id", "chunk_id") == rows(lexical.top_k(index.scores(asked, 1.2, tokens=tx.lemma_tokens, repeated=repeated), k), "query_id", "chunk_id")


def test_scanned_in_small_blocks_and_parts(chunks, asked, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK_ROWS", 10)
    monkeypatch.setattr(scan.best_of_all, "__defaults__", (3,))
    index = lexical.TermIndex(chunks)
    assert rows(index.scanned(asked, 5), "query_id", "chunk_id") == rows(lexical.top_k(index.scores(asked), 5), "query_id", "chunk_id")


def test_many_queries_are_scanned_by_as_many_tasks_as_cores(spark, monkeypatch):
    """Each task sends on the best of every query, so splits of the rows would multiply them."""
    found = lambda batch, place: scan.Found([batch.column(0)], np.ones(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32), np.ones(batch.num_rows), np.zeros(batch.num_rows))
    asked = scan.Asked(np.arange(50), np.arange(51), np.zeros(50, np.int32), np.ones(50), ["t"])
    ids = spark.range(4_000, numPartitions=40)
    assert scan.best(ids, ["id"], asked, 10, found).count() == 40 * 50 * 10
    monkeypatch.setattr(scan, "SENT", 1_000)
    assert scan.best(ids, ["id"], asked, 10, found).count() <= spark.sparkContext.defaultParallelism * 50 * 10


def test_scanned_without_queries_or_chunks(chunks, asked):
    assert lexical.TermIndex(chunks).scanned(asked.filter("false"), 5).count() == 0
    assert lexical.TermIndex(chunks.filter("false")).scanned(asked, 5).count() == 0


def test_parts_of_queries_hold_no_rows(spark):
    sets = spark.range(20_000, numPartitions=8).selectExpr("id as set_id", "transform(sequence(0, 9), i -> named_struct('term', concat('t', cast((id + i) % 500 as string)), 'qtf', double(i))) as terms")
    tracemalloc.start()
    parts = list(scan.parts_of(sets))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000
    (asked,) = parts
    for i in (0, 7, 19_999):
        own = slice(asked.at[i], asked.at[i + 1])
        assert [asked.vocabulary[t] for t in asked.terms[own]] == [f"t{(asked.sets[i] + j) % 500}" for j in range(10)]
        assert list(asked.weights[own]) == list(range(10))
    small = list(scan.parts_of(sets.limit(7), 25))
    assert [len(p.sets) for p in small] == [2, 2, 2, 1]


def test_bm25_distinct_topk_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(lexical.TermIndex, "_sum", no_pairs)
    assert search_queries.bm25_distinct_topk(spark, SMOKE).count() > 0


def test_ngram_best_is_top_k_of_scores(chunks, asked):
    own = lexical.ngram_best_of(chunks, asked, 7)
    assert rows(own, "query_id", "chunk_id") == rows(lexical.top_k(lexical.ngram_scores_of(chunks, asked), 7), "query_id", "chunk_id")


def test_ngram_jaccard_titles_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ngram_scores_of", no_pairs)
    assert search_queries.ngram_jaccard_titles(spark, SMOKE).count() > 0


def test_eval_modes_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ngram_scores_of", no_pairs)
    monkeypatch.setattr(lexical.TermIndex, "_sum", no_pairs)
    assert {r["mode"] for r in search_queries.eval_modes(spark, SMOKE).collect()} == {"bm25", "ngram"}


def test_eval_complement_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ngram_scores_of", no_pairs)
    monkeypatch.setattr(lexical.TermIndex, "_sum", no_pairs)
    search_queries.eval_complement(spark, SMOKE).collect()


@pytest.mark.parametrize("limit", [3, 50])
def test_field_best_is_best_fields_of_scores(chunks, asked, limit):
    timed = chunks.withColumn("updated_at", F.when(F.crc32("chunk_id") % 3 > 0, F.timestamp_seconds(F.crc32("source") % 5)))
    old = lexical.best_fields_of(lexical.field_scores_of(timed, asked), timed, limit)
    own = lexical.field_best_of(timed, asked, limit)
    columns = ("query_id", "chunk_id", "match_score", "rank")
    assert sorted(map(tuple, own.select(*columns).collect())) == sorted(map(tuple, old.select(*columns).collect()))


def test_weighted_fields_v2_titles_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(lexical, "field_scores_of", no_pairs)
    assert search_queries.weighted_fields_v2_titles(spark, SMOKE).count() > 0


def test_weighted_fields_titles_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(lexical, "field_scores_of", no_pairs)
    assert search_queries.weighted_fields_titles(spark, SMOKE).count() > 0
