import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.functions import plain
from docweft.operators import evaluation, fusion, hybrid, lexical, snippets, vector
from docweft.settings import DEFAULTS, merged

SYNONYMS = {"물이": ["누수", "물샘"], "새요": ["누수", "물샘"], "엘베": ["엘리베이터", "승강기"], "고장": ["점검", "유지보수"], "전기": ["차단기", "브레이커", "트립"], "내려감": ["차단기", "브레이커", "트립"], "에어컨": ["냉난방기", "공조기"], "냄새": ["필터", "청소", "점검"], "도면": ["평면도", "cad"], "확인": ["점검"], "as": ["수리", "점검"], "접수": ["요청", "처리"]}
ROWS = [
    ("facility/plumbing/leak.md", "누수 조치 내역", "배관 점검", "천장 물샘과 누수 발생 시 밸브를 잠그고 배관을 점검한다."),
    ("facility/elevator/check.md", "엘리베이터 점검", "승강기 유지보수", "승강기 고장 신고 접수 후 안전 점검을 진행한다."),
    ("facility/electric/breaker.md", "차단기 트립 대응 매뉴얼", "브레이커 점검", "전기 차단 및 브레이커 트립 발생 시 차단기를 확인한다."),
    ("facility/hvac/filter.md", "냉난방기 필터 청소", "공조기 점검", "에어컨 냄새가 날 때 필터를 교체하고 공조기를 점검한다."),
    ("facility/drawing/cad.md", "평면도 CAD 도면", "도면 확인", "시설 평면도와 CAD 파일 위치를 확인한다."),
    ("service/as.md", "A/S 처리 내역", "수리 접수", "as 접수와 점검 요청 처리 내역을 기록한다."),
]
def as_of():
    return F.lit("2026-05-19 00:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"c{i}", f"d{i}", s, t, s.rsplit("/", 1)[1], s.rsplit("/", 1)[0], h, b) for i, (s, t, h, b) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, source string, title string, filename string, folder string, heading string, body string")
    return df.withColumn("updated_at", as_of())


@pytest.mark.parametrize(("query", "title"), [("물이 새요", "누수 조치 내역"), ("엘베 고장", "엘리베이터 점검"), ("전기 내려감", "차단기 트립 대응 매뉴얼"), ("에어컨 냄새", "냉난방기 필터 청소"), ("도면 확인", "평면도 CAD 도면"), ("as 접수", "A/S 처리 내역")])
def test_golden_ranking(chunks, query, title):
    settings = merged(DEFAULTS, {"synonyms": SYNONYMS})
    found = hybrid.search(chunks, query, as_of(), 3, settings=settings).orderBy("rank").collect()
    assert found[0].title == title
    assert all(x.score >= y.score for x, y in zip(found, found[1:], strict=False))


def test_bm25_equals_a_plain_model(spark, chunks):
    corpus = {f"c{i}": plain.bm25_tokens("\n".join([t, h, s.rsplit("/", 1)[1], s.rsplit("/", 1)[0], s, b])) for i, (s, t, h, b) in enumerate(ROWS)}
    n, avg = len(corpus), sum(map(len, corpus.values())) / len(corpus)
    query = "점검 점검 도면 없는말"
    want = {}
    for key, tokens in corpus.items():
        tf, score = Counter(tokens), 0.0
        for t in plain.bm25_tokens(query):
            df = sum(t in x for x in corpus.values())
            if tf[t]:
                score += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(tokens) / avg))
        if score:
            want[key] = score
    got = {r.chunk_id: r.score for r in lexical.TermIndex(chunks).scores(lexical.query_frame(spark, query)).collect()}
    assert got == pytest.approx(want)


def test_stored_index(spark, chunks, tmp_path):
    index = lexical.TermIndex(chunks)
    index.write(str(tmp_path / "i"))
    stored = lexical.TermIndex.read(spark, str(tmp_path / "i"))
    query = "도면 점검 확인"
    own = {r.chunk_id: r.score for r in index.scores(lexical.query_frame(spark, query)).collect()}
    found = stored.scores_of(query)
    assert {r.chunk_id: r.score for r in found.collect()} == pytest.approx(own)
    assert "PushedFilters: [In(term" in found._jdf.queryExecution().toString()
    assert stored.scores_of("!").collect() == []


def test_ngram_scores_equal_sets(chunks):
    query = "엘베 고장 CAD"
    q = plain.ngram_set(query)
    want = {}
    for i, (s, t, h, b) in enumerate(ROWS):
        own = plain.ngram_set("\n".join([t, h, s.rsplit("/", 1)[1], s.rsplit("/", 1)[0], s, b]))
        want[f"c{i}"] = len(q & own) / len(q | own)
    assert {r.chunk_id: r.score for r in lexical.ngram_scores(lexical.ngram_features(chunks), query).collect()} == pytest.approx(want)
    assert {r.score for r in lexical.ngram_scores(lexical.ngram_features(chunks), "!").collect()} == {0.0}


def test_scores_of_many_queries_equal_those_of_each(spark, chunks):
    queries = ["엘베 고장 CAD", "점검 도면 9", "!", "as 처리내역을", "누수"]
    asked = lexical.query_frame(spark, *queries)
    many = {(r.query_id, r.chunk_id): r.score for r in lexical.ngram_scores_of(chunks, asked).collect()}
    fields = {(r.query_id, r.chunk_id): r.match_score for r in lexical.field_scores_of(chunks, asked).collect()}
    features = lexical.ngram_features(chunks)
    assert many == pytest.approx({(i, r.chunk_id): r.score for i, q in enumerate(queries) for r in lexical.ngram_scores(features, q).collect() if r.score})
    assert fields == {(i, r.chunk_id): r.match_score for i, q in enumerate(queries) for r in lexical.field_scores(chunks, plain.search_terms(q)).collect()}


def test_modes_and_sources(spark, chunks):
    near = spark.createDataFrame([("c3", 0.9), ("c1", 0.2)], "chunk_id string, similarity double")
    only = hybrid.search(chunks, "도면", as_of(), 5, "vector_only", vectors=near).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in only] == [("c3", 0.9), ("c1", 0.2)]
    assert hybrid.search(chunks, "도면", as_of(), 5, "vector_only").collect() == []
    both = {r.chunk_id: r.sources for r in hybrid.search(chunks, "도면", as_of(), 6, "no such mode", vectors=near).collect()}
    assert both["c3"] == ["bm25", "ngram", "vector"]
    assert hybrid.search(chunks, "도면", as_of(), 2, "bm25_only").orderBy("rank").first().score == 1.0


def test_debug_candidates(spark, chunks):
    near = spark.createDataFrame([("c3", 0.9)], "chunk_id string, similarity double")
    rows = hybrid.debug_candidates(hybrid.search(chunks, "도면", as_of(), 6, vectors=near), 2).collect()
    assert [r.chunk_id for r in rows if r.list == "vector"] == ["c3"]
    assert [r.place for r in rows if r.list == "final"] == [1, 2]
    assert next(r for r in rows if r.list == "bm25" and r.place == 1).scores["bm25"] == 1.0


def test_stored_search_needs_lexical_evidence(spark, chunks):
    docs = spark.createDataFrame([(s, t, "x", b, None) for s, t, _, b in ROWS], "source string, title string, customer string, content string, deleted_at timestamp")
    near = spark.createDataFrame([("c0", 0.99), ("c4", 0.5)], "chunk_id string, similarity double")
    found = hybrid.stored_search(chunks, docs, "도면", as_of(), vectors=near).collect()
    assert [r.chunk_id for r in found][0] == "c4"
    assert "c0" not in {r.chunk_id for r in found}
    assert "c0" in {r.chunk_id for r in hybrid.stored_search(chunks, docs, "도면", as_of(), vectors=near, semantic=True).collect()}
    gone = docs.withColumn("deleted_at", F.when(F.col("source").contains("cad"), as_of()))
    assert all(r.chunk_id != "c4" for r in hybrid.stored_search(chunks, gone, "도면", as_of()).collect())
    fallback = hybrid.stored_search(chunks.limit(0), docs, "누수", as_of()).collect()
    assert [r.source for r in fallback] == ["facility/plumbing/leak.md"]


def test_v2_search_and_rerank(spark, chunks):
    docs = spark.createDataFrame([(s, None) for s, *_ in ROWS], "source string, deleted_at timestamp")
    found = hybrid.search_v2(chunks, docs, "승강기 점검", as_of(), 3).orderBy(F.desc("score")).collect()
    assert found[0].chunk_id == "c1"
    turned = hybrid.search_v2(chunks, docs, "승강기 점검", as_of(), 3, rerank=lambda q, df: df.withColumn("score", -F.col("score"))).orderBy(F.desc("score")).collect()
    assert turned[0].chunk_id != "c1"


def test_grouping_takes_the_best_chunk(spark):
    chunks = spark.createDataFrame([("a1", "a", "s", "t", "h"), ("a2", "a", "s", "t", "h"), ("b1", "b", "s", "t", "h")], "chunk_id string, document_id string, source string, title string, heading string")
    ranked = spark.createDataFrame([(0, "a2", 3.0, 1), (0, "b1", 2.0, 2), (0, "a1", 1.0, 3)], "query_id bigint, chunk_id string, score double, rank int")
    got = [(r.document_id, r.chunk_id, r.related) for r in lexical.grouped_by_document(ranked, chunks, 5).orderBy("rank").collect()]
    assert got == [("a", "a2", ["a1"]), ("b", "b1", [])]


def test_fusion(spark):
    run = lambda *keys: spark.createDataFrame([(0, k, i + 1) for i, k in enumerate(keys)], "query_id bigint, chunk_id string, rank int")
    got = {r.chunk_id: r for r in fusion.reciprocal_rank({"x": run("a", "b"), "y": run("b", "c")}, {"y": 0.6}).collect()}
    assert got["b"].score == pytest.approx(1 / 62 + 0.6 / 61)
    assert (got["b"].via, got["b"].ranks) == ("x+y", {"x": 2, "y": 1})


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    m[7] = m[3]
    m[9] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(100, None), (101, []), (102, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    sims = np.round(unit @ unit.T, 9)
    want = {q: [i for _, i in sorted((-sims[q, i], i) for i in range(60) if i != q)][:5] for q in range(0, 60, 20)}
    for block in (4096, 1):
        got = {}
        for r in vector.nearest(df, df.filter("vec_id % 20 = 0 and vec_id < 60"), 5, clamp=False, scan_bytes=block).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
    assert vector.nearest(df.limit(0), df, 5).collect() == []
    assert vector.nearest(df, df.limit(0), 5).collect() == []


def test_metrics(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id bigint")
    ranked = spark.createDataFrame([(1, "a", 1), (2, "x", 1), (2, "b", 2), (3, "x", 1), (3, "y", 6)], "query_id bigint, chunk_id string, rank int")
    first = evaluation.first_match(ranked, F.col("chunk_id").isin("a", "b", "y"))
    r = evaluation.metrics(cases, first).first()
    assert (r.n, r.hit_1, r.hit_3, r.hit_5, r.mrr) == (4, 0.25, 0.5, 0.5, pytest.approx((1 + 0.5 + 1 / 6) / 4))
    assert evaluation.metrics(cases.limit(0), first).first().mrr == 0
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "query_id bigint, chunk_id string")
    assert evaluation.recall(wanted, ranked, 5).first().recall == 0.75
    assert sorted(tuple(r) for r in evaluation.complement(cases.limit(2), cases.filter("query_id > 1")).collect()) == [(1, "a only"), (2, "both"), (3, "b only"), (4, "b only")]


def test_cards_and_context(spark):
    body = "서버 접속 정보를 적은 문장입니다. 아무 뜻도 없는 긴 문장입니다. 서버 경로와 계정을 담은 문장입니다."
    ranked = spark.createDataFrame([(0, 1, "s1", "t1", body, 0.9), (0, 2, "s2", "t2", body, 0.5), (0, 3, "s3", "t3", "짧다", 0.4)], "query_id bigint, rank bigint, source string, title string, body string, score double")
    cards = snippets.cards(ranked, F.lit("서버 접속"), 2500, 2).orderBy("rank").collect()
    assert [c.source for c in cards] == ["s1", "s2"]
    assert "아무 뜻도" not in cards[0].text
    assert "아무 뜻도" in cards[1].text
    cut = snippets.cards(ranked, F.lit("서버 접속"), len(cards[0].text) + 20, 2).collect()
    assert len(cut) == 1
    text = snippets.context(ranked, 150).first().context
    assert text.startswith("[근거 1] score=0.900\n파일: s1\n섹션: t1\n")
    assert "[근거 2]" not in text
    assert snippets.context(ranked, 5200).first().context.count("\n---\n") == 2
    answer = snippets.extractive_answer(ranked)
    assert answer.startswith("## 검색 기반 답변")
    assert "- `s3` / t3 / score=0.400" in answer
    assert snippets.extractive_answer(ranked.limit(0)) == snippets.NOTHING_FOUND


def test_answer_filters(spark):
    ranked = spark.createDataFrame([("문서 개요", 1.0), ("점검", 0.8), ("밸브", 0.1)], "title string, score double")
    assert [r.title for r in hybrid.for_answer(ranked).collect()] == ["점검"]
    assert [r.title for r in hybrid.for_answer(ranked.limit(1)).collect()] == ["문서 개요"]


def test_legacy_cosine(spark, chunks):
    got = lexical.cosine_scores(chunks, "평면도 도면", F.col("body")).orderBy(F.desc("score")).first()
    assert got.chunk_id == "c4"
    assert 0 < got.score < 1


@pytest.mark.parametrize("hot", [0, 2, 5, 10**6])
def test_best_by_rare_terms_first_equals_scoring_all(spark, hot):
    rng = random.Random(6)
    vocabulary = ["점검", "밸브", "펌프", "교체", "승강기", "누수", "전기", "보고", "x1", "y2", "z3"]
    weights = [30, 12, 6, 5, 3, 2, 2, 1, 1, 1, 1]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    chunks = spark.createDataFrame([(f"c{i:03}", text(rng.randrange(1, 12))) for i in range(120)], "chunk_id string, body string")
    asked = spark.createDataFrame([(i, text(rng.randrange(1, 5))) for i in range(40)] + [(90, "점검"), (91, "점검 점검"), (92, "없는말"), (93, ""), (94, "점검")], "query_id bigint, query string")
    index = lexical.TermIndex(chunks, text=F.col("body"))
    flat = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 8)) for r in df.collect())
    for how in ({}, {"repeated": False, "k1": 1.2}):
        assert flat(index.best(asked, 4, hot=hot, **how)) == flat(lexical.top_k(index.scores(asked, **how), 4))


def test_index_of_cells_finds_most_neighbours(spark):
    gen = np.random.default_rng(3)
    m = gen.normal(size=(3000, 16)) + gen.normal(size=(12, 16))[gen.integers(0, 12, 3000)] * 1.5
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = df.filter("vec_id % 20 = 0 and vec_id < 3000")
    index = vector.Index(df, sample=1000, part_rows=20)
    exact, found = ({(r.query_id, r.id): r.similarity for r in f.collect()} for f in (vector.nearest(df, asked, 10, clamp=False), index.nearest(asked, 10, clamp=False)))
    assert len(set(exact) & set(found)) / len(exact) >= 0.9
    assert all(abs(exact[x] - found[x]) < 1e-8 for x in set(exact) & set(found))
    assert index.cells.count() == 3000
    every = index.nearest(asked, 10, probes=10**6, clamp=False)
    assert {(r.query_id, r.id) for r in every.collect()} == set(exact)
    empty = vector.Index(df.limit(0))
    assert empty.nearest(asked, 5).collect() == []


def test_noise_titles_leave_answers(spark):
    ranked = spark.createDataFrame([(0, 1, "문서 개요"), (0, 2, "점검"), (0, 3, "월간 보고서"), (1, 1, "본문")], "query_id bigint, rank bigint, title string")
    kept = lambda q: sorted((r.query_id, r.rank, r.title) for r in snippets.without_noise(ranked, F.lit(q)).collect())
    assert kept("밸브") == [(0, 1, "점검"), (1, 1, "본문")]
    assert kept("월간 보고서") == [(0, 1, "점검"), (0, 2, "월간 보고서"), (1, 1, "본문")]
