import datetime as dt

import pytest
from pyspark.sql import functions as F

from docweft.api import GraphCache, Portal
from docweft.operators import vector


@pytest.fixture(scope="module")
def portal(spark, data):
    return Portal(spark, data, as_of=dt.datetime(2026, 1, 1))


def test_search(portal):
    found = portal.search("배수펌프 점검 이력", 3).orderBy("rank").collect()
    assert len(found) == 3
    assert found[0].score >= found[-1].score
    assert portal.search_stored("배수펌프 점검", 3).count() == 3
    assert portal.search_v2("배수펌프 점검", 3).count() == 3
    assert portal.answer("배수펌프 점검").startswith("## 검색 기반 답변")
    assert portal.answer_context("서버 접속 경로").count() <= 3
    assert portal.find_documents("점검", 2).count() == 2
    assert portal.search_tickets("요청", 5).count() == 5
    assert portal.tree().count() == portal.docs.filter("deleted_at is null").count()


def test_graph(portal):
    counts = {(r.what, r.type): r.n for r in portal.stats()["counts"].collect()}
    assert counts["node", "Document"] == counts["edge", "HAS_DOCUMENT"]
    reached = portal.expand("SSL 인증서 갱신 이력", hops=1)["reached"]
    assert reached.count() > 0
    nodes, edges = portal.subgraph()
    assert nodes.filter("type = 'Chunk'").count() == 0
    assert portal.term_candidates(10).count() <= 10
    assert portal.meta().first().documents > 0


def test_graph_cache(portal):
    now = [0.0]
    cache = GraphCache(portal, ttl=100, cooldown=10, clock=lambda: now[0])
    first = cache.get()
    assert cache.get(refresh=True) is first
    now[0] = 50.0
    assert cache.get() is first
    assert cache.get(refresh=True) is not first
    now[0] = 500.0
    assert cache.get() is cache.graph
    assert cache.builds == 2


def test_rebuild_twice(portal):
    run = portal.rebuilt_index()
    first = run.report.first()
    assert first.upserted > 0
    assert run.result.count() == first.upserted + first.skipped


def test_embedding_cache(spark):
    chunks = spark.createDataFrame([("a", "h1", "x"), ("b", "h2", "y"), ("c", "h3", "z")], "chunk_id string, body_hash string, body string")
    cache = spark.createDataFrame([("a", "h1", [1.0, 2.0]), ("b", "old", [3.0, 4.0]), ("c", "h3", [5.0])], "chunk_id string, body_hash string, embedding array<double>")
    made = vector.with_cached(chunks, cache, lambda df: df.select("chunk_id", F.array(F.lit(0.0), F.lit(0.0)).alias("embedding")), dim=2)
    assert {r.chunk_id: r.embedding for r in made.collect()} == {"a": [1.0, 2.0], "b": [0.0, 0.0], "c": [0.0, 0.0]}


def test_refresh_embeds_what_has_changed(spark, data, tmp_path):
    embed = lambda df: df.select("chunk_id", F.array(F.length("body").cast("double")).alias("embedding"))
    portal = Portal(spark, data)
    first = portal.refresh_index(str(tmp_path / "i"), embed, limit=5)
    assert (first["upserted"], first["deleted"]) == (5, 0)
    full = portal.refresh_index(str(tmp_path / "i"), embed)
    assert full["upserted"] == full["chunks"] - 5
    assert portal.refresh_index(str(tmp_path / "i"), embed)["upserted"] == 0
