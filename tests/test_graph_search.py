import pytest
from pyspark.sql import functions as F

from docweft.operators import graph as gr
from docweft.operators import graph_search as gs
from docweft.operators.lexical import TermIndex
from docweft.functions import text as tx
from docweft.plans import graph_queries


def reached(edges, seeds, types, hops=2, decay=0.6, least=0.05):
    """Best score and least hop of every node, by walking all ways."""
    best, front = {}, {s: 1.0 for s in seeds}
    for hop in range(1, hops + 1):
        step = {}
        for a, b, kind, w in edges:
            if a in front and kind in types and (s := front[a] * w * decay) > least:
                step[b] = max(step.get(b, 0), s)
        for node, s in step.items():
            old = best.get(node, (0, hop))
            best[node] = (max(old[0], s), old[1])
        front = step
    return best


@pytest.mark.parametrize("limit", [1, 3, 30])
def test_walks_equal_all_ways(spark, limit):
    edges = [("System:s", f"Chunk:{i}", "MENTIONED_IN", 0.2 + i / 30) for i in range(20)] + [(f"Chunk:{i}", f"Chunk:{(i * 7) % 20}", "SIMILAR_TO", 0.9 - i / 40) for i in range(20)] + [("Chunk:1", "System:s", "MENTIONS", 1.0), ("Document:d", "Chunk:3", "HAS_CHUNK", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, type string, exp_weight double")
    asked = {1: ["System:s"], 2: ["Chunk:4", "Chunk:9"], 3: ["Document:d", "System:s"], 4: ["fehlt"]}
    types = ["MENTIONED_IN", "SIMILAR_TO", "HAS_CHUNK"]
    seeds = spark.createDataFrame([(q, n, types) for q, ns in asked.items() for n in ns], "query_id bigint, node string, types array<string>")
    got = {}
    for r in gs.walk(df, seeds, limit=limit).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.node, round(r.score, 9), r.hop)
    for q, ns in asked.items():
        want = sorted(((-round(s, 9), n, h) for n, (s, h) in reached(edges, ns, types).items() if n.startswith("Chunk:")))[:limit]
        assert [got.get(q, {}).get(i + 1) for i in range(len(want))] == [(n, -s, h) for s, n, h in want]


def test_search_goes_by_words_graph_and_customer(spark):
    docs = spark.createDataFrame([("가온/a.md", "점검", "가온", "x"), ("나래/b.md", "보고", "나래", "y")], "source string, title string, customer string, content string")
    chunks = spark.createDataFrame([("c1", "가온/a.md", 0, "점검", "홈페이지 점검 이력"), ("c2", "가온/a.md", 1, "점검", "누수 기록"), ("c3", "나래/b.md", 0, "보고", "홈페이지 누수 보고"), ("c4", "나래/b.md", 1, "보고", "무관한 글")], "chunk_id string, source string, ordinal int, heading string, body string")
    asked = spark.createDataFrame([(1, "가온 누수"), (2, "홈페이지"), (3, ""), (4, None)], "query_id bigint, query string")
    called = spark.createDataFrame([], "idx bigint, customer string, title string, manager_id bigint, worker_id bigint, source string")
    graph = gr.Graph(docs, chunks.withColumn("heading_path", F.array("heading")), called)
    index = TermIndex(chunks, text=F.col("body"), tokens=tx.lemma_tokens)
    known = gs.aliases(graph)
    named = {(r.query_id, r.node) for r in gs.linked(asked, known).collect()}
    assert named == {(1, "Customer:가온"), (2, "System:홈페이지")}
    assert {r.query_id: r.intent for r in gs.intents(asked, gs.linked(asked, known)).collect()} == {1: "customer_info", 2: "default", 3: "default", 4: "default"}
    found = {}
    for r in gs.search(graph, gs.weighted_edges(graph), chunks, index, asked, known).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.chunk_id, r.via))
    assert found[1][0] == ("c2", "customer+graph+lexical")
    assert {c for c, _ in found[1]} >= {"c1", "c2", "c3"}
    assert {c for c, via in found[2] if "lexical" in via} == {"c1", "c3"}
    assert set(found) == {1, 2}


def test_walks_through_a_hub_once(spark, monkeypatch):
    """Rows written on the way are those of the graph and of lists, not one for each query and chunk of a hub."""
    rows, stage = [], gs.stage

    def counted(df, label):
        out = stage(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(gs, "stage", counted)
    df = spark.createDataFrame([("System:s", f"Chunk:{i:03}", "MENTIONED_IN", 0.9) for i in range(300)], "src string, dst string, type string, exp_weight double")
    seeds = spark.createDataFrame([(q, "System:s", ["MENTIONED_IN"]) for q in range(40)], "query_id bigint, node string, types array<string>")
    found = gs.walk(df, seeds, limit=2).collect()
    assert sorted((r.query_id, r["rank"], r.node, r.hop) for r in found) == [(q, i + 1, f"Chunk:00{i}", 1) for q in range(40) for i in range(2)]
    assert max(rows) <= 300


@pytest.mark.parametrize("k", [1, 4, 100])
def test_counted_within_groups(spark, k):
    texts = [" ".join(w for j, w in enumerate(("누수", "점검", "펌프", "센서", "교체")) if i >> j & 1) for i in range(32)]
    chunks = spark.createDataFrame([(f"c{i:02}", t) for i, t in enumerate(texts)], "chunk_id string, body string")
    groups = {f"c{i:02}": f"g{i % 3}" for i in range(30)}
    asked, scope = {1: "누수 점검 점검", 2: "센서 교체 펌프", 3: "누수", 4: "없는말", 5: None}, {1: ["g0"], 2: ["g1", "g2"], 4: ["g0"], 5: ["g1"], 6: ["g1"]}
    index = TermIndex(chunks, text=F.col("body"), tokens=tx.lemma_tokens)
    named = spark.createDataFrame([(q, g) for q, gs_ in scope.items() for g in gs_], "query_id bigint, grp string")
    got = index.counted_within(spark.createDataFrame(list(asked.items()), "query_id bigint, query string"), spark.createDataFrame(list(groups.items()), "chunk_id string, grp string"), named, k, tx.lemma_tokens)
    want = []
    for q, gs_ in scope.items():
        own = sorted((-len(set(texts[int(c[1:])].split()) & set((asked.get(q) or "").split())), c) for c, g in groups.items() if g in gs_)
        want += [(q, c, -n, i + 1) for i, (n, c) in enumerate([x for x in own if x[0]][:k])]
    assert sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in got.collect()) == sorted(want)


def test_graph_search_titles_makes_no_pairs(spark, monkeypatch):
    def no_pairs(*_, **__):
        raise AssertionError("pairs of query and chunk as rows")

    monkeypatch.setattr(TermIndex, "_sum", no_pairs)
    assert graph_queries.graph_search_titles(spark, "/root/testdata/sf0.001").count() > 0
