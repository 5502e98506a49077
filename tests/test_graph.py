import random

import pytest
from pyspark.sql import functions as F

from docweft.functions import text as tx
from docweft.operators import graph as gr
from docweft.operators import terms


def walks(edges, weight, seeds, hops, least=0.05, decay=0.6):
    """Best score over all walks, by listing them."""
    best = {}

    def go(node, score, left):
        if not left:
            return
        for a, b in edges:
            if a == node:
                s = score * weight.get(b, 1.0) * decay
                if s > least:
                    best[b] = max(best.get(b, 0), s)
                    go(b, s, left - 1)

    for s in seeds:
        go(s, 1.0, hops)
    return {k: v for k, v in best.items() if k not in seeds}


@pytest.mark.parametrize("seed", range(3))
def test_expansion_equals_listing_walks(spark, seed):
    import math

    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(9)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(22)]
    degree = {n: sum(a == n for a, _ in edges) for n in nodes}
    weight = {n: 1 / (1 + 0.9 * math.log(d)) if d > 1 else 1.0 for n, d in degree.items()}
    df = spark.createDataFrame([(a, b, "E") for a, b in edges], "src string, dst string, type string")
    seeds = spark.createDataFrame([("n0",), ("n1",)], "node string")
    for hops in (1, 2, 3):
        got = {r.node: r.score for r in gr.expand(df, seeds, hops).collect()}
        assert got == pytest.approx(walks(edges, weight, ["n0", "n1"], hops))
    free = {r.node: r.score for r in gr.expand(df, seeds, 2, penalty=False).collect()}
    assert free == pytest.approx(walks(edges, {}, ["n0", "n1"], 2))


@pytest.fixture(scope="module")
def graph(spark):
    docs = spark.createDataFrame(
        [("가/a.md", "글", " 가 ", "SSL 인증서 만료 본문", None), ("README.md", "r", "", "x", None), ("나/b.md", "", None, None, None), ("유지보수_접수내역/t.md", "t", "유지보수_접수내역", "x", None), ("다/c.md", "지움", "다", "x", "2026-01-01 00:00:00")],
        "source string, title string, customer string, content string, deleted_at string",
    ).withColumn("deleted_at", F.col("deleted_at").cast("timestamp"))
    chunks = spark.createDataFrame([("가/a.md", 0, ["머리", "갱신"], "SSL 인증서 만료"), ("가/a.md", 1, None, None), ("나/b.md", 0, None, "홈페이지"), ("없음.md", 0, None, "x")], "source string, ordinal int, heading_path array<string>, body string")
    tickets = spark.createDataFrame([(1, "가", "SSL 오류", 7, 7, "s"), (2, " 새 고객_", None, None, 0, None), (3, "", "x", 1, 1, None), (4, "새고객", "y", None, None, None)], "idx bigint, customer string, title string, manager_id bigint, worker_id bigint, source string")
    return gr.Graph(gr.graph_documents(docs), chunks, tickets)


def test_nodes_and_edges(graph):
    nodes = {r.node: r for r in graph.nodes.collect()}
    assert {n for n in nodes if n.startswith("Customer")} == {"Customer:가", "Customer:_공통", "Customer:새 고객_"}
    assert {n for n in nodes if n.startswith(("Document", "Chunk"))} == {"Document:가/a.md", "Document:나/b.md", "Chunk:가/a.md#0000", "Chunk:가/a.md#0001", "Chunk:나/b.md#0000"}
    assert nodes["Chunk:가/a.md#0000"].label == "갱신"
    assert nodes["Chunk:가/a.md#0001"].label == "글 · 2"
    assert nodes["Document:나/b.md"].label == "나/b.md"
    assert nodes["Ticket:ticket:2"].label == "접수 2"
    edges = [tuple(r) for r in graph.edges.collect()]
    assert edges.count(("Person:person:7", "Ticket:ticket:1", "HANDLED")) == 2
    assert ("Chunk:가/a.md#0000", "System:SSL인증서", "MENTIONS") in edges
    assert ("IssueType:갱신", "Chunk:가/a.md#0000", "OCCURS_IN") in edges
    assert ("Customer:새 고객_", "Ticket:ticket:4", "HAS_TICKET") in edges
    assert all(nodes[n].degree == sum(a == n for a, _, _ in edges) for n in nodes)


def test_measures(graph):
    assert {(r.what, r.type): r.n for r in gr.counts(graph).collect()}["node", "Ticket"] == 3
    r = gr.coverage(graph).first()
    assert (r.chunks, r.linked, r.coverage) == (3, 2, 0.6667)
    assert {r.name: r.doc_count for r in gr.customers(graph).collect()} == {"가": 1, "_공통": 1, "새 고객_": 0}
    assert {tuple(r) for r in gr.ownership(graph.edges).collect()} == {("Customer:가", "System:SSL인증서"), ("Customer:_공통", "System:홈페이지")}
    assert {r.node for r in gr.link_entities(graph, "ssl 갱신", {"Customer": {"_공통": ["갱"]}}).collect()} == {"System:SSL인증서", "IssueType:갱신", "Customer:_공통"}
    assert gr.hubs(graph, 1).count() == 1


def test_seeds(spark, graph):
    seeds = spark.createDataFrame([("Customer:가",), ("Document:나/b.md",), ("System:SSL인증서",), ("Ticket:ticket:1",), ("none",)], "node string")
    assert {r.node for r in gr.resolve_seeds(graph, seeds).collect()} == {"Chunk:가/a.md#0000", "Chunk:가/a.md#0001", "Chunk:나/b.md#0000", "System:SSL인증서"}
    assert {r.node for r in gr.resolve_seeds(graph, seeds, per_doc=1).collect()} == {"Chunk:가/a.md#0000", "Chunk:나/b.md#0000", "System:SSL인증서"}


def test_subgraph(graph):
    nodes, edges = gr.subgraph(graph, ["가"], chunks_per_doc=1)
    assert {r.node for r in nodes.collect()} == {"Customer:가", "Document:가/a.md", "Chunk:가/a.md#0000", "Ticket:ticket:1", "System:SSL인증서", "IssueType:갱신", "IssueType:장애", "Person:person:7"}
    assert {r.type for r in edges.collect()} <= set(gr.VISIBLE_EDGES)


def test_similar(spark):
    rows = [(f"Chunk:{c}", f"System:{e}", "MENTIONS") for c, es in {"a": "xyz", "b": "xyw", "c": "x", "d": "xyzw"}.items() for e in es]
    got = {(r.src[-1], r.dst[-1]): (r.shared, r.weight) for r in gr.similar(spark.createDataFrame(rows, "src string, dst string, type string")).collect()}
    assert got == {p: v for a, b, n in (("a", "b", 2), ("a", "d", 3), ("b", "d", 3)) for p in ((a, b), (b, a)) for v in [(n, n / 4)]}
    few = gr.similar(spark.createDataFrame(rows, "src string, dst string, type string"), most_per_node=1).collect()
    assert {(r.src[-1], r.dst[-1]) for r in few} == {("a", "d"), ("b", "d"), ("d", "a")}


@pytest.mark.parametrize("limit, least", [(5, 2), (1, 1), (100, 3)])
def test_similar_by_all_entities(spark, monkeypatch, limit, least):
    """Without a limit of chunks for an entity the partners are those of comparing all pairs, and no pairs are written."""
    rows, stage = [], gr.stage

    def counted(df, label):
        out = stage(df, label)
        rows.append(out.count())
        return out

    rng = random.Random(limit)
    has = {f"Chunk:{i:03}": {f"System:{e}" for e in "uvwxyz" if rng.random() < 0.5} for i in range(150)}
    edges = spark.createDataFrame([(c, e, "MENTIONS") for c, es in has.items() for e in sorted(es)] * 2, "src string, dst string, type string")
    want = {}
    for c, es in has.items():
        alike = sorted((-len(es & other), d) for d, other in has.items() if d != c and len(es & other) >= least)
        want |= {(c, d): (-n, min(1.0, -n / 4)) for n, d in alike[:limit]}
    monkeypatch.setattr(gr, "stage", counted)
    got = gr.similar(edges, least, limit, most_chunks=None).collect()
    assert {(r.src, r.dst): (r.shared, r.weight) for r in got} == want and len(got) == len(want)
    assert max(rows) <= len(has)
    assert gr.similar(edges.limit(0), most_chunks=None).count() == 0


def test_penalties(spark):
    r = spark.createDataFrame([(0,), (1,), (10,)], "d int").select(F.round(gr.hub_penalty(F.col("d")), 6), F.round(gr.hub_penalty(F.col("d"), True), 6)).collect()
    assert [tuple(x) for x in r] == [(1.0, 1.0), (1.0, 1.0), (round(1 / (1 + 0.9 * 2.302585092994), 6), round(1 / 1.9, 6))]
    edges = spark.createDataFrame([("a", "b", "E"), ("b", "c", "E"), ("b", "d", "E")], "src string, dst string, type string")
    assert {r.dst: round(r.exp_weight, 4) for r in gr.edge_weights(edges, F.lit(0.9)).collect()} == {"b": round(0.9 / (1 + 0.9 * 0.30103), 4), "c": 0.9, "d": 0.9}


def test_fingerprint(spark):
    rows = [("a", "2026-01-01"), ("b", None)]
    one = lambda r: gr.fingerprint(spark.createDataFrame(r, "source string, updated_at string")).first().fingerprint
    assert one(rows) == one(rows[::-1])
    assert one(rows) != one([("a", "2026-01-02"), ("b", None)])
    assert one(rows).startswith("2:")
    assert one([]).startswith("0:")


def test_terms(spark):
    docs = spark.createDataFrame([("밸브 밸브 pump.v2 있습니다", "가"), ("밸브 점검", "나"), ("밸브", None), (None, "가")], "content string, customer string")
    assert {r.term: (r.doc_freq, r.customers) for r in terms.term_statistics(docs).collect()} == {"밸브": (3, 2), "pump.v2": (1, 1), "점검": (1, 1)}
    many = spark.createDataFrame([(f"흔함 {'드묾' if i < 4 else ''} 매뉴얼에서", f"c{i % 3}") for i in range(20)], "content string, customer string")
    got = terms.mine(many).collect()
    assert [(r.term, r.doc_freq, r.share, r.customers, r.score) for r in got] == [("드묾", 4, 0.2, 3, 0.96)]
    assert terms.mine(many, known=["드묾"]).collect() == []


def test_entities_in_dictionary_order(spark):
    got = spark.createDataFrame([("https 홈페이지 WAS",)], "t string").select(gr.entities(F.col("t"), gr.SYSTEMS).alias("e")).first().e
    assert got == ["홈페이지", "WAS", "SSL인증서"]
    more = gr.with_terms(gr.SYSTEMS, {"배너": ["Banner"], "DB": ["x"]})
    assert more["배너"] == ("banner", "배너")
    assert more["DB"] == gr.SYSTEMS["DB"]
    assert tx.GRAPH_INTENTS
