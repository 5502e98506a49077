"""Queries over the entity graph; chunks are those of the stored chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import text as tx
from docweft.operators import graph as gr
from docweft.operators import graph_search, tickets
from docweft.plans import search_queries, sql
from docweft.plans.text_queries import _GRAPH_DOCS
from docweft.session import spread, table

SEEDS = ("System:SSL인증서", "IssueType:갱신")
QUERY = "SSL 인증서 갱신 이력과 홈페이지 장애"


def build(spark: SparkSession, root: str) -> gr.Graph:
    docs = gr.graph_documents(table(spark, root, "maintenance_docs"))
    chunks = spread(table(spark, root, "chunks").select("source", "ordinal", "heading", "body"))
    chunks = chunks.withColumn("heading_path", F.when(F.coalesce("heading", F.lit("")) != "", F.array("heading")))
    called = tickets.graph_tickets(tickets.unique_tickets(table(spark, root, "maintenance_requests")), limit=None)
    return gr.Graph(docs, chunks, called)


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SEEDS], "node string")


def graph_nodes(spark: SparkSession, root: str) -> DataFrame:
    return build(spark, root).nodes.select("node", "type", "label", "degree")


def graph_edges(spark: SparkSession, root: str) -> DataFrame:
    return build(spark, root).edges


def graph_counts(spark: SparkSession, root: str) -> DataFrame:
    return gr.counts(build(spark, root))


def hub_penalties(spark: SparkSession, root: str) -> DataFrame:
    degree = gr.out_degree(build(spark, root).edges)
    return degree.select("node", F.round(gr.hub_penalty(F.col("degree")), 6).alias("natural"), F.round(gr.hub_penalty(F.col("degree"), True), 6).alias("base10"))


def _expanded(spark: SparkSession, root: str, hops: int, penalty: bool = True) -> DataFrame:
    edges = build(spark, root).edges
    found = gr.expand(edges, _seeds(spark), hops, gr.INTENT_EDGES["default"], penalty=penalty, least=0.01, limit=None)
    return found.select("node", F.round("score", 6).alias("score"), F.col("hop").cast("bigint").alias("hop"))


def expand_1hop(spark: SparkSession, root: str) -> DataFrame:
    return _expanded(spark, root, 1)


def expand_2hop(spark: SparkSession, root: str) -> DataFrame:
    return _expanded(spark, root, 2)


def expand_3hop(spark: SparkSession, root: str) -> DataFrame:
    return _expanded(spark, root, 3)


def expand_no_penalty(spark: SparkSession, root: str) -> DataFrame:
    return _expanded(spark, root, 2, False)


def expand_top(spark: SparkSession, root: str) -> DataFrame:
    edges = build(spark, root).edges
    return gr.expand(edges, _seeds(spark), 2, gr.INTENT_EDGES["default"]).select("node", F.round("score", 6).alias("score"))


def expand_spread(spark: SparkSession, root: str) -> DataFrame:
    graph = build(spark, root)
    return gr.spread(graph, gr.expand(graph.edges, _seeds(spark), 2, gr.INTENT_EDGES["default"], least=0.01, limit=None))


def entity_coverage(spark: SparkSession, root: str) -> DataFrame:
    return gr.coverage(build(spark, root))


def hub_list(spark: SparkSession, root: str) -> DataFrame:
    return gr.hubs(build(spark, root))


def customer_list(spark: SparkSession, root: str) -> DataFrame:
    return gr.customers(build(spark, root))


def similar_chunks(spark: SparkSession, root: str) -> DataFrame:
    return gr.similar(build(spark, root).edges)


def system_ownership(spark: SparkSession, root: str) -> DataFrame:
    return gr.ownership(build(spark, root).edges)


def linked_entities(spark: SparkSession, root: str) -> DataFrame:
    return gr.link_entities(build(spark, root), QUERY)


def resolved_seeds(spark: SparkSession, root: str) -> DataFrame:
    graph = build(spark, root)
    top = graph.bare_nodes.filter("type = 'Customer' and label like '다온%'").select("node")
    return gr.resolve_seeds(graph, top.union(_seeds(spark)), per_doc=2)


def weighted_edges(spark: SparkSession, root: str) -> DataFrame:
    return graph_search.weighted_edges(build(spark, root)).select("src", "dst", "type", F.round("exp_weight", 6).alias("exp_weight"))


def query_links(spark: SparkSession, root: str) -> DataFrame:
    graph, asked = build(spark, root), search_queries.title_queries(spark, root)
    found = graph_search.linked(asked, graph_search.aliases(graph))
    return found.join(graph_search.intents(asked, found), "query_id").select("query_id", "node", "intent")


def graph_search_titles(spark: SparkSession, root: str) -> DataFrame:
    graph = build(spark, root)
    found = graph_search.search(graph, graph_search.weighted_edges(graph), table(spark, root, "chunks"), search_queries._lemma_index(spark, root), search_queries.title_queries(spark, root), graph_search.aliases(graph))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "via", F.col("rank").cast("bigint").alias("rank"))


def subgraph_nodes(spark: SparkSession, root: str) -> DataFrame:
    return gr.subgraph(build(spark, root))[0].select("node", "type", "degree")


def corpus_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    live = table(spark, root, "maintenance_docs").filter("deleted_at is null").dropDuplicates(["source"])
    return gr.fingerprint(live.select("source", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("updated_at")))


QUERIES = {f.__name__: f for f in (graph_nodes, graph_edges, graph_counts, hub_penalties, expand_1hop, expand_2hop, expand_3hop, expand_no_penalty, expand_top, expand_spread, entity_coverage, hub_list, customer_list, similar_chunks, system_ownership, linked_entities, resolved_seeds, weighted_edges, query_links, graph_search_titles, subgraph_nodes, corpus_fingerprint)}


def _entities(e: str, dictionary: dict) -> str:
    return "list_filter([" + ", ".join(f"case when {sql.any_of(e, tuple(v))} then {sql.lit(n)} end" for n, v in dictionary.items()) + "], lambda x: x is not null)"


_KEY = r"lower(regexp_replace({}, '(?:\s|\p{{Z}}|_)+', '', 'g'))"
_GRAPH = f"""with {_GRAPH_DOCS},
cp as materialized (select 'Chunk:' || c.source || '#' || lpad(c.ordinal::varchar, 4, '0') as node, 'Document:' || c.source as doc, left(case when coalesce(c.heading, '') <> '' then c.heading else d.title || ' · ' || (c.ordinal + 1)::varchar end, 60) as label, d.customer,
  lower(coalesce(c.body, '') || ' ' || coalesce(c.heading, '') || ' ' || d.title) as scope from chunks c join docs d using (source)),
cx as materialized (select *, {_entities("scope", gr.SYSTEMS)} as systems, {_entities("scope", gr.ISSUES)} as issues from cp),
tk as (select distinct on (idx) * from maintenance_requests order by idx, imported_at desc nulls last, last_import_id desc nulls last),
tc as (select idx, {sql.strip("user_id")} as customer, manager_id, worker_id, {sql.strip("coalesce(title, '')")} as title from tk where {sql.strip("coalesce(user_id, '')")} <> ''),
kn as (select {_KEY.format("customer")} as ck, min(customer) as known from docs group by 1),
nw as (select {_KEY.format("customer")} as ck, min(customer) as new from tc group by 1),
tt as (select 'Ticket:ticket:' || idx as node, left(case when title <> '' then title else '접수 ' || idx end, 60) as label, coalesce(known, new) as owner, manager_id, worker_id from tc join nw on nw.ck = {_KEY.format("tc.customer")} left join kn on kn.ck = nw.ck),
tx as materialized (select *, {_entities("lower(label)", gr.SYSTEMS)} as systems, {_entities("lower(label)", gr.ISSUES)} as issues from tt),
ms as (select node, unnest(systems) as x from cx union all select node, unnest(systems) from tx),
mi as (select node, unnest(issues) as x from cx union all select node, unnest(issues) from tx),
pp as (select node, manager_id as p from tx where coalesce(manager_id, 0) <> 0 union all select node, worker_id from tx where coalesce(worker_id, 0) <> 0),
one as (select 'Customer:' || customer as src, 'Document:' || source as dst, 'HAS_DOCUMENT' as type, 'BELONGS_TO' as back from docs
  union all select doc, node, 'HAS_CHUNK', 'PART_OF' from cx union all select node, 'System:' || x, 'MENTIONS', 'MENTIONED_IN' from ms union all select node, 'IssueType:' || x, 'HAS_ISSUE', 'OCCURS_IN' from mi
  union all select node, 'Customer:' || owner, 'REQUESTED_BY', 'HAS_TICKET' from tx union all select 'Person:person:' || p, node, 'HANDLED', 'HANDLED_BY' from pp),
edges as materialized (select src, dst, type from one union all select dst, src, back from one),
bare as materialized (select distinct 'Customer:' || c as node, 'Customer' as type, c as label, c as customer from (select customer as c from docs union select owner from tx)
  union all select 'Document:' || source, 'Document', title, customer from docs union all select node, 'Chunk', label, customer from cx
  union all select distinct 'System:' || x, 'System', x, null from ms union all select distinct 'IssueType:' || x, 'IssueType', x, null from mi
  union all select node, 'Ticket', label, null from tx union all select distinct 'Person:person:' || p, 'Person', '담당자 ' || p, null from pp),
deg as materialized (select src as node, count(*) as degree from edges group by 1),
wt as (select node, degree, case when degree > 1 then 1 / (1 + 0.9 * ln(degree)) else 1.0 end as w from deg)
"""
_WAYS = f"ways as materialized (select distinct src, dst from edges where type in ({', '.join(map(sql.lit, gr.INTENT_EDGES['default']))}))"
_SEEDS = "seeds as (select unnest([" + ", ".join(map(sql.lit, SEEDS)) + "]) as node)"


def _walk(hops: int, penalty: bool = True, least: float = 0.01) -> str:
    factor = "coalesce(w, 1.0)" if penalty else "1.0"
    steps = [f"h0 as (select node, 1.0::double as score from seeds)"]
    for h in range(1, hops + 1):
        steps.append(f"h{h} as materialized (select dst as node, max(score * {factor} * 0.6) as score from h{h - 1} join ways on src = h{h - 1}.node left join wt on wt.node = dst where score * {factor} * 0.6 > {least} group by dst)")
    union = " union all ".join(f"select node, score, {h} as hop from h{h}" for h in range(1, hops + 1))
    return f"{_WAYS}, {_SEEDS}, {', '.join(steps)}, reached as (select node, max(score) as score, min(hop) as hop from ({union}) where node not in (select node from seeds) group by node)"


def _expand(hops: int, penalty: bool = True) -> str:
    return _GRAPH + f", {_walk(hops, penalty)} select node, round(score, 6) as score, cast(hop as bigint) as hop from reached"


_LINKS = "links as (select distinct src as node, dst as entity from edges where type in ('MENTIONS', 'HAS_ISSUE') and prefix(src, 'Chunk:'))"
_ALIASES = [(k, n) for k, d in (("System", gr.SYSTEMS), ("IssueType", gr.ISSUES)) for n, v in d.items() if any(x in QUERY.lower() for x in v)]

_WORTH = " ".join(f"when '{k}' then {v}" for k, v in graph_search.EDGE_WEIGHTS.items())
_RICH = _GRAPH + f""", {_LINKS},
base as materialized (select * from edges where type in ('HAS_DOCUMENT', 'BELONGS_TO', 'HAS_CHUNK', 'PART_OF', 'MENTIONS', 'MENTIONED_IN', 'HAS_ISSUE', 'OCCURS_IN') and not prefix(src, 'Ticket:') and not prefix(dst, 'Ticket:')),
home as (select b.dst as chunk, a.src as customer from base a join base b on a.dst = b.src and a.type = 'HAS_DOCUMENT' and b.type = 'HAS_CHUNK'),
owned as (select distinct customer, c.dst as system from home join base c on c.src = chunk and c.type = 'MENTIONS'),
rare as (select * from links where entity in (select entity from links group by 1 having count(*) <= 60)),
pairs as (select a.node as src, b.node as dst, count(*) as shared from rare a join rare b using (entity) where a.node <> b.node group by all having count(*) >= 2),
alike as (select * from pairs qualify row_number() over (partition by src order by shared desc, dst) <= 5),
rich as (select src, dst, type, case type {_WORTH} else 1.0 end as weight from (select * from base union all select chunk, customer, 'BELONGS_TO' from home union all select customer, system, 'OWNS' from owned union all select system, customer, 'OWNED_BY' from owned)
  union all select src, dst, 'SIMILAR_TO', least(1.0, shared / 4.0) from alike),
out_ as (select src as node, count(*) as n from rich group by 1),
worth as materialized (select src, dst, type, weight * case when coalesce(n, 0) > 1 then 1 / (1 + 0.9 * log10(n)) else 1.0 end as exp_weight from rich left join out_ on out_.node = rich.dst)"""
_ASKED = search_queries._ASKED
_KNOWN = ", ".join(f"({sql.lit(v.lower())}, {sql.lit(f'{k}:{n}')}, '{k}', {sql.lit(n)})" for k, d in (("System", gr.SYSTEMS), ("IssueType", gr.ISSUES)) for n, all_ in d.items() for v in all_)
_LINKED = f"""{_ASKED}, known as (select * from (values {_KNOWN}) v(alias, node, type, label) where node in (select node from bare) union all select lower(label), node, type, label from bare where type = 'Customer'),
linked as materialized (select distinct query_id, node, type, label from asked, known where alias <> '' and contains(lower(query), alias)),
wish as materialized (select query_id, case when {sql.any_of("lower(query)", graph_search.HISTORY_WORDS)} then 'history' when query_id in (select query_id from linked where type = 'Customer') then 'customer_info' when {sql.any_of("lower(query)", graph_search.MANUAL_WORDS)} then 'manual' else 'default' end as intent from asked)"""
_MAY = ", ".join(f"('{i}', '{t}')" for i, ts in graph_search.INTENT_EDGES.items() for t in ts)
_FUSED = f"""{search_queries._LEMMA_SQL.removeprefix("with " + _ASKED + ", ")},
words as materialized (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from lem qualify rank <= 30),
own as materialized (select c.chunk_id, cp.node, cp.customer from chunks c join cp on cp.node = 'Chunk:' || c.source || '#' || lpad(c.ordinal::varchar, 4, '0')),
start as (select query_id, node from linked union select query_id, node from words join own using (chunk_id) where rank <= 5),
may as (select * from (values {_MAY}) v(intent, type)), ok as (select query_id, type from wish join may using (intent)),
w1 as materialized (select query_id, dst as node, max(0.6 * exp_weight) as score from start join worth on src = start.node join ok using (query_id, type) where 0.6 * exp_weight > 0.05 group by all),
w2 as (select query_id, dst as node, max(score * 0.6 * exp_weight) as score from w1 join worth on src = w1.node join ok using (query_id, type) where score * 0.6 * exp_weight > 0.05 group by all),
walked as (select query_id, node, max(score) as score from (select * from w1 union all select * from w2) where prefix(node, 'Chunk:') group by all),
paths as (select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, node) as rank from walked join own using (node) qualify rank <= 30),
terms as (select query_id, chunk_id, count(*) as k from q join post using (term) group by all),
scoped as (select t.query_id, t.chunk_id, row_number() over (partition by t.query_id order by w.rank nulls last, k desc, t.chunk_id) as rank from terms t join own using (chunk_id) join linked l on l.query_id = t.query_id and l.type = 'Customer' and l.label = own.customer
  left join words w on w.query_id = t.query_id and w.chunk_id = t.chunk_id qualify rank <= 20),
runs as (select query_id, chunk_id, 'lexical' as run, rank, 1.0 as w from words union all select query_id, chunk_id, 'graph', rank, 0.6 from paths union all select query_id, chunk_id, 'customer', rank, 1.2 from scoped),
fused as (select query_id, chunk_id, sum(w / (60 + rank)) as score, string_agg(run, '+' order by run) as via from runs group by all)"""

SQL = {
    "weighted_edges": _RICH + " select src, dst, type, round(exp_weight, 6) as exp_weight from worth",
    "query_links": _GRAPH + f", {_LINKED} select query_id, node, intent from linked join wish using (query_id)",
    "graph_search_titles": _RICH + f", {_LINKED}, {_FUSED} select query_id, chunk_id, round(score, 6) as score, via, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from fused qualify rank <= 10",
    "graph_nodes": _GRAPH + "select b.node, b.type, b.label, coalesce(degree, 0) as degree from bare b left join deg using (node)",
    "graph_edges": _GRAPH + "select src, dst, type from edges",
    "graph_counts": _GRAPH + "select 'node' as what, type, count(*) as n from bare group by type union all select 'edge', type, count(*) from edges group by type",
    "hub_penalties": _GRAPH + "select node, round(w, 6) as \"natural\", round(case when degree > 1 then 1 / (1 + 0.9 * log10(degree)) else 1.0 end, 6) as base10 from wt",
    "expand_1hop": _expand(1),
    "expand_2hop": _expand(2),
    "expand_3hop": _expand(3),
    "expand_no_penalty": _expand(2, False),
    "expand_top": _GRAPH + f", {_walk(2, True, 0.05)} select node, round(score, 6) as score from reached order by round(score, 9) desc, node limit 400",
    "expand_spread": _GRAPH + f", {_walk(2)}, s as (select (select count(distinct customer) from reached join bare using (node) where bare.type = 'Chunk') as customers, (select count(*) from bare where type = 'Customer') as total) select customers, total, round(customers / greatest(total, 1), 4) as spread from s",
    "entity_coverage": _GRAPH + f", {_LINKS}, c as (select (select count(*) from bare where type = 'Chunk') as chunks, (select count(distinct node) from links) as linked) select chunks, linked, round(linked / greatest(chunks, 1), 4) as coverage from c",
    "hub_list": _GRAPH + "select node, label, type, degree, round(degree / (select greatest(count(*), 1) from bare where type = 'Chunk'), 4) as share from bare join deg using (node) where type in ('System', 'IssueType') order by degree desc, node limit 8",
    "customer_list": _GRAPH + "select label as name, coalesce(n, 0) as doc_count from bare left join (select src as node, count(*) as n from edges where type = 'HAS_DOCUMENT' group by 1) using (node) where type = 'Customer'",
    "corpus_fingerprint": """with d as (select distinct on (source) source, updated_at from maintenance_docs where deleted_at is null),
one as (select left(sha1(source), 4) as part, source, sha1(source || chr(31) || coalesce(strftime(updated_at at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%f'), '') || chr(30)) as h from d),
parts as (select part, count(*) as n, sha1(string_agg(h, '' order by source)) as h from one group by part)
select cast(sum(n) as varchar) || ':' || left(sha1(string_agg(h, '' order by part)), 12) as fingerprint from parts""",
    "similar_chunks": _GRAPH + f", {_LINKS}, own as materialized (select * from links where entity in (select entity from links group by 1 having count(*) <= 60)), pr as (select a.node as src, b.node as dst, count(*) as shared from own a join own b using (entity) where a.node <> b.node group by all having count(*) >= 2) select src, dst, shared, least(1.0, shared / 4.0) as weight from pr qualify row_number() over (partition by src order by shared desc, dst) <= 5",
    "system_ownership": _GRAPH + "select distinct a.src as customer, c.dst as system from edges a join edges b on b.src = a.dst and b.type = 'HAS_CHUNK' join edges c on c.src = b.dst and c.type = 'MENTIONS' where a.type = 'HAS_DOCUMENT'",
    "linked_entities": _GRAPH + f"select node, type, label from bare where type in ('Customer', 'System', 'IssueType') and ((label <> '' and contains({sql.lit(QUERY.lower())}, lower(label))) or type || ':' || label in ({', '.join(sql.lit(f'{k}:{n}') for k, n in _ALIASES)}))",
    "resolved_seeds": _GRAPH + f", {_SEEDS}, cs as (select node from bare where type = 'Customer' and label like '다온%'), ck as (select b.dst as node, row_number() over (partition by a.dst order by b.dst) as n from cs join edges a on a.src = cs.node and a.type = 'HAS_DOCUMENT' join edges b on b.src = a.dst and b.type = 'HAS_CHUNK') select node from ck where n <= 2 union select node from seeds where node in (select node from bare)",
    "subgraph_nodes": _GRAPH + """, k0 as (select node, type from bare where type in ('Customer', 'Document')),
k1 as (select node, type from (select b.node, b.type, row_number() over (partition by e.src order by b.node) as n from edges e join k0 on k0.node = e.src join bare b on b.node = e.dst where e.type = 'HAS_CHUNK') where n <= 4),
k2 as (select node, type from (select b.node, b.type, row_number() over (partition by e.src order by b.node) as n from edges e join k0 on k0.node = e.src join bare b on b.node = e.dst where e.type = 'HAS_TICKET') where n <= 8),
k as (select distinct * from (select * from k0 union all select * from k1 union all select * from k2) order by case type when 'Customer' then 0 when 'Document' then 1 when 'Chunk' then 2 else 3 end, node limit 1200),
f as (select node from k union select dst from edges join k on k.node = src where edges.type in ('MENTIONS', 'HAS_ISSUE', 'HANDLED_BY'))
select b.node, b.type, coalesce(degree, 0) as degree from bare b join f using (node) left join deg using (node)""",
}
