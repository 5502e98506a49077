"""Entity graph of documents, chunks, customers, systems, issues, tickets and persons.

Nodes are named by their type and natural key ("Chunk:path#0001"), so no numbering is needed to build
them. Edges are a multigraph: two mentions are two edges.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as tx
from docweft.functions.casts import strip
from docweft.operators import scan
from docweft.session import stage, stage_all

# ---- Fixed values: dictionaries of systems and issues, and what an intent may follow ---------------------
SYSTEMS = {
    "홈페이지": ("홈페이지", "웹사이트", "웹 사이트", "website"),
    "그룹웨어": ("그룹웨어", "groupware"),
    "게시판": ("게시판", "bbs"),
    "회원관리": ("회원관리", "회원 관리", "멤버십", "회원가입"),
    "결제시스템": ("결제", "결재시스템", "이니시스", "kcp", "나이스페이", "payment"),
    "메일": ("메일", "이메일", "smtp", "메일서버"),
    "DB": ("데이터베이스", "database", "mysql", "mariadb", "oracle", "postgres", "mssql"),
    "WAS": ("톰캣", "tomcat", "jboss", "웹로직", "weblogic", "apache", "nginx", "was"),
    "SSL인증서": ("ssl", "인증서", "https", "tls"),
    "도메인": ("도메인", "domain", "dns", "네임서버"),
    "호스팅": ("호스팅", "hosting", "클라우드"),
    "백업": ("백업", "backup", "복구", "restore"),
    "모바일앱": ("안드로이드", "android", "ios", "모바일앱"),
    "관리자페이지": ("관리자", "admin", "어드민", "백오피스"),
    "검색": ("검색엔진", "elasticsearch"),
    "SMS": ("sms", "알림톡", "문자발송"),
    "보안": ("취약점", "해킹", "방화벽", "waf"),
    "학회관리": ("학회", "초록", "논문", "심사", "학술대회"),
    "예약": ("예약", "booking", "reservation"),
    "설문": ("설문", "survey"),
}
ISSUES = {
    "장애": ("장애", "다운", "먹통", "접속불가", "에러", "오류"),
    "성능": ("느림", "지연", "타임아웃", "timeout", "부하"),
    "갱신": ("갱신", "만료", "연장", "renewal"),
    "이관": ("이관", "이전", "마이그레이션", "migration"),
    "복구": ("복구", "롤백", "rollback", "재기동"),
    "기능개선": ("개선", "리뉴얼", "기능추가"),
}
INTENT_EDGES = {
    "customer_info": ("PART_OF", "HAS_CHUNK", "MENTIONS", "MENTIONED_IN"),
    "history": ("HAS_ISSUE", "OCCURS_IN", "MENTIONS", "MENTIONED_IN"),
    "manual": ("MENTIONS", "MENTIONED_IN", "PART_OF", "HAS_CHUNK"),
    "default": ("MENTIONS", "MENTIONED_IN", "PART_OF", "HAS_CHUNK", "HAS_ISSUE", "OCCURS_IN"),
}
VISIBLE_EDGES = ("HAS_DOCUMENT", "HAS_CHUNK", "MENTIONS", "HAS_ISSUE", "HAS_TICKET", "HANDLED_BY")
NO_CUSTOMER = "_공통"
TICKET_FOLDERS = ("유지보수_접수내역", "유지보수 접수내역")
EXCLUDED = ("README.md", "SIMPLIFY_CHANGELOG.md", "SIMPLIFY_VALIDATION_REPORT.md", "READABILITY_CLEANUP_REPORT.md", "READABILITY_FINAL_VALIDATION.md")
# ----------------------------------------------------------------------------------------------------------

_NODE = "node string, type string, label string, customer string, source string, preview string"


def _node(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + ":"), key)


def entities(scope: Column, dictionary: dict[str, Sequence[str]]) -> Column:
    """array<string> of the dictionary's names of which a variant stands in `scope`, in dictionary order."""
    low = F.lower(scope)
    return F.array_compact(F.array(*[F.when(tx.any_of(low, tuple(v)), name) for name, v in dictionary.items()]))


def with_terms(dictionary: dict[str, Sequence[str]], approved: dict[str, Sequence[str]]) -> dict[str, Sequence[str]]:
    """The dictionary with approved terms added; what it has stays."""
    lower = {t: tuple(sorted({t.lower(), *(x.lower() for x in v)})) for t, v in approved.items()}
    return {**lower, **dictionary}


def graph_documents(docs: DataFrame, max_docs: int | None = None, excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    """(source, title, customer, content) of live documents that belong in the graph; a blank customer is NO_CUSTOMER.

    Documents of the store itself, by their file names, and copies of tickets are left out. `max_docs` keeps the first by source.
    """
    customer = strip(F.coalesce("customer", F.lit("")))
    named = docs.filter("deleted_at is null").dropDuplicates(["source"]).withColumn("customer", F.when(customer == "", NO_CUSTOMER).otherwise(customer))
    kept = named.filter(~tx.basename(F.col("source")).isin(*excluded or ("",)) & ~F.col("customer").isin(*TICKET_FOLDERS) & ~F.substring_index("source", "/", 1).isin(*TICKET_FOLDERS))
    title = strip(F.coalesce("title", F.lit("")))
    kept = kept.select("source", F.when(title == "", F.col("source")).otherwise(title).alias("title"), "customer", F.coalesce("content", F.lit("")).alias("content"))
    return kept.orderBy("source").limit(max_docs) if max_docs is not None else kept


def customer_count(docs: DataFrame, tickets: DataFrame) -> DataFrame:
    """(n_customers): how many customers the graph of these documents and tickets has, without building it."""
    key = tx.customer_key(F.col("customer"))
    named = docs.select("customer").distinct()
    more = tickets.select(strip(F.coalesce("customer", F.lit(""))).alias("customer")).filter("customer != ''").select(key.alias("ck")).distinct().join(named.select(key.alias("ck")).distinct(), "ck", "left_anti")
    return named.select(F.lit(1)).union(more.select(F.lit(1))).agg(F.count("*").alias("n_customers"))


class Graph:
    """nodes (node, type, label, customer, source, preview, degree) and edges (src, dst, type).

    docs are those of graph_documents(); chunks have source, ordinal (from 0), heading_path and body; tickets
    have idx, customer, title, manager_id, worker_id and source. Tickets without a customer are left out.
    """

    def __init__(self, docs: DataFrame, chunks: DataFrame, tickets: DataFrame, systems: dict = SYSTEMS, issues: dict = ISSUES) -> None:
        doc, cust = _node("Document", F.col("source")), _node("Customer", F.col("customer"))
        part = chunks.join(docs.select("source", "title", "customer"), "source")
        path = F.coalesce("heading_path", F.array().cast("array<string>"))
        body = F.coalesce("body", F.lit(""))
        label = F.when(F.size(path) > 0, F.element_at(path, -1)).otherwise(F.concat(F.col("title"), F.lit(" · "), (F.col("ordinal") + 1).cast("string")))
        scope = F.concat_ws(" ", body, F.array_join(path, " "), F.col("title"))
        part = part.select(_node("Chunk", F.concat(F.col("source"), F.lit("#"), F.lpad(F.col("ordinal").cast("string"), 4, "0"))).alias("node"), doc.alias("doc"), F.substring(label, 1, 60).alias("label"), "customer", "source", F.substring(F.regexp_replace(body, r"(?U)\s+", " "), 1, 110).alias("preview"), entities(scope, systems).alias("systems"), entities(scope, issues).alias("issues"))
        # A ticket's customer is a known one under any spelling, or a new one.
        known = docs.select("customer").distinct().groupBy(tx.customer_key(F.col("customer")).alias("ck")).agg(F.min("customer").alias("known"))
        called = tickets.withColumn("customer", strip(F.coalesce("customer", F.lit("")))).filter("customer != ''").withColumn("ck", tx.customer_key(F.col("customer")))
        new = called.groupBy("ck").agg(F.min("customer").alias("new"))
        called = called.join(known, "ck", "left").join(new, "ck").withColumn("owner", F.coalesce("known", "new"))
        title = strip(F.coalesce("title", F.lit("")))
        name = F.substring(F.when(title != "", title).otherwise(F.concat(F.lit("접수 "), F.col("idx").cast("string"))), 1, 60)
        called = called.select(_node("Ticket", F.concat(F.lit("ticket:"), F.col("idx").cast("string"))).alias("node"), name.alias("label"), "customer", "source", "owner", "manager_id", "worker_id").withColumns({"systems": entities(F.col("label"), systems), "issues": entities(F.col("label"), issues)})
        # Staged, as texts are to be read once and not again for each kind of node and edge.
        part, called = stage_all((part, "graph-chunks"), (called, "graph-tickets"))

        def both(df: DataFrame, a: Column, b: Column, there: str, back: str) -> DataFrame:
            pair = F.array(F.struct(a.alias("src"), b.alias("dst"), F.lit(there).alias("type")), F.struct(b.alias("src"), a.alias("dst"), F.lit(back).alias("type")))
            return df.select(F.explode(pair).alias("e")).select("e.*")

        def mentions(df: DataFrame) -> DataFrame:
            s = df.select("node", F.explode("systems").alias("x"))
            i = df.select("node", F.explode("issues").alias("x"))
            return both(s, F.col("node"), _node("System", F.col("x")), "MENTIONS", "MENTIONED_IN").unionByName(both(i, F.col("node"), _node("IssueType", F.col("x")), "HAS_ISSUE", "OCCURS_IN"))

        people = called.select("node", F.explode(F.array("manager_id", "worker_id")).alias("p")).filter("p is not null and p != 0").withColumn("p", F.col("p").cast("string"))
        person = _node("Person", F.concat(F.lit("person:"), F.col("p")))
        edges = (
            both(docs, cust, doc, "HAS_DOCUMENT", "BELONGS_TO")
            .unionByName(both(part, F.col("doc"), F.col("node"), "HAS_CHUNK", "PART_OF"))
            .unionByName(mentions(part))
            .unionByName(both(called, F.col("node"), _node("Customer", F.col("owner")), "REQUESTED_BY", "HAS_TICKET"))
            .unionByName(both(people, person, F.col("node"), "HANDLED", "HANDLED_BY"))
            .unionByName(mentions(called))
        )
        null = F.lit(None).cast("string")

        def nodes(df: DataFrame, kind: str, node: Column, label: Column, customer: Column = null, source: Column = null, preview: Column = null) -> DataFrame:
            return df.select(node.alias("node"), F.lit(kind).alias("type"), label.alias("label"), customer.alias("customer"), source.alias("source"), preview.alias("preview"))

        owners = docs.select("customer").union(called.select("owner")).distinct()
        names = part.select(F.explode("systems").alias("x")).union(called.select(F.explode("systems"))).distinct()
        faults = part.select(F.explode("issues").alias("x")).union(called.select(F.explode("issues"))).distinct()
        plain = (
            nodes(owners, "Customer", cust, F.col("customer"), F.col("customer"))
            .unionByName(nodes(docs, "Document", doc, F.col("title"), F.col("customer"), F.col("source")))
            .unionByName(nodes(part, "Chunk", F.col("node"), F.col("label"), F.col("customer"), F.col("source"), F.col("preview")))
            .unionByName(nodes(names, "System", _node("System", F.col("x")), F.col("x")))
            .unionByName(nodes(faults, "IssueType", _node("IssueType", F.col("x")), F.col("x")))
            .unionByName(nodes(called, "Ticket", F.col("node"), F.col("label"), F.col("customer"), F.col("source")))
            .unionByName(nodes(people.select("p").distinct(), "Person", person, F.concat(F.lit("담당자 "), F.col("p"))))
        )
        # What is asked of a graph joins edges and nodes several times over: they are written once.
        self.edges, self.bare_nodes = stage_all((edges, "edges"), (plain, "nodes"))
        self.nodes = self.bare_nodes.join(out_degree(self.edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def hub_penalty(degree: Column, base10: bool = False) -> Column:
    """1 for at most one edge, falling with the logarithm of the degree."""
    log = F.log10(degree.cast("double")) if base10 else F.log(degree.cast("double"))
    return F.when(degree > 1, 1.0 / (1.0 + 0.9 * log)).otherwise(1.0)


def edge_weights(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """`edges` with exp_weight: their weight with the base-10 penalty of the node they lead to."""
    degree = out_degree(edges).withColumnRenamed("node", "dst")
    own = F.lit(1.0) if weight is None else weight
    return edges.join(degree, "dst", "left").withColumn("exp_weight", own * hub_penalty(F.coalesce("degree", F.lit(0)), True)).drop("degree")


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, edge_types: Sequence[str] | None = None, decay: float = 0.6, least: float = 0.05, penalty: bool = True, limit: int | None = 400) -> DataFrame:
    """(node, score, hop): what is reached from `seeds` (node) within `hops` steps, seeds themselves left out.

    A step multiplies the score by `decay` and the penalty of the node it enters; at `least` and below a walk
    ends. Score is the best over all walks: as factors do not depend on the way before, the best per node and
    hop is all that has to be carried on. hop is the least. `limit` keeps the best; equal scores go by node.
    """
    ways = edges.filter(F.col("type").isin(*edge_types)) if edge_types else edges
    if penalty:
        weight = out_degree(edges).select(F.col("node").alias("dst"), hub_penalty(F.col("degree")).alias("w"))
        ways = ways.select("src", "dst").distinct().join(weight, "dst", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    else:
        ways = ways.select("src", "dst").distinct().withColumn("w", F.lit(1.0))
    front, reached = seeds.select("node").distinct().withColumn("score", F.lit(1.0)), None
    for hop in range(1, hops + 1):
        step = front.join(ways, front["node"] == ways["src"]).select(F.col("dst").alias("node"), (F.col("score") * F.col("w") * decay).alias("score")).filter(F.col("score") > least)
        front = step.groupBy("node").agg(F.max("score").alias("score"))
        found = front.withColumn("hop", F.lit(hop))
        reached = found if reached is None else reached.unionByName(found)
    out = reached.groupBy("node").agg(F.max("score").alias("score"), F.min("hop").alias("hop")).join(seeds.select("node"), "node", "left_anti")
    return out.orderBy(F.round("score", 9).desc(), "node").limit(limit) if limit is not None else out


def resolve_seeds(graph: Graph, seeds: DataFrame, per_doc: int = 0) -> DataFrame:
    """(node): customers and documents replaced by their chunks (the first `per_doc` each, if over 0); tickets and persons dropped."""
    own = seeds.join(graph.bare_nodes.select("node", "type"), "node")
    by_customer = own.filter("type = 'Customer'").join(graph.edges.filter("type = 'HAS_DOCUMENT'").select(F.col("src").alias("node"), F.col("dst").alias("doc")), "node").select("doc")
    docs = own.filter("type = 'Document'").select(F.col("node").alias("doc")).union(by_customer).distinct()
    chunks = docs.join(graph.edges.filter("type = 'HAS_CHUNK'").select(F.col("src").alias("doc"), F.col("dst").alias("node")), "doc")
    if per_doc > 0:
        chunks = chunks.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("node"))).filter(F.col("n") <= per_doc)
    return own.filter("type in ('Chunk', 'System', 'IssueType')").select("node").union(chunks.select("node")).distinct()


def link_entities(graph: Graph, query: str, aliases: dict[str, dict[str, Sequence[str]]] | None = None) -> DataFrame:
    """(node, type, label) of the customers, systems and issues whose label or alias stands in the query.

    `aliases` maps a type to names with their aliases; systems and issues have those of the dictionaries.
    """
    low = query.lower()
    known = {"System": SYSTEMS, "IssueType": ISSUES, "Customer": {}} | (aliases or {})
    named = [(kind, name) for kind, names in known.items() for name, v in names.items() if any(x.lower() in low for x in v if x)]
    label = F.contains(F.lit(low), F.lower("label")) & (F.col("label") != "")
    by_alias = F.concat_ws(":", "type", "label").isin(*[f"{k}:{n}" for k, n in named]) if named else F.lit(False)
    return graph.bare_nodes.filter(F.col("type").isin("Customer", "System", "IssueType") & (label | by_alias)).select("node", "type", "label")


def entity_links(edges: DataFrame) -> DataFrame:
    """(node, entity): chunks with the systems and issues they name, each once."""
    return edges.filter("type in ('MENTIONS', 'HAS_ISSUE')").filter(F.startswith("src", F.lit("Chunk:"))).select(F.col("src").alias("node"), F.col("dst").alias("entity")).distinct()


def coverage(graph: Graph) -> DataFrame:
    """(chunks, linked, coverage): share of chunks that name an entity."""
    total = graph.bare_nodes.filter("type = 'Chunk'").agg(F.count("*").alias("chunks"))
    linked = entity_links(graph.edges).agg(F.countDistinct("node").alias("linked"))
    return total.join(F.broadcast(linked)).withColumn("coverage", F.round(F.col("linked") / F.greatest("chunks", F.lit(1)), 4))


def hubs(graph: Graph, n: int = 8) -> DataFrame:
    """(node, label, type, degree, share) of the systems and issues with the most edges."""
    total = graph.bare_nodes.agg(F.greatest(F.count_if(F.col("type") == "Chunk"), F.lit(1)).alias("chunks"))
    top = graph.nodes.filter("type in ('System', 'IssueType')").orderBy(F.desc("degree"), "node").limit(n)
    return top.join(F.broadcast(total)).select("node", "label", "type", "degree", F.round(F.col("degree") / F.col("chunks"), 4).alias("share"))


def customers(graph: Graph) -> DataFrame:
    """(name, doc_count) of all customers, those without documents too."""
    counts = graph.edges.filter("type = 'HAS_DOCUMENT'").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("doc_count"))
    return graph.bare_nodes.filter("type = 'Customer'").join(counts, "node", "left").select(F.col("label").alias("name"), F.coalesce("doc_count", F.lit(0)).cast("bigint").alias("doc_count"))


def counts(graph: Graph) -> DataFrame:
    """(what, type, n) of nodes and edges."""
    return graph.bare_nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "type", "n").unionByName(graph.edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "type", "n"))


def spread(graph: Graph, reached: DataFrame) -> DataFrame:
    """(customers, total, spread): customers of the reached chunks among all."""
    own = reached.join(graph.bare_nodes.filter("type = 'Chunk' and customer is not null"), "node").agg(F.countDistinct("customer").alias("customers"))
    total = graph.bare_nodes.agg(F.count_if(F.col("type") == "Customer").alias("total"))
    return own.join(F.broadcast(total)).withColumn("spread", F.round(F.col("customers") / F.greatest("total", F.lit(1)), 4))


def _named(batch: pa.RecordBatch, place: dict) -> scan.Found:
    """The entities of rows (node, entities) that are asked for."""
    sizes, flat = scan.flat_list(batch.column(1))
    at = np.array([place.get(x, -1) for x in flat.to_pylist()], np.int32)
    owner = np.repeat(np.arange(batch.num_rows), sizes)[at >= 0]
    return scan.Found([batch.column(0)], np.bincount(owner, minlength=batch.num_rows), at[at >= 0], np.ones(len(owner), np.int8), np.zeros(batch.num_rows))


def _partners(links: DataFrame, least_shared: int, most: int) -> DataFrame:
    """(src, dst, shared): the best `most` partners of each chunk by all entities, and perhaps one more.

    Chunks of the same entities have the same partners but for themselves, and only the first `most` + 1 of them, by node,
    can be partners. So what is compared, in scans, is each set of entities with these, and no pair of chunks is a row.
    """
    own = links.groupBy("node").agg(F.array_sort(F.collect_list("entity")).alias("entities")).filter(F.size("entities") >= least_shared)
    own = stage(own, "entities")
    order = Window.partitionBy("entities").orderBy("node")
    first = stage(own.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most + 1).select("node", "entities"), "partners-first")
    asked = own.select(F.col("node").alias("query_id"), F.explode("entities").alias("term"), F.lit(1.0).alias("qtf"))
    found = scan.best_of_all(asked, ["node"], most + 1, lambda part: scan.best(first, ["node"], part, most + 1, _named), "partners")
    return found.filter("query_id != node").select(F.col("query_id").alias("src"), F.col("node").alias("dst"), F.round("score").cast("bigint").alias("shared"))


def similar(edges: DataFrame, least_shared: int = 2, most_per_node: int = 5, most_chunks: int | None = 60) -> DataFrame:
    """(src, dst, shared, weight): chunks that share entities, the best few of each.

    Entities of more than `most_chunks` chunks say little and are left out before the self-join, so that no
    entity gives more than `most_chunks` squared rows. With None all entities count, and partners are found from
    scans of the sets of entities instead. Ties go by node.
    """
    links = entity_links(edges)
    if most_chunks is None:
        pairs = _partners(links, least_shared, most_per_node)
    else:
        rare = links.groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") <= most_chunks)
        own = links.join(rare.select("entity"), "entity")
        pairs = own.withColumnRenamed("node", "src").join(own.withColumnRenamed("node", "dst"), "entity").filter("src != dst").groupBy("src", "dst").agg(F.count("*").alias("shared"))
    order = Window.partitionBy("src").orderBy(F.desc("shared"), "dst")
    return pairs.filter(F.col("shared") >= least_shared).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most_per_node).select("src", "dst", "shared", F.least(F.lit(1.0), F.col("shared") / 4.0).alias("weight"))


def ownership(edges: DataFrame) -> DataFrame:
    """(customer, system), each once: systems that a customer's chunks mention."""
    has = edges.filter("type = 'HAS_DOCUMENT'").select(F.col("src").alias("customer"), F.col("dst").alias("doc"))
    chunk = edges.filter("type = 'HAS_CHUNK'").select(F.col("src").alias("doc"), F.col("dst").alias("chunk"))
    mention = edges.filter("type = 'MENTIONS'").select(F.col("src").alias("chunk"), F.col("dst").alias("system"))
    return has.join(chunk, "doc").join(mention, "chunk").select("customer", "system").distinct()


def subgraph(graph: Graph, wanted: Sequence[str] | None = None, chunks_per_doc: int = 4, tickets_per_customer: int = 8, most_nodes: int = 1200) -> tuple[DataFrame, DataFrame]:
    """Nodes and visible edges for showing: of the customers wanted, a few chunks and tickets each, at most `most_nodes`.

    Entities and persons that a kept node names come on top. Which chunks and tickets go first is by node.
    """
    base = graph.bare_nodes.filter("type in ('Customer', 'Document', 'Chunk', 'Ticket')")
    if wanted is not None:
        base = base.filter(F.col("customer").isin(*wanted))
    keep = base.filter("type in ('Customer', 'Document')").select("node", "type")
    for kind, edge, n in (("Chunk", "HAS_CHUNK", chunks_per_doc), ("Ticket", "HAS_TICKET", tickets_per_customer)):
        if n > 0:
            own = base.filter(F.col("type") == kind).select("node", "type")
            under = graph.edges.filter(F.col("type") == edge).select("src", F.col("dst").alias("node")).join(keep.select(F.col("node").alias("src")), "src", "left_semi").join(own, "node")
            first = under.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("node"))).filter(F.col("n") <= n)
            keep = keep.unionByName(first.select("node", "type"))
    rank = F.when(F.col("type") == "Customer", 0).when(F.col("type") == "Document", 1).when(F.col("type") == "Chunk", 2).otherwise(3)
    keep = stage(keep.distinct().orderBy(rank, "node").limit(most_nodes).select("node"), "kept")
    named = graph.edges.filter("type in ('MENTIONS', 'HAS_ISSUE', 'HANDLED_BY')").join(keep.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    keep = stage(keep.union(named).distinct(), "shown")
    shown = graph.edges.filter(F.col("type").isin(*VISIBLE_EDGES)).join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "type")
    return graph.nodes.join(keep, "node", "left_semi"), shown


def fingerprint(docs: DataFrame) -> DataFrame:
    """(fingerprint): count and hash of source and change time of all documents, in the order of their sources.

    A tree of hashes of fixed shape: each document's; those of documents whose source's hash begins alike, in order,
    as one of 65,536; and those together. So any other row, value or number of copies changes it, and no
    task holds more than its share, whatever the sources are.
    """
    source, changed = F.coalesce("source", F.lit("")), F.coalesce(F.col("updated_at").cast("string"), F.lit(""))
    one = docs.select(F.substring(F.sha1(source), 1, 4).alias("part"), source.alias("s"), F.sha1(F.concat(source, F.lit("\x1f"), changed, F.lit("\x1e"))).alias("h"))
    parts = one.groupBy("part").agg(F.count("*").alias("n"), F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "h"))), lambda x: x["h"]), "")).alias("h"))
    whole = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "").alias("all"))
    return whole.select(F.concat(F.col("n").cast("string"), F.lit(":"), F.substring(F.sha1("all"), 1, 12)).alias("fingerprint"))
