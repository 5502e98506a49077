"""Search that fuses words, walks over the entity graph, and the chunks of the customers a query names.

Queries come as (query_id, query). Walks are made once for each node they begin at and the edges they may follow, as lists of
the best chunks; those of a query are the best of its nodes' lists, so that a hub does not open the whole graph for each query.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as tx
from docweft.operators import fusion
from docweft.operators import graph as gr
from docweft.operators.lexical import TermIndex, top_k
from docweft.session import stage

# ---- Fixed values: what edges are worth, and which of them a query of each intent may follow --------------
EDGE_WEIGHTS = {"MENTIONS": 0.9, "MENTIONED_IN": 0.9, "HAS_ISSUE": 0.8, "OCCURS_IN": 0.8, "OWNS": 0.7, "OWNED_BY": 0.7}
INTENT_EDGES = {
    "customer_info": ("BELONGS_TO", "HAS_DOCUMENT", "HAS_CHUNK", "OWNS", "MENTIONED_IN"),
    "history": ("SIMILAR_TO", "OCCURS_IN", "HAS_ISSUE", "MENTIONED_IN"),
    "manual": ("MENTIONED_IN", "HAS_CHUNK", "SIMILAR_TO"),
    "default": ("MENTIONED_IN", "HAS_CHUNK", "SIMILAR_TO", "OWNS"),
}
HISTORY_WORDS = ("이력", "사례", "이전에", "과거", "비슷한", "유사")
MANUAL_WORDS = ("어떻게", "방법", "절차", "설정", "매뉴얼")
RUN_LIMITS = {"lexical": 30, "graph": 30, "customer": 20}
RUN_WEIGHTS = {"lexical": 1.0, "graph": 0.6, "customer": 1.2}
SEED_CHUNKS = 5
# ------------------------------------------------------------------------------------------------------------


def weighted_edges(graph: gr.Graph, most_chunks: int | None = 60) -> DataFrame:
    """(src, dst, type, exp_weight) among customers, documents, chunks, systems and issues.

    To the graph's edges come BELONGS_TO from a chunk to its customer, OWNS and OWNED_BY between a customer and the
    systems of its chunks, and SIMILAR_TO between chunks, by entities of at most `most_chunks` chunks or, with None, by all.
    """
    kinds = ("HAS_DOCUMENT", "BELONGS_TO", "HAS_CHUNK", "PART_OF", "MENTIONS", "MENTIONED_IN", "HAS_ISSUE", "OCCURS_IN")
    ticket = F.startswith("src", F.lit("Ticket:")) | F.startswith("dst", F.lit("Ticket:"))
    base = graph.edges.filter(F.col("type").isin(*kinds) & ~ticket)
    under = base.filter("type = 'HAS_CHUNK'").select(F.col("src").alias("doc"), F.col("dst").alias("chunk"))
    home = base.filter("type = 'HAS_DOCUMENT'").select(F.col("src").alias("customer"), F.col("dst").alias("doc"))
    near = under.join(home, "doc").select(F.col("chunk").alias("src"), F.col("customer").alias("dst"), F.lit("BELONGS_TO").alias("type"))
    owned = gr.ownership(base)
    pairs = [("customer", "system", "OWNS"), ("system", "customer", "OWNED_BY")]
    more = [owned.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("type")) for a, b, kind in pairs]
    plain = reduce(lambda x, y: x.unionByName(y), [near, *more], base)
    weight = reduce(lambda rest, kw: F.when(F.col("type") == kw[0], kw[1]).otherwise(rest), EDGE_WEIGHTS.items(), F.lit(1.0))
    alike = gr.similar(base, most_chunks=most_chunks).select("src", "dst", F.lit("SIMILAR_TO").alias("type"), "weight")
    return stage(gr.edge_weights(plain.withColumn("weight", weight).unionByName(alike), F.col("weight")).select("src", "dst", "type", "exp_weight"), "weighted")


def aliases(graph: gr.Graph, systems: Mapping = gr.SYSTEMS, issues: Mapping = gr.ISSUES, customers: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(alias, node, type, label), in lower case: words of the dictionaries, names of customers and their given aliases."""
    spark = graph.edges.sparkSession
    words = [(v.lower(), f"{kind}:{name}", kind, name) for kind, known in (("System", systems), ("IssueType", issues), ("Customer", customers or {})) for name, all_ in known.items() for v in all_]
    named = spark.createDataFrame(words, "alias string, node string, type string, label string").join(graph.bare_nodes.select("node"), "node", "left_semi")
    own = graph.bare_nodes.filter("type = 'Customer'").select(F.lower("label").alias("alias"), "node", "type", "label")
    return named.select("alias", "node", "type", "label").unionByName(own).filter("alias != ''").distinct()


def linked(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, node, type, label): nodes of which an alias stands in the query.

    An alias can only be where its first two characters are, so these are joined first.
    """
    low = queries.select("query_id", F.lower(F.coalesce("query", F.lit(""))).alias("low"))
    begun = low.select("query_id", "low", F.explode(tx.pieces(F.col("low"))).alias("begin"))
    found = begun.join(known.withColumn("begin", F.substring("alias", 1, 2)), "begin").filter(F.contains("low", F.col("alias")))
    return found.select("query_id", "node", "type", "label").distinct()


def intents(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, intent, types): what a query asks for, by its words and the customers it names, and the edges to follow."""
    named = found.filter("type = 'Customer'").select("query_id", F.lit(True).alias("_named")).distinct()
    low = F.lower(F.coalesce("query", F.lit("")))
    intent = F.when(tx.any_of(low, HISTORY_WORDS), "history").when(F.col("_named"), "customer_info").when(tx.any_of(low, MANUAL_WORDS), "manual").otherwise("default")
    types = reduce(lambda rest, kv: F.when(F.col("intent") == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(rest), INTENT_EDGES.items(), F.array().cast("array<string>"))
    return queries.select("query_id", "query").join(named, "query_id", "left").select("query_id", intent.alias("intent")).withColumn("types", types)


def _ranked(df: DataFrame, score: Column, key: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(score.desc(), key)))


def _lists(edges: DataFrame, starts: DataFrame, kinds: Sequence[Sequence[str]], hops: int, decay: float, least: float, limit: int) -> DataFrame:
    """(kind, node, chunk, score): the best `limit` chunks that walks from each of `starts` (kind, node) lead to.

    A kind is the place in `kinds` of the edges that may be followed. The best of one step more are among the best of
    the nodes that the step leads to, so that a list for each node is all that is carried on, and a hub is gone through once
    and not for each query.
    """
    ways = reduce(lambda a, b: a.unionByName(b), [edges.filter(F.col("type").isin(*types or ("",))).select(F.lit(i).alias("kind"), "src", "dst", (F.col("exp_weight") * decay).alias("way")) for i, types in enumerate(kinds)])

    def best(rows: DataFrame) -> DataFrame:
        once = rows.filter(F.col("score") > least).groupBy("kind", "node", "chunk").agg(F.max("score").alias("score"))
        order = Window.partitionBy("kind", "node").orderBy(F.round("score", 9).desc(), "chunk")
        return once.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).drop("_rank")

    near = best(ways.filter(F.startswith("dst", F.lit("Chunk:"))).select("kind", F.col("src").alias("node"), F.col("dst").alias("chunk"), F.col("way").alias("score")))
    near = stage(near, "near") if hops > 1 else near
    found = near.join(starts, ["kind", "node"], "left_semi")
    for hop in range(2, hops + 1):
        own = ways.join(starts.withColumnRenamed("node", "src"), ["kind", "src"], "left_semi") if hop == hops else ways
        step = own.join(near.withColumnRenamed("node", "dst"), ["kind", "dst"]).select("kind", F.col("src").alias("node"), "chunk", (F.col("way") * F.col("score")).alias("score"))
        near = stage(best(step), "near")
        found = found.unionByName(near if hop == hops else near.join(starts, ["kind", "node"], "left_semi"))
    return stage(best(found), "lists")


def _walked(edges: DataFrame, seeds: DataFrame, hops: int, decay: float, least: float, limit: int) -> tuple[DataFrame, DataFrame, list[list[str]]]:
    """walk() without hop; the seeds as (query_id, kind, node) and the edges of each kind too."""
    seeds = stage(seeds.filter("types is not null").select("query_id", "node", F.array_sort("types").alias("types")).distinct(), "seeds")
    kinds = sorted(list(r.types) for r in seeds.select("types").distinct().collect())  # as many as there are intents
    kind = reduce(lambda rest, it: F.when(F.col("types") == F.array(*map(F.lit, it[1])).cast("array<string>"), it[0]).otherwise(rest), enumerate(kinds), F.lit(None).cast("int"))
    seeds = seeds.select("query_id", kind.alias("kind"), "node")
    lists = _lists(edges, stage(seeds.select("kind", "node").distinct(), "starts"), kinds or [[]], hops, decay, least, limit)
    best = seeds.join(lists, ["kind", "node"]).groupBy("query_id", F.col("chunk").alias("node")).agg(F.max("score").alias("score"))
    return _ranked(best, F.round("score", 9), "node").filter(F.col("rank") <= limit), seeds, kinds


def walk(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.6, least: float = 0.05, limit: int = 30) -> DataFrame:
    """(query_id, node, score, hop, rank): the best `limit` chunks that each query's seeds lead to.

    seeds have query_id, node and types, the edges that may be followed. A step multiplies the score by `decay`
    and the edge's exp_weight, at most 1; at `least` and below a walk ends. A seed that is reached again counts. Equal
    scores go by node. hop is the least number of steps, found by going back from the chunks listed.
    """
    best, seeds, kinds = _walked(edges, seeds, hops, decay, least, limit)
    best = stage(best, "walked")
    back = best.select("query_id", "node").join(seeds.select("query_id", "kind").distinct(), "query_id").select("query_id", "kind", "node", F.col("node").alias("at"), F.lit(1.0).alias("way"))
    met = None
    for hop in range(1, hops):
        allowed = reduce(lambda rest, it: F.when(F.col("kind") == it[0], F.col("type").isin(*it[1] or ("",))).otherwise(rest), enumerate(kinds), F.lit(False))
        step = back.join(edges, back["at"] == edges["dst"]).filter(allowed).select("query_id", "kind", "node", F.col("src").alias("at"), (F.col("way") * F.col("exp_weight") * decay).alias("way")).filter(F.col("way") > least)
        back = stage(step.groupBy("query_id", "kind", "node", "at").agg(F.max("way").alias("way")), "back")
        own = back.join(seeds.withColumnRenamed("node", "at"), ["query_id", "kind", "at"], "left_semi").select("query_id", "node", F.lit(hop).alias("hop"))
        met = own if met is None else met.unionByName(own)
    if met is None:
        return best.select("query_id", "node", "score", F.lit(hops).alias("hop"), "rank")
    met = met.groupBy("query_id", "node").agg(F.min("hop").alias("hop"))
    return best.join(met, ["query_id", "node"], "left").select("query_id", "node", "score", F.coalesce("hop", F.lit(hops)).alias("hop"), "rank")


def search(graph: gr.Graph, edges: DataFrame, chunks: DataFrame, index: TermIndex, queries: DataFrame, known: DataFrame, k: int = 10, k1: float = 1.2) -> DataFrame:
    """(query_id, chunk_id, score, via, ranks, rank): reciprocal rank fusion of up to three runs for each query.

    lexical has the best chunks by words; graph those that a walk reaches from the entities named and from the
    best few of these; customer, for queries that name one, its chunks: first those of the lexical run, then others
    by the number of the query's words in them. chunks have chunk_id, source and ordinal; `index` is over lemmas.
    """
    nodes = chunks.select("chunk_id", F.concat(F.lit("Chunk:"), F.col("source"), F.lit("#"), F.lpad(F.col("ordinal").cast("string"), 4, "0")).alias("node"))
    nodes = stage(nodes.join(graph.bare_nodes.filter("type = 'Chunk'").select("node", "customer"), "node"), "chunk-nodes")
    words = stage(index.scanned(queries, RUN_LIMITS["lexical"], k1=k1, tokens=tx.lemma_tokens, repeated=False), "words")
    named = stage(linked(queries, known), "linked")
    wanted = intents(queries, named)
    start = named.select("query_id", "node").union(words.filter(F.col("rank") <= SEED_CHUNKS).join(nodes, "chunk_id").select("query_id", "node")).distinct()
    paths = _walked(edges, start.join(wanted.select("query_id", "types"), "query_id"), 2, 0.6, 0.05, RUN_LIMITS["graph"])[0].join(nodes.select("node", "chunk_id"), "node")
    scope = named.filter("type = 'Customer'").select("query_id", F.col("label").alias("customer"))
    first = words.join(nodes.select("chunk_id", "customer"), "chunk_id").join(scope, ["query_id", "customer"], "left_semi").select("query_id", "chunk_id", F.col("rank").alias("_place"), F.lit(None).cast("double").alias("n_terms"))
    # As many as the run has besides all that may stand in the lexical one.
    more = index.counted_within(queries, nodes.select("chunk_id", F.col("customer").alias("grp")), scope.withColumnRenamed("customer", "grp"), RUN_LIMITS["lexical"] + RUN_LIMITS["customer"], tx.lemma_tokens)
    more = more.join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.lit(None).cast("int").alias("_place"), F.col("score").alias("n_terms"))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("_place"), F.desc("n_terms"), "chunk_id")
    of_customer = first.unionByName(more).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= RUN_LIMITS["customer"])
    return top_k(fusion.reciprocal_rank({"lexical": words, "graph": paths, "customer": of_customer}, RUN_WEIGHTS), k)
