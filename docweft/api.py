"""The portal's operations as one Python object over a folder of tables.

Tables are maintenance_docs, chunks and maintenance_requests as parquet below the folder. Everything returned
is a DataFrame unless said otherwise; bounds are those of the portal's requests.
"""

from __future__ import annotations

import datetime as dt
import time
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import plain
from docweft.functions import text as tx
from docweft.operators import chunking, corpus_jobs, hybrid, lexical, snippets, store, terms, tickets
from docweft.operators import graph as gr
from docweft.session import table
from docweft.settings import DEFAULTS


def _within(n: int, low: int, high: int) -> int:
    return max(low, min(int(n), high))


class GraphCache:
    """A portal's graph, built again when its documents have changed.

    Within `ttl` seconds nothing is looked at; after that fingerprints are compared, and a rebuild comes at the
    earliest `cooldown` seconds after the last, also when it is asked for.
    """

    def __init__(self, portal: Portal, ttl: float = 600, cooldown: float = 30, clock=time.monotonic) -> None:
        self.portal, self.ttl, self.cooldown, self.clock = portal, ttl, cooldown, clock
        self.graph: gr.Graph | None = None
        self.fingerprint, self.checked, self.built, self.builds = "", 0.0, 0.0, 0

    def get(self, refresh: bool = False) -> gr.Graph:
        now = self.clock()
        if self.graph is not None and (now - self.built < self.cooldown or not refresh and now - self.checked < self.ttl):
            return self.graph
        fresh = Portal(self.portal.spark, self.portal.root, self.portal.settings, self.portal._as_of)
        found = gr.fingerprint(fresh.docs.filter("deleted_at is null")).first().fingerprint
        if self.graph is None or refresh or found != self.fingerprint:
            self.graph, self.fingerprint, self.built = fresh.graph, found, now
            self.builds += 1
        self.checked = now
        return self.graph


class Portal:
    """Search, graph, tickets and index upkeep over the tables below `root`."""

    def __init__(self, spark: SparkSession, root: str, settings: dict = DEFAULTS, as_of: dt.datetime | None = None) -> None:
        self.spark, self.root, self.settings, self._as_of = spark, root, settings, as_of

    @property
    def as_of(self) -> Column:
        """The time that recency counts from: the one given, else now."""
        return F.lit(self._as_of) if self._as_of else F.current_timestamp()

    @cached_property
    def docs(self) -> DataFrame:
        return table(self.spark, self.root, "maintenance_docs").dropDuplicates(["source"])

    @cached_property
    def chunks(self) -> DataFrame:
        return table(self.spark, self.root, "chunks").withColumn("updated_at", F.col("updated_at").cast("string").try_cast("timestamp"))

    @cached_property
    def requests(self) -> DataFrame:
        return tickets.unique_tickets(table(self.spark, self.root, "maintenance_requests"))

    @cached_property
    def graph(self) -> gr.Graph:
        docs = gr.graph_documents(self.docs)
        return gr.Graph(docs, chunking.graph_chunks(docs), tickets.graph_tickets(self.requests))

    def search(self, query: str, top_k: int = 5, mode: str = "hybrid", vectors: DataFrame | None = None) -> DataFrame:
        """Documents for a query, best first, by chunk ranking of the given mode; top_k is 1 to 10."""
        top_k = _within(top_k, 1, 10)
        return hybrid.documents(hybrid.search(self.chunks, query, self.as_of, 4 * top_k, mode, self.settings, vectors), top_k)

    def search_stored(self, query: str, top_k: int = 5, vectors: DataFrame | None = None, semantic: bool = False) -> DataFrame:
        """Chunks of live documents by weighted fields, with the fallback to whole documents."""
        return hybrid.stored_search(self.chunks, self.docs, query, self.as_of, _within(top_k, 1, 10), self.settings, vectors, semantic)

    def search_v2(self, query: str, top_k: int = 5, vectors: DataFrame | None = None, rerank=None) -> DataFrame:
        return hybrid.search_v2(self.chunks, self.docs, query, self.as_of, _within(top_k, 1, 10), settings=self.settings, vectors=vectors, rerank=rerank)

    def answer_context(self, query: str, top_k: int = 5) -> DataFrame:
        """Cards of the best sentences for a question; its intent sets how many chunks and characters are used.

        The intent's number of chunks holds only where the caller leaves the default of 5.
        """
        intent = tx.first_of(F.lit(query.lower().replace(" ", "")), tx.INTENTS, tx.DEFAULT_INTENT)
        cfg = self.settings["intent"][self.spark.range(1).select(intent.alias("i")).first().i]
        found = hybrid.search(self.chunks, query, self.as_of, cfg["top_k"] if top_k == 5 else top_k, settings=self.settings)
        return snippets.cards(hybrid.for_answer(found), F.lit(query), cfg["max_context_chars"], cfg["snippets_per_chunk"])

    def answer(self, query: str, top_k: int = 5) -> str:
        """Extractive answer in markdown."""
        return snippets.extractive_answer(hybrid.search(self.chunks, query, self.as_of, top_k, settings=self.settings))

    def find_documents(self, query: str, limit: int = 50) -> DataFrame:
        """Live documents with any search term of the query, latest first; limit is 1 to 200."""
        found = lexical.any_term(self.docs.filter("deleted_at is null"), plain.search_terms(query))
        return found.orderBy(F.desc_nulls_last("updated_at"), "source").limit(_within(limit, 1, 200))

    def tree(self, text: str = "") -> DataFrame:
        """Live documents whose title, customer or path holds `text`, without regard to case."""
        own = self.docs.filter("deleted_at is null").select("source", "title", "customer", "updated_at")
        return own.filter(F.contains(F.lower(F.concat_ws(" ", "title", "customer", "source")), F.lit(text.lower())))

    def search_tickets(self, query: str, limit: int = 10) -> DataFrame:
        rows = self.requests.withColumn("search_text", tickets.search_text(tickets.html_to_text(F.col("content"))))
        return tickets.search(rows, query, _within(limit, 1, 50))

    def stats(self) -> dict[str, DataFrame]:
        return {"counts": gr.counts(self.graph), "coverage": gr.coverage(self.graph), "hubs": gr.hubs(self.graph), "customers": gr.customers(self.graph).orderBy(F.desc("doc_count"), "name"), "fingerprint": gr.fingerprint(self.docs.filter("deleted_at is null"))}

    def term_candidates(self, top: int = 80) -> DataFrame:
        known = [x.lower() for d in (gr.SYSTEMS, gr.ISSUES) for name, v in d.items() for x in (name, *v)]
        docs = gr.graph_documents(self.docs)
        return terms.mine(docs, known, _within(top, 10, 300), customers=gr.customer_count(docs, tickets.graph_tickets(self.requests)))

    def subgraph(self, customers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges to show; without customers chosen no chunks are given out."""
        return gr.subgraph(self.graph, customers[:12] if customers else None, chunks_per_doc=4 if customers else 0)

    def expand(self, query: str = "", seeds: list[str] | None = None, hops: int = 2, intent: str | None = None) -> dict[str, DataFrame]:
        """What is reached from the entities named in a query and from given nodes; hops are 1 to 3."""
        linked = gr.link_entities(self.graph, query)
        given = self.spark.createDataFrame([(s,) for s in seeds or []], "node string")
        start = gr.resolve_seeds(self.graph, given.union(linked.select("node")).distinct())
        low = query.lower()
        kind = intent or next((k for k, words in tx.GRAPH_INTENTS.items() if any(w in low for w in words)), "default")
        reached = gr.expand(self.graph.edges, start, _within(hops, 1, 3), gr.INTENT_EDGES[kind])
        return {"linked": linked, "reached": reached, "spread": gr.spread(self.graph, reached)}

    def meta(self) -> DataFrame:
        return corpus_jobs.corpus_totals(self.docs, self.chunks)

    def rebuilt_index(self, scope: str | None = None, force: bool = False) -> store.Sync:
        """A run of index upkeep for all documents, or those of a folder or path `scope`; nothing is written here."""
        fresh = chunking.search_chunks(self.docs.filter("deleted_at is null")).withColumn("body_hash", F.sha2("body", 256)).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
        old = self.chunks.withColumn("body_hash", F.sha2(F.coalesce("body", F.lit("")), 256))
        inside = None if scope is None else (F.col("source") == scope) | F.startswith("source", F.lit(scope + "/"))
        return store.Sync(old, (fresh if inside is None else fresh.filter(inside)).select(*[c for c in fresh.columns if c in old.columns]), scope=inside, force=force)

    def refresh_index(self, path: str, embed, scope: str | None = None, force: bool = False, limit: int | None = None) -> dict[str, int]:
        """rebuilt_index() that embeds what has changed and writes the index below `path`; the numbers of the run.

        `embed` maps chunks to (chunk_id, embedding). With a `limit` only the first chunks are looked at and stale ones kept.
        """
        fresh = chunking.search_chunks(self.docs.filter("deleted_at is null")).withColumn("body_hash", F.sha2("body", 256))
        inside = None if scope is None else (F.col("source") == scope) | F.startswith("source", F.lit(scope + "/"))
        fresh = fresh if inside is None else fresh.filter(inside)
        fresh = fresh if limit is None else chunking.first_chunks(fresh, limit)
        return store.refreshed(fresh, path, embed, force, inside, partial=limit is not None)
