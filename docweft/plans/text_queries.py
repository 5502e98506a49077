"""Queries of text functions, chunking and term counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import text as tx
from docweft.operators import chunking, corpus_jobs, lexical, terms, tickets
from docweft.operators import graph as gr
from docweft.plans import sql
from docweft.session import spread, table

AS_OF = "2026-01-01 00:00:00"


def live_docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "maintenance_docs").filter("deleted_at is null").dropDuplicates(["source"])


def normalized_text(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "chunks").select("chunk_id", "body")).select("chunk_id", tx.normalized(F.col("body")).alias("normalized_body"), tx.compact(F.col("body")).alias("compact_body"))


def bm25_tokens_df(spark: SparkSession, root: str) -> DataFrame:
    chunks = spread(table(spark, root, "chunks").select("chunk_id", "body"))
    return lexical.TermIndex(chunks, text=F.col("body")).document_frequency()


def search_terms(spark: SparkSession, root: str) -> DataFrame:
    own = spread(table(spark, root, "maintenance_requests").select("idx", "title")).distinct()
    return own.select("idx", F.explode(tx.search_terms(F.col("title"))).alias("term"))


def detect_intent(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "maintenance_requests").select("idx", "title").distinct()
    return own.select("idx", tx.detect_intent(F.col("title")).alias("intent"), tx.graph_intent(F.col("title")).alias("graph_intent"))


def recency_boost(spark: SparkSession, root: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp")
    return table(spark, root, "maintenance_docs").select("doc_pk", F.round(tx.recency_boost(F.col("updated_at"), as_of), 6).alias("boost")).distinct()


def sha_ids(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "maintenance_docs").select("doc_pk", tx.document_id(F.col("source")).alias("document_id"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash")).distinct()


def path_parts(spark: SparkSession, root: str) -> DataFrame:
    s = F.col("source")
    return table(spark, root, "maintenance_docs").select("source", tx.basename(s).alias("filename"), tx.dirname(s).alias("folder"), tx.stem(s).alias("stem"), tx.suffix(s).alias("suffix"), tx.customer_key(F.col("customer")).alias("customer_key")).distinct()


def html_to_text(spark: SparkSession, root: str) -> DataFrame:
    own = spread(table(spark, root, "maintenance_requests").select("idx", "content"))
    return own.select("idx", tickets.html_to_text(F.col("content")).alias("text")).distinct()


def classify_docs(spark: SparkSession, root: str) -> DataFrame:
    return corpus_jobs.classified(spread(table(spark, root, "maintenance_docs").select("source", "content"))).distinct()


def readable_docs(spark: SparkSession, root: str) -> DataFrame:
    return corpus_jobs.cleaned(spread(table(spark, root, "maintenance_docs").select("doc_pk", "content"))).select("doc_pk", "status", "content").distinct()


def table_cells(spark: SparkSession, root: str) -> DataFrame:
    docs = spread(table(spark, root, "maintenance_docs").select("doc_pk", "content"))
    return docs.select("doc_pk", F.explode(tx.table_rows(F.col("content"))).alias("cells")).select("doc_pk", F.col("cells")[0].alias("first"), F.size("cells").alias("n")).groupBy("first", "n").agg(F.countDistinct("doc_pk").alias("docs"))


def numbered_headings(spark: SparkSession, root: str) -> DataFrame:
    docs = spread(table(spark, root, "maintenance_docs").select("doc_pk", "content")).distinct()
    return docs.select("doc_pk", F.explode(tx.numbered_sections(F.col("content"))).alias("number", "s")).select("doc_pk", "number", F.col("s.title").alias("title"))


def chunk_windows(spark: SparkSession, root: str) -> DataFrame:
    docs = spread(table(spark, root, "documents").select("doc_id", tx.clean(F.col("text")).alias("body")))
    return chunking.windows(docs, "body").select("doc_id", F.col("window_no").cast("bigint").alias("window_no"), F.md5("part").alias("part_hash"), F.length("part").cast("bigint").alias("n"))


def chunk_windows_graph(spark: SparkSession, root: str) -> DataFrame:
    docs = spread(table(spark, root, "documents").select("doc_id", "text"))
    return chunking.windows(docs, "text", 1200, 150, 20, stripped=False).select("doc_id", F.col("window_no").cast("bigint").alias("window_no"), F.md5("part").alias("part_hash"), F.length("part").cast("bigint").alias("n"))


def search_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunking.search_chunks(live_docs(spark, root)).select("chunk_id", "source", "title", "heading", "ordinal", "body")


def graph_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunking.graph_chunks(gr.graph_documents(table(spark, root, "maintenance_docs")))


def term_statistics(spark: SparkSession, root: str) -> DataFrame:
    return terms.term_statistics(gr.graph_documents(table(spark, root, "maintenance_docs")))


def term_mining(spark: SparkSession, root: str) -> DataFrame:
    known = [x.lower() for d in (gr.SYSTEMS, gr.ISSUES) for name, v in d.items() for x in (name, *v)]
    docs = gr.graph_documents(table(spark, root, "maintenance_docs"))
    asked = tickets.graph_tickets(tickets.unique_tickets(table(spark, root, "maintenance_requests")), limit=None)
    return terms.mine(docs, known, customers=gr.customer_count(docs, asked))


def typed_json(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day")).groupBy("day").agg(F.sum("k").alias("total"), F.count("k").alias("n"))


QUERIES = {f.__name__: f for f in (normalized_text, bm25_tokens_df, search_terms, detect_intent, recency_boost, sha_ids, path_parts, html_to_text, classify_docs, readable_docs, table_cells, numbered_headings, chunk_windows, chunk_windows_graph, search_chunks, graph_chunks, term_statistics, term_mining, typed_json)}

_GRAPH_DOCS = f"""docs as (select source, case when trim(coalesce(title, '')) = '' then source else {sql.strip("title")} end as title,
  case when {sql.strip("coalesce(customer, '')")} = '' then '{gr.NO_CUSTOMER}' else {sql.strip("customer")} end as customer, coalesce(content, '') as content
  from (select distinct on (source) * from maintenance_docs where deleted_at is null order by source, doc_pk) as d
  where regexp_replace(source, '^.*/', '') not in ({", ".join(map(sql.lit, gr.EXCLUDED))}) and coalesce(customer, '') not in ({", ".join(map(sql.lit, gr.TICKET_FOLDERS))})
  and string_split(source, '/')[1] not in ({", ".join(map(sql.lit, gr.TICKET_FOLDERS))}))"""
_TERMS = f"""with {_GRAPH_DOCS},
hits as (select source, customer, unnest(list_distinct(regexp_extract_all(lower(content), '[가-힣]{{2,}}|[a-z][a-z0-9._-]{{1,}}'))) as term from docs),
stats as (select term, count(*) as doc_freq, count(distinct customer) as customers from hits where term not in ({", ".join(map(sql.lit, terms.STOP))}) group by term)
"""


def _windows(source: str, body: str, size: int, overlap: int, least: int, stripped: bool) -> str:
    step = size - overlap
    part = f"substring({body}, cast(i * {step} + 1 as int), {size})"
    part = sql.strip(part) if stripped else part
    return f"""select doc_id, i as window_no, md5(part) as part_hash, length(part) as n from (
  select doc_id, i, {part} as part from {source}, lateral (select unnest(range(cast(greatest(1, ceil((length({body}) - {size}) / {step}.0) + 1) as bigint))) as i) where length({body}) > 0) where length(part) >= {least}"""


_NOISE = "(regexp_full_match(term, '[가-힣]+') and (" + " or ".join(f"(suffix(term, {sql.lit(s)}) and length(term) >= {len(s) + 2})" for s in tx.INFLECTIONS) + ")) or regexp_full_match(term, '[0-9a-f]{2}') or " + " or ".join(f"suffix(term, {sql.lit(s)})" for s in tx.IMAGE_ENDS)
_KNOWN = ", ".join(sql.lit(x.lower()) for d in (gr.SYSTEMS, gr.ISSUES) for name, v in d.items() for x in (name, *v))
_VISIBLE = r"regexp_replace({}, '(?:\s|\p{{Z}}|\x{{feff}}|[\x1c-\x1f\x{{85}}])+', '', 'g')"

SQL = {
    "normalized_text": f"select chunk_id, {sql.normalized('body')} as normalized_body, {sql.compact('body')} as compact_body from chunks",
    "bm25_tokens_df": f"select term, count(distinct chunk_id) as df from (select chunk_id, unnest({sql.bm25_tokens('body')}) as term from chunks) group by term",
    "search_terms": f"select distinct idx, term from (select idx, {sql.without_particle('w')} as term from (select idx, unnest({sql.words('title')}) as w from maintenance_requests)) where (length(term) >= 2 or regexp_full_match(term, '[0-9]+')) and term not in ({', '.join(map(sql.lit, tx.SEARCH_STOPWORDS))})",
    "detect_intent": f"select distinct idx, {sql.first_of("replace(lower(coalesce(title, '')), ' ', '')", tx.INTENTS, tx.DEFAULT_INTENT)} as intent, {sql.first_of("lower(coalesce(title, ''))", tx.GRAPH_INTENTS, 'default')} as graph_intent from maintenance_requests",
    "recency_boost": f"select distinct doc_pk, round(coalesce(greatest(0.0, 0.05 * (1 - least(greatest(0.0, (epoch_us(timestamptz '{AS_OF}+00') - epoch_us(updated_at)) / 86400000000.0), 365.0) / 365.0)), 0.0), 6) as boost from maintenance_docs where updated_at is not null union select distinct doc_pk, 0.0 from maintenance_docs where updated_at is null",
    "sha_ids": "select distinct doc_pk, left(sha1(source), 16) as document_id, sha256(coalesce(content, '')) as content_hash from maintenance_docs",
    "path_parts": r"select distinct source, regexp_replace(source, '^.*/', '') as filename, case when contains(source, '/') then regexp_replace(source, '/[^/]*$', '') else '' end as folder, regexp_replace(regexp_replace(source, '^.*/', ''), '(.)\.[^.]*$', '\1') as stem, regexp_extract(regexp_replace(source, '^.*/', ''), '.(\.[^.]+)$', 1) as suffix, lower(regexp_replace(coalesce(customer, ''), '(?:\s|\p{Z}|_)+', '', 'g')) as customer_key from maintenance_docs",
    "classify_docs": f"select distinct source, {sql.first_of("lower(regexp_replace(regexp_replace(source, '^.*/', ''), '(.)\\.[^.]*$', '\\1') || chr(10) || left(coalesce(content, ''), 3000))", tx.DOCUMENT_KINDS, tx.DEFAULT_KIND)} as kind from maintenance_docs",
    "chunk_windows": "with b as (select doc_id, " + sql.strip(r"regexp_replace(replace(text, chr(65279), ''), '\n{3,}', chr(10) || chr(10), 'g')") + " as body from documents) " + _windows("b", "body", 1800, 250, 80, True),
    "chunk_windows_graph": _windows("documents", "text", 1200, 150, 20, False),
    "term_statistics": _TERMS + "select term, doc_freq, customers from stats",
    "term_mining": _TERMS
    + rf""", keys as (select distinct lower(regexp_replace(customer, '(?:\s|\p{{Z}}|_)+', '', 'g')) as ck from docs),
n as (select greatest((select count(*) from docs), 1) as n_docs, (select count(distinct customer) from docs) + (select count(distinct lower(regexp_replace(user_id, '(?:\s|\p{{Z}}|_)+', '', 'g'))) from maintenance_requests
  where {sql.strip("coalesce(user_id, '')")} <> '' and lower(regexp_replace(user_id, '(?:\s|\p{{Z}}|_)+', '', 'g')) not in (select ck from keys)) as n_customers),
x as (select *, doc_freq / n_docs as raw, 1.0 - least(customers / n_customers, 1.0) as focus from stats, n where doc_freq >= 3 and term not in ({_KNOWN}) and not ({_NOISE}))
select term, doc_freq, round(raw, 4) as share, customers, round(doc_freq * (1.0 - raw) * (0.3 + 0.7 * focus), 2) as score from x where raw <= 0.35 order by score desc, term limit 80""",
    "typed_json": "select strftime(ts, '%Y-%m-%d') as day, cast(sum(try_cast(json_extract_string(props, '$.k') as int)) as bigint) as total, count(try_cast(json_extract_string(props, '$.k') as int)) as n from events group by 1",
    "numbered_headings": r"""select doc_pk, number, arg_max(title, k) as title from (
  select doc_pk, k, cast(regexp_extract(line, '^##\s+(\d+)\.\s+(.+?)[ \t\r]*$', 1) as int) as number, regexp_extract(line, '^##\s+(\d+)\.\s+(.+?)[ \t\r]*$', 2) as title from (
    select doc_pk, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as k from (select distinct on (doc_pk) doc_pk, content from maintenance_docs order by doc_pk)) where regexp_matches(line, '^##\s+\d+\.\s+\S')) group by doc_pk, number""",
}
