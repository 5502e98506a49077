"""Queries of single operators: changes of stored tables, splitters, text functions, contexts and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import text as tx
from docweft.operators import corpus_jobs, hybrid, lexical, snippets, store, tickets, vector
from docweft.plans import search_queries as sq
from docweft.plans import sql
from docweft.plans.store_queries import AS_OF, _chunks, _docs, _index
from docweft.plans.store_queries import _INDEX as _INDEX_SQL
from docweft.plans.text_queries import _GRAPH_DOCS
from docweft.session import spread, table

FOLDER = "다온화학"
ALIASES = {"배수 펌프": "배수펌프 배수모터", "점검": "검수"}


# ---- Stored tables -----------------------------------------------------------------------------------------
def ticket_upsert(spark: SparkSession, root: str) -> DataFrame:
    old = tickets.unique_tickets(table(spark, root, "maintenance_requests")).select("idx", "user_id", "title", "status_id")
    new = old.filter("idx % 4 = 0").select("idx", F.upper("title").alias("title"), F.lit(9).alias("status_id"))
    return store.upsert(old, new.unionByName(new.withColumn("idx", -F.col("idx"))), ["idx"], keep=("title",))


def _scoped(spark: SparkSession, root: str) -> store.Sync:
    old, new = _index(spark, root)
    inside = F.startswith("source", F.lit(FOLDER + "/"))
    return store.Sync(old, new.filter(inside), scope=inside)


def scoped_index(spark: SparkSession, root: str) -> DataFrame:
    return _scoped(spark, root).result


def scoped_report(spark: SparkSession, root: str) -> DataFrame:
    return _scoped(spark, root).report


def forced_report(spark: SparkSession, root: str) -> DataFrame:
    old, new = _index(spark, root)
    return store.Sync(old, new, force=True).report


def model_scoped_upsert(spark: SparkSession, root: str) -> DataFrame:
    """Vectors are kept by chunk, model and dimension: another model's stay."""
    own = table(spark, root, "embeddings").select("vec_id", F.lit("a").alias("embedding_model"), F.size("embedding").alias("embedding_dim"), "label")
    new = own.filter("vec_id % 2 = 0").withColumn("embedding_model", F.when(F.col("vec_id") % 4 == 0, "a").otherwise("b")).withColumn("label", F.lit(-1))
    return store.upsert(own, new, ["vec_id", "embedding_model", "embedding_dim"])


def orphans(spark: SparkSession, root: str) -> DataFrame:
    live = _docs(spark, root).filter("deleted_at is null").select("source")
    return store.without_orphans(_chunks(spark, root).select("chunk_id", "source"), live.distinct(), ["source"])


def _assets(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).select(F.explode(F.array(F.concat(tx.dirname(F.col("source")), F.format_string("/images/%d.png", F.col("doc_pk"))), F.concat(F.lit("frei/"), F.col("doc_pk").cast("string")))).alias("path"), F.lit(None).cast("timestamp").alias("deleted_at"))


def _showing(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).filter("doc_pk % 3 = 0").select("source", F.format_string("![a](images/%d.png)", F.col("doc_pk")).alias("content"))


def assets_deleted(spark: SparkSession, root: str) -> DataFrame:
    marked = store.assets_deleted_with(_assets(spark, root), _showing(spark, root), F.lit(AS_OF).cast("timestamp"))
    return marked.select("path", F.col("deleted_at").isNull().alias("live")).distinct()


def exported_paths(spark: SparkSession, root: str) -> DataFrame:
    return store.exported(_showing(spark, root), _assets(spark, root).distinct(), [FOLDER])


def folder_chunks_left(spark: SparkSession, root: str) -> DataFrame:
    return store.without_folder(_chunks(spark, root).select("chunk_id", "source"), FOLDER)


def import_log(spark: SparkSession, root: str) -> DataFrame:
    files = table(spark, root, "raw_requests").groupBy("file_name").agg(F.count("*").alias("row_count"), F.max("import_id").alias("import_id"))
    log = files.select(F.sha2("file_name", 256).alias("file_sha256"), "file_name", "row_count")
    return store.import_log(log, log.filter("row_count % 2 = 0").withColumn("row_count", F.col("row_count") + 1))


def content_status(spark: SparkSession, root: str) -> DataFrame:
    before = spread(_docs(spark, root).select("doc_pk", "source", "content"))
    after = before.filter("doc_pk % 7 != 0").select("source", tx.clean(F.col("content")).alias("content"))
    return corpus_jobs.content_status(before.filter("doc_pk % 5 != 0"), after)


def import_summary(spark: SparkSession, root: str) -> DataFrame:
    own = spread(_docs(spark, root).select("doc_pk", "source", "content"))
    return corpus_jobs.import_summary(own.select("source", tx.clean(F.col("content")).alias("content")), own.filter("doc_pk % 5 != 0").select("source", "content"))


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    return corpus_jobs.inventory(_docs(spark, root).select(F.concat("source", F.when(F.col("doc_pk") % 3 == 0, ".PNG").otherwise("")).alias("path"), F.octet_length("content").alias("size")))


def folder_renamed(spark: SparkSession, root: str) -> DataFrame:
    """A folder renamed in documents, assets, chunks and the list of folders."""
    docs = _docs(spark, root)
    names = docs.select(F.col("customer").alias("name")).distinct()
    assets = docs.select(F.concat("source", F.lit("/a.png")).alias("path"))
    parts = store.renamed_everywhere(docs.select("source", "customer"), assets, _chunks(spark, root).select("source", "folder"), names, FOLDER, "다온정밀화학")
    shown = [("doc", "source", "customer"), ("asset", "path", None), ("chunk", "source", "folder"), ("folder", "name", None)]
    rows = [df.select(F.lit(kind).alias("what"), F.col(a).alias("a"), (F.col(b) if b else F.lit(None).cast("string")).alias("b")) for df, (kind, a, b) in zip(parts, shown, strict=True)]
    return reduce(lambda x, y: x.unionByName(y), rows).groupBy("what", "a", "b").agg(F.count("*").alias("n"))


def updated_docs(spark: SparkSession, root: str) -> DataFrame:
    docs = _docs(spark, root).select("doc_pk", "source", "title", "customer", "content", "updated_at")
    changes = docs.filter("doc_pk % 4 = 0").select("source", F.lit("neu").alias("content")).union(spark.createDataFrame([("gibt es nicht", "x")], "source string, content string"))
    changed = store.updated(docs, changes, F.lit(AS_OF).cast("timestamp"))
    return changed.select("doc_pk", F.md5("content").alias("content_md5"), F.unix_seconds("updated_at").alias("changed_s"))


def fetched_chunks(spark: SparkSession, root: str) -> DataFrame:
    keys = [r.chunk_id for r in _chunks(spark, root).select("chunk_id").orderBy(F.desc("chunk_id")).limit(50).collect()]
    return store.fetched(_chunks(spark, root).select("chunk_id", "source"), [*keys, *keys[:5], "fehlt"], "chunk_id").select("chunk_id", "source", F.col("place").cast("bigint").alias("place"))


# ---- Splitters and text functions --------------------------------------------------------------------------
def section_paths(spark: SparkSession, root: str) -> DataFrame:
    """The headings that each stretch of text stands under."""
    from docweft.operators.chunking import heading_path_sections

    docs = spread(_docs(spark, root).select("doc_pk", "content")).filter("content is not null")
    return docs.select("doc_pk", F.posexplode(heading_path_sections(F.col("content"))).alias("n", "s")).select("doc_pk", F.col("n").cast("bigint").alias("n"), F.array_join("s.path", " > ").alias("path"), F.md5("s.body").alias("body_md5"))


def unified_tokens(spark: SparkSession, root: str) -> DataFrame:
    own = spread(_chunks(spark, root).select("chunk_id", F.coalesce("body", F.lit("")).alias("body")))
    return own.select(F.explode(tx.unified_tokens(F.col("body"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def field_tokens(spark: SparkSession, root: str) -> DataFrame:
    own = spread(_chunks(spark, root).select("chunk_id", F.coalesce("body", F.lit("")).alias("body")))
    return own.select(F.explode(tx.field_tokens(F.col("body"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def legacy_cosine(spark: SparkSession, root: str) -> DataFrame:
    own = spread(_chunks(spark, root).select("chunk_id", F.coalesce("body", F.lit("")).alias("body")))
    found = lexical.cosine_scores(own, sq.QUERY, F.col("body"))
    return found.orderBy(F.round("score", 9).desc(), "chunk_id").limit(50).select("chunk_id", F.round("score", 6).alias("score"))


def legacy_search(spark: SparkSession, root: str) -> DataFrame:
    found = lexical.cosine_search(spread(_chunks(spark, root).select("chunk_id", "source", "title", "body")), f"{FOLDER} 서버 접속 경로", 50)
    return found.select("chunk_id", F.round("score", 6).alias("score"))


def unquoted_refs(spark: SparkSession, root: str) -> DataFrame:
    own = _docs(spark, root).select("source", F.format_string("![a]('images/%d.png') ![b](HTTPS://x/y.png) ![c](//x/z.png) ![d](\"e/%d.jpg\" t)", F.col("doc_pk"), F.col("doc_pk")).alias("content"))
    return own.select("source", F.explode(tx.image_refs(F.col("source"), F.col("content"), True)).alias("path"))


def aliased_titles(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "maintenance_requests").select("idx", "title").filter("title is not null").distinct()
    return own.select("idx", tx.with_aliases(F.col("title"), ALIASES).alias("query"))


def embedding_texts(spark: SparkSession, root: str) -> DataFrame:
    fields = ("title", "folder", "filename", "heading", "body")
    text = tx.embedding_text(*[F.col(c) for c in fields])
    return _chunks(spark, root).select("chunk_id", F.md5(text).alias("text_md5"), tx.body_hash(text, "hash", "h1", 384).alias("body_hash"))


def markdown_cells(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "maintenance_requests").select("idx", F.md5(tx.markdown_value(F.col("content"))).alias("cell_md5")).distinct()


def fenced_blocks(spark: SparkSession, root: str) -> DataFrame:
    own = _docs(spark, root).select("doc_pk", F.concat(F.lit("vorab\n"), F.when(F.col("doc_pk") % 2 == 0, "````markdown\n").otherwise("```markdown\n"), F.coalesce("title", F.lit("-")), F.when(F.col("doc_pk") % 2 == 0, "\n````").otherwise("\n```")).alias("content"))
    return own.select("doc_pk", tx.fenced_markdown(F.col("content")).alias("block"))


def simple_names(spark: SparkSession, root: str) -> DataFrame:
    name = tx.simplified_name(F.col("source"), F.coalesce("customer", F.lit("-")), (*tx.DOCUMENT_KINDS, tx.DEFAULT_KIND), "20260101", "문서")
    return _docs(spark, root).select("doc_pk", name.alias("name"), tx.safe_name(F.concat("source", F.lit(" <a:b>?"))).alias("safe"), tx.is_safe_path(F.col("source")).alias("is_safe"))


def ticket_snippets(spark: SparkSession, root: str) -> DataFrame:
    own = tickets.unique_tickets(table(spark, root, "maintenance_requests")).select("idx", F.coalesce("notes", F.lit("")).alias("notes"))
    return own.select("idx", tx.snippet(F.lit("점검 요청"), F.col("notes"), 60, 20).alias("snippet"))


def imported_texts(spark: SparkSession, root: str) -> DataFrame:
    return spread(_docs(spark, root).select("doc_pk", "title", "content")).filter("content is not null").select("doc_pk", F.md5(tx.imported(F.col("content"), F.coalesce("title", F.lit("")))).alias("text_md5"))


def company_folders(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).withColumn("path", F.concat(F.when(F.col("doc_pk") % 3 == 0, "x/").otherwise("x/corpus/"), "source")).select("doc_pk", corpus_jobs.company_of("path", "corpus").alias("company"))


# ---- Answers -----------------------------------------------------------------------------------------------
def nearest_live(spark: SparkSession, root: str) -> DataFrame:
    """Nearest embedded chunks of live documents, for vectors whose number is divisible by 20."""
    chunks = _chunks(spark, root).select("chunk_id", "source").join(sq.chunk_vectors(spark, root), "chunk_id", "left")
    own = chunks.withColumn("vec_id", F.conv(F.substring(F.md5("chunk_id"), 1, 15), 16, 10).cast("bigint")).withColumn("embedding_model", F.when(F.col("vec_id") % 3 == 0, "old").otherwise("new"))
    asked = table(spark, root, "embeddings").filter("vec_id % 20 = 0")
    found = vector.live_nearest(own, table(spark, root, "maintenance_docs"), asked, 5, "new", same=True)
    return found.select("query_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def contexts(spark: SparkSession, root: str) -> DataFrame:
    chunks = sq.chunk_table(spark, root)
    ranked = lexical.TermIndex(chunks).best(sq.title_queries(spark, root), 5).join(chunks.select("chunk_id", "source", "title", F.coalesce("body", F.lit("")).alias("body")), "chunk_id")
    return snippets.context(ranked.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("score", F.round("score", 2))).select("query_id", F.md5("context").alias("context_md5"))


def answer_chunks(spark: SparkSession, root: str) -> DataFrame:
    settings = sq.merged(sq.DEFAULTS, {"synonyms": sq.SYNONYMS})
    found = hybrid.search(sq.chunk_table(spark, root), sq.QUERY, F.lit(sq.AS_OF).cast("timestamp"), 20, settings=settings)
    return hybrid.for_answer(found).select("chunk_id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (ticket_upsert, scoped_index, scoped_report, forced_report, model_scoped_upsert, orphans, assets_deleted, exported_paths, folder_chunks_left, import_log, content_status, import_summary, file_inventory, folder_renamed, updated_docs, fetched_chunks, section_paths, unified_tokens, field_tokens, legacy_cosine, legacy_search, unquoted_refs, aliased_titles, embedding_texts, markdown_cells, fenced_blocks, simple_names, ticket_snippets, imported_texts, company_folders, nearest_live, contexts, answer_chunks)}

_D = "d as (select distinct on (doc_pk) * from maintenance_docs order by doc_pk)"
_ONE = "tk as (select distinct on (idx) * from maintenance_requests order by idx, imported_at desc nulls last, last_import_id desc nulls last)"
_SHOWN = f"{_D}, shown as (select source, doc_pk, case when contains(source, '/') then regexp_replace(source, '/[^/]*$', '') || '/images/' || doc_pk || '.png' else 'images/' || doc_pk || '.png' end as path from d where doc_pk % 3 = 0), assets as (select case when contains(source, '/') then regexp_replace(source, '/[^/]*$', '') else '' end || '/images/' || doc_pk || '.png' as path from d union all select 'frei/' || doc_pk from d)"
_CLEAN_DOC = sql.strip(r"regexp_replace(replace(content, chr(65279), ''), '\n{3,}', chr(10) || chr(10), 'g')")
_FLAT = r"trim(regexp_replace(lower(coalesce(body, '')), '(?:\s|\p{Z})+', ' ', 'g'))"
_BLANKS = r"'(?:\s|\p{Z})+'"


def _legacy(name: str, rows: str, key: str, e: str) -> str:
    """CTEs that end in `name` (`key`, g): the legacy grams of each row; forms are materialised, as they are used often."""
    grams = ", ".join(sql.grams("dense", n) for n in (2, 3, 4))
    return f"""{name}_f as materialized (select {key}, trim(regexp_replace(lower({e}), {_BLANKS}, ' ', 'g')) as flat from {rows}),
{name}_d as materialized (select *, replace(flat, ' ', '') as dense from {name}_f),
{name} as (select {key}, unnest(list_concat({grams}, list_filter(string_split(flat, ' '), lambda w: w <> ''))) as g from {name}_d)"""


LINES = r"""lines as (select doc_pk, generate_subscripts(l, 1) as k, unnest(l) as line from (select doc_pk, string_split_regex(content, '\r\n|[\n\r]') as l from d where content is not null)),
h as (select *, length(regexp_extract(line, '^(#{1,6})\s+.*$', 1)) as level, """ + sql.strip(r"regexp_extract(line, '^#{1,6}\s+(.*)$', 1)") + """ as head from lines),
s as (select *, sum(case when level > 0 then 1 else 0 end) over (partition by doc_pk order by k) as seg from h),
b as (select doc_pk, seg, """ + sql.strip("string_agg(case when level = 0 then line end, chr(10) order by k)") + """ as body, """ + ", ".join(f"max(p{i}) as p{i}, arg_max(t{i}, p{i}) as t{i}" for i in range(1, 7)) + """ from (
  select *, """ + ", ".join(f"max(case when level = {i} then k end) over w as p{i}, arg_max(case when level = {i} then head end, case when level = {i} then k end) over w as t{i}" for i in range(1, 7)) + """ from s window w as (partition by doc_pk order by k rows between unbounded preceding and current row)) group by doc_pk, seg),
p as (select doc_pk, seg, body, list_filter([""" + ", ".join(f"case when p{i} is not null and p{i} > {'greatest(' + ', '.join(f'coalesce(p{j}, 0)' for j in range(1, i)) + ')' if i > 1 else '0'} then t{i} end" for i in range(1, 7)) + "], lambda x: x is not null and x <> '') as path from b where body <> '')"

_STARTS = "unnest(range(cast(greatest(1, ceil((length({0}) - {1}) / {2}.0) + 1) as bigint)))"
_H1 = sql.strip(r"regexp_extract(content, '(?m)^#\s+(.+)$', 1)")
_OWN = sql.strip(r"regexp_extract(section, '(?m)^#{1,3}\s+(.+)$', 1)")
_SECTIONS = rf"""t as (select source, {_CLEAN_DOC} as content from live where content is not null),
u as (select source, content, case when {_H1} <> '' then {_H1} else regexp_replace(regexp_replace(source, '^.*/', ''), '(.)\.[^.]*$', '\1') end as title from t where content <> ''),
x as (select source, title, generate_subscripts(l, 1) as sec, {sql.strip("unnest(l)")} as section from (select source, title, string_split(regexp_replace(content, '(?m)^(#{{1,3}}\s)', chr(1) || '\1', 'g'), chr(1)) as l from u)),
y as (select *, {_OWN} as own from x where section <> ''),
z as (select * exclude (own), case when own <> '' then own else title end as heading from y where not {sql.any_of("case when own <> '' then own else title end", tx.SKIPPED_SECTIONS)}),
w as (select *, {_STARTS.format("section", 1800, 1550)} as i from z),
v as (select *, {sql.strip("substring(section, cast(i * 1550 + 1 as int), 1800)")} as body from w),
n as (select *, row_number() over (partition by source order by sec, i) as k from v where length(body) >= 80)"""
_READABLE = sql.strip(r"regexp_replace(regexp_replace(regexp_replace(replace(content, chr(65279), ''), '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
_SEEN = r"regexp_replace({}, '(?:\s|\p{{Z}}|\x{{feff}}|\x{{85}}|\x0b)+', '', 'g')"
_UNMARKED = sql.strip(r"regexp_replace(regexp_replace(regexp_replace(c, '<[^>]+>', '', 'g'), '[ \t\r\f\x0b]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")

SQL = {
    "search_chunks": f"with {sql.LIVE}, {_SECTIONS} select left(sha1(source), 16) || '_chunk_' || lpad(k::varchar, 4, '0') as chunk_id, source, title, heading, k - 1 as ordinal, body from n",
    "graph_chunks": f"""with {_GRAPH_DOCS}, d as (select source as doc_pk, content from docs), {LINES},
w as (select *, {_STARTS.format("body", 1200, 1050)} as i from p), c as (select *, substring(body, cast(i * 1050 + 1 as int), 1200) as part from w)
select doc_pk as source, row_number() over (partition by doc_pk order by seg, i) - 1 as ordinal, path as heading_path, part as body from c where length(part) >= 20""",
    "readable_docs": f"""with t as (select distinct doc_pk, content from maintenance_docs), r as (select *, {_READABLE} as new from t),
s as (select *, case when content is null then 'same' when {_SEEN.format("content")} <> {_SEEN.format("new")} then 'refused' when content = new then 'same' else 'changed' end as status from r)
select distinct doc_pk, status, case when status = 'changed' then new else content end as content from s""",
    "table_cells": rf"""with t as (select distinct doc_pk, content from maintenance_docs), u as (select doc_pk, unnest(string_split_regex(content, '\r\n|[\n\r]')) as raw from t), l as (select doc_pk, {sql.strip("raw")} as line from u),
c as (select doc_pk, string_split(regexp_replace(line, '^\||\|$', '', 'g'), '|') as cells from l where prefix(line, '|') and not regexp_matches(line, '^\|[\s:|-]+\|?$'))
select {sql.strip("cells[1]")} as first, len(cells) as n, count(distinct doc_pk) as docs from c group by all""",
    "html_to_text": rf"""with t as (select distinct idx, replace(replace(replace(replace(replace(replace(coalesce(content, ''), '&nbsp;', ' '), '&#64;', '@'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as c from maintenance_requests),
l as (select idx, regexp_replace(regexp_replace(c, '(?i)<\s*br\s*/?>', chr(10), 'g'), '(?i)</\s*(?:p|div|li|tr|h[1-6])\s*>', chr(10), 'g') as c from t)
select distinct idx, {_UNMARKED} as text from l""",
    "ticket_upsert": f"with {_ONE}, n as (select idx, upper(title) as title from tk where idx % 4 = 0) select tk.idx, user_id, coalesce(n.title, tk.title) as title, case when n.idx is not null then 9 else status_id end as status_id from tk left join n using (idx) union all select -idx, null, title, 9 from n",
    "scoped_index": _INDEX_SQL + f"select chunk_id, source, body_hash from n where prefix(source, '{FOLDER}/') union all select chunk_id, source, body_hash from o where not coalesce(prefix(source, '{FOLDER}/'), false)",
    "scoped_report": _INDEX_SQL + f"select (select count(*) from t where prefix(source, '{FOLDER}/')) as upserted, (select count(*) from n where prefix(source, '{FOLDER}/')) - (select count(*) from t where prefix(source, '{FOLDER}/')) as skipped, (select count(*) from o where prefix(source, '{FOLDER}/') and chunk_id not in (select chunk_id from n)) as deleted",
    "forced_report": _INDEX_SQL + "select (select count(*) from n) as upserted, 0 as skipped, (select count(*) from o where chunk_id not in (select chunk_id from n)) as deleted",
    "model_scoped_upsert": "select vec_id, 'a' as embedding_model, len(embedding) as embedding_dim, case when vec_id % 4 = 0 then -1 else label end as label from embeddings union all select vec_id, 'b', len(embedding), -1 from embeddings where vec_id % 2 = 0 and vec_id % 4 <> 0",
    "orphans": "select chunk_id, source from chunks where source in (select source from maintenance_docs where deleted_at is null)",
    "assets_deleted": f"with {_SHOWN} select distinct path, path not in (select path from shown) as live from assets",
    "exported_paths": f"with {_SHOWN}, x as (select * from shown where prefix(source, '{FOLDER}/')) select distinct source as path, 'document' as kind from x union all select distinct path, 'asset' from x where path in (select path from assets)",
    "folder_chunks_left": f"select chunk_id, source from chunks where not prefix(source, '{FOLDER}/')",
    "import_log": "select sha256(file_name) as file_sha256, file_name, case when count(*) % 2 = 0 then count(*) + 1 else count(*) end as row_count from raw_requests group by file_name",
    "content_status": f"with {_D}, a as (select source, coalesce(content, '') as x from d where doc_pk % 5 <> 0), b as (select source, coalesce({_CLEAN_DOC}, '') as y from d where doc_pk % 7 <> 0) select source, case when x is null then 'added' when y is null then 'removed' when x = y then 'same' else 'changed' end as status from a full join b using (source)",
    "import_summary": f"with {_D}, a as (select source, {_CLEAN_DOC} as x from d), b as (select source, content as y, true as had from d where doc_pk % 5 <> 0), j as (select * from a left join b using (source)) select count(*) filter (had is null) as created, count(*) filter (had and x is distinct from y) as updated, count(*) filter (had and x is not distinct from y) as skipped from j",
    "file_inventory": f"with {_D}, f as (select lower(regexp_extract(regexp_replace(source || case when doc_pk % 3 = 0 then '.PNG' else '' end, '^.*/', ''), '.(\\.[^.]+)$', 1)) as kind, strlen(content) as size from d) select case when kind = '' then '(none)' else kind end as kind, count(*) as n, cast(coalesce(sum(size), 0) as bigint) as bytes from f group by 1",
    "folder_renamed": f"""with {_D}, r as (select 'doc' as what, case when prefix(source, '{FOLDER}/') then '다온정밀화학' || substring(source, {len(FOLDER) + 1}) else source end as a, case when prefix(source, '{FOLDER}/') then '다온정밀화학' else customer end as b from d
union all select 'asset', case when prefix(source, '{FOLDER}/') then '다온정밀화학' || substring(source, {len(FOLDER) + 1}) else source end || '/a.png', null from d
union all select 'chunk', case when prefix(source, '{FOLDER}/') then '다온정밀화학' || substring(source, {len(FOLDER) + 1}) else source end, case when prefix(source, '{FOLDER}/') then '다온정밀화학' else folder end from chunks
union all select 'folder', case when customer = '{FOLDER}' then '다온정밀화학' else customer end, null from (select distinct customer from d)) select what, a, b, count(*) as n from r group by all""",
    "updated_docs": f"with {_D} select doc_pk, md5(case when doc_pk % 4 = 0 then 'neu' else content end) as content_md5, case when doc_pk % 4 = 0 then cast(epoch(timestamptz '{AS_OF}+00') as bigint) else cast(floor(epoch_us(updated_at) / 1000000) as bigint) end as changed_s from d",
    "fetched_chunks": "select chunk_id, source, row_number() over (order by chunk_id desc) - 1 as place from chunks qualify place < 50",
    "legacy_search": f"""with {_legacy("cg", "chunks", "chunk_id", "coalesce(title, '') || chr(10) || coalesce(body, '')")}, {_legacy("qg", f"(select '{FOLDER} 서버 접속 경로' as query)", "query", "query")},
g as (select chunk_id, g, count(*) as c from cg group by all), q as (select g, count(*) as q from qg group by g), n as (select chunk_id, sqrt(sum(c * c)) as norm from g group by chunk_id),
s as (select chunk_id, sum(c * q) / (any_value(norm) * (select sqrt(sum(q * q)) from q)) as score from g join q using (g) join n using (chunk_id) group by chunk_id),
x as (select chunk_id, coalesce(score, 0) + case when string_split(source, '/')[1] <> '' and contains('{FOLDER}서버접속경로', lower(string_split(source, '/')[1])) then 0.55 else 0 end
  + {" + ".join(f"case when contains(lower(source || ' ' || coalesce(title, '')), '{t}') then 0.04 else 0 end" for t in (FOLDER, "서버", "접속", "경로"))} - case when string_split(source, '/')[1] = '공통자료' then 0.35 else 0 end
  + least(0.28, {" + ".join(f"case when contains(lower(coalesce(title, '') || chr(10) || coalesce(body, '')), '{w}') then 0.035 else 0 end" for w in lexical.ACCESS_WORDS)}) as score from chunks left join s using (chunk_id))
select chunk_id, round(score, 6) as score from x where score > 0 order by round(score, 9) desc, chunk_id limit 50""",
    "unquoted_refs": f"with {_D}, r as (select source, unnest(['images/' || doc_pk || '.png', 'e/' || doc_pk || '.jpg']) as r from d) select source, case when contains(source, '/') then regexp_replace(source, '/[^/]*$', '') || '/' || r else r end as path from r",
    "section_paths": f"with {_D}, {LINES} select doc_pk, row_number() over (partition by doc_pk order by seg) - 1 as n, array_to_string(path, ' > ') as path, md5(body) as body_md5 from p",
    "unified_tokens": f"with f as materialized (select {_FLAT} as form from chunks), h as materialized (select form, regexp_replace(form, '[^가-힣]', '', 'g') as hangul from f), t as (select unnest(list_concat(regexp_extract_all(form, '[가-힣A-Za-z0-9_./:@!+-]{{2,}}'), {sql.grams('hangul', 2)}, {sql.grams('hangul', 3)})) as token from h) select token, count(*) as n from t group by token",
    "field_tokens": f"with t as (select unnest(regexp_extract_all({_FLAT}, '[가-힣A-Za-z0-9_./:@!+-]{{2,}}')) as token from chunks) select token, count(*) as n from t group by token",
    "legacy_cosine": f"""with {_legacy("cg", "chunks", "chunk_id", "coalesce(body, '')")}, {_legacy("qg", f"(select {sql.lit(sq.QUERY)} as query)", "query", "query")},
g as (select chunk_id, g, count(*) as c from cg group by all), q as (select g, count(*) as q from qg group by g), n as (select chunk_id, sqrt(sum(c * c)) as norm from g group by chunk_id),
s as (select chunk_id, sum(c * q) / (any_value(norm) * (select sqrt(sum(q * q)) from q)) as score from g join q using (g) join n using (chunk_id) group by chunk_id)
select chunk_id, round(score, 6) as score from s order by round(score, 9) desc, chunk_id limit 50""",
    "aliased_titles": "select distinct idx, concat_ws(' ', title, " + ", ".join(f"case when contains(replace(title, ' ', ''), {sql.lit(k.replace(' ', ''))}) then {sql.lit(v)} end" for k, v in ALIASES.items()) + ") as query from maintenance_requests where title is not null",
    "embedding_texts": "with t as (select chunk_id, concat_ws(chr(10), " + ", ".join(f"case when {sql.strip(f)} <> '' then {sql.lit(label + ': ')} || {f} end" for label, f in zip(tx.EMBEDDING_LABELS, ("title", "folder", "filename", "heading", "body"), strict=True)) + ") as x from chunks) select chunk_id, md5(x) as text_md5, sha256('hash:h1:384' || chr(10) || x) as body_hash from t",
    "markdown_cells": r"""with t as (select distinct idx, coalesce(content, '') as c from maintenance_requests),
u as (select idx, replace(replace(replace(replace(replace(replace(c, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as c from t)
select distinct idx, md5(replace(replace(replace(replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '\|'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), '<br>')) as cell_md5 from u""",
    "fenced_blocks": f"with {_D} select doc_pk, {sql.strip("coalesce(title, '-')")} as block from d",
    "simple_names": rf"""with {_D}, a as (select doc_pk, source, coalesce(customer, '-') as c, regexp_replace(regexp_replace(source, '^.*/', ''), '(.)\.[^.]*$', '\1') as r from d),
b as (select *, case when prefix(r, c || '_') then substring(r, length(c) + 2) else r end as r1 from a),
e as (select *, regexp_replace(regexp_replace(r1, '^(?:{"|".join((*tx.DOCUMENT_KINDS, tx.DEFAULT_KIND))})_', ''), '_20260101$', '') as r2 from b)
select doc_pk, c || '_' || case when r2 in ('', c) then '문서' else r2 end || '_20260101.md' as name, regexp_replace({sql.strip(r"regexp_replace(source || ' <a:b>?', '[<>:''|?*\\/\x00-\x1f" + '"' + "]', '', 'g')").replace("[<>:''|", "[<>:|")}, {_BLANKS}, '_', 'g') as safe,
  source <> '' and not prefix(source, '/') and len(list_filter(string_split(source, '/'), lambda x: x = '' or prefix(x, '.'))) = 0 as is_safe from e""",
    "ticket_snippets": rf"""with {_ONE}, f as (select idx, trim(regexp_replace(coalesce(notes, ''), {_BLANKS}, ' ', 'g')) as t from tk),
p as (select *, least(case when strpos(lower(t), '점검') > 0 then strpos(lower(t), '점검') end, case when strpos(lower(t), '요청') > 0 then strpos(lower(t), '요청') end) as i from f),
s as (select *, cast(greatest(1, coalesce(i - 20, 1)) as int) as a from p)
select idx, case when t = '' then '' else case when a > 1 then '... ' else '' end || trim(substring(t, a, 60)) || case when a - 1 + 60 < length(t) then ' ...' else '' end end as snippet from s""",
    "imported_texts": rf"with {_D}, f as (select doc_pk, coalesce(title, '') as t, regexp_replace(regexp_replace(content, '^\x{{feff}}', ''), '\r\n?', chr(10), 'g') as c from d where content is not null) select doc_pk, md5(case when regexp_matches(c, '(?m)^#\s+\S') then c else '# ' || t || chr(10) || chr(10) || c end) as text_md5 from f",
    "company_folders": rf"""with {_D}, p as (select doc_pk, case when doc_pk % 3 = 0 then 'x/' else 'x/corpus/' end || source as path from d), a as (select doc_pk, string_split(path, '/') as l from p), b as (select doc_pk, l, coalesce(list_position(l, 'corpus'), 0) as i from a)
select doc_pk, case when i > 0 and len(l) > i then {sql.strip(r"regexp_replace(regexp_replace(l[i + 1], '\.[^.]*$', ''), '[_\s]+', ' ', 'g')")} else '99_기타_미분류' end as company from b""",
    "nearest_live": f"""with v as (select chunk_id, source, ('0x' || left(md5(chunk_id), 15))::bigint as id, embedding::double[] as e from chunks join embeddings on vec_id = ('0x' || left(md5(chunk_id), 7))::bigint % {sq.PLACES}),
o as (select * from v where id % 3 <> 0 and source in (select source from maintenance_docs where deleted_at is null)),
s as (select vec_id as query_id, id, round(greatest(0.0, least(1.0, list_cosine_similarity(e, embedding::double[]))), 9) as similarity from o, embeddings where vec_id % 20 = 0)
select query_id, round(similarity, 6) as similarity, row_number() over (partition by query_id order by similarity desc, id) as rank from s qualify rank <= 5""",
    "contexts": f"""with {sq._ASKED}, {sq._bm25("b", sql.SEARCHED)}, k as (select x.query_id, x.rank, '[근거 ' || x.rank || '] score=' || format('{{:.3f}}', round(x.score, 2)) || chr(10) || '파일: ' || c.source || chr(10) || '섹션: ' || coalesce(c.title, '') || chr(10) || coalesce(c.body, '') || chr(10) as item from {sq._top("b", 5)} x join chunks c using (chunk_id)),
u as (select *, sum(length(item)) over (partition by query_id order by rank) as so_far from k)
select query_id, md5(string_agg(item, chr(10) || '---' || chr(10) order by rank)) as context_md5 from u where so_far <= 5200 group by query_id""",
    "answer_chunks": f"""with m as ({sq._mode("hybrid")}), t as (select chunk_id, score, {sql.any_of("replace(coalesce(title, ''), ' ', '')", tx.LOW_VALUE_TITLES)} as low from m join chunks using (chunk_id)),
k as (select * from t where not low or (select bool_and(low) from t)) select chunk_id, score from k where score >= (select max(score) from k) * 0.25""",
}
