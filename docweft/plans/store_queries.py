"""Queries of stored-table changes and of batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import text as tx
from docweft.operators import chunking, corpus_jobs, store
from docweft.plans import sql
from docweft.session import spread, table

AS_OF = "2026-01-01 00:00:00"


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "maintenance_docs").dropDuplicates(["doc_pk"])


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks")


def _index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Stored chunk hashes, and those that a rebuild from live documents would give: one whole body per source and ordinal."""
    old = _chunks(spark, root).select("chunk_id", "source", F.sha2(F.coalesce("body", F.lit("")), 256).alias("body_hash"))
    live = _docs(spark, root).filter("deleted_at is null").select("source")
    new = _chunks(spark, root).join(live.distinct(), "source", "left_semi").select("chunk_id", "source", F.sha2(tx.clean(F.coalesce("body", F.lit(""))), 256).alias("body_hash"))
    return old, new


def upsert_merge(spark: SparkSession, root: str) -> DataFrame:
    old = _docs(spark, root).select("source", "title", "customer", "deleted_at")
    new = _docs(spark, root).filter("doc_pk % 3 = 0").select("source", F.upper("title").alias("title"), F.lit(None).cast("string").alias("customer"))
    added = new.withColumn("source", F.concat(F.lit("새/"), "source"))
    stored = store.upsert(old, new.unionByName(added), ["source"], keep=("customer",), values={"deleted_at": F.lit(None).cast("timestamp")})
    return stored.select("source", "title", "customer", F.unix_seconds("deleted_at").alias("deleted_s"))


def insert_if_absent(spark: SparkSession, root: str) -> DataFrame:
    docs = _docs(spark, root)
    seed = docs.select(F.when(F.col("doc_pk") % 2 == 0, F.col("source")).otherwise(F.concat(F.lit("초기/"), "source")).alias("source"), F.lit("seed").alias("title"))
    return store.insert_absent(docs.select("source", "title"), seed, ["source"])


def stale_chunks(spark: SparkSession, root: str) -> DataFrame:
    valid = _docs(spark, root).filter("deleted_at is null").select("source").distinct()
    return store.without_stale(_chunks(spark, root).select("chunk_id", "source"), valid, ["source"])


def hash_diff(spark: SparkSession, root: str) -> DataFrame:
    old, new = _index(spark, root)
    return store.changed(new, old).select("chunk_id")


def sync_report(spark: SparkSession, root: str) -> DataFrame:
    old, new = _index(spark, root)
    return store.Sync(old, new).report


def synced_index(spark: SparkSession, root: str) -> DataFrame:
    old, new = _index(spark, root)
    return store.Sync(old, new).result


def prefix_rename(spark: SparkSession, root: str) -> DataFrame:
    return store.renamed_folder(_docs(spark, root).select("source", "customer"), "다온화학", "다온정밀화학")


def soft_delete_restore(spark: SparkSession, root: str) -> DataFrame:
    docs = _docs(spark, root).select("doc_pk", "source", "customer", "deleted_at")
    marked = store.soft_deleted(docs, F.coalesce(F.startswith("source", F.lit("벼리재단/")), F.lit(False)), F.lit(AS_OF).cast("timestamp"))
    return store.restored(marked, F.col("doc_pk") % 5 == 0).select("doc_pk", F.col("deleted_at").isNull().alias("live"), (F.unix_micros("deleted_at") / 1_000_000).cast("bigint").alias("deleted_s"))


def purge_expired(spark: SparkSession, root: str) -> DataFrame:
    docs, chunks = store.purged(_docs(spark, root), _chunks(spark, root), F.lit(AS_OF).cast("timestamp"), 200)
    return docs.select(F.lit("doc").alias("what"), F.col("source").alias("key")).unionByName(chunks.select(F.lit("chunk").alias("what"), F.col("chunk_id").alias("key")))


def backfilled_ids(spark: SparkSession, root: str) -> DataFrame:
    own = _chunks(spark, root).select("chunk_id", "source", F.lit(None).cast("bigint").alias("document_pk"))
    return store.backfill(own, _docs(spark, root), ["source"], "document_pk", "doc_pk").select("chunk_id", "document_pk")


def folder_order(spark: SparkSession, root: str) -> DataFrame:
    folders = store.folders_of(_docs(spark, root), _chunks(spark, root).select(F.substring_index("folder", "/", 1).alias("name")))
    more = store.folder_added(folders, "새 고객사")
    return store.folders_reordered(more, ["새 고객사", "다온화학"]).select("name", F.col("sort_order").cast("bigint").alias("sort_order"))


def docs_per_folder(spark: SparkSession, root: str) -> DataFrame:
    folders = spark.createDataFrame([("빈 폴더",)], "name string")
    return corpus_jobs.docs_per_folder(table(spark, root, "maintenance_docs"), folders)


def corpus_totals(spark: SparkSession, root: str) -> DataFrame:
    assets = _docs(spark, root).select(F.col("doc_pk").alias("path"), F.length("title").alias("size_bytes"), "deleted_at")
    return corpus_jobs.corpus_totals(table(spark, root, "maintenance_docs"), _chunks(spark, root), assets)


def asset_refs(spark: SparkSession, root: str) -> DataFrame:
    own = _docs(spark, root).select("source", F.concat_ws("\n", "content", F.format_string("![a](images/%d.png) ![b](<http://x/y.png>) ![c](https://x/z.png) ![d](./e/%d.jpg \"t\")", F.col("doc_pk"), F.col("doc_pk"))).alias("content"))
    return own.select("source", F.explode(tx.image_refs(F.col("source"), F.col("content"))).alias("path"))


def unique_names(spark: SparkSession, root: str) -> DataFrame:
    own = _docs(spark, root).select("doc_pk", F.concat(F.coalesce("title", F.lit("")), F.lit(".md")).alias("name"))
    return store.unique_names(own, spark.createDataFrame([], "name string"), "name", ["doc_pk"])


def customers_canonical(spark: SparkSession, root: str) -> DataFrame:
    return corpus_jobs.canonical_customer(table(spark, root, "maintenance_requests").select(F.col("user_id").alias("name")).filter("name is not null"), {"다온화학": "다온정밀화학"})


QUERIES = {f.__name__: f for f in (upsert_merge, insert_if_absent, stale_chunks, hash_diff, sync_report, synced_index, prefix_rename, soft_delete_restore, purge_expired, backfilled_ids, folder_order, docs_per_folder, corpus_totals, asset_refs, unique_names, customers_canonical)}

_D = "d as (select distinct on (doc_pk) * from maintenance_docs order by doc_pk)"
_CLEAN = sql.strip("regexp_replace(replace(coalesce(body, ''), chr(65279), ''), '\\n{3,}', chr(10) || chr(10), 'g')")
_INDEX = f"""with {_D}, o as (select chunk_id, source, sha256(coalesce(body, '')) as body_hash from chunks),
n as (select chunk_id, source, sha256({_CLEAN}) as body_hash from chunks where source in (select source from d where deleted_at is null)),
t as (select n.* from n left join o using (chunk_id) where n.body_hash is distinct from o.body_hash)
"""

SQL = {
    "upsert_merge": f"""with {_D}, n as (select source, upper(title) as title from d where doc_pk % 3 = 0),
a as (select * from n union all select '새/' || source, title from n)
select d.source, case when a.source is not null then a.title else d.title end as title, d.customer, case when a.source is null then cast(floor(epoch_us(d.deleted_at) / 1000000) as bigint) end as deleted_s from d left join a using (source)
union all select a.source, a.title, null, null from a where a.source not in (select source from d)""",
    "insert_if_absent": f"with {_D}, s as (select case when doc_pk % 2 = 0 then source else '초기/' || source end as source from d) select source, title from d union all select source, 'seed' from s where source not in (select source from d)",
    "stale_chunks": "select chunk_id, source from chunks where source in (select source from maintenance_docs where deleted_at is null)",
    "hash_diff": _INDEX + "select chunk_id from t",
    "sync_report": _INDEX + "select (select count(*) from t) as upserted, (select count(*) from n) - (select count(*) from t) as skipped, (select count(*) from o where chunk_id not in (select chunk_id from n)) as deleted",
    "synced_index": _INDEX + "select chunk_id, source, body_hash from n",
    "prefix_rename": f"with {_D} select case when prefix(source, '다온화학/') then '다온정밀화학' || substring(source, 5) else source end as source, case when prefix(source, '다온화학/') then '다온정밀화학' else customer end as customer from d",
    "soft_delete_restore": f"with {_D}, m as (select doc_pk, case when prefix(source, '벼리재단/') and deleted_at is null then timestamptz '{AS_OF}+00' else deleted_at end as x from d), r as (select doc_pk, case when doc_pk % 5 = 0 then null else x end as x from m) select doc_pk, x is null as live, cast(floor(epoch_us(x) / 1000000) as bigint) as deleted_s from r",
    "purge_expired": f"with {_D}, g as (select * from d where deleted_at < timestamptz '{AS_OF}+00' - interval 200 days) select 'doc' as what, source as key from d where doc_pk not in (select doc_pk from g) union all select 'chunk', chunk_id from chunks where source not in (select source from g)",
    "backfilled_ids": f"with {_D} select chunk_id, doc_pk as document_pk from chunks left join d using (source)",
    "folder_order": f"with {_D}, f as (select customer as name from d union select string_split(folder, '/')[1] from chunks), g as (select name, row_number() over (order by lower(name), name) - 1 as o from f where name is not null and name <> '') select name, case name when '다온화학' then 1 else o end as sort_order from g union all select '새 고객사', 0",
    "docs_per_folder": f"with {sql.LIVE}, c as (select coalesce(customer, '') as name, count(*) as doc_count from live where not (not contains(source, '/') and (prefix(source, 'READABILITY_') or source in ({', '.join(map(sql.lit, tx.SYSTEM_DOCUMENTS))}))) group by 1) select name, doc_count from c union all select '빈 폴더', 0",
    "corpus_totals": f"with {sql.LIVE} select count(*) as documents, count(distinct customer) as customers, cast(coalesce(sum(strlen(content)), 0) as bigint) as bytes, (select count(*) from chunks where source in (select source from live)) as chunks, (select count(*) from (select distinct doc_pk from maintenance_docs where deleted_at is null)) as assets, (select cast(coalesce(sum(length(title)), 0) as bigint) from (select distinct doc_pk, title from maintenance_docs where deleted_at is null)) as asset_bytes from live",
    "asset_refs": r"""with d as (select distinct on (doc_pk) * from maintenance_docs order by doc_pk), c as (select source, concat_ws(chr(10), content, format('![a](images/{0}.png) ![b](<http://x/y.png>) ![c](https://x/z.png) ![d](./e/{0}.jpg "t")', doc_pk)) as content from d),
r as (select source, regexp_extract(unnest(regexp_extract_all(content, '!\[[^\]]*\]\(([^)]+)\)', 1)), '^\s*(\S+)', 1) as r from c)
select source, case when contains(source, '/') then regexp_replace(source, '/[^/]*$', '') || '/' || r else r end as path from r where r <> '' and not regexp_matches(r, '^(?:https?://|data:|/)')""",
    "unique_names": f"with {_D}, n as (select doc_pk, coalesce(title, '') as t, row_number() over (partition by coalesce(title, '') order by doc_pk) as i from d) select doc_pk, t || case when i > 1 then '_' || i else '' end || '.md' as name from n",
    "customers_canonical": r"select distinct user_id as name, case when user_id = '다온화학' or regexp_replace(user_id, '\s*\([^()]*\)\s*$', '') = '다온화학' then '다온정밀화학' else replace(regexp_replace(user_id, '\s*\([^()]*\)\s*$', ''), ' ', '_') end as canonical from maintenance_requests where user_id is not null",
}
