"""Changes to stored tables, from one snapshot to the next.

Every function takes the rows stored and returns the rows to store; nothing is changed in place. Keys
are taken to be unique on the stored side; of incoming rows with the same key any one is used.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import text as tx
from docweft.session import numbered, stage


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), values: dict[str, Column] | None = None) -> DataFrame:
    """`old` with the rows of `new` by `keys`: all columns replaced, but those in `keep` only by non-nulls.

    Columns that `new` lacks stay, and are null in new rows. `values` are set on the rows of `new`.
    """
    new = new.dropDuplicates(list(keys)).withColumns(values or {})
    rest = [c for c in old.columns if c not in keys]
    given = [c for c in rest if c in new.columns]
    incoming = new.select(*keys, F.lit(True).alias("_in"), *[F.col(c).alias(f"_n_{c}") for c in given])
    both = old.withColumn("_had", F.lit(True)).join(incoming, list(keys), "full")

    def value(c: str) -> Column:
        if c not in given:
            return F.col(c)
        mine = F.coalesce(f"_n_{c}", c) if c in keep else F.col(f"_n_{c}")
        return F.when(F.col("_in"), mine).otherwise(F.col(c)).alias(c)

    return both.select(*[F.col(c) if c in keys else value(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`old` and the rows of `new` whose keys it lacks."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True).select(*old.columns)


def without_stale(old: DataFrame, valid: DataFrame, keys: Sequence[str], scope: Column | None = None) -> DataFrame:
    """Rows whose keys are in `valid`; with no valid keys nothing is left. Rows outside `scope` stay."""
    inside = old if scope is None else old.filter(scope)
    kept = inside.join(valid.select(*keys), list(keys), "left_semi").select(*old.columns)
    return kept if scope is None else kept.unionByName(old.filter(~F.coalesce(scope, F.lit(False))))


def without_orphans(rows: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(parents.select(*keys), list(keys), "left_semi").select(*rows.columns)


def backfill(rows: DataFrame, parents: DataFrame, keys: Sequence[str], column: str, source: str) -> DataFrame:
    """`rows` with null `column` filled from the parents' `source` by `keys`."""
    found = parents.dropDuplicates(list(keys)).select(*keys, F.col(source).alias("_found"))
    return rows.join(found, list(keys), "left").withColumn(column, F.coalesce(column, "_found")).select(*rows.columns)


def renamed_prefix(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Folder `old` renamed to `new` in the paths of `column`."""
    path = F.col(column)
    return rows.withColumn(column, F.when(F.startswith(path, F.lit(old + "/")), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path))


def renamed_folder(docs: DataFrame, old: str, new: str) -> DataFrame:
    """Documents with the folder renamed in source; those in it have its new name as customer."""
    inside = F.startswith("source", F.lit(old + "/"))
    return renamed_prefix(docs.withColumn("customer", F.when(inside, new).otherwise(F.col("customer"))), "source", old, new)


def renamed_everywhere(docs: DataFrame, assets: DataFrame, chunks: DataFrame, folders: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables with folder `old` renamed: sources and customers, paths, sources and folders of chunks, and the name itself."""
    inside = F.startswith("source", F.lit(old + "/"))
    named = folders.withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name")))
    moved = renamed_prefix(chunks.withColumn("folder", F.when(inside, new).otherwise(F.col("folder"))), "source", old, new)
    return renamed_folder(docs, old, new), renamed_prefix(assets, "path", old, new), moved, named


def updated(docs: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """`docs` with the contents of `changes` (source, content) for the sources that there are; these have changed `at`."""
    given = changes.dropDuplicates(["source"]).select("source", F.col("content").alias("_content"), F.lit(True).alias("_given"))
    both = docs.join(given, "source", "left")
    return both.withColumns({"content": F.when(F.col("_given"), F.col("_content")).otherwise(F.col("content")), "updated_at": F.when(F.col("_given"), at).otherwise(F.col("updated_at"))}).select(*docs.columns)


def renamed_document(docs: DataFrame, source: str, new_source: str, title: str, customer: str, at: Column) -> DataFrame:
    """`docs` with one document under another path, title and customer."""
    own = F.col("source") == source
    values = {"title": F.lit(title), "customer": F.lit(customer), "updated_at": at, "source": F.lit(new_source)}
    return docs.select(*[F.when(own, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in docs.columns])


def fetched(rows: DataFrame, keys: Sequence[str], key: str) -> DataFrame:
    """The rows with the given `keys` and their place, in the order given; a key given again counts once."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(keys))), f"place int, {key} string")
    return rows.join(F.broadcast(wanted), key).orderBy("place")


def soft_deleted(docs: DataFrame, which: Column, at: Column) -> DataFrame:
    """Live documents of `which` marked as deleted `at`; those deleted before keep their time."""
    return docs.withColumn("deleted_at", F.when(which & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at")))


def restored(docs: DataFrame, which: Column) -> DataFrame:
    return docs.withColumn("deleted_at", F.when(which, F.lit(None).cast("timestamp")).otherwise(F.col("deleted_at")))


def purged(docs: DataFrame, chunks: DataFrame, as_of: Column, days: int | None = 30, which: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without those deleted more than `days` before `as_of` (None: at any time), of `which` if given."""
    gone = F.col("deleted_at").isNotNull()
    if days is not None:
        gone = gone & (F.col("deleted_at") < as_of - F.make_dt_interval(days=F.lit(days)))
    if which is not None:
        gone = gone & F.coalesce(which, F.lit(False))
    return docs.filter(~gone), chunks.join(docs.filter(gone).select("source").distinct(), "source", "left_anti").select(*chunks.columns)


def without_folder(chunks: DataFrame, folder: str) -> DataFrame:
    return chunks.filter(~F.startswith("source", F.lit(folder + "/")))


def assets_deleted_with(assets: DataFrame, docs: DataFrame, at: Column) -> DataFrame:
    """`assets` (path, deleted_at) with those marked that `docs` show."""
    shown = docs.select(F.explode(tx.image_refs(F.col("source"), F.col("content"))).alias("path")).distinct().withColumn("_shown", F.lit(True))
    marked = assets.join(shown, "path", "left")
    return marked.withColumn("deleted_at", F.when(F.col("_shown") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).select(*assets.columns)


def folders_of(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(name, sort_order): customers and given folder names, by name without regard to case."""
    every = docs.select(F.col("customer").alias("name")).union(names.select("name")).filter("name is not null and name != ''").distinct()
    return numbered(every, [F.lower("name"), F.col("name")], "sort_order").withColumn("sort_order", F.col("sort_order").cast("int"))


def folder_added(folders: DataFrame, name: str) -> DataFrame:
    """`folders` with `name` at the end, unless it is there."""
    last = folders.agg((F.coalesce(F.max("sort_order"), F.lit(-1)) + 1).cast("int").alias("sort_order"))
    return insert_absent(folders, last.select(F.lit(name).alias("name"), "sort_order"), ["name"])


def folders_reordered(folders: DataFrame, names: Sequence[str]) -> DataFrame:
    """`folders` with those named in the order given; the others keep theirs."""
    given = folders.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, _at int")
    return folders.join(F.broadcast(given), "name", "left").select("name", F.coalesce("_at", "sort_order").alias("sort_order"))


def unique_names(rows: DataFrame, taken: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """`rows` with `name` made unique among themselves and `taken`: the second becomes stem_2, and so on.

    Numbers go on after those that any name of the same stem already has, so a made name meets no given one.
    """
    base = F.regexp_replace(name, r"\.[^./]*$", "")
    ending = F.regexp_extract(name, r"(\.[^./]*)$", 1)
    held = taken.select(F.col(name).alias("_t"))
    every = held.unionByName(rows.select(F.col(name).alias("_t"))).filter(F.col("_t").rlike(r"_\d+(\.[^./]*)?$"))
    number = F.regexp_extract("_t", r"_(\d+)(\.[^./]*)?$", 1).try_cast("bigint")
    last = every.select(F.regexp_replace("_t", r"_(\d+)(\.[^./]*)?$", "$2").alias(name), number.alias("_n")).groupBy(name).agg(F.max("_n").alias("_last"))
    exact = held.distinct().select(F.col("_t").alias(name), F.lit(1).alias("_held"))
    # Numbers within a name from those of all rows, as one name may be that of a large part of them.
    sorted_ = numbered(rows, [name, *order], "_n")
    first = sorted_.groupBy(name).agg(F.min("_n").alias("_first"))
    known = sorted_.join(first, name).join(last, name, "left").join(exact, name, "left")
    placed = known.withColumn("_k", F.col("_n") - F.col("_first") + 1 + F.coalesce("_held", F.lit(0)))
    made = F.concat(base, F.lit("_"), (F.greatest(F.coalesce("_last", F.lit(1)), F.lit(1)) + F.col("_k") - 1).cast("string"), ending)
    return placed.withColumn(name, F.when(F.col("_k") > 1, made).otherwise(F.col(name))).select(*rows.columns)


def changed(new: DataFrame, old: DataFrame, key: str = "chunk_id", digest: str = "body_hash", force: bool = False) -> DataFrame:
    """Rows of `new` that are not stored or whose hash differs; all of them where forced."""
    if force:
        return new
    had = old.select(F.col(key), F.col(digest).alias("_old"))
    return new.join(had, key, "left").filter(~F.col(digest).eqNullSafe(F.col("_old"))).select(*new.columns)


class Sync:
    """One run of index maintenance: `new` rows against the `old` ones, by key and hash.

    result is the table to store, and report has the numbers of rows upserted, skipped and deleted. `scope`
    limits the run to the documents for which it is true; rows of others stay. A second run changes nothing.
    """

    def __init__(self, old: DataFrame, new: DataFrame, key: str = "chunk_id", digest: str = "body_hash", scope: Column | None = None, force: bool = False) -> None:
        own = old if scope is None else old.filter(scope)
        kept = without_stale(old, new, [key], scope)
        todo = changed(new, own, key, digest, force)
        self.todo = todo
        self.result = upsert(kept, todo, [key])
        sizes = own.select(key, F.lit(1).alias("_o")).join(new.select(key, F.lit(1).alias("_n")), key, "full").join(todo.select(key, F.lit(1).alias("_t")), key, "left")
        self.report = sizes.agg(F.count("_t").alias("upserted"), F.count_if(F.col("_n").isNotNull() & F.col("_t").isNull()).alias("skipped"), F.count_if(F.col("_n").isNull()).alias("deleted"))


def import_log(log: DataFrame, entry: DataFrame) -> DataFrame:
    """`log` with an entry (file_sha256, file_name, headers, row_count, imported_at): one for each file content."""
    return upsert(log, entry, ["file_sha256"])


def exported(docs: DataFrame, assets: DataFrame, folders: Sequence[str] = (), sources: Sequence[str] = ()) -> DataFrame:
    """(path, kind): the documents chosen by folder or path and the stored images they show, each once."""
    chosen = F.col("source").isin(*sources) if sources else F.lit(False)
    for f in folders:
        chosen = chosen | F.startswith("source", F.lit(f + "/"))
    own = docs.filter(chosen)
    shown = own.select(F.explode(tx.image_refs(F.col("source"), F.col("content"))).alias("path")).distinct()
    return own.select(F.col("source").alias("path"), F.lit("document").alias("kind")).distinct().unionByName(assets.select("path").join(shown, "path", "left_semi").distinct().withColumn("kind", F.lit("asset")))


def publish(index: DataFrame, path: str) -> str:
    """Writes an index as a snapshot below `path` and makes it the current one; the name of the snapshot.

    Readers of the one before go on reading it; the file that names the current one is written last.
    """
    spark, name = index.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    index.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return name


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The current snapshot of an index below `path`, if there is one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/current').first().value}")


def refreshed(fresh: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], force: bool = False, scope: Column | None = None, partial: bool = False, key: str = "chunk_id", digest: str = "body_hash") -> dict[str, int]:
    """One run of index upkeep that writes: chunks that are new or changed are embedded, merged and published.

    `fresh` has the chunks there should be, with their hash; `embed` maps those that need it to (key, embedding).
    Of a `partial` list (as of a first few chunks) stale ones are kept. Gives the numbers of chunks, of those
    upserted and skipped, and of stale ones deleted.
    """
    spark = fresh.sparkSession
    old = current(spark, path)
    if old is None:
        old = spark.createDataFrame([], fresh.schema).withColumn("embedding", F.lit(None).cast("array<double>"))
    run = Sync(old, fresh, key, digest, scope, force)
    todo = stage(run.todo.join(embed(run.todo).select(key, "embedding"), key, "left").select(*old.columns), "embedded")
    kept = old if partial else without_stale(old, fresh, [key], scope)
    found = run.report.first()
    publish(upsert(kept, todo, [key]), path)
    return {"chunks": fresh.count(), "upserted": found.upserted, "skipped": found.skipped, "deleted": 0 if partial else found.deleted}
