"""Nearest neighbours by cosine similarity, exact or through an index of cells.

Exact: queries are broadcast as one matrix of bounded size, each task multiplies its rows with it and keeps its
best k per query, and only these are shuffled. No pair is ever a row. The vectors are scanned once for each
such matrix. Exact search is the product of both numbers by nature; for many queries against very many
vectors, Index compares a query with the vectors of the nearest cells alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions.vectors import clamped, cosine
from docweft.session import bounded_sample, stage

#: Vectors that are multiplied at once, and the bytes of queries that are broadcast for one scan.
BLOCK = 4096
SCAN_BYTES = 128 << 20
_SCHEMA = "query_id bigint, id bigint, similarity double"


def _units(lists: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the wanted length as unit vectors (zeros stay), and which rows these are."""
    sizes = np.diff(lists.offsets.to_numpy())
    good = np.flatnonzero((sizes == dim) & ~np.asarray(lists.is_null()))
    flat = lists.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = np.nan_to_num(flat.reshape(len(good), dim))
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0), good


def _better(best_s: np.ndarray, best_i: np.ndarray, ids: np.ndarray, asked: np.ndarray, own: np.ndarray, m: np.ndarray, k: int, clamp: bool, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The best `k` of those so far and of the vectors `m` with the ids `own`, for each query."""
    s = asked @ m.T
    s = np.round(np.clip(s, 0, 1) if clamp else s, 9)
    if not same:
        s[ids[:, None] == own[None, :]] = -9
    best_s, best_i = np.concatenate([best_s, s], 1), np.concatenate([best_i, np.broadcast_to(own, s.shape)], 1)
    if best_s.shape[1] > k:
        order = np.lexsort((best_i, -best_s), axis=1)[:, :k]
        best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
    return best_s, best_i


def _rows(ids: np.ndarray, best_s: np.ndarray, best_i: np.ndarray) -> pa.RecordBatch:
    keep = best_s > -9
    q = np.broadcast_to(ids[:, None], best_s.shape)
    return pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(best_i[keep]), pa.array(best_s[keep])], ["query_id", "id", "similarity"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", clamp: bool = True, same: bool = False, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(query_id, id, similarity, rank) of the `k` nearest of `vectors` to each of `queries`.

    Both have `key` (bigint) and `vector`. Vectors that are null or not as long as the query's are no
    neighbours; zero vectors have similarity 0. Similarities are cut to 0..1 where `clamp`. A query's own id is
    left out unless `same`. Equal similarities (to 9 places) go by id.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null")
    out = None
    held: list = []

    def searched() -> DataFrame:
        dims = {len(r.v) for r in held}
        made = []
        for dim in sorted(dims):
            own = [r for r in held if len(r.v) == dim]
            ids = np.array([r.id for r in own])
            m = np.nan_to_num(np.array([r.v for r in own], np.float64))
            norm = np.sqrt((m * m).sum(1, keepdims=True))
            shared = spark.sparkContext.broadcast((ids, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)))

            def run(batches: Iterator[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
                ids, asked = shared.value
                best = [(np.zeros((len(ids[at : at + BLOCK]), 0)), np.zeros((len(ids[at : at + BLOCK]), 0), np.int64)) for at in range(0, len(ids), BLOCK)]
                for batch in batches:
                    lists = batch.column(1)
                    lists = lists if isinstance(lists, pa.ListArray) else pa.chunked_array([lists]).combine_chunks()
                    m, good = _units(lists, dim)
                    if not len(good):
                        continue
                    own = batch.column(0).to_numpy()[good]
                    for at in range(0, len(own), 2048):
                        for tile, (s, i) in enumerate(best):
                            best[tile] = _better(s, i, ids[tile * BLOCK : (tile + 1) * BLOCK], asked[tile * BLOCK : (tile + 1) * BLOCK], own[at : at + 2048], m[at : at + 2048], k, clamp, same)
                for tile, (s, i) in enumerate(best):
                    yield _rows(ids[tile * BLOCK : (tile + 1) * BLOCK], s, i)

            made.append(rows.mapInArrow(run, _SCHEMA))
        both = made[0]
        for other in made[1:]:
            both = both.unionByName(other)
        return both

    size = 0
    for row in asked.toLocalIterator():
        held.append(row)
        size += 8 * len(row.v)
        if size >= scan_bytes:
            out = searched() if out is None else out.unionByName(searched())
            held, size = [], 0
    if held:
        out = searched() if out is None else out.unionByName(searched())
    if out is None:
        out = spark.createDataFrame([], _SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_to(vectors: DataFrame, query: Sequence[float], k: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(`key`, similarity): the `k` nearest of `vectors` to one literal vector, within 0 and 1; equal ones (to 9 places) go by key.

    Vectors that are null or not as long as the query's have similarity 0 and are left out.
    """
    asked = F.array(*[F.lit(float(x)) for x in query])
    own = vectors.filter(F.size(vector) == len(query)).select(key, clamped(cosine(F.col(vector), asked)).alias("similarity"))
    return own.orderBy(F.round("similarity", 9).desc(), key).limit(k)


def live_nearest(chunks: DataFrame, docs: DataFrame, queries: DataFrame, k: int, model: str, **how) -> DataFrame:
    """Nearest chunks of documents that are not deleted, of one embedding model, among those that are embedded."""
    live = docs.filter("deleted_at is null").select("source").distinct()
    own = chunks.filter((F.col("embedding_model") == model) & F.col("embedding").isNotNull()).join(live, "source", "left_semi")
    return nearest(own, queries, k, **how)


def with_cached(chunks: DataFrame, cache: DataFrame, embed, key: str = "chunk_id", digest: str = "body_hash", dim: int | None = None) -> DataFrame:
    """`chunks` with embedding: taken from `cache` (key, digest, embedding) where key and digest agree, else made.

    Cached vectors that are not `dim` long are made anew. `embed` maps the rows that need it to (key, embedding).
    """
    fits = cache if dim is None else cache.filter(F.size("embedding") == dim)
    known = fits.select(key, F.col(digest).alias("_digest"), "embedding").dropDuplicates([key, "_digest"])
    joined = chunks.join(known, (chunks[key] == known[key]) & (chunks[digest] == known["_digest"]), "left").select(chunks["*"], "embedding")
    todo = joined.filter("embedding is null").drop("embedding")
    return joined.filter("embedding is not null").unionByName(todo.join(embed(todo), key))


class Index:
    """Vectors in cells around centres, for approximate search: every row is in a cell, and searches look into a few cells.

    Centres are fitted by spherical k-means on at most `sample` rows, those of the least hash of their key, so the
    same on every run; there are about sqrt(rows) of them, `most_cells` at most. Large cells are searched in parts of
    about `part_rows`, so that none is one task. Vectors that are null, zero or of another length than most are not indexed.
    """

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", sample: int = 20_000, most_cells: int = 4096, rounds: int = 12, part_rows: int = 50_000) -> None:
        rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and size(v) > 0")
        dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        self.dim, count = (dims.d, dims.n) if dims else (1, 0)
        held = rows.filter(F.size("v") == self.dim)
        fit = np.nan_to_num(np.array([r.v for r in bounded_sample(held, "id", count, sample).collect()], np.float64).reshape(-1, self.dim))
        norm = np.linalg.norm(fit, axis=1)
        fit = fit[norm > 0] / norm[norm > 0, None]
        self.centres = self._fitted(fit, max(1, min(most_cells, int(count**0.5), max(1, len(fit) // 4))), rounds)
        self.cells = stage(self._placed(held, 1), "cells")
        sizes = self.cells.groupBy("cell").agg(F.count("*").alias("n"))
        #: (cell, parts): at most most_cells rows.
        self.parts = stage(sizes.select("cell", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")), "parts")

    @staticmethod
    def _fitted(fit: np.ndarray, cells: int, rounds: int) -> np.ndarray:
        if not len(fit):
            return np.zeros((1, fit.shape[1]))
        centres = fit[np.linspace(0, len(fit) - 1, cells).astype(int)]
        for _ in range(rounds):
            home = (fit @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, home, fit)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
        return centres

    def _placed(self, rows: DataFrame, cells: int) -> DataFrame:
        """(id, v, cell): the unit vectors of `rows` in their nearest `cells`; zero vectors are left out."""
        shared, dim = rows.sparkSession.sparkContext.broadcast(self.centres), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            n = min(cells, len(centres))
            for batch in batches:
                lists = batch.column(1)
                m, good = _units(lists if isinstance(lists, pa.ListArray) else pa.chunked_array([lists]).combine_chunks(), dim)
                full = np.flatnonzero(np.abs(m).sum(1) > 0)
                m, good = m[full], good[full]
                if not len(good):
                    continue
                near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :n]
                own = np.repeat(np.arange(len(m)), n)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(own) + 1) * dim, dim), pa.int32()), pa.array(m[own].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good[own])), flat, pa.array(near.reshape(-1).astype(np.int32))], ["id", "v", "cell"])

        return rows.mapInArrow(run, "id bigint, v array<double>, cell int")

    def nearest(self, queries: DataFrame, k: int, probes: int = 16, key: str = "vec_id", vector: str = "embedding", clamp: bool = True, same: bool = False) -> DataFrame:
        """nearest() among the vectors of the `probes` cells nearest to each query."""
        asked = self._placed(queries.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == self.dim), probes)
        parts = F.broadcast(self.parts)
        own = self.cells.join(parts, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
        asked = asked.join(parts, "cell").select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        dim = self.dim

        def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
            m, rows = _units(vectors.column("v").combine_chunks(), dim)
            q, wanted = _units(queries.column("v").combine_chunks(), dim)
            names, ids = vectors.column("id").to_numpy()[rows], queries.column("id").to_numpy()[wanted]
            out = []
            for at in range(0, len(ids), BLOCK):
                s, i = np.zeros((len(ids[at : at + BLOCK]), 0)), np.zeros((len(ids[at : at + BLOCK]), 0), np.int64)
                for begin in range(0, len(names), 2048):
                    s, i = _better(s, i, ids[at : at + BLOCK], q[at : at + BLOCK], names[begin : begin + 2048], m[begin : begin + 2048], k, clamp, same)
                out.append(_rows(ids[at : at + BLOCK], s, i))
            return pa.Table.from_batches(out) if out else pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())]).empty_table()

        found = own.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(run, _SCHEMA)
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
