"""Near-duplicate records with small edits: similarity join on character shingles.

1. Records with equal normalised text form a class; its record with the least id stands for it.
2. One-permutation hashing gives each class one minimum per bin from a single hash of every shingle; an
   empty bin takes the value of a bin picked by a hash of its own place (optimal densification).
3. Bands of bins make bucket keys. A bucket's rows come together with a small digest of their signatures, and only links whose
   digests are close become rows, to be checked on their texts. In a bucket of at most HOT classes each is compared with each.
4. So it is in one of up to WIDE classes that share the bucket by chance, where few digests are close: at most HOT/2 links a row.
   In all other buckets each is first linked to the one with the least id only: a star, so links are fewer than rows.
5. A leaf of a star that is not similar to the centre may be similar to other leaves. It is compared with those that
   share one of its rarest shingles, which all texts of at least the threshold do (prefix filter), so that a form
   letter's common part makes no candidates.
6. Leaves that are similar to one centre may be similar among themselves. For the list of all pairs, and only for it,
   links that share a class are closed to triangles and checked on their texts too, until no new link appears.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.blocks import blocks
from docweft.session import bounded_sample, spread, stage

#: Fixed value: the characters that count, after lower-casing.
_KEPT = re.compile("[0-9a-z가-힣]+")
SHINGLE = 5
THRESHOLD = 0.6
MIN_CHARS = 60
BANDS, ROWS = 32, 4
#: The digest holds this many 4-bit values of the signature.
DIGEST = 64
#: In buckets of up to this many rows each is compared with each; beyond it by stars and rarest shingles, unless few are close.
HOT = 128
#: In buckets of up to this many rows the digests of all are compared to see if few are close.
WIDE = 4096
#: Rows of buckets, and pairs of digests, that are looked at together.
BLOCK, PAIRS = 1 << 16, 1 << 18
#: Rows and shingles of the sample that orders shingles by how common they are; it decides what is compared, never the result.
SAMPLE, COMMON = 2000, 100_000

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _detours(bins: int, tries: int = 96) -> np.ndarray:
    """For each try and bin, the bin that an empty one looks at; the same for all records."""
    at = np.arange(bins, dtype=np.uint64)[None, :] + np.uint64(bins) * np.arange(1, tries + 1, dtype=np.uint64)[:, None]
    return (_mixed(at * _G) >> np.uint64(33)).astype(np.int64) % bins


def signatures(texts: list[str], bins: int, shingle: int = SHINGLE) -> np.ndarray:
    """One-permutation minima, densified: a row of `bins` 64-bit values for each text of at least `shingle` characters."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.full((len(texts), bins), none)
    high = np.uint64(64 - max(1, math.ceil(math.log2(bins))))
    for places, parts in blocks(texts, overlap=shingle - 1):
        sizes = np.array([len(t) for t in parts])
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(codes) < shingle:
            continue
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h = np.zeros(len(codes) - shingle + 1, np.uint64)
        for j in range(shingle):
            h = h * np.uint64(0x100000001B3) + codes[j : len(codes) - shingle + 1 + j]
        h = _mixed(h * _G + _G)
        part = np.repeat(np.arange(len(parts)), sizes)[: len(h)]
        # Shingles that reach into the next part are none.
        inside = np.arange(len(h)) - starts[part] <= sizes[part] - shingle
        owner, h = np.array(places)[part[inside]], h[inside]
        slot = (h >> high).astype(np.int64) * bins >> int(64 - high)
        np.minimum.at(low.reshape(-1), owner * bins + slot, h)
    full = low != none
    out = low.copy()
    row, at = np.nonzero(~full)
    for detour in _detours(bins):
        if not len(row):
            break
        source = detour[at]
        hit = full[row, source]
        out[row[hit], at[hit]] = low[row[hit], source[hit]]
        row, at = row[~hit], at[~hit]
    for r, b in zip(row, at, strict=True):
        out[r, b] = low[r].min()
    return out


def jaccard(a: str, b: str, shingle: int = SHINGLE) -> float:
    """Distinct shingles in both by those in either."""
    x, y = {a[i : i + shingle] for i in range(len(a) - shingle + 1)}, {b[i : i + shingle] for i in range(len(b) - shingle + 1)}
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def normalised(text: str) -> str:
    """Lower-cased, with only digits, Latin letters and Hangul syllables left."""
    return "".join(_KEPT.findall(text.lower()))


def _signed(texts: DataFrame, bands: int, rows: int, min_chars: int) -> DataFrame:
    """(tbl, id, h, c, digest, bands) of records (tbl, id, content) that are long enough; h and c are hashes of the normalised text and the content."""
    bins = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                norms = [normalised(x) for x in part.column(2).to_pylist()]
                kept = [i for i, x in enumerate(norms) if len(x) >= min_chars]
                if not kept:
                    continue
                part = part.take(pa.array(kept))
                norms = [norms[i] for i in kept]
                sig = signatures(norms, bins)
                tag = np.array([sum(map(ord, t)) for t in part.column(0).to_pylist()], np.uint64)
                keys = np.zeros((len(sig), bands), np.uint64)
                for r in range(rows):
                    keys = _mixed(keys * _G + sig[:, r::rows])
                keys = _mixed(keys + _G * (np.arange(bands, dtype=np.uint64)[None, :] + tag[:, None] * np.uint64(1009)))
                small = (sig[:, :: bins // DIGEST or 1][:, :DIGEST] >> np.uint64(7) & np.uint64(15)).astype(np.uint8)
                if small.shape[1] % 2:
                    small = small[:, :-1]
                packed = small[:, ::2] << 4 | small[:, 1::2]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).reshape(-1)), bands).cast(pa.list_(pa.int64()))
                contents = pa.array([hashlib.md5(x.encode("utf-8", "surrogatepass")).digest() for x in part.column(2).to_pylist()], pa.binary())
                hashes = pa.array([hashlib.md5(x.encode("utf-8", "surrogatepass")).digest() for x in norms], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), hashes, contents, pa.array([x.tobytes() for x in packed], pa.binary()), lists], ["tbl", "id", "h", "c", "digest", "bands"])

    return texts.mapInArrow(run, "tbl string, id bigint, h binary, c binary, digest binary, bands array<bigint>")


def _norms(texts: DataFrame) -> DataFrame:
    """(tbl, id, norm) of records (tbl, id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([normalised(x) for x in batch.column(2).to_pylist()], pa.string())], ["tbl", "id", "norm"])

    return texts.select("tbl", "id", "content").mapInArrow(run, "tbl string, id bigint, norm string")


def _hashed(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of the distinct shingles of each text, in order. Two shingles have one hash with probability 2**-64."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(codes) - shingle + 1), np.uint64)
    for j in range(shingle):
        h = h * np.uint64(0x100000001B3) + codes[j : len(codes) - shingle + 1 + j]
    h = _mixed(h * _G + _G).view(np.int64)
    out, at = [], 0
    for text in texts:
        own = np.sort(h[at : max(at, at + len(text) - shingle + 1)])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
        at += len(text)
    return out


def _shared(x: np.ndarray, y: np.ndarray) -> float:
    """Share of the values in both of those in either."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small):
        return 0.0
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both / (len(x) + len(y) - both)


def _common(norms: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a bounded sample of the `rows` share, ordered, and in how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_hashed([text])[0], pa.int64())], ["g"])

    sample = bounded_sample(norms, "id", rows, SAMPLE).select("norm")
    seen = sample.mapInArrow(run, "g bigint").groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    rows = seen.orderBy(F.desc("n"), "g").limit(COMMON).collect()
    rows.sort()
    return np.array([r.g for r in rows], np.int64), np.array([r.n for r in rows], np.int64)


def _prefixed(norms: DataFrame, threshold: float, shared: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(tbl, id, failed, g, at, size, early) of texts (tbl, id, failed, norm): their rarest shingles and the places of these.

    Of two texts of at least `threshold`, the larger has their rarest common shingle among these, and the smaller as an early one.
    """
    known, often = shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(3).to_pylist()):
                g = _hashed([text])[0]
                n = len(g)
                place = np.minimum(np.searchsorted(known, g), max(len(known) - 1, 0))
                count = np.where(known[place] == g, often[place], 0) if len(known) else np.zeros(n, np.int64)
                most = n - math.ceil(threshold * n - 1e-9) + 1
                g = g[np.lexsort((g, count))][:most]
                at = np.arange(len(g), dtype=np.int32)
                early = at < n - math.ceil(2 * threshold / (1 + threshold) * n - 1e-9) + 1
                one = batch.slice(i, 1).select([0, 1, 2])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(np.zeros(len(g), np.int64))) for c in one.columns), pa.array(g), pa.array(at), pa.array(np.full(len(g), n, np.int32)), pa.array(early)], ["tbl", "id", "failed", "g", "at", "size", "early"])

    return norms.mapInArrow(run, "tbl string, id bigint, failed boolean, g bigint, at int, size int, early boolean")


def _sharing(prefixes: DataFrame, threshold: float) -> DataFrame:
    """Links (tbl, a, b) of prefixes, of which at least one has failed, that can reach the threshold after their first common shingle.

    With a column part, only links between different parts.
    """
    x, y = prefixes.filter("early").alias("x"), prefixes.alias("y")
    sizes = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.id") < F.col("y.id")))
    apart = F.col("x.part") != F.col("y.part") if "part" in prefixes.columns else F.lit(True)
    enough = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) >= threshold / (1 + threshold) * (F.col("x.size") + F.col("y.size")) - 1e-9
    on = (F.col("x.g") == F.col("y.g")) & (F.col("x.tbl") == F.col("y.tbl")) & (F.col("x.id") != F.col("y.id")) & (F.col("x.failed") | F.col("y.failed")) & apart & sizes & enough
    return x.join(y, on).select("x.tbl", F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _least(threshold: float) -> int:
    """Of DIGEST digest values, how many are equal in texts of at least `threshold`.

    The share of equal digest values is J + (1 - J)/16 on average; four standard deviations are allowed.
    """
    floor = threshold - 4 * math.sqrt(threshold * (1 - threshold) / DIGEST)
    return math.floor(DIGEST * (floor + (1 - floor) / 16))


def _words(digests: pa.Array) -> tuple[np.ndarray, int]:
    """Digests as rows of 64-bit words, padded with zeros, and the number of their values."""
    parts = digests.to_pylist()
    size = len(parts[0]) if parts else 0
    own = np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), size)
    return np.pad(own, ((0, 0), (0, -size % 8))).view(np.uint64).reshape(len(parts), -1), 2 * size


def _close(x: np.ndarray, y: np.ndarray, values: int, least: int) -> np.ndarray:
    """Whether digests x and y, of `values` values of 4 bits, have at least `least` of DIGEST equal."""
    far = x ^ y
    far |= far >> np.uint64(2)
    far |= far >> np.uint64(1)
    differ = np.bitwise_count(far & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)
    return (values - differ) * DIGEST >= least * values


def _alike(links: DataFrame, threshold: float) -> DataFrame:
    """Links (tbl, a, b, da, db) whose digests may belong to texts of at least `threshold`."""
    least = _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (x, values), (y, _) = _words(batch.column(3)), _words(batch.column(4))
                yield batch.filter(pa.array(_close(x, y, values, least))).select([0, 1, 2])

    return links.select("tbl", "a", "b", "da", "db").mapInArrow(run, "tbl string, a bigint, b bigint")


def _few_close(ids: np.ndarray, words: np.ndarray, values: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The pairs of rows of different ids whose digests are close; None as soon as they are more than `most`."""
    n, found, total = len(ids), [], 0
    step = max(1, PAIRS // n)
    for i in range(0, n, step):
        x, y = np.nonzero(_close(words[i : i + step, None, :], words[None, i:, :], values, least))
        kept = (y > x) & (ids[i + x] != ids[i + y])
        found.append((i + x[kept], i + y[kept]))
        total += int(kept.sum())
        if total > most:
            return None
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _linked(signed: DataFrame, threshold: float) -> DataFrame:
    """(tbl, bucket, a, b, near, leaf) of rows (tbl, id, digest, bands): the links of close digests within buckets.

    A leaf is any row of a bucket that is linked as a star, near or not, with the bucket's least id as a. Rows come by bucket
    and id; of one bucket at most WIDE are held, and a pair that is not close is no row.
    """
    least, hot, wide, block = _least(threshold), HOT, max(HOT, WIDE), BLOCK
    names = ["tbl", "bucket", "a", "b", "near", "leaf"]

    def of(rows: pa.Table, x: np.ndarray, y: np.ndarray, near: np.ndarray | bool, leaf: bool) -> pa.RecordBatch:
        """The rows at places y, linked to those at places x."""
        end = rows.take(pa.array(y))
        flags = [pa.array(np.broadcast_to(near, len(y))), pa.array(np.full(len(y), leaf))]
        columns = [end["tbl"], end["bucket"], rows["id"].take(pa.array(x)), end["id"]]
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in columns), *flags], names)

    def small(rows: pa.Table, at: np.ndarray, bucket: np.ndarray, ids: np.ndarray, words: np.ndarray, values: int) -> Iterator[pa.RecordBatch]:
        """The links among the rows at places `at`, of buckets where each is compared with each: by distance in the order."""
        apart = 1
        while len(at := at[at + apart < len(ids)]) and len(at := at[bucket[at] == bucket[at + apart]]):
            close = at[(ids[at] != ids[at + apart]) & _close(words[at], words[at + apart], values, least)]
            if len(close):
                yield of(rows, close, close + apart, True, False)
            apart += 1

    def star(rows: pa.Table, centre: pa.Table, words: np.ndarray, values: int) -> Iterator[pa.RecordBatch]:
        """Rows of one bucket as leaves of `centre`."""
        both = pa.concat_tables([centre, rows])
        first, _ = _words(centre["digest"])
        y = np.flatnonzero(np.asarray(rows["id"]) != centre["id"][0].as_py())
        if len(y):
            yield of(both, np.zeros(len(y), np.int64), y + 1, _close(words[y], first, values, least), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        centre: pa.Table | None = None

        def linked(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """Links of the buckets that end in `rows`; the rows of the last one stay held, or go to its star if they are too many."""
            nonlocal centre
            bucket, ids = np.asarray(rows["bucket"]), np.asarray(rows["id"])
            words, values = _words(rows["digest"])
            begin = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
            end = np.concatenate([begin[1:], [len(bucket)]])
            if centre is not None and centre["bucket"][0].as_py() == bucket[0]:
                yield from star(rows.slice(0, end[0]), centre, words[: end[0]], values)
                begin, end = begin[1:], end[1:]
            if len(begin) and not last:
                n = int(end[-1] - begin[-1])
                if n > wide:
                    centre = rows.slice(begin[-1], 1)
                    yield from star(rows.slice(begin[-1]), centre, words[begin[-1] :], values)
                else:
                    held.extend(rows.slice(begin[-1]).to_batches())
                begin, end = begin[:-1], end[:-1]
            sizes = end - begin
            each = (sizes > 1) & (sizes <= hot)
            places = np.repeat(begin[each] - np.concatenate([[0], np.cumsum(sizes[each])[:-1]]), sizes[each]) + np.arange(sizes[each].sum()) if each.any() else np.zeros(0, np.int64)
            yield from small(rows, places, bucket, ids, words, values)
            for b, e in zip(begin[sizes > hot], end[sizes > hot], strict=True):
                few = _few_close(ids[b:e], words[b:e], values, least, hot * int(e - b) // 2) if e - b <= wide else None
                if few is None:
                    yield from star(rows.slice(b, e - b), rows.slice(b, 1), words[b:e], values)
                elif len(few[0]):
                    yield of(rows, b + few[0], b + few[1], True, False)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(x.num_rows for x in held) >= block:
                    rows = pa.Table.from_batches(held)
                    held.clear()
                    yield from linked(rows, False)
        if held:
            yield from linked(pa.Table.from_batches(held), True)

    rows = signed.select("tbl", "id", "digest", F.explode("bands").alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "id")
    return rows.mapInArrow(run, "tbl string, bucket bigint, a bigint, b bigint, near boolean, leaf boolean")


def _checked(links: DataFrame, texts: DataFrame) -> DataFrame:
    """(tbl, a, b, sim) of links (tbl, a, b) with the similarity of their texts (tbl, id, norm).

    A text is hashed once for all its links that come together, and shingles are compared as ordered arrays.
    """

    def parts(xs: list[str], ys: list[str]) -> Iterator[tuple[int, int]]:
        begin = size = 0
        for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
            size += len(x) + len(y)
            if size > 1 << 22:
                yield begin, i + 1
                begin, size = i + 1, 0
        if begin < len(xs):
            yield begin, len(xs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, sims = batch.column(3).to_pylist(), batch.column(4).to_pylist(), []
            for begin, end in parts(xs, ys):
                own = list(dict.fromkeys(xs[begin:end] + ys[begin:end]))
                known = dict(zip(own, _hashed(own), strict=True))
                sims += [_shared(known[x], known[y]) for x, y in zip(xs[begin:end], ys[begin:end], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sims, pa.float64())], ["tbl", "a", "b", "sim"])

    left = texts.select("tbl", F.col("id").alias("a"), F.col("norm").alias("x"))
    right = texts.select("tbl", F.col("id").alias("b"), F.col("norm").alias("y"))
    both = links.join(left, ["a", "tbl"]).join(right, ["b", "tbl"])
    return both.select("tbl", "a", "b", "x", "y").mapInArrow(run, "tbl string, a bigint, b bigint, sim double")


@contextmanager
def _short_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of fewer rows, as rows hold two texts; both sides of a Python worker keep a batch in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class NearDuplicates:
    """The near-duplicate classes and links of the records (tbl, id, content) of `records`.

    Records are compared within their `tbl`. Contents are lower-cased and stripped of all but digits, Latin
    letters and Hangul syllables; null, empty and otherwise too short ones (under `min_chars`) take no part.
    Repeated rows of one id count once (should their texts differ, each text counts). Ids may be any bigint;
    rows with a null id are left out, as they can't be named in a result. Long texts are compared whole.
    `bands` and `rows` set the candidate search: at similarity s a pair is missed with probability
    (1 - s**rows)**bands before triangles are closed. Rows of 4 suit some 10 million records of one kind; more need 5.
    """

    def __init__(self, records: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS, bands: int = BANDS, rows: int = ROWS) -> None:
        self.threshold = threshold
        with _short_batches(records.sparkSession):
            self._find(records, min_chars, bands, rows)

    def _find(self, records: DataFrame, min_chars: int, bands: int, rows: int) -> None:
        # Keys of joins begin with a number, by whose first bytes rows are sorted without comparing the name of the table.
        # No text is shorter than its normalised form, so what is too short is dropped before Python sees it.
        texts = records.filter("content is not null and id is not null").filter(F.length("content") >= min_chars).select("tbl", F.col("id").cast("bigint").alias("id"), "content")
        every = stage(_signed(texts, bands, rows, min_chars), "signed")
        ids = every.groupBy("tbl", "id", "h").agg(F.min("c").alias("c"))
        firsts = ids.groupBy("tbl", "h").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
        several = ids.join(firsts, ["h", "tbl"])
        contents = several.groupBy("tbl", "h", "c").agg(F.min("id").alias("first"))
        #: (tbl, rep, id, first) of each record of a class of several: the first of the class, and of those with its very content.
        self.members = stage(several.join(contents, ["h", "c", "tbl"]).select("tbl", "rep", "id", "first"), "members")
        #: (tbl, rep, id) of each record that is not its class's first.
        self.copies = self.members.filter("id != rep").select("tbl", "rep", "id")
        self.ids = ids
        signed = every.join(self.copies.select("tbl", "id"), ["id", "tbl"], "left_anti")
        # One shuffle of all buckets; a bucket that holds a large part of all rows is gone through in one task without being held.
        with _short_batches(records.sparkSession, 10_000):
            links = stage(_linked(signed, self.threshold), "linked")
        hot = links.filter("leaf").select("tbl", "bucket", "a", "b")
        self._digests = signed.select("tbl", "id", "digest").dropDuplicates(["id", "tbl"])
        candidates = stage(links.filter("near").select("tbl", "a", "b").distinct(), "candidates")
        wanted = candidates.select("tbl", F.col("a").alias("id")).union(candidates.select("tbl", "b")).union(hot.select("tbl", "b")).distinct()
        self.texts = stage(_norms(texts.join(wanted, ["id", "tbl"], "left_semi").dropDuplicates(["id", "tbl"])), "texts")
        self._tested = stage(_checked(candidates, self.texts), "links")
        self._hot, self._links = hot, None

    def _near(self, links: DataFrame) -> DataFrame:
        """Those of the links (tbl, a, b) whose digests are close."""
        a, b = (self._digests.select("tbl", F.col("id").alias(c), F.col("digest").alias(f"d{c}")) for c in ("a", "b"))
        return _alike(links.join(a, ["a", "tbl"]).join(b, ["b", "tbl"]), self.threshold)

    def _prefixes(self) -> DataFrame | None:
        """The rarest shingles of the texts in buckets of which a leaf has failed at the centre; nothing if none has."""
        found = self._tested.filter(F.col("sim") >= self.threshold).select("tbl", "a", "b", F.lit(False).alias("failed"))
        judged = self._hot.join(found, ["a", "b", "tbl"], "left").select("tbl", "bucket", F.col("b").alias("id"), F.coalesce("failed", F.lit(True)).alias("failed"))
        open_ = judged.filter("failed").select("bucket").distinct()
        ends = stage(judged.join(open_, "bucket", "left_semi").groupBy("tbl", "id").agg(F.max("failed").alias("failed")), "ends")
        n = ends.count()
        if not n:
            return None
        norms = self.texts.join(ends, ["id", "tbl"]).select("tbl", "id", "failed", "norm")
        return stage(_prefixed(norms, self.threshold, _common(norms, n)), "prefixes")

    def _rest(self, prefixes: DataFrame) -> DataFrame:
        """The links among leaves of stars that share one of their `prefixes`, checked."""
        rest = _sharing(prefixes, self.threshold).join(self._tested.select("tbl", "a", "b"), ["a", "b", "tbl"], "left_anti")
        return stage(_checked(self._near(rest), self.texts), "links")

    def _closed(self, tested: DataFrame) -> DataFrame:
        """All links of at least the threshold: those tested, and the triangles over them."""
        while True:
            found = tested.filter(F.col("sim") >= self.threshold)
            ends = found.select("tbl", F.col("a").alias("mid"), F.col("b").alias("end")).union(found.select("tbl", F.col("b"), F.col("a")))
            other = ends.withColumnRenamed("end", "b")
            open_ = ends.withColumnRenamed("end", "a").join(other, ["mid", "tbl"]).filter("a < b").select("tbl", "a", "b").distinct().join(tested.select("tbl", "a", "b"), ["a", "b", "tbl"], "left_anti")
            more = stage(_checked(open_, self.texts), "triangles")
            if more.isEmpty():
                return found
            tested = tested.unionByName(more)

    def links(self) -> DataFrame:
        """(tbl, a, b, sim), a < b: all links between class representatives."""
        if self._links is None:
            with _short_batches(self._tested.sparkSession):
                prefixes = self._prefixes()
                self._links = self._closed(self._tested if prefixes is None else self._tested.unionByName(self._rest(prefixes)))
        return self._links

    def pairs(self) -> DataFrame:
        """(tbl, id_a, id_b), id_a < id_b: the pairs of similar records, in one form whatever the number of copies.

        Of records with the very same content the one with the least id is the first. A pair comes out when at least
        one of the two is the first of its content: so each record has the links to all other contents, by their
        firsts, and to its own first, and copies make rows in proportion to their number.
        """
        links = self.links().select("tbl", "a", "b")
        ends = links.select("tbl", F.col("a").alias("rep")).union(links.select("tbl", "b")).distinct()
        members = self.members.select("tbl", "rep", "id", "first").unionByName(ends.join(self.members.select("tbl", "rep").distinct(), ["rep", "tbl"], "left_anti").select("tbl", "rep", F.col("rep").alias("id"), F.col("rep").alias("first")))
        firsts = members.filter("id = first")

        def across(of_a: DataFrame, of_b: DataFrame) -> DataFrame:
            return links.join(of_a.select("tbl", F.col("rep").alias("a"), F.col("id").alias("x")), ["a", "tbl"]).join(of_b.select("tbl", F.col("rep").alias("b"), F.col("id").alias("y")), ["b", "tbl"]).select("tbl", "x", "y")

        star = self.members.filter("id != first").select("tbl", F.col("first").alias("x"), F.col("id").alias("y"))
        among = self.members.filter("id = first").select("tbl", "rep", F.col("id").alias("x")).join(self.members.select("tbl", "rep", "first", F.col("id").alias("y")), ["rep", "tbl"]).filter("x != first").select("tbl", "x", "y")
        every = across(firsts, members).union(across(members.filter("id != first"), firsts)).union(star).union(among)
        return every.select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).filter("id_a < id_b").distinct()

    def groups(self) -> DataFrame:
        """(tbl, id, class_id, group_id): every record taking part, the least ids of its class and of its group.

        A group is what links and equal texts connect. Triangles over tested links connect nothing further and are
        not made; leaves that failed at their centre are compared only with such as stand in another group so far.
        """
        groups = self._connected(self._tested)
        with _short_batches(self._tested.sparkSession):
            prefixes = self._prefixes()
            if prefixes is not None:
                apart = prefixes.join(groups.withColumnRenamed("g", "part"), ["id", "tbl"], "left").withColumn("part", F.coalesce("part", "id"))
                several = apart.groupBy("tbl", "g").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("tbl", "g")
                groups = self._joined(groups, self._rest(apart.join(several, ["g", "tbl"], "left_semi")))
        members = self.ids.select("tbl", "id").join(self.copies.select("tbl", "id", "rep"), ["id", "tbl"], "left").select("tbl", "id", F.coalesce("rep", "id").alias("rep"))
        return members.join(groups.withColumnRenamed("id", "rep"), ["rep", "tbl"], "left").select("tbl", "id", F.col("rep").alias("class_id"), F.coalesce("g", "rep").alias("group_id")).distinct()

    def _joined(self, groups: DataFrame, more: DataFrame) -> DataFrame:
        """`groups` (tbl, id, g) after further links `more`: only the groups that these connect are gone through."""
        more = stage(more.filter(F.col("sim") >= self.threshold), "more")
        if more.isEmpty():
            return groups
        alone = more.select("tbl", F.col("a").alias("id")).union(more.select("tbl", "b")).distinct().join(groups, ["id", "tbl"], "left_anti").select("tbl", "id", F.col("id").alias("g"))
        groups = stage(groups.unionByName(alone), "all-groups")
        side = lambda c: groups.select("tbl", F.col("id").alias(c), F.col("g").alias(f"g{c}"))
        between = more.join(side("a"), ["a", "tbl"]).join(side("b"), ["b", "tbl"]).filter("ga != gb").select("tbl", F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b"), F.lit(1.0).alias("sim"))
        lower = self._connected(between.distinct()).select("tbl", F.col("id").alias("g"), F.col("g").alias("lower"))
        return groups.join(lower, ["g", "tbl"], "left").select("tbl", "id", F.coalesce("lower", "g").alias("g"))

    def _connected(self, tested: DataFrame) -> DataFrame:
        """(tbl, id, g): the least id of the group of each class that has links.

        Each round, a class takes the least group among its neighbours and then the group of that group, so
        rounds grow with the logarithm of a chain's length.
        """
        links = tested.filter(F.col("sim") >= self.threshold).select("tbl", "a", "b")
        both = stage(links.union(links.select("tbl", F.col("b"), F.col("a"))), "both")
        group = stage(both.groupBy("tbl", F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("g")), "groups")
        while True:
            near = both.join(group.select("tbl", F.col("id").alias("b"), "g"), ["b", "tbl"]).groupBy("tbl", F.col("a").alias("id")).agg(F.min("g").alias("m"))
            lower = group.join(near, ["id", "tbl"], "left").select("tbl", "id", "g", F.least("g", "m").alias("m"))
            jump = group.select("tbl", F.col("id").alias("m"), F.col("g").alias("j"))
            new = stage(lower.join(jump, ["m", "tbl"], "left").select("tbl", "id", "g", F.least("m", "j").alias("m")), "groups")
            if new.filter("g != m").isEmpty():
                return new.select("tbl", "id", "g")
            group = new.select("tbl", "id", F.col("m").alias("g"))


def records_of(tables: dict[str, tuple[DataFrame, str]], text: str = "content") -> DataFrame:
    """The rows of several tables (name to table and key column) as (tbl, id, content)."""
    parts = [spread(df.select(F.lit(name).alias("tbl"), df[key].cast("bigint").alias("id"), df[text].alias("content"))) for name, (df, key) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
