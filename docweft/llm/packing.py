"""Filling containers of fixed capacity with texts, measured in tokens.

Space-filling-curve order: each text's hashed token vector is projected to a few dimensions, texts are
range-sorted by the Hilbert key of their place, and neighbours along the curve are packed together. Each
task packs a bounded window of the curve at a time, largest items first into the fullest container that
still takes them; containers that are left too empty are opened again for the next window. How many tasks
there are follows from the total of tokens, as each may leave one container partly empty.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.tokenizer import SPLIT_PATTERN, default_vocabulary, encoded_batch, transducer_of
from docweft.session import spread, stage

DIMENSIONS, BITS = 4, 8
WINDOW = 4096
#: Containers that a task fills at least, and the most tasks, for which the range sort samples keys on the driver; beyond that tasks fill more.
PER_TASK, MOST_TASKS = 256, 5_000
#: A container whose free part is above this share is opened again while its task has more items.
REOPEN_SHARE = 0.01


def _directions(n: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signs of each token id's hash in each dimension."""
    x = np.arange(n, dtype=np.uint64)[:, None] * np.uint64(dimensions) + np.arange(dimensions, dtype=np.uint64)[None, :]
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(63)).astype(np.float32) * 2 - 1).astype(np.float32)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of `cells` (unsigned, below 2**bits)."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    q = top
    while q > 1:
        turn ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def measured(df: DataFrame, key: str, text: str, vocabulary: str | None = None, pattern: str = SPLIT_PATTERN) -> DataFrame:
    """(k, n_tokens, curve): length in tokens and Hilbert key of each text that has any token."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = transducer_of(shared.value, pattern)
        directions = _directions(max(transducer.tokens) + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ends, ids = encoded_batch(transducer, part.column(1).to_pylist())
                counts = np.diff(ends)
                full = np.flatnonzero(counts)
                if not len(full):
                    continue
                sums = np.stack([np.add.reduceat(directions[:, d][ids], ends[:-1][full]) for d in range(DIMENSIONS)], 1)
                place = 0.5 + 0.5 * np.tanh(6 * sums / counts[full][:, None])
                curve = hilbert_keys(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full)), pa.array(counts[full]), pa.array(curve)], ["k", "n_tokens", "curve"])

    narrow = spread(df.select(df[key].alias("k"), df[text].alias("t")).filter("t is not null and t != ''"))
    return narrow.mapInArrow(run, T.StructType([narrow.schema["k"], T.StructField("n_tokens", T.LongType()), T.StructField("curve", T.LongType())]))


def _best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[int]]]:
    """(free, places) of each container: (place, size) items, largest first, each into the fullest that takes it."""
    free: list[tuple[int, int]] = []  # sorted by free space, of the containers that have any
    boxes: list[tuple[int, list[int]]] = []
    for place, size in sorted(items, key=lambda x: (-x[1], x[0])):
        at = bisect_left(free, (size, -1))
        if at == len(free):
            box, left = len(boxes), capacity
            boxes.append((capacity, []))
        else:
            left, box = free.pop(at)
        left -= size
        boxes[box][1].append(place)
        boxes[box] = (left, boxes[box][1])
        if left:
            insort(free, (left, box))
    return boxes


def pack(items: DataFrame, capacity: int = 8192, window: int = WINDOW, partitions: int | None = None) -> DataFrame:
    """(container_id, k, piece_no, start, n_tokens): each item (k, n_tokens, curve) in containers of `capacity`.

    An item is divided only if it alone is larger: into full pieces, each a container of its own, and a rest
    that is packed like other items. Items of size 0 or null stay out. Repeated rows are items of their own.
    The range sort is by curve, then k and size, so items of equal curve (copies) split over partitions.
    Items of containers that are opened again take up at most half of the next window; what goes beyond is left as it is.
    There is one task for each PER_TASK containers' worth of tokens unless `partitions` is given.
    """
    items = items.select("k", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.col("curve").cast("bigint").alias("curve")).filter("n_tokens > 0")
    if not partitions:
        total = items.agg(F.sum("n_tokens")).first()[0] or 0
        partitions = min(MOST_TASKS, max(1, total // (capacity * PER_TASK)))
    order = ["curve", "k", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        made, waiting = 0, []  # waiting: (key, piece_no, start, size)
        out: list[tuple] = []

        def put(group: list[tuple]) -> None:
            nonlocal made
            out.extend((base + made, *x) for x in group)
            made += 1

        def close(last: bool) -> None:
            nonlocal waiting
            rest = []
            for left, places in _best_fit([(i, x[3]) for i, x in enumerate(waiting)], capacity):
                group = [waiting[i] for i in sorted(places)]
                if last or left <= REOPEN_SHARE * capacity or len(rest) > window // 2:
                    put(group)
                else:
                    rest += group
            waiting = rest

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], key_type), pa.array(columns[2], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[3:])], ["container_id", "k", "piece_no", "start", "n_tokens"])

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = size // capacity if size > capacity else 0
                for piece in range(whole):
                    put([(key, piece, piece * capacity, capacity)])
                if size - whole * capacity:
                    waiting.append((key, whole, whole * capacity, size - whole * capacity))
                if len(waiting) >= window:
                    close(False)
            if out:
                yield batch_of()
        close(True)
        if out:
            yield batch_of()

    schema = T.StructType([T.StructField("container_id", T.LongType()), T.StructField("k", items.schema["k"].dataType), T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return items.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def fill_containers(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 8192, vocabulary: str | None = None) -> DataFrame:
    """(container_id, `key`, piece_no, start, n_tokens) for every text of `df` that is not null or empty.

    Sizes are tokens of `vocabulary` (byte_bpe_50k unless given). start and n_tokens say which of the text's
    tokens a piece holds. An empty table gives no rows; other columns are ignored; texts of any length are read whole.
    """
    # Staged, as a range sort reads its input twice, once for a sample of the keys.
    return pack(stage(measured(df, key, text, vocabulary), "measured"), capacity).withColumnRenamed("k", key)
