"""Occurrences and document frequency of every distinct term of a collection.

Heavy-light aggregation: the terms that are frequent in a bounded sample are broadcast, and each task
counts them in arrays of its own, of which it hands on one row per task. Only the remaining, light terms
are shuffled, each task having added up its own first. Which terms are called heavy has no influence on
any count.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.session import once, spread, stage

#: Fixed value: what a term is, in lower-cased text.
TERM_PATTERN = r"[가-힣]{2,}|[a-z][a-z0-9]+(?:[._-][a-z0-9]+)*"

#: The sample that heavy terms are found in, and how many of them are broadcast (at most some 100 kB).
SAMPLE_ROWS = 2000
HEAVY_TERMS = 4096
FLUSH_TERMS = 200_000
LONG_TEXT = 1 << 20


def _heavy_terms(texts: DataFrame, pattern: str, rows: int, most: int) -> list[str]:
    """The terms found in the most of at most `rows` first records that the scan gives; ties go by term.

    Records are counted where they are, in groups, and take() reads only as many partitions as it needs.
    A group sends its most frequent terms, so what comes to the driver has a fixed bound.
    """
    group = max(1, min(200, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                df = Counter()
                for text in batch.column(0).slice(at, group).to_pylist():
                    if text:
                        df.update(set(find(text.lower())))
                top = [(t, n) for t, n in df.most_common(most) if n > 1 or group < 10]
                yield pa.RecordBatch.from_arrays([pa.array([[t for t, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["terms", "counts"])

    df = Counter()
    for row in texts.mapInArrow(run, "terms array<string>, counts array<bigint>").take(max(1, rows // group)):
        df.update(dict(zip(row.terms, row.counts, strict=True)))
    return [t for t, n in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:most] if n > 1]


def term_frequencies(
    docs: DataFrame,
    key: str,
    text: str,
    pattern: str = TERM_PATTERN,
    min_df: int = 3,
    max_share: float = 0.35,
    sample_rows: int = SAMPLE_ROWS,
    heavy_terms: int = HEAVY_TERMS,
    flush_terms: int = FLUSH_TERMS,
) -> DataFrame:
    """(term, occurrences, doc_freq, n_docs, mark) for every term in `text`, each `key` being one record.

    Rows with the same key count once (they are taken to be the same record); rows with a null key are
    records that share the key null. Null and empty texts count in n_docs and have no terms. mark is
    'rare' below `min_df` records, else 'common' in more than `max_share` of all records, else null.
    Texts of any length are read whole. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    narrow = spread(docs.select(docs[key].alias("k"), docs[text].alias("t")))
    heavy = _heavy_terms(narrow.select("t"), pattern, sample_rows, heavy_terms)
    shared = spark.sparkContext.broadcast(heavy)
    schema = pa.schema([("term", pa.string()), ("occ", pa.int64()), ("df", pa.int64()), ("heavy_occ", pa.list_(pa.int64())), ("heavy_df", pa.list_(pa.int64())), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        occ, df = array("q", bytes(8 * len(place))), array("q", bytes(8 * len(place)))
        find, each, at, n = re.compile(pattern).findall, re.compile(pattern).finditer, place.get, 0
        light: dict[str, int] = {}  # occurrences in the upper, records in the lower 32 bits
        had = light.get

        def flushed() -> pa.RecordBatch:
            both = np.fromiter(light.values(), np.int64, len(light))
            none = pa.nulls(len(light), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(list(light), pa.string()), pa.array(both >> 32), pa.array(both & 0xFFFFFFFF), none, none, pa.nulls(len(light), pa.int64())], schema=schema)

        for batch in batches:
            for content in batch.column(0).to_pylist():
                n += 1
                if not content:
                    continue
                low = content.lower()
                # A very long text is counted match by match, not as one list.
                for term, k in (Counter(find(low)) if len(low) < LONG_TEXT else Counter(m[0] for m in each(low))).items():
                    if (i := at(term)) is None:
                        light[term] = had(term, 0) + (k << 32 | 1)
                    else:
                        occ[i] += k
                        df[i] += 1
                if len(light) >= flush_terms:
                    yield flushed()
                    light.clear()
        if light:
            yield flushed()
        if n:
            yield pa.RecordBatch.from_pydict({"term": [None], "occ": [None], "df": [None], "heavy_occ": [occ.tolist()], "heavy_df": [df.tolist()], "n": [n]}, schema=schema)

    records = once(narrow, "k").select("t")
    counted = stage(records.mapInArrow(run, "term string, occ bigint, df bigint, heavy_occ array<bigint>, heavy_df array<bigint>, n bigint"), "terms")
    total = counted.agg(F.sum("n")).first()[0] or 0
    light = counted.filter("term is not null").groupBy("term").agg(F.sum("occ").alias("occurrences"), F.sum("df").alias("doc_freq"))
    arrays = counted.filter("term is null").select(F.posexplode(F.arrays_zip("heavy_occ", "heavy_df")).alias("i", "both"))
    names = spark.createDataFrame(list(enumerate(heavy)), "i int, term string")
    sums = arrays.groupBy("i").agg(F.sum("both.heavy_occ").alias("occurrences"), F.sum("both.heavy_df").alias("doc_freq")).filter("doc_freq > 0")
    dense = sums.join(F.broadcast(names), "i").select("term", "occurrences", "doc_freq")
    mark = F.when(F.col("doc_freq") < min_df, "rare").when(F.col("doc_freq") / F.lit(max(total, 1)) > max_share, "common")
    return light.unionByName(dense).withColumn("n_docs", F.lit(total).cast("bigint")).withColumn("mark", mark)
