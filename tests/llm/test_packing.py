import random
from collections import defaultdict

import numpy as np

from docweft.llm import packing, tokenizer
from docweft.session import table


def checked(rows, items, capacity):
    """Every item whole and in order, none divided without need, no container over capacity."""
    load, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r.container_id] += r.n_tokens
        parts[r.k].append((r.piece_no, r.start, r.n_tokens))
    assert max(load.values(), default=0) <= capacity
    for k, size in items.items():
        at = 0
        for no, (piece, start, n) in enumerate(sorted(parts[k])):
            assert (piece, start) == (no, at)
            at += n
        assert at == size
        assert len(parts[k]) == max(1, -(-size // capacity))
    return sum(load.values()) / (len(load) * capacity) if load else 1


def test_packing(spark):
    rng = random.Random(2)
    items = {i: int(rng.lognormvariate(5, 1.2)) + 1 for i in range(3000)} | {9001: 1000, 9002: 5000, 9003: 1001, 9004: 2000}
    df = spark.createDataFrame([(k, n, k % 17, "x") for k, n in items.items()] + [(-1, 0, 0, "x"), (-2, None, 0, "x")], "k bigint, n_tokens bigint, curve bigint, start string")
    rows = packing.pack(df, 1000, window=500, partitions=3).collect()
    assert checked(rows, items, 1000) > 0.97
    assert {r.k for r in rows} == set(items)


def test_tasks_follow_from_the_tokens(spark, data):
    docs = table(spark, data, "documents")
    fills = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = packing.fill_containers(docs).collect()
        fills.append(sum(r.n_tokens for r in rows) / (8192 * len({r.container_id for r in rows})))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(fills) - min(fills) < 0.01


def test_repeated_rows_are_items_of_their_own(spark):
    df = spark.createDataFrame([(7, 600, 1)] * 4, "k bigint, n_tokens bigint, curve bigint")
    assert len({r.container_id for r in packing.pack(df, 1000, partitions=2).collect()}) == 4


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "x", "y")], "doc_id bigint, text string, k string")
    assert packing.fill_containers(df.limit(0)).collect() == []
    assert packing.fill_containers(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).collect() == []


def test_corpus(spark, data):
    docs = table(spark, data, "documents")
    sizes = {r.doc_id: len(r.ids) for r in tokenizer.encode_corpus(docs).collect() if r.ids}
    rows = packing.fill_containers(docs).withColumnRenamed("doc_id", "k").collect()
    assert checked(rows, sizes, 8192) > 0.9


def test_the_curve_visits_each_cell_once_and_steps_to_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_like_texts_are_near_on_the_curve(spark):
    a, b = "the valve of the pump " * 40, "통계테이블 점검 이력 " * 40
    df = spark.createDataFrame([(i, (a if i % 2 else b) + str(i)) for i in range(40)], "doc_id bigint, text string")
    order = [r.k for r in packing.measured(df, "doc_id", "text").orderBy("curve").collect()]
    assert sum(x % 2 != y % 2 for x, y in zip(order, order[1:], strict=False)) <= 3
