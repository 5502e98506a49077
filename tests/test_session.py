import pytest

from docweft.session import bounded_sample, numbered, once, shared_dir, stage, stage_all, staging


@pytest.mark.parametrize("most", [0, 1000])
def test_once(spark, most):
    rows = [(1, "a"), (2, "b"), (2, "b"), (None, "c"), (None, "c"), (3, None), (4, ""), (4, "")]
    df = spark.createDataFrame(rows, "k int, count string")
    got = once(df, "k", most)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(set(rows), key=str)
    assert once(df.limit(0), "k", most).collect() == []


@pytest.mark.parametrize("most", [0, 1000])
def test_the_latest_row_stays(spark, most):
    df = spark.createDataFrame([(1, 5, "a"), (1, None, "b"), (1, 7, "c"), (None, 1, "d"), (None, 2, "e"), (2, None, "f")], "k int, at int, v string")
    assert sorted(r.v for r in once(df, "k", most, ("at",)).collect()) == ["c", "e", "f"]


def test_rows_that_occur_once_are_not_shuffled(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 900 as k", "repeat('x', 100) as t").write.parquet(str(tmp_path / "t"))
    plan = once(spark.read.parquet(str(tmp_path / "t")), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "broadcast" in plan.lower()


def test_numbers_are_places_in_the_order(spark):
    rows = [(i % 3, i) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = {(r.a, r.b): r.n for r in numbered(df, ["a", "b"], "n").collect()}
    assert got == {x: i for i, x in enumerate(sorted(rows))}
    assert numbered(df.limit(0), ["a"], "n").collect() == []


def test_a_bounded_sample_is_of_the_least_hashes(spark):
    df = spark.range(5000).selectExpr("id", "'x' as t")
    want = {r.id for r in df.selectExpr("id", "xxhash64(id) as h").orderBy("h").limit(50).collect()}
    assert {r.id for r in bounded_sample(df, "id", 5000, 50).collect()} == want
    assert bounded_sample(df.limit(30), "id", 30, 50).count() == 30


def test_staged_files_go_with_their_request(spark, tmp_path):
    from pathlib import Path

    count = lambda: len([p for p in Path(shared_dir(spark).removeprefix("file://")).iterdir() if p.name.startswith("docweft-mine")])
    kept = stage(spark.range(3), "mine")
    with staging():
        a, b = stage_all((spark.range(2), "mine"), (spark.range(4), "mine"))
        assert (a.count(), b.count(), count()) == (2, 4, 3)
    assert count() == 1
    assert kept.count() == 3
