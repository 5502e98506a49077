
from docweft import cli
from docweft.operators import corpus_jobs


def test_jobs(spark, data, tmp_path):
    docs, out = f"{data}/maintenance_docs.parquet", str(tmp_path / "a")
    cli.main(["build-index", docs, out], spark)
    assert spark.read.parquet(out).count() > 0
    cli.main(["build-index", docs, str(tmp_path / "b"), "--old", out], spark)
    assert spark.read.parquet(str(tmp_path / "b")).exceptAll(spark.read.parquet(out)).count() == 0
    cli.main(["load-records", f"{data}/raw_requests.parquet", str(tmp_path / "c")], spark)
    assert spark.read.parquet(str(tmp_path / "c/tickets")).count() > 0
    cli.main(["mine-terms", docs, str(tmp_path / "d"), "--top", "5"], spark)
    assert spark.read.parquet(str(tmp_path / "d")).count() <= 5
    (tmp_path / "tree/가").mkdir(parents=True)
    (tmp_path / "tree/가/나.md").write_text("# 다")
    cli.main(["load-tree", str(tmp_path / "tree"), str(tmp_path / "e")], spark)
    assert spark.read.parquet(str(tmp_path / "e")).first().customer == "가"
    cli.main(["load-files", str(tmp_path / "tree"), str(tmp_path / "f")], spark)
    assert spark.read.parquet(str(tmp_path / "f")).first().content == "# 다"


def test_layouts(spark):
    docs = spark.createDataFrame([("t/인수인계/가/로그인 안내.md", "가", "vpn"), ("t/인수인계/가/x/로그인 안내.md", "가", "vpn"), ("t/y.md", "나", "![a](./../07/z.png)")], "source string, customer string, content string")
    got = {r.source: (r.company, r.kind, r.target) for r in corpus_jobs.organised(docs, "인수인계", {"관리자계정": "03"}).collect()}
    assert {v[2] for v in got.values()} == {"가/03/로그인_안내.md", "가/03/로그인_안내_2.md", "99_기타_미분류/작업팁/y.md"}
    flat = {r.source: r for r in corpus_jobs.simplified(docs, "20260514", "정보", ("./../07", "./images")).collect()}
    assert flat["t/y.md"].target == "나/나_y_20260514.md"
    assert flat["t/y.md"].content == "![a](./images/z.png)"
    books = spark.createDataFrame([("머리\n### 가 (본사)\n글\n",)], "t string")
    assert [r.customer for r in corpus_jobs.handbook_blocks(books, "t", {"가": "가나"}).collect()] == ["가나"]
