import pytest
from pyspark.sql import functions as F

from docweft.operators import corpus_jobs, store, tickets
from docweft.settings import DEFAULTS, load, merged, save

def at():
    return F.lit("2026-02-01 00:00:00").cast("timestamp")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, None, None), (3, "c", "z")], "id int, v string, w string")
    assert sorted(store.upsert(old, new, ["id"], keep=("w",)).collect()) == sorted([(1, "a", "x"), (2, None, "y"), (3, "c", "z")], key=str) or {r.id: (r.v, r.w) for r in store.upsert(old, new, ["id"], keep=("w",)).collect()} == {1: ("a", "x"), 2: (None, "y"), 3: ("c", "z")}
    part = {r.id: (r.v, r.w) for r in store.upsert(old, new.select("id", "v"), ["id"]).collect()}
    assert part == {1: ("a", "x"), 2: (None, "y"), 3: ("c", None)}
    assert rows(store.upsert(old, new.limit(0), ["id"])) == rows(old)
    assert {r.id for r in store.upsert(old.limit(0), new, ["id"]).collect()} == {2, 3}


def test_sync_twice_changes_nothing(spark):
    old = spark.createDataFrame([("k1", "s1", "h1"), ("k2", "s1", "h2"), ("k9", "s2", "h9")], "chunk_id string, source string, body_hash string")
    new = spark.createDataFrame([("k1", "s1", "h1"), ("k2", "s1", "hx"), ("k3", "s1", "h3")], "chunk_id string, source string, body_hash string")
    run = store.Sync(old, new)
    assert tuple(run.report.first()) == (2, 1, 1)
    assert rows(run.result) == rows(new)
    assert tuple(store.Sync(run.result, new).report.first()) == (0, 3, 0)
    assert tuple(store.Sync(run.result, new, force=True).report.first()) == (3, 0, 0)
    part = store.Sync(old, new, scope=F.col("source") == "s1")
    assert {r.chunk_id for r in part.result.collect()} == {"k1", "k2", "k3", "k9"}
    assert tuple(part.report.first()) == (2, 1, 0)


def test_no_valid_keys_delete_all(spark):
    old = spark.createDataFrame([("a", "m1"), ("b", "m2")], "k string, model string")
    none = old.limit(0)
    assert store.without_stale(old, none, ["k"]).collect() == []
    assert rows(store.without_stale(old, none, ["k"], F.col("model") == "m1")) == [("b", "m2")]


def test_folders(spark):
    docs = spark.createDataFrame([("b",), ("A",), ("",), (None,)], "customer string")
    names = spark.createDataFrame([("c",), ("b",)], "name string")
    folders = store.folders_of(docs, names)
    assert rows(folders) == [("A", 0), ("b", 1), ("c", 2)]
    assert rows(store.folder_added(folders, "d")) == [("A", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(store.folder_added(folders, "b")) == rows(folders)
    assert rows(store.folder_added(folders.limit(0), "x")) == [("x", 0)]
    assert rows(store.folders_reordered(folders, ["c", "b"])) == [("A", 0), ("b", 1), ("c", 0)]


def test_deletes(spark):
    docs = spark.createDataFrame([("a/1", None), ("a/2", "2026-01-20 00:00:00"), ("b/1", "2025-12-01 00:00:00")], "source string, d string").select("source", F.col("d").cast("timestamp").alias("deleted_at"))
    chunks = spark.createDataFrame([("a/1",), ("b/1",)], "source string")
    assert store.soft_deleted(docs, F.col("source").startswith("a/"), at()).filter(F.col("deleted_at") == at()).count() == 1
    assert store.restored(docs, F.lit(True)).filter("deleted_at is null").count() == 3
    kept, left = store.purged(docs, chunks, at())
    assert {r.source for r in kept.collect()} == {"a/1", "a/2"}
    assert rows(left) == [("a/1",)]
    assert {r.source for r in store.purged(docs, chunks, at(), None)[0].collect()} == {"a/1"}
    assert rows(store.without_folder(chunks, "b")) == [("a/1",)]
    assets = spark.createDataFrame([("a/x.png", None), ("y.png", None)], "path string, deleted_at string").withColumn("deleted_at", F.col("deleted_at").cast("timestamp"))
    shown = spark.createDataFrame([("a/1.md", "![x](x.png)")], "source string, content string")
    assert {r.path for r in store.assets_deleted_with(assets, shown, at()).filter("deleted_at is not null").collect()} == {"a/x.png"}
    got = rows(store.exported(shown, assets, ["a"]))
    assert got == [("a/1.md", "document"), ("a/x.png", "asset")]


def test_names(spark):
    own = spark.createDataFrame([(1, "a.md"), (2, "a.md"), (3, "b.md"), (4, "c")], "id int, name string")
    taken = spark.createDataFrame([("b.md",), ("b_2.md",), ("c",)], "name string")
    assert rows(store.unique_names(own, taken, "name", ["id"])) == [(1, "a.md"), (2, "a_2.md"), (3, "b_3.md"), (4, "c_2")]
    close = spark.createDataFrame([(1, "a.md"), (2, "a.md"), (3, "a_2.md"), (4, "a.md")], "id int, name string")
    assert rows(store.unique_names(close, taken.limit(0), "name", ["id"])) == [(1, "a.md"), (2, "a_3.md"), (3, "a_2.md"), (4, "a_4.md")]
    assert rows(store.renamed_prefix(own.withColumn("name", F.concat(F.lit("x/"), "name")), "name", "x", "y").limit(1).select("name"))[0][0].startswith("y/")


def test_log(spark):
    log = spark.createDataFrame([("h1", "f", 1)], "file_sha256 string, file_name string, row_count int")
    entry = spark.createDataFrame([("h1", "g", 2), ("h2", "i", 3)], log.schema)
    assert rows(store.import_log(log, entry)) == [("h1", "g", 2), ("h2", "i", 3)]


def test_jobs(spark):
    docs = spark.createDataFrame([("a.md", "x  \r\ny"), ("b.md", None), ("c.md", "z")], "source string, content string")
    assert {r.source: r.status for r in corpus_jobs.cleaned(docs).collect()} == {"a.md": "changed", "b.md": "same", "c.md": "same"}
    after = spark.createDataFrame([("a.md", "w"), ("c.md", "z"), ("d.md", "")], docs.schema)
    assert {r.source: r.status for r in corpus_jobs.content_status(docs, after).collect()} == {"a.md": "changed", "b.md": "removed", "c.md": "same", "d.md": "added"}
    assert tuple(corpus_jobs.import_summary(after, docs).first()) == (1, 1, 1)
    files = spark.createDataFrame([("a/x.PNG", 3), ("b.png", 4), ("c", None)], "path string, size bigint")
    assert {r.kind: (r.n, r.bytes) for r in corpus_jobs.inventory(files).collect()} == {".png": (2, 7), "(none)": (1, 0)}
    paths = spark.createDataFrame([("t/인수인계/가_회사.md",), ("t/인수인계/나 회사/x.md",), ("t/x.md",)], "path string")
    assert [r[0] for r in paths.select(corpus_jobs.company_of("path", "인수인계")).collect()] == ["가 회사", "나 회사", "99_기타_미분류"]
    names = spark.createDataFrame([("가",), ("가 (본사)",), ("나 다",)], "name string")
    assert rows(corpus_jobs.canonical_customer(names, {"가": "가나다"})) == [("가", "가나다"), ("가 (본사)", "가나다"), ("나 다", "나_다")]


def test_asset_matches(spark):
    assets = spark.createDataFrame([("d/x.png",), ("z/y.png",), ("d/images/글_image_2_a.png",), ("d/images/my_pic_1.png",)], "path string")
    wanted = spark.createDataFrame([("d/글_20260101.md", r) for r in ("x.png", "q/y.png", "image 2.png", "my pic.jpg", "none.png")], "source string, ref string")
    assert {r.ref: r.path for r in corpus_jobs.asset_matches(wanted, assets).collect()} == {"x.png": "d/x.png", "q/y.png": "z/y.png", "image 2.png": "d/images/글_image_2_a.png", "my pic.jpg": "d/images/my_pic_1.png"}


@pytest.mark.parametrize(("text", "want"), [("<p>가&nbsp;나</p><br/>다", "가 나\n\n다"), ("&lt;b&gt;x&lt;/b&gt; &amp; y", "x & y"), ("a<br>b<BR />c", "a\nb\nc"), (None, ""), ("plain", "plain"), ("<li>1</li><li>2</li>", "1\n2")])
def test_html(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tickets.html_to_text(F.col("t")).alias("x")).first().x == want


def test_ticket_search_wildcards_match_but_do_not_score(spark):
    df = spark.createDataFrame([(1, "u", "가 나", "가 x 나"), (2, "u", "가%나", "가%나")], "idx bigint, user_id string, title string, search_text string").withColumns({"updated_at": at(), "request_date": F.to_date(at())})
    got = {r.idx: r.score for r in tickets.search(df, "가%나").collect()}
    assert got == {1: 0, 2: 26}
    assert [r.idx for r in tickets.search(df, "").collect()] == [2, 1]
    assert tickets.search(df, "2").collect() == []


def test_ticket_texts(spark):
    df = spark.createDataFrame([(5, "고객", None, "보고", "<p>본문|</p>", True, "이슈", None)], "idx bigint, user_id string, title string, report_title string, content string, is_urgent boolean, issues string, notes string")
    for c in ("contact_person", "manager_id", "worker_id", "type_id", "status_id", "progress_status", "progress_rate", "request_date", "expected_date", "completed_date", "created_at", "updated_at"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    r = df.select(tickets.ticket_title().alias("t"), tickets.ticket_source("접수").alias("s"), tickets.markdown(["idx", "content"]).alias("m"), tickets.search_text(tickets.html_to_text(F.col("content"))).alias("x"), tickets.row_hash(["idx", "title"]).alias("h")).first()
    assert (r.t, r.s) == ("[5] 보고", "접수/접수_5.md")
    assert r.m.startswith("# [5] 보고\n\n## 접수 요약\n\n- 접수번호: 5\n- 고객사: 고객\n- 보고서 제목: 보고\n- 긴급: 예\n")
    assert "## 요청 내용\n\n본문\\|\n" in r.m
    assert r.m.endswith("| `idx` | 5 |\n| `content` | &lt;p&gt;본문\\|&lt;/p&gt; |\n")
    assert r.x.startswith("5 고객 보고 본문| 이슈 idx: 5")
    assert len(r.h) == 64


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert load(path) == DEFAULTS
    save(path, {"bm25": {"k1": 2.0}})
    assert load(path)["bm25"] == {"k1": 2.0, "b": 0.75}
    assert merged({"a": {"b": 1}}, {"a": 2}) == {"a": 2}


def test_refresh_writes_snapshots(spark, tmp_path):
    path, seen = str(tmp_path / "index"), []

    def embed(df):
        seen.append(sorted(r.chunk_id for r in df.collect()))
        return df.select("chunk_id", F.array(F.length("body").cast("double")).alias("embedding"))

    def run(rows, **how):
        fresh = spark.createDataFrame(rows, "chunk_id string, source string, body string").withColumn("body_hash", F.sha2("body", 256))
        report = store.refreshed(fresh, path, embed, **how)
        return report, {r.chunk_id: (r.body, r.embedding) for r in store.current(spark, path).collect()}

    assert store.current(spark, path) is None
    report, rows = run([("a1", "a", "x"), ("b1", "b", "yy")])
    assert (report, rows) == ({"chunks": 2, "upserted": 2, "skipped": 0, "deleted": 0}, {"a1": ("x", [1.0]), "b1": ("yy", [2.0])})
    before = store.current(spark, path)
    report, rows = run([("a1", "a", "xxx"), ("c1", "c", "z")])
    assert report == {"chunks": 2, "upserted": 2, "skipped": 0, "deleted": 1}
    assert rows == {"a1": ("xxx", [3.0]), "c1": ("z", [1.0])}
    assert before.count() == 2
    report, rows = run([("c1", "c", "z")], partial=True)
    assert (report["skipped"], report["deleted"], set(rows)) == (1, 0, {"a1", "c1"})
    report, rows = run([("c1", "c", "zz")], scope=F.col("source") == "c")
    assert (report["upserted"], rows["a1"], rows["c1"]) == (1, ("xxx", [3.0]), ("zz", [2.0]))
    report, _ = run([("a1", "a", "xxx"), ("c1", "c", "zz")], force=True)
    assert report["upserted"] == 2
    assert seen[-1] == ["a1", "c1"]


def test_one_document_changes(spark):
    docs = spark.createDataFrame([("a", "t", "c", "x", None), ("b", "t", "c", "y", None)], "source string, title string, customer string, content string, updated_at timestamp")
    at = F.lit("2026-01-01").cast("timestamp")
    moved = {r.source: r for r in store.renamed_document(docs, "a", "n/a", "neu", "d", at).collect()}
    assert (moved["n/a"].title, moved["n/a"].customer, moved["n/a"].content, moved["b"].title, moved["b"].updated_at) == ("neu", "d", "x", "t", None)
    assert [r.source for r in store.fetched(docs, ["b", "z", "a", "b"], "source").collect()] == ["b", "a"]
