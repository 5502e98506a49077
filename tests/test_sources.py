import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docweft.operators.csv_repair import TICKET_COLUMNS
from docweft.sources import converters, files, ticket_csv
from docweft.streaming import ingest


@pytest.fixture
def tree(tmp_path):
    for path, data in {"가 나/글.md": "# 제목\n본문".encode(), "뿌리.md": b"\xff\xfeok", "버림/x.md": b"x", "가 나/그림+1.PNG": b"png", "가 나/.숨김.md": b"h", "a.txt": "한글".encode("cp949")}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    return str(tmp_path)


def test_markdown_tree(spark, tree):
    got = {r.source: r for r in files.markdown_tree(spark, tree, ("버림",)).collect()}
    assert {"가 나/글.md", "뿌리.md"} <= set(got)
    assert "버림/x.md" not in got
    assert (got["가 나/글.md"].title, got["가 나/글.md"].customer, got["가 나/글.md"].content) == ("글", "가 나", "# 제목\n본문")
    assert got["뿌리.md"].content.endswith("ok")
    assert got["뿌리.md"].customer == ""


def test_images(spark, tree):
    assert [(r.path, r.mime_type, r.size_bytes) for r in files.image_assets(spark, tree).collect()] == [("가 나/그림+1.PNG", "image/png", 3)]


def test_import(spark, tree):
    got = {r.path: r for r in converters.converted(files.import_files(spark, tree)).collect()}
    assert got["a.txt"].content == "# a\n\n한글"
    assert got["가 나/글.md"].content == "# 제목\n본문"
    assert not any("숨김" in p for p in got)


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_docx():
    p = lambda text, style="": f'<w:p><w:pPr>{f"<w:pStyle w:val=\"{style}\"/>" if style else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = p("제목", "Heading1") + p("글") + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b|c") + "</w:tc></w:tr><w:tr><w:tc>" + p("1") + "</w:tc></w:tr></w:tbl>" + p("항목", "ListBullet") + p("")
    data = zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})
    assert converters.docx_to_markdown(data) == "# 제목\n\n글\n\n- 항목\n\n| a | b\\|c |\n|---|---|\n| 1 |  |"


def test_xlsx():
    data = zipped(
        {
            "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="가" r:id="r1"/><sheet name="나" r:id="r2"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {S}><si><t>이름</t></si></sst>",
            "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
            "xl/worksheets/s1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>날</t></is></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="C2" s="1"><v>45292</v></c></row><row r="3"><c r="A3"/></row></sheetData></worksheet>',
            "xl/worksheets/s2.xml": f"<worksheet {S}><sheetData/></worksheet>",
        }
    )
    assert converters.xlsx_to_markdown(data) == "## 가\n\n| 이름 | B | 날 |\n|---|---|---|\n| 1.5 |  | 2024-01-01 |"


def test_broken_file_does_not_end_the_job(spark):
    df = spark.createDataFrame([("x.docx", ".docx", bytearray(b"no zip")), ("y.md", ".md", bytearray(b"# y"))], "path string, ending string, content binary")
    got = {r.path: r for r in converters.converted(df).collect()}
    assert got["x.docx"].content is None
    assert "BadZipFile" in got["x.docx"].error
    assert got["y.md"].error is None


def write_csv(path, rows, header=None):
    lines = [",".join(header or TICKET_COLUMNS)] + [",".join(r.get(c, "") for c in TICKET_COLUMNS) for r in rows]
    path.write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")


def test_strict_csv(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [{"idx": " 7 ", "title": '"줄\n바꿈, ""인용"""', "request_date": "2024.01.02", "updated_at": "2024-01-02T03:04:05Z", "is_urgent": "yes"}, {}])
    (r,) = ticket_csv.read_tickets(spark, str(tmp_path / "a.csv")).collect()
    assert (r.idx, r.title, str(r.request_date), r.is_urgent, r.expected_hours_confirmed) == (7, '줄\n바꿈, "인용"', "2024-01-02", True, False)
    write_csv(tmp_path / "b.csv", [{"idx": "x", "title": "t"}])
    with pytest.raises(Exception, match="idx is no number"):
        ticket_csv.read_tickets(spark, str(tmp_path / "b.csv")).collect()
    write_csv(tmp_path / "c.csv", [], ["idx", "title"])
    with pytest.raises(ValueError, match="columns are missing"):
        ticket_csv.read_tickets(spark, str(tmp_path / "c.csv"))


def test_cases(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"query": "q", "expected_keywords": ["a"]}, {"question": "r", "expected_source": "s"}, {"query": " "}]))
    assert sorted(r.query for r in files.cases_json(spark, str(tmp_path / "c.json")).collect()) == ["q", "r"]
    (tmp_path / "c.csv").write_text('question,expected_source,expected_title\n"a, b",s,\n,x,y\n')
    assert [tuple(r) for r in files.cases_csv(spark, str(tmp_path / "c.csv")).collect()] == [("a, b", "s", None)]


def test_stored_documents(spark, data):
    where = f"{data}/maintenance_docs.parquet"
    docs = spark.read.parquet(where)
    assert files.documents(spark, where, True).count() == docs.filter("deleted_at is null").count()
    index = files.document_index(docs)
    assert "content" not in index.columns
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_ingest_stream(spark, tmp_path):
    arrivals, path, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()

    def arrive(name, *docs):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(d) for d in docs))
        query = ingest.ingest(spark, arrivals, path, check).trigger(availableNow=True).start()
        query.awaitTermination()

    doc = lambda source, word, day, **more: {"source": source, "content": f"# 글\n\n{word} " * 40, "updated_at": f"2026-01-0{day}T00:00:00Z"} | more
    arrive("1.json", doc("a.md", "밸브", 1), doc("b.md", "펌프", 1), doc("a.md", "헌것", 0 or 1, updated_at="2025-01-01T00:00:00Z"))
    first = {r.source: r for r in ingest.current(spark, path).collect()}
    assert set(first) == {"a.md", "b.md"}
    assert "밸브" in first["a.md"].body
    arrive("2.json", doc("a.md", "새것", 2), doc("b.md", "펌프", 2, deleted_at="2026-01-02T00:00:00Z"))
    second = {r.source: r.body for r in ingest.current(spark, path).collect()}
    assert set(second) == {"a.md"}
    assert "새것" in second["a.md"]


def test_event_windows(spark, tmp_path, data):
    (tmp_path / "ev").mkdir()
    spark.read.parquet(f"{data}/events.parquet").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "ev"))
    schema = spark.read.parquet(str(tmp_path / "ev")).schema
    stream = ingest.event_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "ev")))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()
