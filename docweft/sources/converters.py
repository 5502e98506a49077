"""Office files into markdown.

.docx and .xlsx are zipped XML and are read with the standard library; .pdf needs pypdf, where it is
installed. Conversion is Python work on bytes, so it runs in mapInPandas over a binary scan.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

try:
    import pypdf
except ImportError:
    pypdf = None

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Numbers of the built-in date formats of spreadsheets.
_DATES = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47))


def _row(cells: list[str]) -> str:
    return "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"


def _table(rows: list[list[str]]) -> list[str]:
    width = max(map(len, rows))
    full = [r + [""] * (width - len(r)) for r in rows]
    return [_row(full[0]), "|" + "---|" * width, *map(_row, full[1:])]


def docx_to_markdown(data: bytes) -> str:
    """Headings of levels 1 to 3, list items and paragraphs in order; tables follow after them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out = []
    for p in body.findall(f"{_W}p"):
        words = text(p)
        if not words:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = (style.get(f"{_W}val") or "") if style is not None else ""
        level = re.fullmatch(r"(?:Heading|heading|제목)\s*([1-3])", name)
        listed = name.startswith("List") or p.find(f"{_W}pPr/{_W}numPr") is not None
        out.append(f"{'#' * int(level[1])} {words}" if level else f"- {words}" if listed else words)
    for table in body.findall(f"{_W}tbl"):
        rows = [[text(c) for c in r.findall(f"{_W}tc")] for r in table.findall(f"{_W}tr")]
        if rows:
            out.append("\n".join(_table(rows)))
    return "\n\n".join(out)


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_to_markdown(data: bytes) -> str:
    """A table for each sheet, headed by its name where there are several; blank header cells get column letters."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        read = lambda n: ElementTree.fromstring(z.read(n))
        shared = ["".join(t.text or "" for t in e.iter(f"{_S}t")) for e in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dated = []
        if "xl/styles.xml" in names:
            styles = read("xl/styles.xml")
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{_S}numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^]]*\]', "", f.get("formatCode") or ""), re.I)}
            dated = [int(x.get("numFmtId") or 0) in _DATES | own for x in (() if styles.find(f"{_S}cellXfs") is None else styles.find(f"{_S}cellXfs"))]
        paths = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        sheets = [(s.get("name"), paths[s.get(f"{_R}id")]) for s in read("xl/workbook.xml").iter(f"{_S}sheet")]

        def value(c: ElementTree.Element) -> str:
            kind, v = c.get("t"), c.find(f"{_S}v")
            if kind == "inlineStr":
                return "".join(t.text or "" for t in c.iter(f"{_S}t"))
            if v is None or v.text is None:
                return ""
            if kind == "s":
                return shared[int(v.text)]
            if kind == "b":
                return "TRUE" if v.text == "1" else "FALSE"
            style = int(c.get("s") or 0)
            if kind is None and style < len(dated) and dated[style]:
                at = dt.datetime(1899, 12, 30) + dt.timedelta(days=float(v.text))
                return str(at.date()) if at.time() == dt.time() else str(at.replace(microsecond=0))
            return v.text

        out = []
        for name, path in sheets:
            rows: list[list[str]] = []
            for r in read(path.lstrip("/") if path.startswith("/") else f"xl/{path}").iter(f"{_S}row"):
                cells: list[str] = []
                for c in r.findall(f"{_S}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells) + 1
                    cells += [""] * (at - 1 - len(cells)) + [value(c).strip()]
                rows += [[] for _ in range(int(r.get("r") or len(rows) + 1) - 1 - len(rows))] + [cells]
            while rows and not any(rows[-1]):
                rows.pop()
            if not rows:
                continue
            width = max(map(len, rows))
            head = rows[0] + [""] * (width - len(rows[0]))
            table = "\n".join(_table([[h or _letters(i + 1) for i, h in enumerate(head)], *rows[1:]]))
            out.append(f"## {name}\n\n{table}" if len(sheets) > 1 else table)
    return "\n\n".join(out)


def pdf_to_markdown(data: bytes) -> str:
    """A section for each page that has text."""
    if pypdf is None:
        raise RuntimeError("reading .pdf files needs pypdf")
    pages = [(n, (p.extract_text() or "").strip()) for n, p in enumerate(pypdf.PdfReader(io.BytesIO(data)).pages, 1)]
    return "\n\n".join(f"## 페이지 {n}\n\n{text}" for n, text in pages if text)


def plain_text(data: bytes) -> str:
    """UTF-8 text, else that of the older Korean code page, which the JVM's decoder does not take."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp949", errors="replace")


CONVERTERS = {".docx": docx_to_markdown, ".xlsx": xlsx_to_markdown, ".pdf": pdf_to_markdown, ".md": plain_text, ".txt": plain_text}


def converted(files: DataFrame) -> DataFrame:
    """(path, content, error) of files (path, ending, content): markdown, or why a file could not be converted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, ending, data in zip(batch["path"], batch["ending"], batch["content"], strict=True):
                try:
                    text = CONVERTERS[ending](data).replace("\r\n", "\n").replace("\r", "\n")
                    name = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
                    out.append((path, text if re.search(r"^#\s+\S", text, re.M) else f"# {name}\n\n{text}", None))
                except Exception as x:  # noqa: BLE001 - one file must not end the job
                    out.append((path, None, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(out, columns=["path", "content", "error"])

    return files.select("path", "ending", "content").mapInPandas(run, "path string, content string, error string")
