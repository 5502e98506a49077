"""Documents into sections and windows.

All splitters work within a row, on arrays of its sections and windows: they need no shuffle, and each
row of the result carries its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as tx
from docweft.functions.casts import strip

_LINE = r"\r\n|[\n\r]"


def window_starts(length: Column, size: int, overlap: int) -> Column:
    """array<int> of the starts (from 0) of windows of `size` characters over `length`, the last one ending the text.

    An overlap near the size is cut back to leave a step of 100, as a step of nothing would never end.
    """
    step = size - min(overlap, max(0, size - 100))
    n = F.greatest(F.lit(1), F.ceil((length - size) / float(step)).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * step)


def _windows(df: DataFrame, body: str, size: int, overlap: int, least: int, stripped: bool) -> DataFrame:
    parts = df.select("*", F.posexplode(window_starts(F.length(body), size, overlap)).alias("window_no", "start"))
    part = F.substring(F.col(body), F.col("start") + 1, F.lit(size))
    return parts.withColumn("part", strip(part) if stripped else part).filter(F.length("part") >= least).drop("start")


def windows(df: DataFrame, body: str, size: int = 1800, overlap: int = 250, least: int = 80, stripped: bool = True) -> DataFrame:
    """`df` with window_no and part for each window of its column `body` that has `least` characters."""
    return _windows(df.filter(F.length(body) > 0), body, size, overlap, least, stripped)


def heading_sections(df: DataFrame, text: str, title: Column, skipped: tuple[str, ...] = tx.SKIPPED_SECTIONS) -> DataFrame:
    """`df` with doc_title, section_no, heading and section: cut before headings of levels 1 to 3.

    doc_title is the first level-1 heading or `title`; a section without a heading has the doc_title. Sections
    whose heading contains one of `skipped` are left out, blank ones too.
    """
    h1 = strip(F.regexp_extract(F.col(text), r"(?m)^#\s+(.+)$", 1))
    named = df.withColumn("doc_title", F.when(h1 != "", h1).otherwise(title))
    cut = named.select("*", F.posexplode(F.split(F.col(text), r"(?m)(?=^#{1,3}\s+)")).alias("section_no", "section")).withColumn("section", strip("section")).filter(F.col("section") != "")
    own = strip(F.regexp_extract("section", r"(?m)^#{1,3}\s+(.+)$", 1))
    return cut.withColumn("heading", F.when(own != "", own).otherwise(F.col("doc_title"))).filter(~tx.any_of(F.col("heading"), skipped))


def _cut(section: Column, size: int, overlap: int, least: int, stripped: bool) -> Column:
    """array<string> of the windows of a section that are long enough."""
    part = lambda start: F.substring(section, start + 1, F.lit(size))
    parts = F.transform(window_starts(F.length(section), size, overlap), lambda i: strip(part(i)) if stripped else part(i))
    return F.filter(parts, lambda p: F.length(p) >= least)


def search_chunks(docs: DataFrame, size: int = 1800, overlap: int = 250, least: int = 80, skipped: tuple[str, ...] = tx.SKIPPED_SECTIONS) -> DataFrame:
    """Chunks for search of documents (source, content, updated_at), cut before headings and then in windows.

    chunk_id counts the chunks of a document that are long enough, from 1. Null and blank contents give none.
    """
    clean = docs.select("source", "updated_at", tx.clean(F.col("content")).alias("content")).filter(F.length("content") > 0)
    h1 = strip(F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1))
    titled = clean.withColumn("title", F.when(h1 != "", h1).otherwise(tx.stem(F.col("source"))))
    sections = F.filter(F.transform(F.split("content", r"(?m)(?=^#{1,3}\s+)"), strip), lambda x: x != "")
    own = lambda x: strip(F.regexp_extract(x, r"(?m)^#{1,3}\s+(.+)$", 1))
    headed = F.transform(sections, lambda x: F.struct(F.when(own(x) != "", own(x)).otherwise(F.col("title")).alias("heading"), x.alias("section")))
    kept = F.filter(headed, lambda x: ~tx.any_of(x["heading"], skipped))
    parts = F.flatten(F.transform(kept, lambda x: F.transform(_cut(x["section"], size, overlap, least, True), lambda p: F.struct(x["heading"].alias("heading"), p.alias("part")))))
    flat = titled.select("source", "title", "updated_at", F.posexplode(parts).alias("n", "p"))
    doc_id = tx.document_id(F.col("source"))
    return flat.select(
        F.concat(doc_id, F.lit("_chunk_"), F.lpad((F.col("n") + 1).cast("string"), 4, "0")).alias("chunk_id"),
        doc_id.alias("document_id"),
        "source",
        "title",
        tx.basename(F.col("source")).alias("filename"),
        tx.dirname(F.col("source")).alias("folder"),
        F.col("p.heading").alias("heading"),
        F.col("n").alias("ordinal"),
        F.col("p.part").alias("body"),
        tx.normalized(F.col("p.part")).alias("normalized_body"),
        tx.compact(F.col("p.part")).alias("compact_body"),
        "updated_at",
    )


def first_chunks(chunks: DataFrame, limit: int) -> DataFrame:
    """The first `limit` chunks by source and place."""
    return chunks.orderBy("source", "ordinal").limit(limit)


def heading_path_sections(text: Column) -> Column:
    """array<struct<path: array<string>, body: string>>: the text under each run of headings of levels 1 to 6.

    A heading closes all of its own and of deeper levels; levels left out have no part in the path. Heading
    lines are in no body. One fold over the lines keeps the open headings and the lines since.
    """
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("stack"), none.alias("lines"), F.array().cast("array<struct<path:array<string>,body:string>>").alias("done"))
    path = lambda s: F.filter(s["stack"], lambda h: h != "")
    body = lambda s: strip(F.array_join(s["lines"], "\n"))
    closed = lambda s: F.when(body(s) != "", F.concat(s["done"], F.array(F.struct(path(s).alias("path"), body(s).alias("body"))))).otherwise(s["done"])

    def step(s: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, r"^(#{1,6})\s+.*$", 1))
        head = strip(F.regexp_extract(line, r"^#{1,6}\s+(.*)$", 1))
        above = F.slice(s["stack"], F.lit(1), F.greatest(level - 1, F.lit(0)))
        gap = F.greatest(level - 1 - F.size(above), F.lit(0))
        opened = F.concat(above, F.array_repeat(F.lit(""), gap), F.array(head))
        return F.when(level > 0, F.struct(opened.alias("stack"), none.alias("lines"), closed(s).alias("done"))).otherwise(F.struct(s["stack"].alias("stack"), F.concat(s["lines"], F.array(line)).alias("lines"), s["done"].alias("done")))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), _LINE), zero, step, closed)


def graph_chunks(docs: DataFrame, size: int = 1200, overlap: int = 150, least: int = 20, least_body: int = 0) -> DataFrame:
    """(source, ordinal, heading_path, body) of documents (source, content), ordinal from 0 within a document.

    Stretches of text under `least_body` characters give none.
    """
    long = F.filter(heading_path_sections(F.col("content")), lambda s: F.length(s["body"]) >= least_body)
    parts = F.flatten(F.transform(long, lambda s: F.transform(_cut(s["body"], size, overlap, least, False), lambda p: F.struct(s["path"].alias("heading_path"), p.alias("body")))))
    return docs.select("source", F.posexplode(parts).alias("ordinal", "p")).select("source", "ordinal", F.col("p.heading_path").alias("heading_path"), F.col("p.body").alias("body"))


def customer_blocks(df: DataFrame, text: str) -> DataFrame:
    """`df` with block_no, customer and block: a handbook cut at its level-3 headings and lines that are all bold."""
    cut = df.select("*", F.posexplode(F.split(F.col(text), r"(?m)(?=^###\s+\S)|(?=^\*\*[^*\n]+\*\*\s*$)")).alias("block_no", "block"))
    name = F.coalesce(F.nullif(F.regexp_extract("block", r"^###\s+(.+?)\s*(?:\n|$)", 1), F.lit("")), F.nullif(F.regexp_extract("block", r"^\*\*([^*\n]+)\*\*", 1), F.lit("")))
    return cut.withColumn("customer", strip(name)).filter("customer is not null")


def customer_rows(df: DataFrame, text: str, least: int = 2, heads: tuple[str, ...] = ("고객사", "업체명")) -> DataFrame:
    """`df` with row_no, customer and block: the rows of markdown tables of a handbook, each as a table of its own.

    A row of at least `least` cells is about the customer in its first one; its block has a line for each cell
    under the name of its column, "-" where it is empty. The row before with one of `heads` first names the columns.
    """
    rows = F.transform(tx.table_rows(F.col(text)), lambda r, i: F.struct(i.alias("i"), r.alias("cells")))
    cut = df.withColumn("_rows", rows).withColumn("_heads", F.filter("_rows", lambda r: r["cells"][0].isin(*heads)))
    one = cut.select("*", F.explode("_rows").alias("_row")).filter((F.size("_row.cells") >= least) & ~F.col("_row.cells")[0].isin(*heads))
    head = F.element_at(F.filter("_heads", lambda h: h["i"] < F.col("_row.i")), -1)
    named = one.withColumn("_head", F.when(F.size(F.filter("_heads", lambda h: h["i"] < F.col("_row.i"))) > 0, head["cells"]))
    line = lambda c, i: F.concat(F.lit("| "), F.coalesce(F.get("_head", i), F.lit("")), F.lit(" | "), F.when(c != "", c).otherwise("-"), F.lit(" |"))
    cells = F.transform("_row.cells", line)
    block = F.array_join(F.concat(F.array(F.lit("| 항목 | 내용 |"), F.lit("|---|---|")), cells), "\n")
    bare = strip(F.replace(F.col("_row.cells")[0], F.lit("**"), F.lit("")))
    return named.select(*df.columns, F.col("_row.i").alias("row_no"), bare.alias("customer"), block.alias("block")).filter("customer != ''")
