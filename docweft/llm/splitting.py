"""Splitting of oversized texts at natural boundaries by recursive bisection.

A text over the limit is cut at the strongest boundary near its middle, and each half that is still over
the limit less the overlap is cut in the same way; then each piece but the first gets the overlap in
front. Boundaries, strongest first: blank line before a heading, heading line, blank line, line end,
sentence end, clause end, blank. Where there is none, the cut is made between the two characters as readers see them
(grapheme clusters: marks, joined emoji, flags and conjoining jamo stay together) that are nearest before the
middle; only a single one that is longer than a part may be is cut within.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweft.session import spread

#: Boundaries by strength; the cut is at the end of the match.
BOUNDARIES = [
    regex.compile(r"\n[ \t\r]*\n\s*(?=#{1,6}\s)"),
    regex.compile(r"\n(?=#{1,6}\s)"),
    regex.compile(r"\n[ \t\r]*\n\s*"),
    regex.compile("\r\n|\n|\r|\u2028|\u2029"),
    regex.compile(r"[.!?。！？…]+[\"'”’)\]]*\s+"),
    regex.compile(r"[,;:、，；：]\s+|</(?:p|div|tr|li|td)>"),
    regex.compile(r"\s+"),
]

_CLUSTER = regex.compile(r"\X")


def _joined(text: str, at: int) -> bool:
    """Whether a cut at `at` would part a character from what it stands with."""
    left, right = text[at - 1], text[at]
    return unicodedata.category(right)[0] == "M" or right in "\u200d\ufe0e\ufe0f" or left == "\u200d" or (left == "\r" and right == "\n")


def _cut(text: str, start: int, end: int, least: int) -> int:
    """Where to cut text[start:end]: the strongest boundary near the middle, leaving `least` on both sides."""
    middle = (start + end) // 2
    # Near: within a quarter of the span around the middle. What pauses at all is looked for farther out.
    for reach in (max(1, (end - start) // 4), max(1, (end - start) // 2 - least)):
        low, high = max(start + least, middle - reach), min(end - least, middle + reach)
        for boundary in BOUNDARIES:
            best = -1
            for found in boundary.finditer(text, max(start, low - 200), min(end, high + 200)):
                at = found.end()
                if low <= at <= high and start < at < end and not _joined(text, at) and (best < 0 or abs(at - middle) < abs(best - middle)):
                    best = at
            if best >= 0:
                return best
    # The span begins between two clusters, so reading on from there finds all others.
    best = -1
    for found in _CLUSTER.finditer(text, start, end):
        if found.end() > middle and best >= 0 or found.end() >= end:
            break
        best = found.end()
        if best >= middle:
            break
    return best if start + least <= best <= end - least else middle


def cuts(text: str, limit: int = 1200, overlap: int = 150) -> list[tuple[int, int, int]]:
    """(start with overlap, start of what is new, end) of each piece, in order."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    most, spans, todo = limit - overlap, [], [(0, len(text))]
    while todo:
        start, end = todo.pop()
        if end - start <= most:
            spans.append((start, end))
            continue
        at = _cut(text, start, end, max(1, min(most, end - start) // 8))
        todo += [(at, end), (start, at)]
    return [(max(0, start - overlap) if k else 0, start, end) for k, (start, end) in enumerate(spans)]


def split_texts(df: DataFrame, keys: list[str], text: str, limit: int = 1200, overlap: int = 150) -> DataFrame:
    """`keys`, piece_no (from 0), n_pieces, start, fresh, end, piece for each piece of each row's text.

    Lengths are Unicode code points. A piece holds text[start:end]; all but the first begin with the
    `overlap` characters before `fresh`, which end the piece before. So the pieces from `fresh` on, joined,
    are the text. A piece has at most `limit` characters, and every part is at most `limit - overlap` long,
    so the overlap is always whole unless the text before it is shorter. Texts within the limit and empty
    ones are one piece; null texts give no row. Repeated rows are split each; other columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be from 0 to limit - 1")
    names = [f"k{i}" for i in range(len(keys))]
    narrow = spread(df.select(*[df[k].alias(n) for k, n in zip(keys, names, strict=True)], df[text].alias("t")).filter("t is not null"))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                row, number, count, starts, fresh, ends, pieces = [], [], [], [], [], [], []
                for i, content in enumerate(part.column(n).to_pylist()):
                    spans = cuts(content, limit, overlap)
                    for k, (a, b, c) in enumerate(spans):
                        row.append(i)
                        number.append(k)
                        count.append(len(spans))
                        starts.append(a)
                        fresh.append(b)
                        ends.append(c)
                        pieces.append(content[a:c])
                taken = [part.column(j).take(pa.array(row, pa.int32())) for j in range(n)]
                yield pa.RecordBatch.from_arrays([*taken, *(pa.array(x, pa.int32()) for x in (number, count, starts, fresh, ends)), pa.array(pieces, pa.string())], [*names, "piece_no", "n_pieces", "start", "fresh", "end", "piece"])

    schema = T.StructType([narrow.schema[x] for x in names] + [T.StructField(x, T.IntegerType()) for x in ("piece_no", "n_pieces", "start", "fresh", "end")] + [T.StructField("piece", T.StringType())])
    out = narrow.mapInArrow(run, schema)
    return out.toDF(*keys, *out.columns[n:])
