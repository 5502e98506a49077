import itertools
import random

import pytest

from docweft.operators import csv_repair as cr

NAMES = list(cr.TICKET_COLUMNS)


def record(**given):
    return ",".join(given.get(n, "1" if n == "idx" else "") for n in NAMES)


@pytest.mark.parametrize(
    ("text", "want"),
    [("", [""]), ("a", ["a"]), (",", ["", ""]), ('"a,""b""",c', ['a,"b"', "c"]), ('"a\nb"', ["a\nb"]), ('a"b', None), ('"a"b', None), ('"a', None), (' "a"', None), ('""', [""]), ('"x,"', ["x,"]), ('a,""', ["a", ""]), ('"",', ["", ""])],
)
def test_fields(text, want):
    assert cr.fields_of(text) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ({}, []),
        ({"idx": " 7 "}, []),
        ({"idx": "", "title": "x"}, ["idx"]),
        ({"idx": "9" * 6000}, ["idx"]),
        ({"idx": "0" * 6000 + "1"}, []),
        ({"idx": "0"}, ["idx"]),
        ({"idx": "007"}, []),
        ({"idx": "９"}, ["idx"]),
        ({"idx": "9223372036854775807"}, []),
        ({"idx": "9223372036854775808"}, ["idx"]),
        ({"idx": "-1", "progress_rate": "101", "request_date": "x"}, ["idx", "progress_rate", "request_date"]),
        *[({"progress_rate": x}, []) for x in ("0", "100", "100.00", "080", "7.5", " 7.25")],
        *[({"progress_rate": x}, ["progress_rate"]) for x in ("100.01", ".5", "5.", "1.234", "-1", "1e1", "50%")],
        *[({"request_date": x}, []) for x in ("2024-02-29", "2024.2.9", "2024/02/9", "2024-04-07T08:30:00+09:00", "2024-04-07 08:30:00", "2024-04-07T23:59:59Z", " 2024-1-1 ")],
        *[({"request_date": x}, ["request_date"]) for x in ("2023-02-29", "24.03.05", "2024-1.1", "9-Mar-2024", "2024-04-07T24:00:00", "2024-4-7T08:30:00", "20240407", "2024-13-01", "0000-01-01")],
        ({"title": '"a'}, ["quoting"]),
        ({"title": 'a"'}, ["quoting"]),
        ({"title": "a,b"}, ["column_count"]),
        ({"title": '"a, ""b"""'}, []),
    ],
)
def test_reasons(given, want):
    assert cr.judge(record(**given), NAMES)[1] == want


def fewest_quotes(text):
    """Fewest edits of quotes alone that make a record well-formed, up to two."""
    seen = {text}
    for edits in range(3):
        if any(cr.fields_of(x) is not None for x in seen):
            return edits
        grown = set()
        for x in seen:
            for i in range(len(x) + 1):
                grown.add(x[:i] + '"' + x[i:])
                if i < len(x) and x[i] == '"':
                    grown.add(x[:i] + x[i + 1 :])
        seen = grown
    return 3


def test_repairs_are_cheapest():
    rng = random.Random(3)
    texts = sorted({"".join(rng.choice('a"",,b') for _ in range(rng.randrange(0, 9))) for _ in range(400)})
    for width in (1, 3):
        for text, (edits, fields) in zip(texts, cr.repairs(texts, width), strict=True):
            assert len(fields) == width, text
            quotes = sum(" quote@" in e for e in edits)
            whole = cr.fields_of(text)
            assert min(quotes, 3) == fewest_quotes(text), (text, width, edits)
            if whole is not None:
                assert len(edits) == abs(len(whole) - width), (text, width, edits)


def test_repairs_side_by_side_are_those_of_each_record():
    rng = random.Random(5)
    texts = ["".join(rng.choice('a"",,bc') for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    assert cr.repairs(texts, 9) == [cr.repair(t, 9) for t in texts]


def test_a_long_record_needs_little_memory():
    import tracemalloc

    text = 'x"y,' * 6000
    tracemalloc.start()
    edits, fields = cr.repair(text, 30)
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()
    assert len(fields) == 30
    assert sum("delete quote" in e for e in edits) > 0


def test_repair_says_what_it_did():
    assert cr.repair('a,"b,c', 2)[0] == ["insert quote@6"]
    assert cr.repair("a,b,c", 2)[0] == ["delete delimiter@1"]
    assert cr.repair("a", 2)[0] == ["insert delimiter@1"]
    # Commas inside quotes are no reason to touch the quotes, nor is a delimiter one to excuse them.
    assert cr.repair('"a,b,c",d', 4)[0] == ["insert delimiter@7"] * 2 or all("delimiter" in e for e in cr.repair('"a,b,c",d', 4)[0])
    assert all("quote" in e for e in cr.repair('"a"b', 1)[0])
    assert any("quote" in e for e in cr.repair('"a"b', 2)[0])


def test_well_formed_records_cost_nothing():
    for a, b in itertools.product(["", "x", '"x"', '"x,""y"""'], repeat=2):
        assert cr.repair(f"{a},{b}", 2)[0] == []


def test_table_of_all_cases(spark):
    rows = [(1, record(idx="5", request_date="2024.1.2", progress_rate="7.5", is_urgent="Y", expected_pm_hours="abc") + "\r"), (2, None), (3, ""), (4, "," * 29), (5, ' ,"",' + "," * 40), (6, "﻿" + record()), (None, record(idx="x")), (7, record(title='"' + "가" * 40000 + '"')), (7, record(title='"' + "가" * 40000 + '"')), (8, 'x"' * 3000)]
    df = spark.createDataFrame([(i, r, "z") for i, r in rows], "raw_id bigint, raw_record string, fields string")
    parsed = cr.parse_records(df, "raw_id", "raw_record")
    assert parsed.columns == ["raw_id", "fields", "reasons", "edits"]
    assert sorted((r.raw_id or 0, r.reason) for r in cr.rejected(parsed, "raw_id").collect()) == [(0, "idx"), (6, "idx"), (8, "quoting")]
    valid = cr.typed_rows(parsed, "raw_id")
    assert [t for n, t in valid.dtypes if n != "raw_id"] == list(cr.TICKET_COLUMNS.values())
    got = {r.raw_id: r for r in valid.collect()}
    assert sorted(got) == [1, 7]
    assert (got[1].idx, str(got[1].request_date), str(got[1].progress_rate), got[1].is_urgent, got[1].expected_pm_hours, got[1].title) == (5, "2024-01-02", "7.50", True, None, None)
    assert len(got[7].title) == 40000
    assert cr.parse_records(df.limit(0), "raw_id", "raw_record").collect() == []
