import re
from collections import Counter

import pytest

from docweft.llm.term_frequency import TERM_PATTERN, term_frequencies

SCHEMA = "id bigint, body string, k string, t string, term string"


def brute(rows, min_df=3, max_share=0.35):
    unique = {}
    for i, body in rows:
        unique.setdefault(i, body)
    occ, df = Counter(), Counter()
    for body in unique.values():
        found = re.findall(TERM_PATTERN, (body or "").lower())
        occ.update(found)
        df.update(set(found))
    n = len(unique)
    return {t: (occ[t], df[t], n, "rare" if df[t] < min_df else "common" if df[t] / n > max_share else None) for t in occ}


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, b, "x", "y", "z") for i, b in rows], SCHEMA)
    return {r.term: (r.occurrences, r.doc_freq, r.n_docs, r.mark) for r in term_frequencies(df, "id", "body", **how).collect()}


def test_counts_equal_brute_force(spark):
    rows = [(i, f"점검 밸브{'가' * (i % 3)} pump pump v{i} log-file.v{i % 7} A{i % 4}x") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "   "), (103, "밸 a 1 ."), (0, "점검 밸브 pump pump v0 log-file.v0 A0x"), (5, "점검 밸브가가 pump pump v5 log-file.v5 A1x")]
    rows += [(200, "긴 " + "아주긴말" * 5000 + " pump" * 3000)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize(("heavy", "sample", "flush"), [(0, 10, 1), (1, 5, 3), (1000, 1000, 2)])
def test_what_is_heavy_changes_no_count(spark, heavy, sample, flush):
    rows = [(i, f"공통 말{i % 5}번 한번{i} 두번{i // 2}") for i in range(40)]
    rows = [(i, re.sub(r"\d", lambda m: "가나다라마바사아자차"[int(m[0])], b)) for i, b in rows]
    assert run(spark, rows, heavy_terms=heavy, sample_rows=sample, flush_terms=flush) == brute(rows)


def test_marks_at_the_limits(spark):
    # 20 records; 7 of 20 is exactly 35 percent, which is not more.
    rows = [(i, ("seven " if i < 7 else "") + ("eight " if i < 8 else "") + ("three " if i < 3 else "") + ("two " if i < 2 else "")) for i in range(20)]
    assert {t: x[3] for t, x in run(spark, rows).items()} == {"seven": None, "eight": "common", "three": None, "two": "rare"}


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_null_keys_are_one_record(spark):
    assert run(spark, [(None, "밸브"), (None, "밸브"), (1, "밸브")])["밸브"][:3] == (2, 2, 2)
