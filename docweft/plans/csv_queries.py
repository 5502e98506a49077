"""Queries over ticket records as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators import csv_repair
from docweft.session import table


def _parsed(spark: SparkSession, root: str) -> DataFrame:
    return csv_repair.parse_records(table(spark, root, "raw_requests").filter("record_no > 1"), "raw_id", "raw_record")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return csv_repair.rejected(_parsed(spark, root), "raw_id")


def p3_tickets(spark: SparkSession, root: str) -> DataFrame:
    return csv_repair.typed_rows(_parsed(spark, root), "raw_id")


def p3_edits(spark: SparkSession, root: str) -> DataFrame:
    return _parsed(spark, root).filter(F.size("edits") > 0).select("raw_id", F.array_join("reasons", ",").alias("reason"), F.array_join("edits", "; ").alias("edits"))


QUERIES = {"p3_found": p3_found, "p3_tickets": p3_tickets, "p3_edits": p3_edits}

_SPLIT = r"""with r as (select raw_id, case when suffix(raw_record, chr(13)) then left(raw_record, -1) else raw_record end as rec from raw_requests where record_no > 1),
q as (select raw_id, rec, regexp_full_match(rec, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') as whole from r),
f as (select raw_id, whole, case when whole then regexp_extract_all(rec || ',', '(?s)("(?:[^"]|"")*"|[^",]*),', 1) end as f from q),
u as (select raw_id, whole, [case when prefix(x, '"') then replace(x[2:-2], '""', '"') else x end for x in f] as f from f),
v as (select raw_id, whole, f, regexp_replace(f[1], '^\s+|\s+$', '', 'g') as idx, regexp_replace(f[26], '^\s+|\s+$', '', 'g') as rate, regexp_replace(f[10], '^\s+|\s+$', '', 'g') as day from u
  where not whole or len([x for x in f if regexp_replace(x, '\s+', '', 'g') <> '']) > 0)
"""
_BAD_DAY = r"""not (day = ''
  or regexp_full_match(day, '[0-9]{4}(?:-[0-9]{1,2}-|\.[0-9]{1,2}\.|/[0-9]{1,2}/)[0-9]{1,2}') and try_cast(regexp_replace(day, '[./]', '-', 'g') as date) is not null
  or regexp_full_match(day, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?') and try_cast(left(day, 10) as date) is not null)"""


def _typed(e: str, kind: str) -> str:
    """A field's value in the type of its column; null where it does not convert, but false for booleans."""
    x = rf"regexp_replace({e}, '^(?:\s|\p{{Z}})+|(?:\s|\p{{Z}})+$', '', 'g')"
    if kind == "string":
        return f"nullif({x}, '')"
    if kind == "boolean":
        return f"lower({x}) in ('1', 'true', 't', 'y', 'yes', 'on')"
    if kind == "date":
        return rf"case when regexp_full_match({x}, '[0-9]{{4}}(?:-[0-9]{{1,2}}-|\.[0-9]{{1,2}}\.|/[0-9]{{1,2}}/)[0-9]{{1,2}}') then try_cast(regexp_replace({x}, '[./]', '-', 'g') as date) when regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}') then try_cast(left({x}, 10) as date) end"
    if kind == "timestamp":
        return f"try_cast({x} as timestamptz)"
    number = "[+-]?[0-9]+" if "int" in kind else r"[+-]?[0-9]+(?:\.[0-9]*)?"
    return f"case when regexp_full_match({x}, '{number}') then try_cast({x} as {kind}) end"


_BAD_IDX = "not coalesce(regexp_full_match(idx, '[0-9]+') and try_cast(idx as hugeint) between 1 and 9223372036854775807, false)"
_BAD_RATE = r"not (rate = '' or coalesce(regexp_full_match(rate, '[0-9]+(?:\.[0-9]{1,2})?') and try_cast(rate as double) <= 100, false))"

SQL = {
    "p3_found": _SPLIT
    + f"""select distinct raw_id, 'quoting' as reason from v where not whole
union all select distinct raw_id, 'column_count' from v where whole and len(f) <> 30
union all select distinct raw_id, 'idx' from v where whole and len(f) = 30 and {_BAD_IDX}
union all select distinct raw_id, 'progress_rate' from v where whole and len(f) = 30 and {_BAD_RATE}
union all select distinct raw_id, 'request_date' from v where whole and len(f) = 30 and {_BAD_DAY}""",
    "p3_tickets": _SPLIT + "select raw_id, " + ", ".join(f"{_typed(f'f[{i}]', kind)} as {name}" for i, (name, kind) in enumerate(csv_repair.TICKET_COLUMNS.items(), 1)) + f" from v where whole and len(f) = 30 and not {_BAD_IDX} and not {_BAD_RATE} and not {_BAD_DAY}",
}
