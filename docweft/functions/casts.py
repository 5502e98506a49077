"""Typed casts of text columns; none of them ever raises, under ANSI mode either."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without any Unicode blanks at both ends (trim() would take spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def to_number(c: Column, kind: str) -> Column:
    """Number of a trimmed text; null for what is none or overflows."""
    return strip(c).try_cast(kind)


def to_boolean(c: Column) -> Column:
    """True for the accepted words; false for anything else, null and blank included."""
    return F.coalesce(F.lower(strip(c)).isin("1", "true", "t", "y", "yes", "on"), F.lit(False))


def to_date(c: Column) -> Column:
    """Date written with -, . or /, or that an ISO timestamp starts with."""
    c = strip(c)
    day = F.regexp_replace(F.regexp_extract(c, r"^(\d{4}([-./])\d{1,2}\2\d{1,2})$", 1), "[./]", "-")
    moment = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})[T ]\d{2}:\d{2}", 1)
    return F.coalesce(F.nullif(day, F.lit("")), F.nullif(moment, F.lit(""))).try_cast("date")


def to_timestamp(c: Column) -> Column:
    """ISO timestamp, read as UTC (the session's zone) unless it has an offset."""
    return strip(c).try_cast("timestamp")
