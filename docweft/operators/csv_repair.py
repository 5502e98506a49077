"""Parsing of CSV records that may be broken: valid ones come out typed, others with their reasons.

Minimum-cost error parse: a record is read by the automaton of quoted and bare fields, which may insert or
delete quotes and delimiters. A dynamic program over (token, automaton state, fields so far) finds the cheapest
way to a record of the right width, for many records side by side. Records that parse at no cost and whose checked
columns are valid load; of all others the edits state the reason: those of quotes that the quoting is broken, those
of delimiters alone that the number of fields is wrong. Records that a pattern proves to be well-formed and of the
right width skip the program, whose answer for them is known to be no edit.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.functions import casts
from docweft.session import spread

#: The columns of a ticket record, in their order in the file.
TICKET_COLUMNS = {
    "idx": "bigint", "user_id": "string", "contact_person": "string", "manager_id": "bigint", "worker_id": "bigint", "type_id": "int", "status_id": "int",
    "title": "string", "content": "string", "request_date": "date", "expected_date": "date", "completed_date": "date",
    "expected_pm_hours": "decimal(10,2)", "expected_design_hours": "decimal(10,2)", "expected_pub_hours": "decimal(10,2)", "expected_dev_hours": "decimal(10,2)",
    "expected_hours_confirmed": "boolean", "expected_hours_confirmed_at": "timestamp",
    "actual_pm_hours": "decimal(10,2)", "actual_design_hours": "decimal(10,2)", "actual_pub_hours": "decimal(10,2)", "actual_dev_hours": "decimal(10,2)",
    "is_urgent": "boolean", "issues": "string", "report_title": "string", "progress_rate": "decimal(6,2)", "progress_status": "string", "notes": "string", "created_at": "timestamp", "updated_at": "timestamp",
}

_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_WHOLE = re.compile(rf"(?:{_FIELD},)*+\Z")
_EACH = re.compile(rf"({_FIELD}),")
_TOKENS = re.compile(r'[^",]+|"|,')

_ID = re.compile(r"[0-9]+\Z")
_RATE = re.compile(r"[0-9]+(?:\.[0-9]{1,2})?\Z")
_DAY = re.compile(r"([0-9]{4})([-./])([0-9]{1,2})\2([0-9]{1,2})\Z")
_MOMENT = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})[T ]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?\Z")

# Automaton states: before a field, in a bare field, in a quoted field, after a quote in a quoted field.
_START, _BARE, _QUOTED, _QUOTE = range(4)
_TEXT, _MARK, _COMMA, _END = range(4)
_KIND = {'"': _MARK, ",": _COMMA}
#: An edit of a delimiter costs one, one of a quote more than all those of delimiters.
_FAR, _DEAR = 1 << 50, 1 << 24
#: Records that the program reads side by side.
GROUP = 128


def _day(text: str) -> dt.date | None:
    """The calendar day that `text` writes in an accepted way, if any."""
    try:
        if found := _DAY.match(text):
            return dt.date(int(found[1]), int(found[3]), int(found[4]))
        if found := _MOMENT.match(text):
            return dt.datetime(*map(int, found.groups())).date()
    except ValueError:
        pass
    return None


#: What is wrong with a trimmed value, by column.
CHECKS = {
    "idx": lambda x: not (_ID.match(x) and len(x.lstrip("0")) <= 19 and 1 <= int(x.lstrip("0") or 0) < 1 << 63),
    "progress_rate": lambda x: x != "" and not (_RATE.match(x) and float(x) <= 100),
    "request_date": lambda x: x != "" and _day(x) is None,
}


def fields_of(record: str) -> list[str] | None:
    """The fields of a well-formed record without their quotes; None if its quoting is broken."""
    if '"' not in record:
        return record.split(",")
    record += ","
    if not _WHOLE.match(record):
        return None
    return [x[1:-1].replace('""', '"') if x[:1] == '"' else x for x in _EACH.findall(record)]


def _closed(cost: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Costs after any insertions: quotes change the state, delimiters also the number of fields.

    A delimiter is not put where it would make up for a quote out of place: between a quoted field's end and
    further text, or between bare text and a quote. `ahead` is the kind of each record's next token.
    """
    after_bare = np.where(ahead == _MARK, _FAR, 1)[:, None]
    after_quote = np.where((ahead == _COMMA) | (ahead == _END), 1, _FAR)[:, None]
    step = np.arange(cost.shape[2])
    while True:
        before = cost.copy()
        np.minimum(cost[:, _QUOTED], cost[:, _START] + _DEAR, out=cost[:, _QUOTED])
        np.minimum(cost[:, _QUOTE], cost[:, _QUOTED] + _DEAR, out=cost[:, _QUOTE])
        np.minimum(cost[:, _QUOTED], cost[:, _QUOTE] + _DEAR, out=cost[:, _QUOTED])
        np.minimum(cost[:, _START, 1:], cost[:, _BARE, :-1] + after_bare, out=cost[:, _START, 1:])
        np.minimum(cost[:, _START, 1:], cost[:, _QUOTE, :-1] + after_quote, out=cost[:, _START, 1:])
        cost[:, _START] = np.minimum.accumulate(cost[:, _START] - step, axis=1) + step
        if (before == cost).all():
            return cost


def _read(cost: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Costs after each record's next token, read as it is, or deleted if it is a quote or delimiter.

    A deleted delimiter joins two fields, each of which keeps its own quotes.
    """
    kind = kind[:, None]
    new = cost + np.select([kind == _MARK, kind == _END], [_DEAR, 0], _FAR)[:, None]
    quote = np.minimum(cost[:, _START], cost[:, _QUOTE])
    np.minimum(new[:, _QUOTED], np.where(kind == _MARK, quote, cost[:, _QUOTED]), out=new[:, _QUOTED])
    np.minimum(new[:, _QUOTE], np.where(kind == _MARK, cost[:, _QUOTED], _FAR), out=new[:, _QUOTE])
    bare = np.minimum(cost[:, _START], cost[:, _BARE])
    np.minimum(new[:, _BARE], np.where(kind == _TEXT, bare, _FAR), out=new[:, _BARE])
    ended = np.where(kind == _COMMA, np.minimum(bare, cost[:, _QUOTE]), _FAR)
    np.minimum(new[:, _START, 1:], ended[:, :-1], out=new[:, _START, 1:])
    np.minimum(new[:, _START], ended + 1, out=new[:, _START])
    return new


class _Path:
    """The way back through a record's costs, with the edits on it."""

    def __init__(self, tokens: list[str], last: np.ndarray) -> None:
        self.tokens, self.at, self.count = tokens, len(tokens), last.shape[1] - 1
        self.places = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).tolist()
        self.state = min((_START, _BARE, _QUOTE), key=lambda s: last[s, self.count])
        self.edits: list[str] = []
        self.fields: list[list[str]] = [[]]

    def back(self, costs: list[np.ndarray], begin: int) -> None:
        """Down to the token `begin`; costs[i] are those before token begin + i."""
        while self.at > begin or begin == 0 and (self.state, self.count) != (_START, 0):
            here, state, count = costs[self.at - begin], self.state, self.count
            now = here[state, count]
            if state == _QUOTED:
                put = next(((s, count, '"') for s in (_START, _QUOTE) if here[s, count] + _DEAR == now), None)
            elif state == _QUOTE:
                put = (_QUOTED, count, '"') if here[_QUOTED, count] + _DEAR == now else None
            elif state == _START and count:
                ahead = _KIND.get(self.tokens[self.at], _TEXT) if self.at < len(self.tokens) else _END
                ways = [s for s, ok in ((_BARE, ahead != _MARK), (_QUOTE, ahead in (_COMMA, _END)), (_START, True)) if ok]
                put = next(((s, count - 1, ",") for s in ways if here[s, count - 1] + 1 == now), None)
            else:
                put = None
            if put:
                self.edits.append(f"insert {'quote' if put[2] == '"' else 'delimiter'}@{self.places[self.at]}")
                self._take(put[2], put[0])
                self.state, self.count = put[:2]
                continue
            self.at -= 1
            token, before = self.tokens[self.at], costs[self.at - begin]
            outside = [s for s in (_START, _BARE, _QUOTE) if state == _START]
            if token == '"':
                ways = [(s, count, 0) for s in {_QUOTED: (_START, _QUOTE), _QUOTE: (_QUOTED,)}.get(state, ())] + [(state, count, _DEAR)]
            elif token == ",":
                ways = [(_QUOTED, count, 0)] if state == _QUOTED else [(s, count - 1, 0) for s in outside if count] + [(s, count, 1) for s in outside]
            else:
                ways = [(s, count, 0) for s in {_BARE: (_START, _BARE), _QUOTED: (_QUOTED,)}.get(state, ())]
            came, left, price = next(x for x in ways if before[x[:2]] + x[2] == now)
            if price:
                self.edits.append(f"delete {'quote' if token == '"' else 'delimiter'}@{self.places[self.at]}")
            else:
                self._take(token, came)
            self.state, self.count = came, left

    def _take(self, token: str, came: int) -> None:
        """Puts what was read from the state `came` before what is known of the fields."""
        if token == "," and self.state == _START:
            self.fields.append([])
        elif token != '"' or self.state == _QUOTED and came == _QUOTE:
            self.fields[-1].append(token)

    def found(self) -> tuple[list[str], list[str]]:
        return self.edits[::-1], ["".join(reversed(f)) for f in reversed(self.fields)]


def repairs(records: list[str], width: int) -> list[tuple[list[str], list[str]]]:
    """The edits of a cheapest parse of each record as `width` fields, and the fields it then has.

    Edits are "insert quote@12" and the like, with the character position. A parse has as few edits of
    quotes as can be, and of those with so few it has the fewest of delimiters; so edits of quotes mean that the
    quoting is broken, and no edit but those of delimiters that only the number of fields is wrong. Which of
    equally cheap parses is taken is fixed by the order of the automaton's states. Costs are kept at every
    square root of a record's tokens and made again in between on the way back.
    """
    if len(records) > GROUP:
        order = sorted(range(len(records)), key=lambda i: records[i].count('"') + records[i].count(","))
        out: list = [None] * len(records)
        for at in range(0, len(order), GROUP):
            part = order[at : at + GROUP]
            for i, found in zip(part, repairs([records[i] for i in part], width), strict=True):
                out[i] = found
        return out
    tokens = [_TOKENS.findall(r) for r in records]
    size = max(map(len, tokens), default=0)
    if len(records) > 1 and size > 1 << 14:  # long ones by themselves
        return [x for r in records for x in repairs([r], width)]
    kinds = np.full((len(records), size + 1), _END, np.int8)
    for i, found in enumerate(tokens):
        kinds[i, : len(found)] = [_KIND.get(t, _TEXT) for t in found]
    every = max(1, int(size**0.5))
    cost = np.full((len(records), 4, width), _FAR, np.int64)
    cost[:, _START, 0] = 0
    cost, saved = _closed(cost, kinds[:, 0]), {}
    for t in range(size):
        if t % every == 0:
            saved[t] = cost
        cost = _closed(_read(cost, kinds[:, t]), kinds[:, t + 1])
    paths = [_Path(t, cost[i]) for i, t in enumerate(tokens)]
    for begin in reversed(range(0, max(size, 1), every)):
        costs = [saved.get(begin, cost)]
        for t in range(begin, min(begin + every, size)):
            costs.append(_closed(_read(costs[-1], kinds[:, t]), kinds[:, t + 1]))
        for i, path in enumerate(paths):
            if path.at > begin or begin == 0:
                path.back([c[i] for c in costs], begin)
    return [p.found() for p in paths]


def repair(record: str, width: int) -> tuple[list[str], list[str]]:
    """repairs() of one record."""
    return repairs([record], width)[0]


def judged(records: list[str | None], names: list[str], checks: dict = CHECKS) -> list[tuple[list[str] | None, list[str], list[str]]]:
    """(fields, reasons, edits) of each record; no fields and no reasons for records of blank fields only.

    Records with the right number of well-formed fields have a parse without edits and need no program.
    The edits of the cheapest parse are the reasons of all others.
    """
    out: list = []
    broken: dict[int, str] = {}
    for i, record in enumerate(records):
        record = (record or "").removesuffix("\r")
        fields = fields_of(record)
        if fields is not None and not any(x.strip() for x in fields):
            out.append((None, [], []))
        elif fields is None or len(fields) != len(names):
            broken[i] = record
            out.append(None)
        else:
            out.append((fields, [name for name, wrong in checks.items() if wrong(fields[names.index(name)].strip())], []))
    for i, (edits, fields) in zip(broken, repairs(list(broken.values()), len(names)), strict=True):
        out[i] = (fields, ["quoting" if any(" quote@" in e for e in edits) else "column_count"], edits)
    return out


def judge(record: str | None, names: list[str], checks: dict = CHECKS) -> tuple[list[str] | None, list[str], list[str]]:
    """judged() of one record."""
    return judged([record], names, checks)[0]


def parse_records(df: DataFrame, key: str, record: str, columns: dict[str, str] = TICKET_COLUMNS) -> DataFrame:
    """(`key`, fields array<string>, reasons array<string>, edits array<string>) of each record of `df`.

    Header rows are to be left out before. reasons is empty for valid records; fields is null for records
    that are null, empty or have blank fields only, which are neither valid nor wrong. Of broken records,
    fields are those of the cheapest repair. A carriage return at the end is not part of a record; a byte
    order mark is, as only headers may have one. Records of any length are read whole; repeated rows come out repeated, null keys as null.
    """
    names = list(columns)
    narrow = spread(df.select(df[key].alias("k"), df[record].alias("r")))
    schema = T.StructType([narrow.schema["k"], *(T.StructField(x, T.ArrayType(T.StringType())) for x in ("fields", "reasons", "edits"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        for batch in batches:
            found = judged(batch.column(1).to_pylist(), names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], kind) for i in range(3))], ["k", "fields", "reasons", "edits"])

    return narrow.mapInArrow(run, schema).withColumnRenamed("k", key)


def _typed(value: Column, kind: str) -> Column:
    value = casts.strip(value)
    if kind == "string":
        return F.when(value != "", value)
    if kind == "date":
        return casts.to_date(value)
    if kind == "timestamp":
        return casts.to_timestamp(value)
    if kind == "boolean":
        return casts.to_boolean(value)
    return casts.to_number(value, kind)


def typed_rows(parsed: DataFrame, key: str, columns: dict[str, str] = TICKET_COLUMNS) -> DataFrame:
    """`key` and the typed columns of the valid records; unchecked columns that do not convert are null."""
    valid = parsed.filter(F.col("fields").isNotNull() & (F.size("reasons") == 0))
    return valid.select(key, *[_typed(F.get("fields", F.lit(i)), kind).alias(name) for i, (name, kind) in enumerate(columns.items())])


def rejected(parsed: DataFrame, key: str) -> DataFrame:
    """(`key`, reason) of the invalid records, once for each reason."""
    return parsed.select(key, F.explode("reasons").alias("reason")).distinct()
