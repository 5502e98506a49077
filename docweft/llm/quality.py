"""Per-document statistics of text quality, and what kind of text it is.

The texts of a batch are one array of code points. Tables of character classes and sums over segments give, without a
loop over texts, lines or words, the counts of each line: characters by class, words, common words, separators
of cells, bullets, sentence endings. Rules with fixed thresholds on these say what a line is (a sentence, an entry,
a row of cells, nothing readable); its sums by text are held against the thresholds of RULES, and each rule that
fails is a recorded reason. The kind of a text is the kind that its failed rules name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.session import spread

#: Fixed thresholds as published for web text: words, mean word length, symbols to words, bullet lines, common words
#: (two of them), lines with a full stop, repeated lines. They are recorded, and make no kind.
PUBLISHED = {"few_words": 50, "many_words": 100_000, "short_words": 3.0, "long_words": 10.0, "symbol_ratio": 0.10, "bullet_lines": 0.90, "common_words": 2, "no_punctuation": 0.10, "repeated_lines": 0.30}
#: Fixed thresholds on the share of non-blank characters, with the kind of text that each of them makes, in order.
RULES = {"unreadable": (0.5, "junk"), "one_line_repeated": (0.5, "junk"), "few_distinct_words": (0.05, "junk"), "rows_of_cells": (0.5, "table"), "short_entries": (0.5, "list")}
MIN_CHARS, MIN_ENTRIES = 40, 3
MAX_COMMON_WORDS = 100_000
#: Characters that are looked at together; a longer line is looked at whole.
BLOCK = 1 << 19

# ---- Fixed values: Korean endings of sentences and of words inside them, bullets, what encodings and garbling leave ----
ENDINGS = "니다 세요 시오 어요 아요 해요 까요 네요 군요 지요 는다 했다 였다 었다 았다 한다 된다 이다 있다 없다 같다".split()
PARTICLES = "을 를 은 는".split()
LONG_PARTICLES = "에서 에게 으로 하고 하여 하면 하는 하지 도록 려면 면서 이며 지만 까지 부터 에는 에도".split()
BULLETS = "-*+•‣▪▫◦○●■□▶➤·–—※☐☑✓✔"
SENTENCE_ENDS, CLOSERS = ".!?。！？…:;", "\"'”’)]"
GARBLED = [(0xFFFD, 0xFFFD), (0x25A0, 0x25A1), (0x3F, 0x3F), (0x80, 0x9F), (0xA1, 0xB6), (0xB8, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x400, 0x4FF), (0x2018, 0x201E), (0x2020, 0x2026), (0x2030, 0x2030), (0x2039, 0x203A), (0x20AC, 0x20AC), (0x2122, 0x2122)]
BREAKS = "\n\v\f\r\x1c\x1d\x1e\x85  "
# ------------------------------------------------------------------------------------------------------------------------

_BLANK, _WORD, _READ, _LOWER, _CONSONANT, _DIGIT, _HANGUL, _STROKE, _GARBLED, _HEX, _CODE, _A_TO_F, _BREAK, _END, _CLOSER, _BULLET, _BOX, _CIRCLED = (np.uint32(1 << i) for i in range(18))
PROSE, LIST, TABLE, JUNK, OPEN = range(5)
_MIX, _POWER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and lower-case form of each code point."""
    bits, lower = np.zeros(0x110000, np.uint32), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        group = unicodedata.category(x)
        if x.isspace():
            bits[c] |= _BLANK
        elif group[0] in "LNM" or group == "Cf":
            bits[c] |= _WORD
            if len(low := x.lower()) == 1:
                lower[c] = ord(low)
    for low, high, flag in [(0x30, 0x39, _READ | _DIGIT | _HEX | _CODE), (0x41, 0x5A, _READ | _CODE), (0x61, 0x7A, _READ | _CODE | _LOWER), (0xAC00, 0xD7A3, _READ | _HANGUL), (0xFF10, 0xFF19, _READ), (0xFF21, 0xFF3A, _READ), (0xFF41, 0xFF5A, _READ), (0x3131, 0x318E, _STROKE), (0x1100, 0x11FF, _READ | _HANGUL), (0x41, 0x46, _HEX | _A_TO_F), (0x61, 0x66, _HEX | _A_TO_F), (0x2500, 0x257F, _BOX), (0x2460, 0x24FF, _CIRCLED), (0x3260, 0x327F, _CIRCLED)]:
        bits[low : high + 1] |= flag
    for low, high in GARBLED:
        bits[low : high + 1] |= _GARBLED
    for chars, flag in [(BREAKS, _BREAK), (SENTENCE_ENDS, _END), (CLOSERS, _CLOSER), (BULLETS, _BULLET), ("+/=_-", _CODE), ("bcdfghjklmnpqrstvwxz", _CONSONANT)]:
        bits[[ord(x) for x in chars]] |= flag
    return bits, lower


def _pairs(words: list[str]) -> np.ndarray:
    return np.array([ord(w[0]) << 21 | ord(w[1]) for w in words], np.uint64)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of true values, and their lengths."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n + 1, _POWER))


def _hashes(words: list[str], most: int) -> np.ndarray:
    power = _powers(most)
    out = [sum((ord(c) + 1) * int(p) for c, p in zip(w, power, strict=False)) & (1 << 64) - 1 for w in words if len(w) <= most]
    return np.array(sorted(out), np.uint64)


def _isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the ordered `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def line_statistics(parts: list[str], owners: list[int], common: np.ndarray, longest: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Arrays of the counts of each line of `parts`, which end in a line break each, and (owner, word hash) of each word."""
    bits, lower = _classes()
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size, flags = len(codes), bits[codes]
    after = np.append(codes[1:], np.uint32(10))
    # A carriage return before a line feed is a blank.
    ends = np.flatnonzero((flags & _BREAK != 0) & ~((codes == 13) & (after == 10)))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n_lines = len(ends)
    line_of = np.repeat(np.arange(n_lines, dtype=np.int32), ends - starts + 1)
    part_of = np.searchsorted(np.cumsum([len(p) for p in parts]), starts, side="right")
    out = {"owner": np.asarray(owners, np.int64)[part_of], "chars": ends - starts}

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int32), starts)

    def at(places: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(line_of[places], weights, n_lines).astype(np.int64)

    solid, word = flags & _BLANK == 0, flags & _WORD != 0
    out["blank"] = total(~solid)
    out["n"] = total(solid)
    out["symbols"] = total(solid & ~word)
    for name, flag in (("readable", _READ), ("strokes", _STROKE), ("garbled", _GARBLED), ("letters", _LOWER)):
        out[name] = total(flags & flag != 0)
    first, lengths = _runs(solid)
    last = first + lengths - 1
    out["words"] = at(first)
    # Words: a hash of each, whether it is common without what stands around it, and hexadecimal ones.
    power = _powers(int(lengths.max(initial=1)))
    place = np.arange(size) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [size]])))
    spelled = np.where(solid, (codes.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)], np.uint64(0))
    hashed = np.add.reduceat(spelled, first) if len(first) else np.zeros(0, np.uint64)
    word_line = line_of[first]
    order = np.arange(len(first)) - np.searchsorted(word_line, np.arange(n_lines))[word_line] if len(first) else first
    line_power = _powers(int(out["words"].max(initial=1)))
    mixed = (hashed ^ hashed >> np.uint64(29)) * _MIX * line_power[order]
    out["hash"] = np.zeros(n_lines, np.uint64)
    np.add.at(out["hash"], word_line, mixed)
    inside = np.flatnonzero(word)
    if len(inside) and len(first):
        begin = inside[np.minimum(np.searchsorted(inside, first), len(inside) - 1)]
        end = inside[np.maximum(np.searchsorted(inside, last, side="right") - 1, 0)]
        core = np.where((begin <= last) & (end >= begin), end - begin + 1, 0)
        short = np.flatnonzero((core > 0) & (core <= longest))
        spelled_core = np.zeros(len(short), np.uint64)
        for j, p in enumerate(_powers(longest)[:longest]):
            there = core[short] > j
            spelled_core[there] += (lower[codes[begin[short[there]] + j]].astype(np.uint64) + np.uint64(1)) * p
        out["common"] = at(first[short[_isin(spelled_core, common)]])
    else:
        out["common"] = np.zeros(n_lines, np.int64)
    hex_sum, af_sum = (np.concatenate([[0], np.cumsum(flags & f != 0, dtype=np.int32)]) for f in (_HEX, _A_TO_F))
    hexed = (hex_sum[last + 1] - hex_sum[first] == lengths) & (lengths >= 2)
    out["hex"], out["hex_letters"] = at(first[hexed], lengths[hexed]), at(first[hexed], (af_sum[last + 1] - af_sum[first])[hexed])
    # Runs that no written language has: five consonants, 28 characters of an encoding, escapes.
    for name, flag, least in (("clusters", _CONSONANT, 5), ("encoded", _CODE, 28)):
        begin, length = _runs(flags & flag != 0)
        begin, length = begin[length >= least], length[length >= least]
        out[name] = at(begin, length)
    escaped = np.flatnonzero((codes == 37) & (bits[after] & _HEX != 0))
    slashed = np.flatnonzero((codes == 92) & ((after == 120) | (after == 117)))
    entity = np.flatnonzero((codes == 38) & (after == 35))
    out["escaped"] = 3 * at(escaped) + 5 * at(slashed) + 6 * at(entity)
    # Sentences: endings and particles at the end of Hangul words.
    tails = np.flatnonzero((flags & _HANGUL != 0) & (bits[after] & _HANGUL == 0))
    tails = tails[tails > 0]
    pair = codes[tails - 1].astype(np.uint64) << np.uint64(21) | codes[tails]
    stop = np.sort(_pairs(ENDINGS))
    out["endings"] = at(tails[_isin(pair, stop)])
    single = np.isin(codes[tails], [ord(x) for x in PARTICLES]) & (flags[tails - 1] & _HANGUL != 0)
    out["particles"] = at(tails[single | _isin(pair, np.sort(_pairs(LONG_PARTICLES)))])
    # The last non-blank character that is no closing mark.
    bare = np.flatnonzero(solid & (flags & _CLOSER == 0))
    where = np.searchsorted(bare, ends) - 1
    closing = bare[np.maximum(where, 0)] if len(bare) else np.zeros(n_lines, np.int64)
    out["punctuated"] = (where >= 0) & (closing >= starts) & (flags[closing] & _END != 0) if size else np.zeros(0, bool)
    # Cells: pipes, tabs, semicolons, commas without a blank, gaps of blanks, box lines, tags of tables.
    out["pipes"], out["tabs"], out["semicolons"] = (total(codes == c) for c in (0x7C, 9, 0x3B))
    out["commas"] = total((codes == 0x2C) & ((bits[after] & _BLANK == 0) | (bits[after] & _BREAK != 0)))
    gap, length = _runs((codes == 0x20) | (codes == 0x3000))
    gap_end = np.minimum(gap + length, size - 1)
    between = (gap > starts[line_of[gap]]) & (flags[gap_end] & _BLANK == 0)
    out["gaps"] = at(gap[between & (length >= 2)])
    out["wide"] = at(gap[between & ((length >= 3) | (codes[gap] == 0x3000))]) > 0
    out["listed"] = total(np.isin(codes, [ord(x) for x in ",;/·|、"]) & (bits[after] & _BLANK != 0) & (bits[after] & _BREAK == 0))
    out["box"] = total(flags & _BOX != 0)
    open_ = np.flatnonzero(codes[:-2] == 0x3C) if size > 2 else np.zeros(0, np.int64)
    name = np.where(codes[open_ + 1] == 0x2F, open_ + 2, open_ + 1)
    second = lower[codes[np.minimum(name + 1, size - 1)]]
    out["tags"] = at(open_[(lower[codes[np.minimum(name, size - 1)]] == 0x74) & np.isin(second, [ord(x) for x in "rdhab"])])
    out["rules"] = total(np.isin(codes, [ord(x) for x in "-:="]))
    # Bullets: a first word that is one mark, a circled number, a box to tick, or a short number or letter with a mark.
    out["bullet"] = np.zeros(n_lines, bool)
    if len(first):
        leads = np.concatenate([[True], word_line[1:] != word_line[:-1]])
        lead, length, line, alone = first[leads], lengths[leads], word_line[leads], out["words"][word_line[leads]] == 1
        digits = np.concatenate([[0], np.cumsum(flags & _DIGIT != 0, dtype=np.int32)])
        tail = lead + length - 1
        opened = (codes[lead] == 0x28).astype(np.int64)
        marked = np.isin(codes[tail], [ord(x) for x in ".)]"])
        body = length - opened - 1
        numbered = marked & (body > 0) & (body <= 4) & (digits[tail] - digits[lead + opened] == body)
        lettered = marked & (body == 1) & (flags[tail - 1] & _WORD != 0)
        tick = (codes[lead] == 0x5B) & ((length == 1) | (length == 3) & (codes[np.minimum(lead + 2, size - 1)] == 0x5D) | (length == 2))
        one = (length == 1) & ((flags[lead] & _BULLET != 0) | (codes[lead] == 0x6F))
        out["bullet"][line] = ~alone & (one | numbered | lettered | tick) | (flags[lead] & _CIRCLED != 0)
    return out, np.stack([out["owner"][word_line].astype(np.uint64), hashed])


def _of_groups(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of keys, how often it occurs and the sum of its weights."""
    _, group = np.unique(keys, return_inverse=True)
    return np.bincount(group)[group], np.bincount(group, weights)[group]


def line_kinds(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each line is (OPEN for blank ones), how many entries it holds, and whether the text mostly repeats it."""
    n, owner = s["n"], s["owner"]
    there = n > 0
    size = np.bincount(owner, s["chars"] + 1)[owner]
    often, chars = _of_groups(s["hash"] ^ owner.astype(np.uint64) * _MIX, s["chars"] + 1)
    repeated = there & (often >= 5) & (2 * chars > size)
    tabular = (s["pipes"] >= 2) | (s["box"] > 0)
    plain = np.where(tabular, n - s["pipes"] - s["box"] - s["rules"], n)
    illegible = (plain > 2) & (2 * s["readable"] < plain) & (s["tags"] < 2) | (2 * s["strokes"] > n)
    coded = (2 * s["encoded"] > n) | (2 * s["escaped"] > n) | (4 * s["garbled"] > n)
    dumped = (n >= 24) & (2 * s["hex"] > n) & (10 * s["hex_letters"] > s["hex"])
    mashed = (s["letters"] >= 16) & (2 * s["letters"] > n) & (4 * s["clusters"] > s["letters"])
    junk = illegible | (n >= 12) & (coded | dumped | mashed)
    korean = (s["endings"] >= 1) | (s["particles"] >= 2)
    english = (s["words"] >= 5) & (s["common"] >= 1) & (s["pipes"] + s["tabs"] == 0)
    trailing = (s["semicolons"] == 1) & ~korean & s["punctuated"] | (s["commas"] == 1)
    marks = np.where(trailing & (s["semicolons"] <= 1) & (s["commas"] <= 1), 0, np.maximum(s["semicolons"], s["commas"]))
    cells = np.maximum.reduce([s["pipes"], s["tabs"], marks, np.where(s["wide"], s["gaps"], 0)])
    row = tabular | (s["tags"] > 0) | (s["tabs"] >= 2) | (cells >= 2)
    kind = np.full(len(n), OPEN)
    kind[there & junk & ~english] = JUNK
    kind[there & english & ~korean & ~dumped] = PROSE
    kind[there & korean & ((n < 30) | ~junk)] = PROSE
    kind[(kind == PROSE) & korean & ((s["pipes"] >= 3) | (s["tags"] > 0) | (s["tabs"] >= 2) | (s["box"] > 0))] = TABLE
    kind[repeated] = JUNK
    # Paragraphs: lines without a blank one between them.
    paragraph = np.cumsum(np.concatenate([[True], (owner[1:] != owner[:-1]) | ~there[1:] | ~there[:-1]])) - 1 if len(n) else n
    open_, free = there & (kind == OPEN), there & ~s["bullet"] & ((kind == OPEN) | (kind == PROSE))

    def within(mask: np.ndarray) -> np.ndarray:
        return np.bincount(paragraph, mask)[paragraph] if len(n) else n

    flowing = (within(free) > 1) & (10 * within(free & (kind == PROSE)) >= 3 * within(free))
    single = open_ & (cells == 1)
    alike = within(single)
    rows = open_ & (row | single & (alike >= 3) & (2 * alike > within(there)))
    flow = open_ & ~rows & flowing & ~s["bullet"]
    parts = s["listed"] + 1
    entries = open_ & ~rows & ~flow & ((n <= 70) | (parts >= 4) & (n <= 40 * parts))
    kind[rows], kind[flow], kind[entries] = TABLE, PROSE, LIST
    kind[open_ & ~rows & ~flow & ~entries] = PROSE
    return kind, np.where(entries, np.where(n <= 70, 1, parts), 0), repeated


SCHEMA = "n_chars bigint, n_lines bigint, n_words bigint, mean_word_length double, symbol_ratio double, punctuation_line_share double, bullet_line_share double, common_word_share double, repeated_line_share double, prose_share double, list_share double, table_share double, junk_share double, kind string, reasons array<string>"


def _parts(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Lines of texts, each part ending in a line break, about BLOCK characters together."""
    parts, owners, size = [], [], 0
    for i, text in enumerate(texts):
        text += "\n"
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= BLOCK else text.find("\n", at + BLOCK) + 1
            parts.append(text[at:end])
            owners.append(i)
            size += end - at
            at = end
            if size >= BLOCK:
                yield parts, owners
                parts, owners, size = [], [], 0
    if parts:
        yield parts, owners


def _statistics(texts: list[str | None], common: frozenset[str]) -> dict[str, np.ndarray | list]:
    """Columns of SCHEMA for each of the texts."""
    given = [unicodedata.normalize("NFC", t) if t and not t.isascii() else t or "" for t in texts]
    longest = max(map(len, common), default=0)
    known = _hashes(sorted(common), longest)
    found = [line_statistics(parts, owners, known, longest) for parts, owners in _parts(given)]
    s = {k: np.concatenate([x[k] for x, _ in found]) for k in found[0][0]} if found else {}
    m = len(given)
    if not m:
        return {}
    kind, entries, repeated = line_kinds(s)
    owner, there = s["owner"], s["n"] > 0

    def sums(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, m)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.divide(part, whole, out=np.zeros(m), where=whole > 0)

    solid, words, lines = sums(s["n"]), sums(s["words"]), sums(there)
    seen = np.concatenate([w for _, w in found], axis=1)
    distinct = _distinct(seen, m)
    lone = _distinct(np.stack([owner[there].astype(np.uint64), s["hash"][there]]), m)
    by_kind = [share(sums(s["n"] * (there & (kind == k))), solid) for k in (PROSE, LIST, TABLE, JUNK)]
    hits = sums(s["common"])
    sizes = np.array([len(t or "") for t in texts])
    out = {
        "n_chars": sizes, "n_lines": lines.astype(np.int64), "n_words": words.astype(np.int64), "mean_word_length": share(solid, words), "symbol_ratio": share(sums(s["symbols"]), solid),
        "punctuation_line_share": share(sums(s["punctuated"] & there), lines), "bullet_line_share": share(sums(s["bullet"] & there), lines), "common_word_share": share(hits, words), "repeated_line_share": share(lines - lone, lines),
        "prose_share": by_kind[0], "list_share": by_kind[1], "table_share": by_kind[2], "junk_share": by_kind[3],
    }
    p = PUBLISHED
    failed = {
        "few_words": words < p["few_words"], "many_words": words > p["many_words"], "short_words": (words > 0) & (out["mean_word_length"] < p["short_words"]), "long_words": out["mean_word_length"] > p["long_words"], "symbol_ratio": out["symbol_ratio"] > p["symbol_ratio"],
        "bullet_lines": out["bullet_line_share"] > p["bullet_lines"], "common_words": hits < p["common_words"], "no_punctuation": out["punctuation_line_share"] < p["no_punctuation"], "repeated_lines": out["repeated_line_share"] > p["repeated_lines"],
    }
    judged = (sizes >= MIN_CHARS) & (solid > 0)
    alone = share(sums(s["n"] * repeated), solid)
    kinds = {
        "unreadable": judged & (by_kind[3] > RULES["unreadable"][0]),
        "one_line_repeated": judged & (alone > RULES["one_line_repeated"][0]),
        "few_distinct_words": judged & (words >= 20) & (distinct <= RULES["few_distinct_words"][0] * words) & (distinct <= 8),
        "rows_of_cells": judged & (by_kind[2] > RULES["rows_of_cells"][0]),
        "short_entries": judged & (by_kind[1] > RULES["short_entries"][0]) & (sums(entries) >= MIN_ENTRIES),
    }
    named = [name for name in failed if failed[name].any()] + [name for name in kinds if kinds[name].any()]
    both = failed | kinds
    out["kind"] = np.where(solid == 0, np.where(sizes < MIN_CHARS, "short", "blank"), np.where(sizes < MIN_CHARS, "short", "prose")).astype(object)
    for name in reversed(kinds):
        out["kind"][kinds[name]] = RULES[name][1]
    reasons = [[] for _ in range(m)]
    for name in named:
        for i in np.flatnonzero(both[name]):
            reasons[i].append(name)
    out["reasons"] = reasons
    return out


def _distinct(seen: np.ndarray, m: int) -> np.ndarray:
    """How many different (owner, hash) there are by owner."""
    keys = (seen[1] ^ seen[1] >> np.uint64(31)) * _POWER ^ seen[0] * _MIX
    _, places = np.unique(keys, return_index=True)
    return np.bincount(seen[0][places].astype(np.int64), minlength=m)


def text_quality(df: DataFrame, key: str, text: str, common_words: DataFrame | list[str]) -> DataFrame:
    """`key` and the statistics of SCHEMA for each row of `df`.

    Words are what blanks separate; mean_word_length is in characters; symbol_ratio is the share of non-blank
    characters that are no letters, digits, marks or format characters; line shares are of non-blank lines; texts are
    in their composed form (NFC), but for n_chars; words are common without what stands around them and in any case. kind is list, table or junk as the failed rules of
    RULES say, the first of them in that order, else prose; short under 40 characters, blank if all are blanks.
    reasons names each failed rule, also the published ones, which make no kind. Null texts are as empty: zeros,
    kind short, reasons few_words and those of a missing share. Repeated rows and null keys come out as they are;
    other columns are ignored; texts are read whole, in memory that grows with the longest line.
    `common_words` is a list or a table with a column word of at most 100,000 rows (more is an error).
    """
    if isinstance(common_words, DataFrame):
        found = common_words.select("word").filter("word is not null").distinct().limit(MAX_COMMON_WORDS + 1).collect()
        if len(found) > MAX_COMMON_WORDS:
            raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
        common_words = [r.word for r in found]
    shared = df.sparkSession.sparkContext.broadcast(frozenset(w.lower() for w in common_words))
    narrow = spread(df.select(df[key].alias("k"), df[text].alias("t")))
    schema = T.StructType([narrow.schema["k"], *T.StructType.fromDDL(SCHEMA).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        kinds = [pa.int64()] * 3 + [pa.float64()] * 10 + [pa.string(), pa.list_(pa.string())]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                columns = _statistics(part.column(1).to_pylist(), common)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(columns[n], k) for n, k in zip(names[1:], kinds, strict=True))], names)

    return narrow.mapInArrow(run, schema).withColumnRenamed("k", key)


def unfit(quality: DataFrame, key: str) -> DataFrame:
    """(`key`, kind) of the texts that are lists, tables or junk."""
    return quality.filter(F.col("kind").isin("list", "table", "junk")).select(key, "kind").distinct()
