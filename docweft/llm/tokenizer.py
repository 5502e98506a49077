"""Byte-level BPE encoding of a corpus with a lazily determinised finite-state transducer.

Each pre-token (a match of the tokenizer's split pattern) is read byte by byte. A state of the
transducer is the tree of token boundaries that are still possible, each with the vocabulary-trie
node of the bytes read since and the last token before it; its root is the latest boundary that all
continuations share, so what lies before the root has been emitted. For byte-pair vocabularies a
sequence is the encoding of its bytes exactly when every two neighbouring tokens encode to themselves
when joined, so each prefix has one possible last token and a step needs only pair checks. States and
transitions are made when text first needs them and dropped together when there are too many, which is looked
at before each new one: the tree in hand is carried over. Work is linear in the bytes and states are bounded, also
for unbroken strings of any length.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweft.session import spread

#: Fixed value: the split pattern that byte_bpe_50k is defined with.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MAX_STATES = 60_000
MAX_MEMO = 150_000
MEMO_LONGEST = 48


def default_vocabulary() -> str:
    """Path of byte_bpe_50k in the installed set of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to id from the content of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


#: Longer texts are read in segments. No pre-token reaches over a blank that follows a character that is
#: none, so a cut there changes nothing.
LONG_TEXT = 1 << 20
_CUT = regex.compile(r"\S(?=\s)")


def _segments(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + LONG_TEXT - 1)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


class Transducer:
    """Encodes and decodes with the vocabulary `ranks` (token bytes to id, ids in order of merging)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT_PATTERN, max_states: int = MAX_STATES, max_memo: int = MAX_MEMO) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.max_states, self.max_memo = max_states, max_memo
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for token, i in ranks.items():
            node = 0
            for b in token:
                below = children[node].get(b)
                if below is None:
                    below = children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = below
            ends[node] = i
        self.children, self.ends = children, ends
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}  # pre-token to its ids as 32-bit integers
        self._forget()

    def _forget(self) -> None:
        start = ((0, -1, -1),)
        self.states: list[tuple] = [start]
        self.number = {start: 0}
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.finals: dict[int, tuple[int, ...]] = {}

    def _merged(self, data: bytes) -> list[int]:
        """Plain merging, for the few bytes of a pair."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left` (-1: the start of a pre-token)."""
        found = self.pairs.get((left, right))
        if found is None:
            own = self.tokens[right]
            if left < 0:
                found = self._merged(own) == [right]
            else:
                joined = self.tokens[left] + own
                whole = self.ranks.get(joined, -1)
                # What is one token when joined doesn't stay two; the rest is merged to see.
                found = not (whole >= 0 and self._fits(-1, whole)) and self._merged(joined) == [left, right]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[left, right] = found
        return found

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state's boundary tree and the tokens that became certain."""
        tree = self.states[state]
        grown: list[tuple[int, int, int]] = []
        token, parent = -1, -1
        for k, (node, last, up) in enumerate(tree):
            below = self.children[node].get(byte, -1) if node >= 0 else -1
            if below >= 0 and token < 0 and (t := self.ends[below]) >= 0 and self._fits(last, t):
                token, parent = t, k
            grown.append((below if below >= 0 and self.children[below] else -1, last, up))
        if token < 0:
            raise ValueError("the vocabulary lacks a single byte")
        grown.append((0, token, parent))
        # Boundaries from which no token can continue stay only as ancestors of others.
        kept = [node >= 0 for node, _, _ in grown]
        for k in range(len(grown) - 1, 0, -1):
            if kept[k]:
                kept[grown[k][2]] = True
        # The root moves up while all that is left goes through its only child.
        root, out = 0, []
        while grown[root][0] < 0:
            below = [k for k in range(root + 1, len(grown)) if kept[k] and grown[k][2] == root]
            if len(below) != 1:
                break
            root = below[0]
            out.append(grown[root][1])
        place: dict[int, int] = {}
        rest = []
        for k in range(root, len(grown)):
            node, last, up = grown[k]
            if kept[k] and (k == root or up in place):
                place[k] = len(rest)
                rest.append((node, last, -1 if k == root else place[up]))
        if len(self.states) >= self.max_states:
            self._forget()
            return self._place(tuple(rest)), tuple(out)
        found = self.steps[state][byte] = (self._place(tuple(rest)), tuple(out))
        return found

    def _place(self, tree: tuple) -> int:
        """The number of the state with this tree, made if there is none."""
        number = self.number.get(tree)
        if number is None:
            number = self.number[tree] = len(self.states)
            self.states.append(tree)
            self.steps.append({})
        return number

    def _final(self, state: int) -> tuple[int, ...]:
        """Tokens still to be emitted at the end: the way from the root to the last boundary."""
        tree = self.states[state]
        out, k = [], len(tree) - 1
        while k > 0:
            out.append(tree[k][1])
            k = tree[k][2]
        found = self.finals[state] = tuple(reversed(out))
        return found

    def piece(self, text: str) -> bytes:
        """Ids of one pre-token, as 32-bit integers."""
        steps, state, out = self.steps, 0, array("i")
        for byte in text.encode("utf-8"):
            found = steps[state].get(byte)
            if found is None:
                found = self._step(state, byte)
                steps = self.steps  # another list, if states were dropped
            state, certain = found
            if certain:
                out.extend(certain)
        rest = self.finals.get(state)
        out.extend(self._final(state) if rest is None else rest)
        ids = out.tobytes()
        if len(text) <= MEMO_LONGEST:
            if len(self.memo) >= self.max_memo:
                self.memo.clear()
            self.memo[text] = ids
        return ids

    def encoded(self, text: str) -> bytes:
        """Ids of `text`, as 32-bit integers."""
        if len(text) > LONG_TEXT:
            return b"".join(map(self._encoded, _segments(text)))
        return self._encoded(text)

    def _encoded(self, text: str) -> bytes:
        parts, get = self.find(text), self.memo.get
        try:
            return b"".join(map(get, parts))
        except TypeError:  # a pre-token that is not in the memo
            piece = self.piece
            return b"".join([get(p) or piece(p) for p in parts])

    def encode(self, text: str | None) -> list[int]:
        """Ids of `text`; empty for an empty or null text."""
        return array("i", self.encoded(text)).tolist() if text else []

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as it is certain: bytes of an unfinished character are held back.

        An incremental UTF-8 automaton counts the continuation bytes due; bytes that are not UTF-8
        come out as U+FFFD.
        """
        due, held = 0, bytearray()
        for i in ids:
            done = bytearray()
            for b in self.tokens[i]:
                if due and b & 0xC0 == 0x80:
                    held.append(b)
                    due -= 1
                else:
                    done += held
                    held.clear()
                    held.append(b)
                    due = 1 if b & 0xE0 == 0xC0 else 2 if b & 0xF0 == 0xE0 else 3 if b & 0xF8 == 0xF0 else 0
                if not due:
                    done += held
                    held.clear()
            if done:
                yield done.decode("utf-8", "replace")
        if held:
            yield held.decode("utf-8", "replace")

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


_MADE: dict[tuple[int, str], Transducer] = {}


def transducer_of(data: bytes, pattern: str = SPLIT_PATTERN) -> Transducer:
    """This process's transducer for a vocabulary file's content; Python workers keep it between tasks."""
    key = (hash(data), pattern)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Transducer(read_ranks(data), pattern)
    return _MADE[key]


def encoded_batch(transducer: Transducer, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of a batch of texts."""
    parts = [transducer.encoded(t) if t else b"" for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(p) >> 2 for p in parts])]).astype(np.int64)
    return ends, np.frombuffer(b"".join(parts), np.int32)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str = SPLIT_PATTERN) -> DataFrame:
    """(`key`, ids array<int>) for each row of `df`, without special tokens.

    Empty and null texts give an empty list, repeated rows give repeated rows, a null key stays null,
    and further columns are ignored. An empty table gives an empty result. `vocabulary` is the path of a
    .tiktoken file on the driver; its content (under 1 MB) goes to the executors as a broadcast.
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = transducer_of(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ends, ids = encoded_batch(transducer, part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["k", "ids"])

    narrow = spread(df.select(df[key].alias("k"), df[text].alias("t")))
    schema = T.StructType([T.StructField("k", narrow.schema["k"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return narrow.mapInArrow(run, schema).withColumnRenamed("k", key)


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(`key`, text) for each row of `df`, the text that its `ids` stand for; empty for an empty or null list."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = transducer_of(shared.value)
        for batch in batches:
            texts = [transducer.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "text"])

    narrow = df.select(df[key].alias("k"), df[ids].alias("ids"))
    schema = T.StructType([T.StructField("k", narrow.schema["k"].dataType), T.StructField("text", T.StringType())])
    return narrow.mapInArrow(run, schema).withColumnRenamed("k", key)
