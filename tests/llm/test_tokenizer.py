import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from docweft.llm import tokenizer as tk
from docweft.session import table


@pytest.fixture(scope="module")
def data_bytes():
    with open(tk.default_vocabulary(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def transducer(data_bytes):
    return tk.Transducer(tk.read_ranks(data_bytes))


@pytest.fixture(scope="module")
def plain(transducer):
    return tiktoken.Encoding("own", pat_str=tk.SPLIT_PATTERN, mergeable_ranks=transducer.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=200), st.text(alphabet="ab 가나다1.,-=\n'st", max_size=300)))
def test_ids_equal_plain_merging(transducer, plain, text):
    ids = transducer.encode(text)
    assert ids == plain.encode_ordinary(text)
    assert transducer.decode(ids) == text


@pytest.mark.parametrize("text", ["-" * 5000, "가" * 3000, "ab" * 4000, " " * 999 + "x", "<|endoftext|>", "\r\n\r\n  \t", "é‍﻿", "aA1" * 2000, "\U0001f600" * 300])
def test_long_and_odd_texts(transducer, plain, text):
    assert transducer.encode(text) == plain.encode_ordinary(text)


def test_segments_of_long_texts_change_nothing(transducer, plain, monkeypatch):
    monkeypatch.setattr(tk, "LONG_TEXT", 7)
    for text in ("Please have  the cold door\n\n measured before. " * 5, "가나다라마바사아자차카타파하 " * 4, "x" * 50, " " * 40 + "a b", "a\u3000b\xa0c " * 9, "it's  a 12345678 test\t\tof\r\n segments"):
        assert "".join(tk._segments(text)) == text
        assert transducer.encode(text) == plain.encode_ordinary(text)


def test_forgetting_states_changes_nothing(data_bytes, plain):
    small = tk.Transducer(tk.read_ranks(data_bytes), max_states=40, max_memo=5)
    for text in ("배수패널에 점검 이력이 13건 남아 있어 오수센서는 연결할 수 없는 상태입니다. " * 3, "Please have the cold door measured before the reader is sealed."):
        assert small.encode(text) == plain.encode_ordinary(text)


def test_states_stay_bounded_within_one_string(data_bytes, plain):
    import random

    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    small = tk.Transducer(tk.read_ranks(data_bytes), max_states=500)
    assert small.encode(text) == plain.encode_ordinary(text)
    assert len(small.states) <= 501


def test_streamed_text_is_never_cut_within_a_character(transducer):
    text = "한글 \U0001f600 é 점검"
    parts = list(transducer.decode_stream(transducer.encode(text)))
    assert "".join(parts) == text
    assert all("�" not in p for p in parts)
    assert "�" in transducer.decode([transducer.ranks[b"\xed"]])


def test_corpus(spark, data, plain):
    docs = table(spark, data, "documents")
    want = {r.doc_id: plain.encode_ordinary(r.text) if r.text else [] for r in docs.collect()}
    assert {r.doc_id: r.ids for r in tk.encode_corpus(docs).collect()} == want


def test_table_of_all_cases(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (None, "a", "k"), (3, "b", "k"), (3, "b", "k")], "doc_id int, text string, ids string")
    got = tk.encode_corpus(df)
    assert got.columns == ["doc_id", "ids"]
    assert sorted((r.doc_id or 0, r.ids) for r in got.collect()) == [(0, [64]), (1, []), (2, []), (3, [65]), (3, [65])]
    assert tk.encode_corpus(df.limit(0)).collect() == []
