import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweft.llm.splitting import cuts, split_texts


def checked(text, limit=1200, overlap=150):
    spans = cuts(text, limit, overlap)
    assert "".join(text[f:e] for _, f, e in spans) == text
    assert all(0 < e - s <= limit or not text for s, _, e in spans)
    for (_, _, before), (s, f, _) in zip(spans, spans[1:], strict=False):
        assert f == before
        assert f - s == min(overlap, f)
        assert f - s == overlap or len(text) < overlap
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab가나 .,\n#|é́\U0001f600", max_size=700), st.sampled_from([(50, 0), (50, 12), (120, 60)]))
def test_pieces_cover_the_text(text, how):
    checked(text, *how)


@pytest.mark.parametrize("n", [0, 1, 1199, 1200, 1201, 2400, 2401, 30000])
def test_unbroken_strings(n):
    assert (len(checked("x" * n)) > 1) == (n > 1200)


def test_cuts_stand_at_natural_boundaries():
    rng = random.Random(1)
    text = "\n\n".join(" ".join("문장" + "가" * rng.randrange(3, 9) + "." for _ in range(8)) for _ in range(40))
    assert all(text[f - 2 : f] == "\n\n" for _, f, _ in checked(text)[1:])
    flat = text.replace("\n\n", " ")
    assert all(flat[f - 2 : f] == ". " for _, f, _ in checked(flat)[1:])
    words = flat.replace(".", "")
    assert all(words[f - 1] == " " for _, f, _ in checked(words)[1:])


def test_headings_are_stronger_than_paragraphs():
    text = ("단락입니다. " * 30 + "\n\n") * 4 + "# 제목\n\n" + ("단락입니다. " * 30 + "\n\n") * 3
    assert any(text[f:].startswith("# 제목") for _, f, _ in checked(text)[1:])


def test_combining_marks_stay_with_their_base():
    text = "é" * 2000
    assert all(text[f] != "́" for _, f, _ in checked(text)[1:])


@pytest.mark.parametrize("cluster", ["e" + "\u0301" * 70, "\U0001f1f0\U0001f1f7", "\U0001f44d\U0001f3fd", "\u1112\u1161\u11ab", "\U0001f468\u200d\U0001f469\u200d\U0001f467"])
def test_characters_as_read_stay_whole(cluster):
    text = cluster * 900
    assert all(f % len(cluster) == 0 for _, f, _ in checked(text))


def test_a_character_longer_than_a_part_is_cut():
    checked("e" + "\u0301" * 5000)


def test_table_of_all_cases(spark):
    rows = [(1, "a" * 1200, "x"), (2, "b " * 1000, "x"), (2, "b " * 1000, "x"), (None, "c", "x"), (4, None, "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "id bigint, body string, piece string")
    got = split_texts(df, ["id"], "body").collect()
    assert sorted((r.id or 0, r.piece_no) for r in got if r.id != 2) == [(0, 0), (1, 0), (5, 0)]
    assert sum(r.id == 2 for r in got) == 2 * len(cuts("b " * 1000))
    assert split_texts(df.limit(0), ["id"], "body").collect() == []
    with pytest.raises(ValueError, match="overlap"):
        split_texts(df, ["id"], "body", 100, 100)
