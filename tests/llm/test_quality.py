import pytest

from docweft.llm import quality as q

COMMON = ["the", "is", "다시", "있습니다"]
SENTENCES = ["배수펌프를 다시 점검한 뒤 결과를 기록하고 있습니다.", "온수단말은 지하밸브를 연결한 뒤 따로 청소해 주세요."]


def kind(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return q.text_quality(df, "doc_id", "text", COMMON).first().kind


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (" ".join(SENTENCES * 4), "prose"),
        ("\n".join(s.rstrip(".") for s in SENTENCES * 4), "prose"),
        (" ".join(SENTENCES * 4) + "\n\n| 항목 | 수량 |\n|---|---|\n| 밸브 | 3 |", "prose"),
        ("When the pump is dry, the valve\nhas to be closed by hand so that\nthe pressure is held and\nthe alarm does not come back.", "prose"),
        ("\n".join(f"- 밸브 {i}개" for i in range(12)), "list"),
        ("점검 대상\n" + "\n".join(f"{i}) 승강단말 (기계실);" for i in range(12)), "list"),
        ("\n".join(f"[x] noisy pump {i}," for i in range(12)), "list"),
        ("| 항목 | 수량 |\n|---|---|\n" + "\n".join(f"| 밸브 | {i} |" for i in range(9)), "table"),
        ("\n".join(f"밸브;{i};;O" for i in range(9)), "table"),
        ("\n".join(f"밸브{' ' * 10}{i}{' ' * 12}정상" for i in range(9)), "table"),
        ("<table>\n" + "\n".join(f"<tr><td>밸브</td><td>{i}</td></tr>" for i in range(9)) + "\n</table>", "table"),
        ("견적모듈\n" * 30, "junk"),
        ("=" * 40 + "\n" + "^" * 50, "junk"),
        ("ㅁㄴㅇㄹ ㅂㅈㄷㄱ ㅋㅌㅊㅍ " * 6, "junk"),
        ("%EB%B0%B0%EC%88%98%ED%8C%A8%EB%84%90" * 4, "junk"),
        ("7/@A!@(~:A</^^;{=0>\\:?(`~; */<^>?|$|:>$\\};+{]]#!\n?}})x>x{/}!^~]0f;&?%+=`{f[{$|7{&&?%0|=", "junk"),
        ("6jmsZGbwH5/yu5cG23NaLkQ0NJkkcwFwps7cIuq+c0PQ62FkFULElOaxFTSMBOP0usj87lhG4oyQ\nNhqLdlOpN192uuvdL6s7IrVx5", "junk"),
        ("\n".join(f"{16 * i:08x}  {' '.join(f'{(37 * j + 91 * i) % 256:02x}' for j in range(16))}" for i in range(8)), "junk"),
        ("sqzjlzd cljllqzhzx sacfeczqcdhce ffkw fgdawqkhwqjs qeszgadczg jfsqdck glxgejw", "junk"),
        ("\n".join(f"    o  밸브  {i}개" for i in range(12)), "list"),
        ("12 40 55 61\n" * 2 + "\n".join(f"{i}  {i * 7}  {i * 91}   ab" for i in range(10, 30)), "table"),
        ("짧은 글", "short"),
        ("", "short"),
        (None, "short"),
        (" \n" * 50, "blank"),
    ],
)
def test_kinds(spark, text, want):
    assert kind(spark, text) == want


def test_statistics(spark):
    text = "The pump is dry.\n\n- a valve\nThe pump is dry.\n# heading!"
    r = q.text_quality(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "doc_id", "text", COMMON).first()
    assert (r.n_chars, r.n_lines, r.n_words) == (len(text), 4, 13)
    assert r.mean_word_length == pytest.approx(len("".join(text.split())) / 13)
    assert r.symbol_ratio == pytest.approx(5 / len("".join(text.split())))
    assert r.punctuation_line_share == pytest.approx(3 / 4)
    assert r.common_word_share == pytest.approx(4 / 13)
    assert r.repeated_line_share == pytest.approx(1 / 4)
    assert "repeated_lines" not in r.reasons
    assert "symbol_ratio" in r.reasons


def test_size_of_blocks_changes_no_statistic(monkeypatch):
    texts = ["가 나,다! \n" * 50, "", "x.y " * 300, None, "\n", "- 밸브 3개\n- 모터 4개\n\n" * 40, "a\r\nb\x85c"]
    whole = {k: list(v) for k, v in q._statistics(texts, frozenset({"가"})).items()}
    monkeypatch.setattr(q, "BLOCK", 64)
    assert {k: list(v) for k, v in q._statistics(texts, frozenset({"가"})).items()} == whole


def test_kinds_follow_from_the_reasons():
    texts = ["=" * 60, "견적모듈\n" * 30, "하나 " * 60, "a|b|c\n" * 12 + "d|e|f\n" * 12, "\n".join(f"* 밸브 {i}개" for i in range(12)), "The pump is dry. " * 4]
    found = q._statistics(texts, frozenset(COMMON))
    for kind, reasons in zip(found["kind"], found["reasons"], strict=True):
        named = [q.RULES[r][1] for r in q.RULES if r in reasons]
        assert kind == (named[0] if named else "prose")
    assert list(found["kind"]) == ["junk", "junk", "junk", "table", "list", "prose"]
    assert "few_words" in found["reasons"][5]


def test_table_of_all_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a", "x"), (3, "b" * 30000, "x"), (3, "b" * 30000, "x")], "id bigint, body string, kind string")
    got = q.text_quality(df, "id", "body", spark.createDataFrame([("the",), ("the",), (None,)], "word string")).collect()
    assert sorted((r.id or 0, r.n_chars) for r in got) == [(0, 1), (1, 0), (3, 30000), (3, 30000)]
    assert q.text_quality(df.limit(0), "id", "body", []).collect() == []
    assert [tuple(r) for r in q.unfit(q.text_quality(df, "id", "body", []), "id").collect()] == [(3, "junk")]
