import pytest

from docweft.llm import pii


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("회신은 y.sora+as@mail.gaon.example으로 부탁드립니다.", "회신은 [EMAIL]으로 부탁드립니다."),
        ("문의 k.onbit5(골뱅이)dasolchem.example 입니다", "문의 [EMAIL] 입니다"),
        ("write to y.sora at sub dot noori dot test now", "write to [EMAIL] now"),
        ("[메일](mailto:ops.team5@example.com)", "[메일](mailto:[EMAIL])"),
        ("rowan64 @ mirae-fac.test | jun_s [at] example.com", "[EMAIL] | [EMAIL]"),
        ("H.P 010-0710-2981 B3 복도", "H.P [PHONE] B3 복도"),
        ("01006649070, +82-10-0695-0876, +82 (0)10 0681 2000", "[PHONE], [PHONE], [PHONE]"),
        ("０１０－０１１９－３３３４ / 공일공-공구삼팔-팔삼일이", "[PHONE] / [PHONE]"),
        ("031)000-8425, 02-000-1052, Tel (607) 555-0176", "[PHONE], [PHONE], Tel [PHONE]"),
        ("<p>010-<b>0370-1428</b> 로</p>", "<p>[PHONE] 로</p>"),
        ("주민번호 861119-2886356 로", "주민번호 [ID_NUMBER] 로"),
        ("(주민등록번호: 361112 1121056), 2610195448830", "(주민등록번호: [ID_NUMBER]), [ID_NUMBER]"),
        ("여권 M67169565 / 면허번호 14-89-074038-86", "여권 [ID_NUMBER] / 면허번호 [ID_NUMBER]"),
        ("택배 수령지 다온시 아라구 솔마루동 81-7\n신청", "택배 수령지 [ADDRESS]\n신청"),
        ("부품은 누리시 한결구 윤슬로42길 58-14 (벼루동) 한슬온 앞으로 보내", "부품은 [ADDRESS] [NAME] 앞으로 보내"),
        ("(04008) 미르구 한울대로 401, 117동 607호 건너편", "[ADDRESS] 건너편"),
        ("The tenant at 198 Tinsmith Ave., Oldcastle Park 41362 complained", "The tenant at [ADDRESS] complained"),
        ("010-0197-2902(으)로 전화했더니 홍라결씨가 받았습니다.", "[PHONE](으)로 전화했더니 [NAME]씨가 받았습니다."),
        ("담당자 이벼솜 실장, 성함은 송늘빛이고 신청자 강해울 (", "담당자 [NAME] 실장, 성함은 [NAME]이고 신청자 [NAME] ("),
        ("작성 이라람 / 검토 임다뜰\n- 홍라솔 드림", "작성 [NAME] / 검토 [NAME]\n- [NAME] 드림"),
        ("| 이름 | 직책 |\r\n|---|---|\r\n| 조람찬 | 기사 |\r\n\r\n| 권한 | 수량 |\r\n|---|---|\r\n| 권한록 | 3 |", "| 이름 | 직책 |\r\n|---|---|\r\n| [NAME] | 기사 |\r\n\r\n| 권한 | 수량 |\r\n|---|---|\r\n| 권한록 | 3 |"),
        ("Contact: Jorun Starrow <a.b@c.example> Mr.&nbsp; Varn Corrant confirmed", "Contact: [NAME] <[EMAIL]> Mr.&nbsp; [NAME] confirmed"),
        ("김철 과장에게, 담당 남궁민수 부장, 최 민호 대리, 박지성 선수", "[NAME] 과장에게, 담당 [NAME] 부장, [NAME] 대리, [NAME] 선수"),
        ("강남대로 12\n주소는 한빛로 5", "[ADDRESS]\n주소는 [ADDRESS]"),
        ("user AT example DOT com / tel:010-1234-5678", "[EMAIL] / tel:[PHONE]"),
        ("M12345678 제출함", "[ID_NUMBER] 제출함"),
        ("At noon John Smith called, then Mary Jane Watson-Parker replied.", "At noon [NAME] called, then [NAME] replied."),
    ],
)
def test_items_are_replaced(text, want):
    assert pii.masked(text) == want


@pytest.mark.parametrize(
    "text",
    [
        "화면 캡처는 panel78@2x.png 입니다.",
        "@media print 규칙, core-ui@1.10.1 패키지",
        "자산번호 997266-9374911 라벨, 주문번호 2461-9350-7834 건",
        "묶음 번호 4423633261356, 시리얼 SN5767-68694, 부품 코드 K36805268",
        "접수 시각 2025-01-19 16:25:00, 점검표 v2.17.0198, 10.0.106.153 장비",
        "경로 14 에서 바로 7건을 처리합니다. 별도로 32개, 다시 새로 3건",
        "안녕하세요, 담당자님. 고객님 안내 문구와 담당자님 확인란",
        "담당자 미정, 관리자 승인 대기 상태입니다.",
        "관리자 페이지 주소는 사내망 4번 링크입니다.",
        "removed at month end, and photos were kept. The dot matrix",
        "오나빛 발전기 수치가 208밀리미터까지 올랐습니다.",
        "계약 59-0077-42호 부속서",
        "주문번호 0212345678, 주문번호: 010-1234-5678, order no. 0212345678",
        "자산번호 M12345678, serial M12345678, asset # S12345678",
        "안전 과장 회의, 전산 팀장 승인, 민원 대리 접수",
        "그대로 12번, 예정대로 3건을 처리했습니다. 순서대로 12",
        "The Main Pump called for service. Last Night reported nothing.",
        "",
    ],
)
def test_what_only_looks_like_it_stays(text):
    assert pii.find_items(text) == []
    assert pii.masked(text) == text


def test_overlaps_take_linear_time():
    import time

    took = []
    for n in (2000, 8000):
        text = "서울시 강남구 테헤란로 12-3, " * n
        began = time.process_time()
        assert len(pii.find_items(text)) == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_no_text():
    assert pii.find_items(None) == []
    assert pii.masked(None) is None


def test_long_texts_are_read_whole():
    text = "가나다 " * 20000 + "a@b.example"
    assert pii.find_items(text) == [(len(text) - 11, len(text), "email")]


def test_table_of_all_cases(spark):
    df = spark.createDataFrame([(1, "a@b.example", None, "x"), (2, "", "정기 점검", "x"), (None, "010-1234-5678", "010-1234-5678 a@b.example c@d.example", "x"), (1, "a@b.example", None, "x")], "idx bigint, content string, notes string, fld string")
    got = sorted((r.idx or 0, r.fld, r.masked, r.types, r.n_items) for r in pii.mask_fields(df, "idx", ["content", "notes"]).collect())
    assert got == [
        (0, "content", "[PHONE]", ["phone"], 1),
        (0, "notes", "[PHONE] [EMAIL] [EMAIL]", ["email", "phone"], 3),
        (1, "content", "[EMAIL]", ["email"], 1),
        (1, "content", "[EMAIL]", ["email"], 1),
        (2, "content", "", [], 0),
        (2, "notes", "정기 점검", [], 0),
    ]
    assert pii.mask_fields(df.limit(0), "idx", ["content"]).collect() == []
