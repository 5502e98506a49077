"""Personal data in free text: found, typed and replaced by placeholders.

Anchor expansion: one Aho-Corasick pass over the text finds what personal data stand with - at-signs and their
disguises, schemes, digits and the marks that numbers begin with, cues and titles of persons, identifier words, street
words, the ends of road and neighbourhood names before a number. From each anchor a small deterministic parser
reads to both sides within fixed bounds, fixes the item's ends and checks that it is one. Nothing else looks
through the text. Offsets are those of the text given: characters are folded one for one (full-width forms,
dashes, blanks) and never removed.
"""

from __future__ import annotations

import bisect
import datetime as dt
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.session import spread

TYPES = ("email", "id_number", "phone", "address", "name")

# ---- Fixed values: words that personal data stand with -------------------------------------------------
AT_MARKS = ("@", "골뱅이", "[at]", "(at)", "{at}", "<at>", "[@]", "(@)", " at ", " AT ", "[AT]", "(AT)", "&#64;", "&commat;", "[골뱅이]", "앳")
SURNAMES = "가간갈감강개견경계고공곽교구국군권궉금기길김나남낭내노뇌누단담당대도독동두라란랑려로뢰류리림마만매맹명모목묘묵문미민박반방배백범변보복봉부비빈빙사산삼상서석선설섭성소손송수순승시신심아안애야양어엄여연염엽영예오옥온옹왕요용우운원위유육윤은을음이인임자장저전점정제조종좌주준증지진차창채천초최추춘탁탄탕태판팽편평포표풍피필하학한함해허현형호홍화황"
COMMON_SURNAMES = "강고곽구권금기길김나남노도류마맹명모문민박반방배백변봉부서석선설성소손송신심안양엄여연염예오옥왕용우원위유육윤은이인임장전정제조주지진차채천최추탁태편표하한함허현형호홍황"
#: Surnames that a name of two syllables is believed with, before a title.
SHORT_SURNAMES = "강고곽권김나남노류맹문박배백변서송신심안양엄오우윤이임장전정조주진차채최추한함허현홍황"
TWO_SYLLABLE_SURNAMES = ("남궁", "황보", "제갈", "사공", "선우", "서문", "독고", "동방")
NAME_CUES = ("성함은", "성함", "성명", "이름은", "이름", "신청자", "신청인", "세대주", "요청자", "요청인", "담당자", "담당", "작성자", "작성", "검토자", "검토", "승인자", "결재", "수령인", "수령자", "받는분", "받는 분", "보낸이", "보낸 사람", "보내는 분", "고객명", "입주자", "세입자", "임차인", "연락 담당", "접수자", "처리자", "예금주", "기안", "확인자", "대표자", "보호자", "방문자", "작업자", "통화자", "제보자", "발신", "수신")
TITLES = ("부장", "차장", "과장", "대리", "사원", "주임", "팀장", "실장", "소장", "기사", "이사", "상무", "전무", "사장", "대표", "본부장", "센터장", "매니저", "책임", "선임", "수석", "연구원", "반장", "국장", "계장", "조장", "총무", "주무관", "교수", "원장", "관장", "점장", "지점장", "파트장", "엔지니어", "회장", "간사", "선수", "감독", "기자", "작가", "변호사", "간호사", "약사", "교사", "선생", "박사", "경위", "순경")
NAME_ENDS = ("씨", "님", "드림", "올림", "배상", "앞으로", "귀하", "앞")
#: Words with a surname's syllable first that are roles or things, not persons.
NO_NAMES = frozenset("담당자 관리자 고객 고객사 사용자 작업자 신청자 요청자 책임자 선생 손 사장 부장 차장 과장 대리 팀장 실장 소장 기사 주임 사원 회원 임차인 임대인 세대주 입주자 입주민 방문자 방문객 운영자 개발자 기획자 기술자 설치자 점검자 검토자 작성자 승인자 수령인 주인 이용자 이사 전무 상무 대표 원장 교수 강사 의사 여러분 어머 아버 형 누 미정 없음 확인 확인중 변경 변경됨 공석 부재 부재중 전체 전원 지정 배정 예정 대기 대기중 현장 외부 내부 본사 지사 협력사 업체 업체명 하청 시설팀 관리팀 전산팀 운영팀 지원팀 보안팀 총무팀 담당 담당부서 부서 미지정 미배정 이메일 연락처 전화 전화번호 주소 직책 직급 소속 비고 이력 내역 완료 진행 진행중 정보 기준 문서 보고 승인 요청 접수 배송 수리 점검 교체 설정 연결 조치 안내 서버 화면 목록 설비 장비 기계 전기 소방 배관 주차 승강기 이후 이전 오늘 어제 내일 오전 오후 지난주 지난달 이번 다음 하나 모두 함께 따로 새로 우선 즉시 다시 먼저 그래서 다만 한편 최초 최종 최근 현재 정기 정상 정전 주말 월말 교대 조직 조회 조건 기록 기본 기타 사유 사항 상태 시간 시각 장애 장소 전달 전송 정리 제목 제출 주문 지원 진단 차단 처리 추가 출입 통신 표시 필요 해결 협의 회신 회의 안전 전산 정비 조경 민원 인사 노무 재무 회계 기획 홍보 영업 구매 자재 품질 설계 시공 공무 전략 해외 국내 신규 차기 전임 현임 신임 임시 주간 야간 당직 계약 법무 감사 심사 연구 개발 미화 경비 방재 변전 통신 서비스 이상 진상 유지 보수 보안 한전 조사 정산 배차 현직 전직 강사 문화 복지 주민 남자 여자 전문 공사 임대 분양 추천 최고".split())
ENGLISH_CUES = ("Mr.&", "Mrs.&", "Ms.&", "Dr.&", "Contact:", "contact:", "Contact ", "Attn:", "Attn ", "attn:", "Mr. ", "Mrs. ", "Ms. ", "Mr ", "Ms ", "Dr. ", "call ", "Call ", "Regards,", "regards,", "Sincerely,", "Thanks,", "Signed by ", "signed by ", "Requested by ", "requested by ", "Reported by ", "reported by ", "Requester:", "requester:", "Reporter:", "Assignee:", "Name:", "name:", "Tenant:", "tenant ", "Owner:", "From:", "by ", "ask ", "Ask ", "told ", "Dear ", "Reviewed by ", "Author:", "Prepared by ", "Approved by ")
#: English verbs that a person's full name stands before.
ENGLISH_VERBS = (" called", " confirmed", " reported", " requested", " replied", " said", " asked", " wrote", " signed", " approved")
SCHEMES = ("mailto:", "tel:", "sms:", "callto:")
#: English words that a street's name ends with, and what they stand after.
STREETS = tuple(a + b for a in (" ", "-") for b in ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Drive", "Dr", "Boulevard", "Blvd", "Way", "Court", "Ct", "Square", "Sq", "Place", "Pl", "Terrace", "ro", "gil", "daero"))
ADDRESS_CUES = ("주소는", "주소지", "주소", "소재지", "수령지", "배송지", "거주지", "도로명")
#: What a number after these is no telephone number and no passport.
OTHER_NUMBERS = ("주문", "자산", "시리얼", "일련", "접수", "관리", "송장", "운송장", "계약", "제품", "부품", "모델", "품목", "자재", "로트", "묶음", "티켓", "품번", "사업자", "사업자등록", "order", "asset", "serial", "part", "invoice", "tracking", "lot", "ticket", "model", "batch", "s/n", "sku")
PASSPORT_CUES = ("여권", "passport", "Passport", "PASSPORT")
LICENCE_CUES = ("면허", "licence", "license", "Licence", "License")
PHONE_CUES = ("전화", "연락처", "Tel", "TEL", "tel", "H.P", "HP", "☎", "문의", "팩스", "FAX", "Fax", "휴대", "핸드폰", "고객센터", "대표번호", "phone", "Phone", "call", "Call")
#: Ends that make "name.end" after an at-sign a file or a version, not a host.
FILE_ENDS = frozenset("png jpg jpeg gif webp svg bmp ico pdf css js ts md txt csv xlsx docx zip log json xml html htm php exe dll jar gz tar".split())
#: Korean words that end like a road or a neighbourhood but stand before numbers in ordinary text.
NO_ROADS = frozenset("경로 바로 새로 서로 따로 별로 주로 통로 회로 진로 도로 선로 수로 항로 활로 원래대로 예정대로 그대로 제대로 마음대로 대로 으로 홀로 스스로 실제로 억지로 수시로 임시로 순서대로 차례로 최대로 연로 관로 급수로 배수로 배관로 저절로 이대로 절대로 가로 세로 작동 이동 자동 수동 행동 활동 변동 연동 구동 가동 시동 기동 재기동 진동 충동 운동 노동 공동 합동 유동 냉동 반동 제동 발동 전동 부동 감동 관리동 별동 본동 생활동 연구동 사무동 기숙사동 병동 손길 눈길 발길 물길 뱃길 갈림길 빗길 지름길".split())
#: Korean words that end like a city or district and are none.
NO_AREAS = frozenset("다시 즉시 임시 수시 동시 잠시 역시 혹시 표시 게시 지시 일시 상시 적시 당시 감시 경시 무시 전시 개시 제시 명시 암시 연구 요구 기구 출구 입구 공구 도구 친구 복구 청구 영구 배구 전구 촉구 강구 탐구 비상구 통풍구 배기구 급기구 환기구 점검구 정도 온도 습도 속도 각도 별도 제도 용도 의도 태도 밀도 강도 고도 농도 빈도 순도 조도 휘도 구도 지도 보도 철도 수도 차도 인도 복도 포도 방면 화면 도면 측면 전면 후면 정면 표면 평면 단면 장면 이면 반면 하면 되면 보면 으면 면 읍 군 구 시 도".split())
PROVINCES = ("서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주")
# ---------------------------------------------------------------------------------------------------------

_FOLD = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {ord(c): " " for c in " 　    \t"} | {ord(c): "-" for c in "‐‑‒–—―−－ー"} | {0xFF5E: "~", 0xFF0E: "."}
_SPOKEN = "공영일이삼사오육륙칠팔구"
_TAG = r"(?:</?[a-zA-Z][^<>]{0,40}>|&nbsp;)*"
_GAP = rf"{_TAG}[ .\-)/·]{{0,3}}{_TAG}"
_D = rf"[0-9{_SPOKEN}]"


def _digits(n: str) -> str:
    """`n` digits, written as figures or spoken syllables, with tags allowed between."""
    return rf"{_D}{{{n}}}"


_PHONE = re.compile(rf"(?:(?:\+ ?|00)82{_GAP}(?:\(0\){_GAP})?0?|[0공영])(?:[1일][016789공영일륙육칠팔구]|[2이]|[3-6삼사오육륙][1-5일이삼사오]|[7칠][0공영]|[5오][0공영][0-9]?|[8팔][0공영]){_GAP}(?:{_digits('3,4')}){_GAP}(?:{_digits('4')})(?!{_D}|-?[0-9])")
_PHONE_ABROAD = re.compile(rf"(?:\+1{_GAP})?(?:\([2-9][0-9]{{2}}\) ?|[2-9][0-9]{{2}}[-. ])[2-9][0-9]{{2}}[-. ][0-9]{{4}}(?![0-9]|-[0-9])")
_PHONE_OTHER = re.compile(r"\+(?:[2-79][0-9]{0,2}|8[013-9][0-9]?)[ .\-()]{0,2}(?:[0-9]{1,4}[ .\-()]{1,2}){1,4}[0-9]{3,4}(?![0-9])")
_PHONE_SHORT = re.compile(r"1[5-8][0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])")
_RESIDENT = re.compile(rf"([0-9]{{2}})([0-9]{{2}})([0-9]{{2}}){_TAG} {{0,2}}-? {{0,2}}{_TAG}([0-9])[0-9]{{6}}(?![0-9]|-[0-9])")
_LICENCE = re.compile(r"(?:[0-9]{2}|(?:" + "|".join(PROVINCES) + r")) ?- ?[0-9]{2} ?- ?[0-9]{6} ?- ?[0-9]{2}(?![0-9]|-[0-9])")
_LICENCE_BARE = re.compile(r"[0-9]{2}[- ]?[0-9]{2}[- ]?[0-9]{6}[- ]?[0-9]{2}(?![0-9])")
_PASSPORT = re.compile(r"[A-Za-z](?:[0-9]{8}|[0-9]{3}[A-Za-z][0-9]{4})(?![0-9A-Za-z])")
_PASSPORT_LONE = re.compile(r"(?<![0-9A-Za-z-])[MSRGDO](?:[0-9]{8}|[0-9]{3}[A-Z][0-9]{4})(?![0-9A-Za-z-])")
_OPEN, _CLOSE = re.compile(r"<[a-zA-Z][^<>]{0,40}>"), re.compile(r"</[a-zA-Z]+>")
_OTHER_NUMBER = re.compile(rf"(?<![a-z])(?:{'|'.join(OTHER_NUMBERS)}) ?(?:번호|코드|no\.?|number|id|#)?(?:는|은|이|가)? ?[:#=]? ?$")
_BEFORE_STREET = re.compile(r"(?<![0-9A-Za-z-])[0-9]{1,5}(?:-[0-9]{1,4})?,? [A-Z][a-z]+(?:[ -][A-Z]?[a-z]+){0,2}$")
_AFTER_STREET = re.compile(r"(?![A-Za-z])\.?(?:,? (?:Suite|Ste\.?|Apt\.?|Unit|Floor|Room|No\.?|#) ?[0-9A-Z-]{1,6}\b)?(?:, [A-Z][a-z]+(?:[ -](?:[A-Z][a-z]+|gu|si|do|dong))?){0,3}(?:,? [A-Z]{2})?(?: [0-9]{5}\b)?")
_ADDRESS_CUE = re.compile(rf"(?:{'|'.join(ADDRESS_CUES)})(?:는|은)? ?[:：]? ?$")

_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_+-])?$")
_DOT = r"(?:\.| ?[\[({](?:dot|점|\.)[\])}] ?| (?:dot|DOT|점) )"
_HOST = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_DOTS = re.compile(_DOT)

_UNIT = r"(?:,? ?(?:지하 ?)?[0-9]{1,4}동(?: ?[0-9]{1,5}호)?|,? ?[0-9]{1,5}호|,? ?(?:지하 ?)?[0-9]{1,3}층(?: ?[0-9]{1,5}호)?)"
_LOT = re.compile(rf"(?:(?:번)?길 ?)? ?(?:산 ?)?[0-9]{{1,5}}(?:-[0-9]{{1,4}})?(?:번길 ?[0-9]{{1,4}}(?:-[0-9]{{1,4}})?|길 ?[0-9]{{1,4}}(?:-[0-9]{{1,4}})?)?(?:번지)?(?![0-9])")
_AFTER = re.compile(rf"(?: ?\([가-힣0-9, ]{{2,20}}\))?{_UNIT}?(?: ?\([가-힣0-9, ]{{2,20}}\))?")
_COUNTED = re.compile(r" ?(?:건(?!너|물)|회(?!관|사)|분(?!수)|초|개|층|도(?![가-힣])|명|대|번(?!지)|시간|시(?![가-힣])|일|월|년|퍼센트|%|원|리터|볼트|바|암페어|메가|킬로|밀리|차|단계|배|미터|kg|cm|mm|호기|호선|라인|페이지|쪽|장|줄|행|열|단|회선|포트|에서|까지|부터|~)")
_AREA = re.compile(r"(?:(?:\([0-9]{5}\)|[0-9]{5}) ?)?(?:(?:[가-힣]{1,7}(?:특별자치도|특별자치시|특별시|광역시|시|도|군|구|읍|면)|서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충북|충남|전북|전남|경북|경남|제주) ){1,4}$")
_ROAD = re.compile(r"[가-힣]{1,10}[0-9]{0,3}$")

_NAME_TEXT = re.compile(r"[가-힣]{2,5}")
_AFTER_NAME = re.compile(rf"(?: ?(?:{'|'.join(TITLES)}))?(?:님|씨)?(?:이고|이며|이고요|입니다|이라|이라고|이에요|예요|으로|로|에게|께서|께|에서|이|가|은|는|을|를|의|와|과|도|만|라고|한테)?(?![가-힣])")
_ENGLISH_PART = r"[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?"
_ENGLISH_NAME = re.compile(rf"(?:[ \t]|&nbsp;)*({_ENGLISH_PART}(?: [A-Z]\.)? {_ENGLISH_PART})(?![A-Za-z])")
_ENGLISH_BEFORE = re.compile(rf"(?<![A-Za-z0-9.'-]){_ENGLISH_PART}(?: [A-Z]\.)?(?: {_ENGLISH_PART}){{1,2}}$")
_ENGLISH_SINGLE = re.compile(r"(?:[ \t]|&nbsp;)*([A-Z][a-z]+)(?![A-Za-z])")
#: Capitalised words that do not begin a person's name.
_NOT_PERSONS = frozenset("Yesterday Today Tomorrow Later Then Finally The Please We Before After During Following Over Last This Right On At In It If When While Until Without Order Package Contact Call Support Service Center Centre Team Admin Help Desk Office Manager Customer Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Room Floor Building Server Product Version Ticket Request Asset Serial Number Street Road Maintenance Security Front Control Main Night Duty".split())


class _Text:
    """A text with what its parsers share."""

    def __init__(self, text: str) -> None:
        self.raw = text
        self.plain = text.translate(_FOLD) if not text.isascii() else text.replace("\t", " ")
        self.items: list[tuple[int, int, str]] = []

    def add(self, start: int, end: int, kind: str) -> None:
        self.items.append((start, end, kind))


def _real_day(yy: int, mm: int, dd: int, century: str) -> bool:
    base = {"1": 1900, "2": 1900, "5": 1900, "6": 1900, "3": 2000, "4": 2000, "7": 2000, "8": 2000}.get(century, 1800)
    try:
        dt.date(base + yy, mm, dd)
    except ValueError:
        return False
    return True


def _email(t: _Text, start: int, end: int) -> None:
    """From an at-sign: the mailbox before and the host after it."""
    s = t.plain
    left = start
    while left > 0 and s[left - 1] in " [({<" and start - left < 2:
        left -= 1
    found = _LOCAL.search(s, max(0, left - 64), left)
    if not found:
        return
    right = end
    while right < len(s) and s[right] in " ])}>" and right - end < 2:
        right += 1
    host = _HOST.match(s, right)
    if not host:
        return
    labels = _DOTS.split(host[0])
    # What follows the host's last letter label in the text is no part of it: "example으로" ends at "example".
    if labels[-1].lower() in FILE_ENDS or not labels[-1].isalpha() or len(labels[-1]) < 2 or not any(c.isalpha() for c in labels[0]) or labels[0].lower() in ("2x", "3x", "1x"):
        return
    if " " in s[left:start] + s[start:end].strip("at") + s[end:right] and "@" in s[start:end] and found[0][-1:] in "._-":
        return
    begin = found.start()
    if begin and (s[begin - 1].isalnum() and s[begin - 1].isascii() or s[begin - 1] in "._-"):
        return
    t.add(begin, host.end(), "email")


def _number(t: _Text, at: int) -> None:
    """From the first character of a number: identity, licence and telephone numbers."""
    s = t.plain
    if at and (s[at - 1].isascii() and s[at - 1].isalnum() or s[at - 1] == "." or s[at - 1] == "-" and at > 1 and s[at - 2].isdigit()):
        return
    if found := _LICENCE.match(s, at):
        t.add(at, found.end(), "id_number")
    elif (found := _RESIDENT.match(s, at)) and found[4] in "12345678" and _real_day(int(found[1]), int(found[2]), int(found[3]), found[4]):
        t.add(at, found.end(), "id_number")
    elif found := _PHONE.match(s, at) or _PHONE_ABROAD.match(s, at) or _PHONE_OTHER.match(s, at):
        if _OTHER_NUMBER.search(s[max(0, at - 20) : at].lower()):
            return
        end = found.end()
        opened = len(_OPEN.findall(found[0])) - len(_CLOSE.findall(found[0]))
        while opened > 0 and (close := _CLOSE.match(s, end)):  # a tag opened in the number is closed after it
            end, opened = close.end(), opened - 1
        t.add(at, end, "phone")
    elif (found := _PHONE_SHORT.match(s, at)) and any(c in s[max(0, at - 14) : at] for c in PHONE_CUES):
        t.add(at, found.end(), "phone")


def _lone_passport(t: _Text, at: int) -> None:
    """From a letter that passport numbers begin with: one without a word for it."""
    s = t.plain
    found = _PASSPORT_LONE.match(s, at)
    if found and not _OTHER_NUMBER.search(s[max(0, at - 20) : at].lower()):
        t.add(at, found.end(), "id_number")


def _street(t: _Text, start: int, end: int) -> None:
    """From an English street word: the number and name before it, and what may follow."""
    s = t.plain
    before, after = _BEFORE_STREET.search(s, max(0, start - 60), start), _AFTER_STREET.match(s, end)
    if before and after:
        t.add(before.start(), after.end(), "address")


def _passport(t: _Text, end: int) -> None:
    found = re.compile(r"(?: ?(?:번호|No\.?|number|no\.?))?[ :：(#)]{0,3}").match(t.plain, end)
    if number := _PASSPORT.match(t.plain, found.end()):
        t.add(found.end(), number.end(), "id_number")


def _licence(t: _Text, end: int) -> None:
    found = re.compile(r"(?:증)?(?: ?(?:번호|No\.?|number|no\.?))?[ :：(#)]{0,3}").match(t.plain, end)
    if number := _LICENCE_BARE.match(t.plain, found.end()):
        t.add(found.end(), number.end(), "id_number")


def _address(t: _Text, start: int) -> None:
    """From the last syllable of a road or neighbourhood before a number, at `start`."""
    s = t.plain
    road = _ROAD.search(s, max(0, start - 11), start + 1)
    if not road:
        return
    name = road[0]
    lot = _LOT.match(s, start + 1)
    if not lot:
        return
    begin = road.start()
    area = _AREA.search(s, max(0, begin - 60), begin)
    sure = area is not None and area[0].split()[-1] not in NO_AREAS
    if name in NO_ROADS:
        return
    plain_lot = "-" in lot[0] or "번지" in lot[0]
    if not sure and _ADDRESS_CUE.search(s, max(0, begin - 8), begin):
        sure, area = True, None
    elif not sure and len(name) >= 4 and name.endswith("대로") and _LONE_ROAD.match(s, lot.end()):
        sure, area = True, None
    if not sure:
        if len(name) < 3 or any(name.endswith(x) for x in ("으로", "대로", "에서로", "하는로")) and not plain_lot:
            return
        # Without a city or district, only a lot that nothing is counted by.
        if not plain_lot and not _UNIT_NEXT.match(s, lot.end()):
            return
    elif _COUNTED.match(s, lot.end()) and not plain_lot and not _UNIT_NEXT.match(s, lot.end()):
        return
    end = _AFTER.match(s, lot.end()).end()
    t.add(area.start() if sure and area else begin, end, "address")


#: A road that stands alone ends its line or clause after the number.
_LONE_ROAD = re.compile(r"(?= ?(?:$|[\n\r,)<]))")
_UNIT_NEXT = re.compile(rf"(?: ?\([가-힣0-9, ]{{2,20}}\))?{_UNIT}")


def _is_name(word: str, strict: bool = True) -> bool:
    if word in NO_NAMES or len(word) < 2 or len(word) > 5:
        return False
    if word[:2] in TWO_SYLLABLE_SURNAMES:
        return 3 <= len(word) <= 4
    if word[0] not in (COMMON_SURNAMES if strict else SURNAMES):
        return False
    return len(word) == 3 or not strict and len(word) == 2


def _name_after(t: _Text, end: int) -> None:
    """From the end of a cue: a name that follows."""
    s = t.raw
    at, spaces = end, 0
    while at < len(s) and s[at] in " \t:：-·|*( " and at - end < 6:
        spaces += 1
        at += 1
    if not spaces:
        return
    found = _NAME_TEXT.match(s, at)
    if not found:
        return
    for length in (3, 4, 2):
        word = s[at : at + length]
        if len(word) == length and len(found[0]) >= length and _is_name(word, strict=length == 3) and _AFTER_NAME.match(s, at + length):
            # Two and four syllables only where nothing but a mark follows and a mark came before.
            if length != 3 and not (":" in s[end:at] or "：" in s[end:at]):
                continue
            if length != 3 and at + length < len(s) and s[at + length] not in "\n<|,/)":
                continue
            t.add(at, at + length, "name")
            return


def _name_before(t: _Text, start: int, glued: bool, word_end: int) -> None:
    """From the start of a title or ending: a name that precedes."""
    s = t.raw
    at = start
    if not glued:
        while at > 0 and s[at - 1] in " \t " and start - at < 3:
            at -= 1
        if at == start:
            return
    if not _AFTER_TITLE.match(s, word_end):
        return
    for length in (4, 3, 2):
        word = s[max(0, at - length) : at]
        if len(word) < length or not _NAME_TEXT.fullmatch(word) or at > length and "가" <= s[at - length - 1] <= "힣":
            continue
        if length == 2 and not glued and at >= 4 and s[at - 3] == " " and s[at - 4] in COMMON_SURNAMES and not (at > 4 and "가" <= s[at - 5] <= "힣"):
            t.add(at - 4, at, "name")  # the surname stands apart
        elif length == 4 and word[:2] in TWO_SYLLABLE_SURNAMES or length == 3 and _is_name(word) or length == 2 and not glued and word[0] in SHORT_SURNAMES and word not in NO_NAMES:
            t.add(at - length, at, "name")
        return


_AFTER_TITLE = re.compile(r"(?:이|가|은|는|을|를|의|께서|께|에게|께서는|이랑|과|와|도|만|입니다|이며|한테|님)?(?![가-힣])")


def _english_name(t: _Text, end: int, cue: str) -> None:
    s = t.raw
    if cue.endswith("&"):
        cue, end = cue[:-1], end - 1
    found = _ENGLISH_NAME.match(s, end)
    if found and not any(w in _NOT_PERSONS for w in found[1].replace(".", "").split()):
        t.add(found.start(1), found.end(1), "name")
    elif cue.strip() in ("Mr.", "Mrs.", "Ms.", "Mr", "Ms", "Dr.") and (found := _ENGLISH_SINGLE.match(s, end)) and found[1] not in _NOT_PERSONS:
        t.add(found.start(1), found.end(1), "name")


def _english_before(t: _Text, start: int) -> None:
    """From a verb: the full name of a person before it."""
    s = t.raw
    at = max(0, start - 50)
    # A capitalised word that begins no name may stand before one, as at the start of a sentence.
    while found := _ENGLISH_BEFORE.search(s, at, start):
        parts = re.split("[ .'-]+", found[0])
        if not any(w in _NOT_PERSONS for w in parts):
            t.add(found.start(), found.end(), "name")
            return
        if parts[0] not in _NOT_PERSONS:
            return
        at = found.start() + len(parts[0]) + 1


_ROW = re.compile(r"^[ \t]*\|(.*)\|[ \t]*\r?$", re.M)
_NAME_HEADERS = frozenset(("이름", "성명", "담당", "담당자", "성함", "작성자", "요청자", "신청자", "Name", "name", "Contact"))


def _tables(t: _Text) -> None:
    """Names in the columns of tables whose header says that they hold persons."""
    s = t.raw
    column, last = -1, -2
    for row in _ROW.finditer(s):
        cells = row[1].split("|")
        if row.start() > last + 1:
            column = next((i for i, c in enumerate(cells) if c.strip() in _NAME_HEADERS), -1)
        elif column >= 0 and column < len(cells):
            word = cells[column].strip()
            if word and (_NAME_TEXT.fullmatch(word) and _is_name(word, strict=False) or (found := _ENGLISH_NAME.fullmatch(word)) and not any(w in _NOT_PERSONS for w in found[1].split())):
                at = row.start(1) + sum(len(c) + 1 for c in cells[:column])
                at += len(cells[column]) - len(cells[column].lstrip())
                t.add(at, at + len(word), "name")
        last = row.end()


def _automaton() -> ahocorasick.Automaton:
    found: dict[str, tuple[str, str]] = {}
    for mark in AT_MARKS:
        found[mark] = ("at", mark)
    for cue in NAME_CUES:
        found[cue] = ("cue", cue)
    for title in TITLES:
        found[title] = ("title", title)
    for word in NAME_ENDS:
        found[word] = ("end", word)
    for cue in ENGLISH_CUES:
        found[cue] = ("english", cue)
    for cue in PASSPORT_CUES:
        found[cue] = ("passport", cue)
    for cue in LICENCE_CUES:
        found[cue] = ("licence", cue)
    for syllable in "로길동리가읍면":
        for digit in "0123456789":
            for gap in ("", " "):
                found[syllable + gap + digit] = ("road", syllable + gap + digit)
        found[syllable + " 산"] = ("road", syllable + " 산")
    for digit in "0123456789+(":
        found[digit] = ("number", digit)
    for first in "공영":
        for second in _SPOKEN + "륙":
            found[first + second] = ("number", first + second)
    for letter in "MSRGDO":
        for digit in "0123456789":
            found[letter + digit] = ("lone", letter + digit)
    for word in STREETS:
        found[word] = ("street", word)
    for word in ENGLISH_VERBS:
        found[word] = ("verb", word)
    for word in SCHEMES:
        found[word] = ("scheme", word)
    found["</th>"] = found["|-"] = ("table", "")
    found["---|"] = ("table", "")
    out = ahocorasick.Automaton()
    for word, what in found.items():
        out.add_word(word, (*what, len(word)))
    out.make_automaton()
    return out


_AUTOMATON: list[ahocorasick.Automaton] = []


def find_items(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of each item in `text`, in order and without overlap."""
    if not text:
        return []
    if not _AUTOMATON:
        _AUTOMATON.append(_automaton())
    t = _Text(text)
    tables = False
    for last, (what, word, n) in _AUTOMATON[0].iter(t.plain):
        start, end = last - n + 1, last + 1
        if what == "at":
            _email(t, start, end)
        elif what == "cue":
            _name_after(t, end)
        elif what == "title":
            _name_before(t, start, False, end)
        elif what == "end":
            _name_before(t, start, word in ("씨", "님"), end)
        elif what == "road":
            _address(t, start)
        elif what == "english":
            if start == 0 or not text[start - 1].isalnum():
                _english_name(t, end, word)
        elif what == "number":
            # Of a run of digits only the first can begin a number.
            if start == 0 or not ("0" <= t.plain[start - 1] <= "9"):
                _number(t, start)
        elif what == "lone":
            _lone_passport(t, start)
        elif what == "street":
            _street(t, start, end)
        elif what == "verb":
            if not text[end : end + 1].isalnum():
                _english_before(t, start)
        elif what == "scheme":
            if word != "mailto:":
                _number(t, end)
            elif (at := t.plain.find("@", end, end + 65)) > 0:
                _email(t, at, at + 1)
        elif what == "passport":
            _passport(t, end)
        elif what == "licence":
            _licence(t, end)
        else:
            tables = True
    if tables:
        _tables(t)
    # Where items overlap, the first in the order of TYPES that is longest stands.
    starts: list[int] = []
    ends: list[int] = []
    kinds: list[str] = []
    for start, end, kind in sorted(set(t.items), key=lambda x: (TYPES.index(x[2]), x[0] - x[1], x[0])):
        at = bisect.bisect_left(starts, end)
        if at and ends[at - 1] > start:
            continue
        starts.insert(at, start)
        ends.insert(at, end)
        kinds.insert(at, kind)
    return list(zip(starts, ends, kinds, strict=True))


def masked(text: str | None, items: list[tuple[int, int, str]] | None = None) -> str | None:
    """`text` with each item replaced by its type in brackets, as [EMAIL]; all else unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in find_items(text) if items is None else items:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def mask_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(`key`, fld, masked, types array<string>, n_items) for each row and field of `df` with a text.

    types holds each type found once, in alphabetical order. Null fields give no row, empty ones an empty
    text without items. Repeated rows come out repeated; other columns are ignored; texts are read whole.
    """
    long = df.select(df[key].alias("k"), F.explode(F.array(*[F.struct(F.lit(f).alias("fld"), df[f].alias("t")) for f in fields])).alias("x")).select("k", "x.fld", "x.t").filter("t is not null")
    schema = T.StructType([long.schema["k"], T.StructField("fld", T.StringType()), T.StructField("masked", T.StringType()), T.StructField("types", T.ArrayType(T.StringType())), T.StructField("n_items", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            items = [find_items(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([masked(x, y) for x, y in zip(texts, items, strict=True)], pa.string()), pa.array([sorted({z for _, _, z in y}) for y in items], pa.list_(pa.string())), pa.array([len(y) for y in items], pa.int32())],
                ["k", "fld", "masked", "types", "n_items"],
            )

    return spread(long).mapInArrow(run, schema).withColumnRenamed("k", key)
