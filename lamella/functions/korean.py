"""Event, team and person names in Korean: fields, codes, types and romanisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _col, alias, keyword_case

# Spellings of weapon, gender, age and category, and patterns of event names in order of precedence.
WEAPONS = {"에페": "에뻬", "플뢰레": "플러레", "epee": "에뻬", "foil": "플러레", "sabre": "사브르", "saber": "사브르"}
GENDERS = {"남자": "남", "여자": "여", "m": "남", "f": "여", "male": "남", "female": "여"}
CATEGORIES = {"pro": "전문", "club": "동호인", "아마추어": "동호인"}
AGES = {
    "초등저": "E1", "초등 저학년": "E1", "초등1-2": "E1", "초등 1-2": "E1", "초등중": "E2", "초등 중학년": "E2", "초등3-4": "E2", "초등 3-4": "E2",
    "초등고": "E3", "초등 고학년": "E3", "초등5-6": "E3", "초등 5-6": "E3", "초등부": "E3", "중등부": "MS", "중학교": "MS", "중학부": "MS",
    "고등부": "HS", "고등학교": "HS", "고교부": "HS", "대학부": "UNI", "대학생": "UNI", "일반부": "SR", "성인부": "SR", "시니어": "SR",
}
WORD_END = "(?![0-9A-Za-z가-힣_])"
EVENT_AGES = [
    (r"초등부?\s*\(?1-?2학년\)?", "E1"), (r"초등부?\s*\(?3-?4학년\)?", "E2"), (r"초등부?\s*\(?5-?6학년\)?", "E3"),
    (r"초등\s*저", "E1"), (r"초등\s*중", "E2"), (r"초등\s*고", "E3"),
    (f"U9{WORD_END}", "E1"), (f"U11{WORD_END}", "E2"), (f"U13{WORD_END}", "E3"), (f"U15{WORD_END}", "MS"), (f"U17{WORD_END}", "HS"), (f"U20{WORD_END}", "UNI"),
    (f"^[남여]고{WORD_END}", "HS"), (f"^[남여]중{WORD_END}", "MS"), (f"^[남여]일{WORD_END}", "SR"), (f"^[남여]대{WORD_END}", "UNI"), (f"^[남여]초{WORD_END}", "E3"),
    ("중등부?|중학", "MS"), ("고등부?|고교", "HS"), ("대학부?|대학생", "UNI"), ("일반부?|시니어|성인", "SR"), ("엘리트부?", "SR"),
]
GLOBAL_AGES = [
    ("초등.*1[-~]?2|1[-~]?2학년", "Y8"), ("초등.*3[-~]?4|3[-~]?4학년", "Y10"), ("초등.*5[-~]?6|5[-~]?6학년", "Y12"),
    (rf"(?<!\d)9세이하|U9{WORD_END}", "Y8"), (f"11세이하|U11{WORD_END}", "Y10"), (f"13세이하|U13{WORD_END}", "Y12"), (f"17세이하|U17{WORD_END}", "U17"), (f"20세이하|U20{WORD_END}", "Junior"),
    (rf"(?<!\d)8세이하|[UY]8{WORD_END}", "Y8"), (rf"(?<!\d)10세이하|[UY]10{WORD_END}", "Y10"), (f"12세이하|[UY]12{WORD_END}", "Y12"), (f"14세이하|[UY]14{WORD_END}", "Y14"),
    (f"15세이하|16세이하|18세이하|U1[568]{WORD_END}", "Cadet"),
    ("남중|여중|중등", "Y14"), ("남고|여고|고등|카뎃|Cadet", "Cadet"), ("남대|여대|대학|주니어|Junior", "Junior"), ("일반|베테랑|시니어|마스터즈|Veteran|Senior|Open", "Veteran"), ("초등", "Y12"),
]
ORGANISATIONS = [
    ("university", ["대학교", "대학", "대"]),
    ("high", ["고등학교", "고등", "여고", "남고", "체육고", "예술고", "과학고", "외고", "국제고", "자사고", "특목고", "고"]),
    ("middle", ["중학교", "중학", "여중", "남중", "중"]),
    ("professional", ["시청", "군청", "구청", "도청", "체육회", "공사", "공단", "은행", "보험", "증권", "카드", "전력", "가스", "통신", "철도", "항공", "삼성", "현대", "LG", "SK", "롯데", "포스코", "KT", "CJ"]),
    ("national", ["국가대표", "대표팀", "협회", "연맹"]),
    ("club", ["클럽", "펜싱클럽", "펜싱", "스포츠클럽", "FC", "SC", "아카데미", "도장", "체육관", "센터", "랩", "LAB"]),
]
ORGANISATION_CODES = {"club": "C", "middle": "M", "high": "H", "university": "V", "professional": "A", "national": "N", "unknown": "X"}
# Regions, in their order of precedence; they are spelled by the rule of ``spelled`` but for these.
REGION_NAMES = (
    "서울 부산 대구 인천 광주 대전 울산 세종 경기 강원 충북 충남 전북 전남 경북 경남 제주 수원 성남 용인 고양 안양 안산 청주 천안 전주 포항 창원 김해 진주 양산 구미 경주 거제 통영 사천 밀양 함안 거창 합천 의령 하동 산청 남해 함양 목포 여수 순천 나주 "
    "광양 군산 익산 정읍 남원 김제 완주 안동 영주 영천 상주 문경 경산 칠곡 예천 봉화 울진 영덕 청도 고령 성주 원주 춘천 강릉 동해 태백 속초 삼척 홍천 횡성 영월 평창 정선 철원 화천 양구 인제 고성 양양 충주 제천 보은 옥천 영동 증평 진천 괴산 음성 단양 "
    "공주 보령 아산 서산 논산 계룡 당진 금산 부여 서천 청양 홍성 예산 태안 서귀포 강남 강동 강북 강서 관악 광진 구로 금천 노원 도봉 동대문 동작 마포 서대문 서초 성동 성북 송파 양천 영등포 용산 은평 종로 중구 중랑 호성 제일 동래 원예 신언 경덕 목동 "
    "압구정 송도 최병철"
).split()
REGION_SPELLINGS = {"강릉": "Gangneung", "철원": "Cheorwon", "종로": "Jongno", "중구": "Jung-gu", "중랑": "Jungnang", "동래": "Dongnae", "최병철": "Choibyeongcheol"}
ORGANISATION_WORDS = {
    "중학교": "Middle School", "여자중학교": "Girls' Middle School", "남자중학교": "Boys' Middle School", "고등학교": "High School", "여자고등학교": "Girls' High School",
    "남자고등학교": "Boys' High School", "체육고등학교": "Sports High School", "예술고등학교": "Arts High School", "과학고등학교": "Science High School",
    "외국어고등학교": "Foreign Language High School", "산업고등학교": "Technical High School", "원예고등학교": "Horticultural High School", "대학교": "University", "대학": "University",
    "광역시청": "Metropolitan City Hall", "광역시": "Metropolitan City", "특별시청": "Special City Hall", "특별시": "Special City",
    "시청": "City Hall", "군청": "County Office", "구청": "District Office", "도청": "Provincial Office", "체육회": "Sports Council", "펜싱클럽": "Fencing Club", "클럽": "Club",
    "스포츠클럽": "Sports Club", "아카데미": "Academy", "센터": "Center", "협회": "Association", "연맹": "Federation", "주니어펜싱클럽": "Junior Fencing Club", "거점스포츠클럽": "Regional Sports Club",
}
TEAM_LABELS = {"club": "클럽", "elementary": "초등학교", "middle": "중학교", "high": "고등학교", "university": "대학교", "professional": "실업팀"}
INITIALS = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
VOWELS = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i"]
FINALS = ["", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t"]


def spelled(name: str) -> str:
    """A name in Latin letters, syllable by syllable."""
    parts = [(ord(ch) - 44032) for ch in name]
    return "".join(INITIALS[at // 588] + VOWELS[at % 588 // 28] + FINALS[at % 28] for at in parts).capitalize()


REGIONS = {name: REGION_SPELLINGS.get(name) or spelled(name) for name in REGION_NAMES}


def _first(text: Column, table: list[tuple[str, str]], otherwise: object = None) -> Column:
    out = None
    for pattern, code in table:
        hit = text.rlike(f"(?i){pattern}")
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(otherwise)


def event_fields(name: Column | str) -> Column:
    """weapon, gender, age_group, event_type and category named in an event; null where none is."""
    c = F.trim(_col(name))
    weapon = keyword_case(c, [(WEAPONS.get(w, w), [w]) for w in ("에뻬", "플러레", "사브르", "에페", "플뢰레")])
    sex = F.when(c.contains("남자") | c.contains("남 ") | c.startswith("남"), "남").when(c.contains("여자") | c.contains("여 ") | c.startswith("여"), "여")
    kind = keyword_case(c, [("단체전", ["단체", "팀"]), ("개인전", ["개인"])])
    category = keyword_case(c, [("전문", ["전문"]), ("동호인", ["동호인", "아마추어"])])
    return F.struct(weapon.alias("weapon"), sex.alias("gender"), _first(c, EVENT_AGES).alias("age_group"), kind.alias("event_type"), category.alias("category"))


def normalised(weapon: Column | str, gender: Column | str, age: Column | str, category: Column | str, name: Column | str) -> Column:
    """Standard spellings, with what is missing taken from the event name; ``*_source`` says which."""
    found = event_fields(name)
    out = []
    for field, value, table in (("weapon", weapon, WEAPONS), ("gender", gender, GENDERS), ("age_group", age, AGES), ("category", category, CATEGORIES)):
        own = F.nullif(alias(value, table), F.lit(""))
        out += [F.coalesce(own, found[field]).alias(field), F.when(own.isNotNull(), "given").when(found[field].isNotNull(), "extracted").alias(f"{field}_source")]
    return F.struct(*out)


def global_age(name: Column | str) -> Column:
    """Age code of the international scheme; U17 counts for two groups."""
    return _first(_col(name), GLOBAL_AGES, "Veteran")


def age_memberships(age: Column | str) -> Column:
    """The groups that an age code is listed under."""
    c = _col(age)
    return F.when(c == "U17", F.array(F.lit("U17"), F.lit("Y14"), F.lit("Cadet"))).otherwise(F.array(c))


def organisation_type(name: Column | str) -> Column:
    return keyword_case(F.trim(_col(name)), ORGANISATIONS, "unknown")


def region(name: Column | str) -> Column:
    """The first region named, in the table's order; null if none is."""
    return keyword_case(name, [(k, [k]) for k in REGIONS])


def organisation_english(name: Column | str, verified: Column | None = None) -> Column:
    """English name: a verified one, else the longest region named and then the words of organisations, the longest first, in English.

    Only the longest region is replaced (of equally long ones the first in order of precedence). If other Korean
    characters are left they are romanised and every run of letters begins with a capital, so names
    without any keep their capitals. The romanisation is the one of person names; the reference's own table of finals
    is out of step with the alphabet.
    """
    c = _col(name)
    longest = sorted(REGIONS.items(), key=lambda kv: -len(kv[0]))
    c = F.coalesce(*[F.when(c.contains(k), F.replace(c, F.lit(k), F.lit(f"{v} "))) for k, v in longest], c)
    for k, v in sorted(ORGANISATION_WORDS.items(), key=lambda kv: -len(kv[0])):
        c = F.replace(c, F.lit(k), F.lit(f" {v}"))
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    c = F.when(c.rlike("[가-힣]"), title_case(romanised(c))).otherwise(c)
    return c if verified is None else F.coalesce(verified, c)


def title_case(text: Column | str) -> Column:
    """Each run of letters with a capital at its beginning and small letters behind, also after hyphens and apostrophes."""
    runs = F.regexp_extract_all(_col(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 1_000_000)))), "")


def _syllable(ch: Column) -> tuple[Column, Column, Column, Column]:
    at = F.ascii(ch) - 44032
    return ch.rlike("^[가-힣]$"), F.floor(at / 588).cast("int"), F.floor((at % 588) / 28).cast("int"), (at % 28).cast("int")


def _pick(table: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, table)), at)


def romanised(name: Column | str) -> Column:
    """Syllables by their parts; other characters stay."""

    def one(ch: Column) -> Column:
        hangul, i, v, f = _syllable(ch)
        return F.when(hangul, F.concat(_pick(INITIALS, i), _pick(VOWELS, v), _pick(FINALS, f))).otherwise(ch)

    return F.array_join(F.transform(F.split(_col(name), ""), one), "")


def masked_name(name: Column | str) -> Column:
    """Initials of a name: the first letter of each syllable's initial, and Latin letters upper-case."""

    def one(ch: Column) -> Column:
        hangul, i, _, _ = _syllable(ch)
        return F.when(hangul, F.upper(F.left(_pick(INITIALS, i), F.lit(1)))).when(ch.rlike(r"^\p{L}$"), F.upper(ch)).otherwise("")

    found = F.filter(F.transform(F.split(F.coalesce(_col(name), F.lit("")), ""), one), lambda x: x != "")
    return F.when(F.size(found) > 0, F.concat(F.array_join(found, "."), F.lit("."))).otherwise("")


def anonymous_team(kind: Column | str, province: Column | str, keep_empty: bool = False) -> Column:
    """Region and kind of a team instead of its name; ``keep_empty`` replaces a null region only, as the database's own function does."""
    label = F.lit("기타")
    for key, value in TEAM_LABELS.items():
        label = F.when(_col(kind) == key, value).otherwise(label)
    return F.concat(F.coalesce(_col(province) if keep_empty else F.nullif(_col(province), F.lit("")), F.lit("전국")), F.lit("("), label, F.lit(")"))


def is_minor(born: Column | str, as_of: Column | str) -> Column:
    """Under 14 on the day; without a birth date not."""
    years = F.floor(F.months_between(F.to_date(_col(as_of)), F.to_date(_col(born))) / 12)
    return F.coalesce(years < 14, F.lit(False))
