"""Terms of rounds, ages, names and stored pages as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import korean, scalar, vocabulary
from .scalar import _col, lookup

# Rounds of elimination by size, display names (Korean, English), age codes, surnames.
SIZES = [256, 128, 64, 32, 16, 8, 4, 2]
POOL_TERMS = ["pool", "풀", "예선", "뿔", "pool_round", "pool_rounds", "풀라운드", "예선전", "poule"]
DE_TERMS = [
    "de", "본선", "d.e.", "direct elimination", "direct_elimination", "엘리미나시옹디렉트", "엘리미나시옹 디렉트", "엘리미나시옹_디렉트", "elimination directe",
    "de_bracket", "de_round", "de_rounds", "토너먼트", "녹아웃", "knockout", "elimination",
]
# Late rounds by names that are no round of elimination by size.
LATE_TERMS = {"gold_medal_bout": "final", "금메달전": "final", "semi-final": "semifinal", "semi_final": "semifinal", "quarter-final": "quarterfinal", "quarter_final": "quarterfinal"}
NAMED_ROUNDS = {
    "quarterfinal": "t8", "semifinal": "t4", "준결승": "t4", "결승": "t2", "결승전": "t2", "t2": "t2", "final": "t2", "동메달전": "bronze", "3위결정전": "bronze", "bronze": "bronze",
}
DISPLAY = {
    "t256": ("256강", "Round of 256"), "t128": ("128강", "Round of 128"), "t64": ("64강", "Round of 64"), "t32": ("32강", "Round of 32"), "t16": ("16강", "Round of 16"),
    "t8": ("8강", "Quarterfinal"), "t4": ("준결승", "Semifinal"), "t2": ("결승", "Final"), "bronze": ("동메달전", "Bronze Medal Bout"),
    "Pool": ("예선", "Pool"), "DE": ("본선", "Direct Elimination"), "final": ("결승", "Final"), "semifinal": ("준결승", "Semifinal"), "quarterfinal": ("8강", "Quarterfinal"),
}
START_ROUNDS = {4: "준결승", 8: "8강", 16: "16강", 32: "32강", 64: "64강", 128: "128강"}
LOST_IN = [(1, "결승_승자"), (2, "결승"), (4, "준결승"), (8, "8강"), (16, "16강"), (32, "32강"), (64, "64강")]
GLOBAL_TO_LEGACY = {"Y8": ["E1"], "Y10": ["E2"], "Y12": ["E3"], "Y14": ["MS", "U17"], "Cadet": ["HS", "U17"], "Junior": ["UNI"], "Veteran": ["SR"]}
INTERNATIONAL_AGES = {"U9": "Y8", "U11": "Y10", "U13": "Y12", "U20": "Junior"}
AGE_CATEGORIES = [
    ("일반", ["일반부", "일반", "시니어"]), ("대학", ["대학부", "U20", "Y20", "청년부", "대학", "여대", "남대"]), ("고등", ["고등부", "U17", "Y17", "여고", "남고"]),
    ("중등", ["중등부", "U14", "Y14", "여중", "남중"]), ("초등", ["초등부", "초등저", "초등고", "U9", "U11", "U13", "Y9", "Y11", "Y13"]),
]
SURNAMES = {
    "김": ["Kim", "Gim"], "이": ["Lee", "Yi", "Rhee"], "박": ["Park", "Pak", "Bak"], "최": ["Choi", "Choe"], "정": ["Jung", "Jeong", "Chung"], "강": ["Kang", "Gang"], "조": ["Jo", "Cho"],
    "윤": ["Yoon", "Yun"], "장": ["Jang", "Chang"], "임": ["Lim", "Im", "Yim"], "한": ["Han"], "오": ["Oh", "O"], "서": ["Seo", "Suh"], "신": ["Shin", "Sin"], "권": ["Kwon", "Gwon"],
    "황": ["Hwang"], "안": ["An", "Ahn"], "송": ["Song"], "류": ["Ryu", "Yoo", "Yu"], "유": ["Yoo", "Yu", "You"], "홍": ["Hong"], "전": ["Jeon", "Jun", "Chun"], "고": ["Ko", "Go", "Koh"],
    "문": ["Moon", "Mun"], "양": ["Yang"], "손": ["Son"], "배": ["Bae", "Pae"], "백": ["Baek", "Paek", "Back"], "허": ["Heo", "Hur", "Huh"], "노": ["No", "Noh", "Roh"], "남": ["Nam"], "하": ["Ha"],
    "심": ["Shim", "Sim"], "주": ["Joo", "Ju"], "공": ["Gong", "Kong"],
}
COMPETITION_STATES = {"예정": "scheduled", "진행": "in_progress", "진행중": "in_progress", "종료": "completed", "완료": "completed"}
MATCH_STATES = {"V": "victory", "A": "abandon", "F": "forfeit", "E": "exclusion", "P": "penalty"}


def _folded(term: Column | str) -> Column:
    return F.lower(F.trim(_col(term)))


def round_code(term: Column | str) -> Column:
    """t256 to t2 or bronze for a named round of elimination, whatever its case and the space around it; null for other terms."""
    known = {f"{n}강{end}": f"t{n}" for n in SIZES if n > 2 for end in ("", "전")} | {f"t{n}": f"t{n}" for n in SIZES} | NAMED_ROUNDS
    return lookup(_folded(term), known)


def round_type(term: Column | str) -> Column:
    """Pool, DE or Unknown.

    Rounds of elimination are DE, as their names stand in the reference's index after those of the types and
    replace them there; the few names of late rounds that only the types have keep their type (final, semifinal, quarterfinal).
    """
    low = _folded(term)
    found = F.when(low.isin(POOL_TERMS), F.lit("Pool")).when(low.isin(DE_TERMS), F.lit("DE"))
    return F.coalesce(found, lookup(low, LATE_TERMS), F.when(round_code(term).isNotNull(), F.lit("DE")), F.lit("Unknown"))


def canonical_round(term: Column | str) -> Column:
    """The round's code, else its type, else the term itself."""
    kind = round_type(term)
    return F.coalesce(round_code(term), F.when(kind != "Unknown", kind), _col(term))


def display_name(code: Column | str, lang: str = "ko") -> Column:
    return lookup(_col(code), {k: v[0 if lang == "ko" else 1] for k, v in DISPLAY.items()}, _col(code))


def bout_type(term: Column | str) -> Column:
    """Pool, DE or Unknown; named late rounds are DE (the reference compares upper- with lower-case and never finds them)."""
    kind = round_type(term)
    return F.when(kind.isin("Pool", "Unknown"), kind).otherwise(F.lit("DE"))


def bout_format(kind: Column | str, score: Column | str) -> Column:
    kind, score = _col(kind), _col(score)
    return F.when((kind == "DE") & score.between(10, 14), F.lit("de_10")).when(kind == "DE", F.lit("de_15")).when(kind == "Team", F.lit("team_45")).otherwise(F.lit("pool_5"))


def bout_info(term: Column | str, score_a: Column | str, score_b: Column | str) -> Column:
    kind, code = bout_type(term), canonical_round(term)
    return F.struct(
        kind.alias("bout_type"), bout_format(kind, F.greatest(_col(score_a), _col(score_b))).alias("bout_format"), code.alias("round_canonical"),
        display_name(code, "ko").alias("display_ko"), display_name(code, "en").alias("display_en"), F.when(kind == "Pool", 5).otherwise(15).alias("max_score"),
    )


def open_bracket_size(n: Column | str) -> Column:
    """The least power of two that holds n; null under 1."""
    n = _col(n)
    return F.when(n >= 1, F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int"))


def start_round(size: Column | str) -> Column:
    return lookup(_col(size), START_ROUNDS, F.lit("32강"))


def lost_in(rank: Column | str) -> Column:
    """The round in which a final rank fell out; the champion's is marked so."""
    rank, out = _col(rank), F.lit("128강")
    for bound, name in reversed(LOST_IN):
        out = F.when(rank <= bound, F.lit(name)).otherwise(out)
    return F.when(rank.isNotNull(), out)


def player_key(name: Column | str, team: Column | str) -> Column:
    return F.concat(F.coalesce(_col(name), F.lit("")), F.lit("|"), F.coalesce(_col(team), F.lit("")))


def key_parts(key: Column | str) -> Column:
    """name, team of a player key; what follows the first bar is the team."""
    parts = F.split(_col(key), r"\|", 2)
    return F.struct(parts[0].alias("name"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("team"))


def legacy_codes(code: Column | str) -> Column:
    """The stored age codes that a code of the international scheme stands for."""
    out = F.array(_col(code))
    for k, v in GLOBAL_TO_LEGACY.items():
        out = F.when(_col(code) == k, F.array(*map(F.lit, v))).otherwise(out)
    return out


def global_code(code: Column | str) -> Column:
    return lookup(_col(code), vocabulary.LEGACY_TO_GLOBAL | {"U17": "Cadet"}, _col(code))


def valid_progression(old_age: Column | str, old_date: Column | str, new_age: Column | str, new_date: Column | str) -> Column:
    """False where a later date has a lower age level; true where anything is unknown."""
    before, after = scalar.age_level(old_age), scalar.age_level(new_age)
    return ~F.coalesce((_col(new_date) > _col(old_date)) & (before > 0) & (after > 0) & (after < before), F.lit(False))


def age_category(event: Column | str) -> Column:
    """``U`` and the number behind it, from an event's name; null without one."""
    n = F.regexp_extract(_col(event), r"(?i)U\s*(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("U"), n))


def international_age(category: Column | str, birth_year: Column | str, year: Column | int) -> Column:
    """U17 is Y14 up to 15 years, else Cadet; unknown categories pass."""
    key, year = F.upper(F.trim(_col(category))), year if isinstance(year, Column) else F.lit(year)
    young = F.coalesce(year - _col(birth_year) <= 15, F.lit(False))
    return F.when(key == "U17", F.when(young, F.lit("Y14")).otherwise(F.lit("Cadet"))).otherwise(lookup(key, INTERNATIONAL_AGES, _col(category)))


def highest_category(ages: Column | str) -> Column:
    """The highest category that any age group of an array names; 일반 if none does."""
    out = F.lit("일반")
    for name, words in reversed(AGE_CATEGORIES):
        out = F.when(F.exists(_col(ages), _naming(words)), F.lit(name)).otherwise(out)
    return out


def _naming(words: list[str]) -> Callable[[Column], Column]:
    return lambda text: F.coalesce(_any_of(text, words), F.lit(False))


def _any_of(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def one_gender(genders: Column | str) -> Column:
    """True where an array of genders names one at most, empty values aside."""
    return F.size(F.array_distinct(F.filter(_col(genders), lambda g: g.isNotNull() & (g != "")))) <= 1


def names_match(a: Column | str, b: Column | str, least: float = 0.7) -> Column:
    """Equal without spaces and case, or one inside the other, or sharing enough distinct characters."""
    x, y = (F.replace(F.lower(F.trim(_col(c))), F.lit(" "), F.lit("")) for c in (a, b))
    common = F.size(F.array_intersect(F.array_distinct(F.split(x, "")), F.array_distinct(F.split(y, ""))))
    close = x.contains(y) | y.contains(x) | (common / F.greatest(F.length(x), F.length(y)) >= least)
    return F.coalesce((_col(a) != "") & (_col(b) != "") & close, F.lit(False))


def surname_variants(name: Column | str) -> Column:
    first = F.substring(_col(name), 1, 1)
    out = F.array(F.initcap(korean.romanised(first)))
    for k, v in SURNAMES.items():
        out = F.when(first == k, F.array(*map(F.lit, v))).otherwise(out)
    return out


def romanised_names(name: Column | str, verified: Column | None = None) -> Column:
    """Whole names by every spelling of the surname in three styles each: given surname, surname given, SURNAME given.

    A verified name stands alone. The surname is the first character. Null and empty names have none.
    """
    given = F.initcap(korean.romanised(F.substring(_col(name), 2, 100)))
    styles = lambda s: F.array(F.concat_ws(" ", given, s), F.concat_ws(" ", s, given), F.concat_ws(" ", F.upper(s), given))
    found = F.when(F.coalesce(_col(name), F.lit("")) != "", F.flatten(F.transform(surname_variants(name), styles))).otherwise(F.array().cast("array<string>"))
    return found if verified is None else F.when(verified.isNotNull(), F.array(verified)).otherwise(found)


def name_candidates(name: Column | str, verified: Column | None = None) -> Column:
    """array of (full_name, surname, given, order, confidence, source): a verified name alone, else romanisations.

    The n-th spelling of the surname has confidence 0.7 - 0.1 n in western order, 0.05 less in eastern order.
    """
    given = F.initcap(korean.romanised(F.substring(_col(name), 2, 100)))

    def one(surname: Column, n: Column, western: bool) -> Column:
        full = F.concat_ws(" ", given, surname) if western else F.concat_ws(" ", surname, given)
        sure = F.round(F.lit(0.7) - n * 0.1 - (0.0 if western else 0.05), 2)
        return F.struct(full.alias("full_name"), surname.alias("surname"), given.alias("given"), F.lit("western" if western else "eastern").alias("name_order"), sure.alias("confidence"), F.lit("romanization").alias("source"))

    made = F.flatten(F.transform(surname_variants(name), lambda s, n: F.array(one(s, n, True), one(s, n, False))))
    if verified is None:
        return made
    known = F.array(F.struct(verified.alias("full_name"), F.element_at(F.split(verified, " "), -1).alias("surname"), F.get(F.split(verified, " "), F.lit(0)).alias("given"), F.lit("western").alias("name_order"), F.lit(1.0).alias("confidence"), F.lit("verified").alias("source")))
    return F.when(verified.isNotNull(), known).otherwise(made)


def best_name(candidates: Column | str) -> Column:
    """The candidate of the highest confidence, the first on ties."""
    return F.aggregate(F.slice(_col(candidates), 2, 1000), F.get(_col(candidates), F.lit(0)), lambda best, c: F.when(c["confidence"] > best["confidence"], c).otherwise(best))


def name_score(name: Column | str, english: Column | str, verified: Column | None = None) -> Column:
    """1.0 for the verified name, 0.8 for a part of it, the confidence of an equal romanisation, 0.9 of it with the parts in another order, 0.5 for the surname, else 0."""
    low = F.lower(_col(english))
    parts = F.split(low, r"\s+")
    first = F.aggregate(
        name_candidates(name), F.lit(None).cast("double"),
        lambda found, c: F.coalesce(found, F.when(F.lower(c["full_name"]) == low, c["confidence"]).when(F.array_contains(parts, F.lower(c["surname"])) & F.array_contains(parts, F.lower(c["given"])), c["confidence"] * 0.9)),
    )
    listed = F.lit(False)
    for k, v in SURNAMES.items():
        listed = F.when(F.substring(_col(name), 1, 1) == k, _any_of(low, [s.lower() for s in v])).otherwise(listed)
    score = F.round(F.coalesce(first, F.when(listed, F.lit(0.5)), F.lit(0.0)), 4)
    if verified is None:
        return score
    bits = F.split(F.lower(verified), " ")
    return F.when(F.lower(verified) == low, F.lit(1.0)).when(F.exists(bits, lambda p: low.contains(p)), F.lit(0.8)).otherwise(score)


def special_id(name: Column | str, teams: Column | str, fixed: list[tuple[str, str, list[str]]], otherwise: Column) -> Column:
    """A fixed id for a listed name that was with one of the listed teams: fixed has (id, name, teams)."""
    out = otherwise
    for known, who, where in reversed(fixed):
        out = F.when((_col(name) == who) & F.arrays_overlap(_col(teams), F.array(*map(F.lit, where))), F.lit(known)).otherwise(out)
    return out


def changed_fields(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """map of field to (old, new) texts of the fields that differ, nulls compared as values."""
    pairs = [F.struct(F.lit(k).alias("key"), F.struct(before[k].cast("string").alias("old"), after[k].cast("string").alias("new")).alias("value")) for k in after]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: ~p["value"]["old"].eqNullSafe(p["value"]["new"])))


def competition_state(text: Column | str) -> Column:
    return lookup(_col(text), COMPETITION_STATES, F.lit("unknown"))


def match_state(code: Column | str) -> Column:
    return lookup(F.upper(_col(code)), MATCH_STATES, F.lit("unknown"))


def birth_year(*fields: Column | str) -> Column:
    """The first of the fields whose first four characters are a year."""
    return F.coalesce(*[F.expr("null").cast("int") if f is None else F.substring(_col(f).cast("string"), 1, 4).try_cast("int") for f in fields])


def page_count(html: Column | str) -> Column:
    """The page of the link to the last one, else the greatest page number of the pagination, else 1."""
    listed = F.regexp_extract(_col(html), r'(?s)<ul[^>]*class="[^"]*pagination[^"]*"[^>]*>(.*?)</ul>', 1)
    last = F.regexp_extract(listed, r"funcPage\((\d+)\)[^>]*>\s*마지막\s*<", 1).try_cast("int")
    numbers = F.transform(F.regexp_extract_all(listed, F.lit(r"<a[^>]*>\s*(\d+)\s*</a>"), 1), lambda n: n.try_cast("int"))
    return F.coalesce(last, F.greatest(F.array_max(numbers), F.lit(1)), F.lit(1))


def without_prefix(name: Column | str) -> Column:
    """A name without its bracketed legal form at the start."""
    return F.trim(F.regexp_replace(_col(name), r"^\s*\((사|주|재|학|의|합|유)\)\s*", ""))


def form_fields(body: Column | str) -> Column:
    """map of ``a=b&c=d``; of a repeated field the last one counts."""
    pairs = F.filter(F.split(_col(body), "&"), lambda p: p.contains("="))
    entry = F.transform(pairs, lambda p: F.split(p, "=", 2))
    names = F.transform(entry, lambda e: e[0])
    last = F.filter(entry, lambda e, i: F.array_position(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), e[0]) == 0)
    return F.map_from_arrays(F.transform(last, lambda e: e[0]), F.transform(last, lambda e: e[1]))


def verification(valid: Column, confidence: Column, extracted: Column, expected: Column, approve: float = 0.85, reject: float = 0.60) -> Column:
    """approved, rejected or pending by confidence, and by the name where one is expected."""
    named = F.coalesce(expected, F.lit("")) == ""
    ok = valid & (confidence >= approve) & (named | names_match(extracted, expected))
    return F.when(ok, F.lit("approved")).when((confidence < reject) | ~valid, F.lit("rejected")).otherwise(F.lit("pending"))
