"""Classification, normalisation, points and privacy as Column expressions."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyword_case(text: Column | str, table: list[tuple[object, list[str]]], otherwise: object = None) -> Column:
    """The label of the first entry with a keyword inside the text."""
    text, out = _col(text), None
    for label, words in table:
        hit = reduce(lambda a, b: a | b, [text.contains(w) for w in words])
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def ladder(value: Column | str, steps: list[tuple[float, float]], otherwise: float, down: bool = False) -> Column:
    """A step function: the first step with value <= bound, or >= bound when ``down``."""
    value, out = _col(value), None
    for bound, result in steps:
        hit = value >= bound if down else value <= bound
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def lookup(value: Column | str, table: dict, otherwise: Column | object = None) -> Column:
    """The table's entry, else ``otherwise``; null values have none."""
    value, out = _col(value), None
    for key, result in table.items():
        out = F.when(value == key, F.lit(result)) if out is None else out.when(value == key, F.lit(result))
    return out.otherwise(otherwise)


def alias(value: Column | str, table: dict[str, str]) -> Column:
    """Canonical spelling by trimmed lower-case key; an unknown value passes trimmed."""
    value = _col(value)
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable((k.lower(), v) for k, v in table.items())])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(value))), F.trim(value))


def rank_ratio(rank: Column | str) -> Column:
    """Share of the points for a rank; ranks below 1 count as the last step."""
    rank = _col(rank)
    return F.when(rank < 1, F.lit(V.OTHER_RATIO)).otherwise(ladder(rank, V.RANK_RATIOS, V.OTHER_RATIO))


def participant_factor(n: Column | str) -> Column:
    return ladder(n, V.PARTICIPANT_FACTORS, V.FEW_FACTOR, down=True)


def age_weight(age: Column | str) -> Column:
    return lookup(age, V.AGE_WEIGHTS, F.lit(1.0))


def points(tier: Column | str, rank: Column | str, participants: Column | str, age: Column | str) -> Column:
    """tier x ratio x factor x weight, to two places, half to even."""
    base = lookup(tier, V.TIER_POINTS, F.lit(V.UNKNOWN_TIER_POINTS))
    return F.bround(base * rank_ratio(rank) * participant_factor(participants) * age_weight(age), 2)


def competition_tier(name: Column | str) -> Column:
    return keyword_case(name, V.TIER_KEYWORDS, "C")


def club_or_pro(name: Column | str) -> Column:
    return keyword_case(name, [("CLUB", V.CLUB_KEYWORDS)], "PRO")


def competition_class(name: Column | str) -> Column:
    return keyword_case(name, [("NATIONAL", [V.NATIONAL_KEYWORD]), ("AMATEUR", V.AMATEUR_KEYWORDS)], "ELITE")


def legacy_age(name: Column | str) -> Column:
    """Age code of an event name; student and senior names last, else SR."""
    name = _col(name)
    late = F.when(name.rlike("대학|U20|U23|20세이하|[남여]대\\s"), "UNI").when(name.rlike("일반|시니어|Senior"), "SR").when(name.rlike("^(남대|여대)"), "UNI").otherwise("SR")
    return F.coalesce(keyword_case(name, V.LEGACY_AGE_KEYWORDS), late)


def gender(name: Column | str) -> Column:
    """F before M, empty if neither is named."""
    name = _col(name)
    return F.when(name.rlike("여자|여중|여고|여대|여초"), "F").when(name.rlike("남자|남중|남고|남대|남초"), "M").otherwise("")


def first_pattern(text: Column | str, patterns: list[str]) -> Column:
    """The first group of the first pattern found; null if none is."""
    text = _col(text)
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def age_token(name: Column | str) -> Column:
    return first_pattern(name, V.AGE_TOKENS)


def age_level(token: Column | str) -> Column:
    return keyword_case(token, [(level, words) for words, level in V.AGE_LEVELS], 0)


def team_type(team: Column | str) -> Column:
    team = F.trim(_col(team))
    out = None
    for kind, pattern in V.TEAM_TYPES:
        out = F.when(team.rlike(pattern), kind) if out is None else out.when(team.rlike(pattern), kind)
    return out.otherwise("club")


def school_level(team: Column | str) -> Column:
    return lookup(team_type(team), V.SCHOOL_LEVELS, F.lit(0))


def letter_rating(best: Column | str, latest_year: Column | str) -> Column:
    """A to E by best rank, else U, and the last two digits of the latest year."""
    best = _col(best)
    letter = F.when(best == 1, "A").when(best == 2, "B").when(best <= 4, "C").when(best <= 8, "D").when(best <= 16, "E").otherwise("U")
    return F.concat(letter, F.lpad((_col(latest_year) % 100).cast("string"), 2, "0"))


def win_rate(wins: Column, total: Column, places: int = 1) -> Column:
    """Per cent, half to even; 0 without bouts."""
    return F.coalesce(F.bround(F.try_divide(wins * F.lit(100.0), total), places), F.lit(0.0))


def safe_int(value: Column | str) -> Column:
    return F.coalesce(_col(value).try_cast("int"), F.lit(0))


def score_of(value: Column | str) -> Column:
    """A score given as {"score": n}, as n, or as "a-b" / "a:b" (the first number)."""
    value = _col(value)
    json = F.get_json_object(value, "$.score").try_cast("int")
    return F.coalesce(json, value.try_cast("int"), F.nullif(F.regexp_extract(value, r"^\s*(\d+)\s*[-:]", 1), F.lit("")).try_cast("int"))


def mask_email(email: Column | str) -> Column:
    """The first two characters of the name stay (one, if it has two or fewer)."""
    email = _col(email)
    name, rest = F.substring_index(email, "@", 1), F.substring_index(email, "@", -1)
    shown = F.when(F.length(name) <= 2, 1).otherwise(2)
    masked = F.concat(F.left(name, shown), F.repeat(F.lit("*"), F.greatest(F.length(name) - shown, F.lit(1))), F.lit("@"), rest)
    return F.when(email.contains("@"), masked).otherwise(email)


def mask_phone(phone: Column | str) -> Column:
    """First three and last four digits stay; under seven digits nothing does."""
    digits = F.regexp_replace(_col(phone), "[^0-9]", "")
    return F.when(F.length(digits) >= 7, F.concat(F.left(digits, F.lit(3)), F.lit("-****-"), F.right(digits, F.lit(4)))).otherwise(F.lit("****"))


def initials(name: Column | str, joint: str = ".") -> Column:
    """First letters of the words of a name, upper-case."""
    words = F.filter(F.split(F.trim(_col(name)), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.concat(F.array_join(F.transform(words, lambda w: F.upper(F.left(w, F.lit(1)))), joint), F.lit(joint))


def full_years(since: Column | str, as_of: Column | str) -> Column:
    return F.floor(F.months_between(F.to_date(_col(as_of)), F.to_date(_col(since))) / 12).cast("int")


def pair_key(a: Column | str, b: Column | str) -> Column:
    """An unordered pair."""
    return F.struct(F.least(_col(a), _col(b)).alias("low"), F.greatest(_col(a), _col(b)).alias("high"))


def ip_allowed(allowed: Column | str, ip: Column | str) -> Column:
    """Exact, or by prefix where an entry ends in ``.*``."""
    ip = _col(ip)
    return F.coalesce(F.exists(_col(allowed), lambda x: (ip == x) | (x.endswith(".*") & ip.startswith(F.left(x, F.length(x) - 1)))), F.lit(False))


def bracket_size(n: Column | str) -> Column:
    """The next of 4, 8, ... 128."""
    return ladder(n, [(2**k, 2**k) for k in range(2, 7)], 128)


def round_by_count(n: Column | str) -> Column:
    return ladder(n, [(1, V.FINAL), (2, V.SEMIFINAL), (4, "8강"), (8, "16강"), (16, "32강")], "64강")


def round_label(name: Column | str) -> Column:
    """A round's plain name: without the last syllable of ``...전``; 4강 is the semifinal."""
    plain = F.regexp_replace(F.trim(_col(name)), "(?<=.)전$", "")
    return F.when(plain == "4강", F.lit(V.SEMIFINAL)).otherwise(plain)


def round_order(name: Column | str) -> Column:
    return lookup(round_label(name), V.ROUND_ORDER, F.lit(99))


def hangul_parts(ch: Column | str) -> Column:
    """Initial, vowel and final numbers of a Hangul syllable; null for other characters."""
    at = F.ascii(_col(ch)) - 44032
    parts = F.struct(F.floor(at / 588).cast("int").alias("initial"), F.floor((at % 588) / 28).cast("int").alias("vowel"), (at % 28).cast("int").alias("final"))
    return F.when(_col(ch).rlike("^[가-힣]$"), parts)
