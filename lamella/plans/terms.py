"""Terms, stored pages, brackets and validation rules over the benchmark tables, beside the same results in SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import korean
from ..functions import terms as M
from ..operators import brackets as K
from ..operators import quality as Q
from ..operators import rankings
from ..sources import endpoints as E
from .registry import query


def _of(values: list, n: Column) -> Column:
    """The value at n modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql_of(values: list, n: str) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][CAST({n} % {len(values)} AS INT) + 1]"


# Every name of a round: its type, and its code.
ROUND_TABLE = [
    ("Pool", None, "풀 예선 뿔 pool pool_round pool_rounds 풀라운드 예선전 poule".split()),
    ("DE", None, ["de", "본선", "d.e.", "direct elimination", "direct_elimination", "엘리미나시옹디렉트", "엘리미나시옹 디렉트", "엘리미나시옹_디렉트", "elimination directe", "de_bracket", "de_round", "de_rounds", "토너먼트", "녹아웃", "knockout", "elimination"]),
    ("final", None, ["gold_medal_bout", "금메달전"]), ("semifinal", None, ["semi-final", "semi_final"]), ("quarterfinal", None, ["quarter-final", "quarter_final"]),
    ("DE", "t256", ["256강", "256강전", "t256"]), ("DE", "t128", ["128강", "128강전", "t128"]), ("DE", "t64", ["64강", "64강전", "t64"]), ("DE", "t32", ["32강", "32강전", "t32"]), ("DE", "t16", ["16강", "16강전", "t16"]),
    ("DE", "t8", ["8강", "8강전", "t8", "quarterfinal"]), ("DE", "t4", ["4강", "4강전", "t4", "semifinal", "준결승"]), ("DE", "t2", ["결승", "결승전", "t2", "final"]), ("DE", "bronze", ["동메달전", "3위결정전", "bronze"]),
    ("Unknown", None, ["연습", "2강", "", "round of 16"]),
]
ROUND_WORDS = [form for *_, names in ROUND_TABLE for name in names for form in (name, f" {name.upper()} ", name.title())]
_ROUND_CASE = " ".join(f"WHEN '{name}' THEN '{kind}'" for kind, _, names in ROUND_TABLE for name in names)
_CODE_CASE = " ".join(f"WHEN '{name}' THEN '{code}'" for _, code, names in ROUND_TABLE if code for name in names)


@query(f"""
    WITH r AS (SELECT o_orderkey, {_sql_of(ROUND_WORDS, "o_orderkey")} AS term, CAST(o_custkey % 20 AS INT) AS a, CAST(o_custkey % 7 AS INT) AS b FROM orders),
    c AS (SELECT *, CASE lower(trim(term)) {_ROUND_CASE} END AS round_type, CASE lower(trim(term)) {_CODE_CASE} END AS round_code FROM r),
    d AS (SELECT *, CASE WHEN round_type IN ('Pool', 'Unknown') THEN round_type ELSE 'DE' END AS bout_type, coalesce(round_code, CASE WHEN round_type <> 'Unknown' THEN round_type END, term) AS round_canonical FROM c)
    SELECT o_orderkey, round_type, round_code, bout_type, round_canonical, CASE WHEN bout_type = 'DE' AND greatest(a, b) BETWEEN 10 AND 14 THEN 'de_10' WHEN bout_type = 'DE' THEN 'de_15' ELSE 'pool_5' END AS bout_format,
           CASE round_canonical WHEN 'Pool' THEN '예선' WHEN 'DE' THEN '본선' WHEN 'final' THEN '결승' WHEN 'semifinal' THEN '준결승' WHEN 'quarterfinal' THEN '8강' WHEN 't256' THEN '256강' WHEN 't128' THEN '128강' WHEN 't64' THEN '64강' WHEN 't32' THEN '32강' WHEN 't16' THEN '16강'
                                WHEN 't8' THEN '8강' WHEN 't4' THEN '준결승' WHEN 't2' THEN '결승' WHEN 'bronze' THEN '동메달전' ELSE round_canonical END AS display_ko,
           CASE round_canonical WHEN 'DE' THEN 'Direct Elimination' WHEN 'final' THEN 'Final' WHEN 'semifinal' THEN 'Semifinal' WHEN 'quarterfinal' THEN 'Quarterfinal' WHEN 't256' THEN 'Round of 256' WHEN 't128' THEN 'Round of 128' WHEN 't64' THEN 'Round of 64' WHEN 't32' THEN 'Round of 32'
                                WHEN 't16' THEN 'Round of 16' WHEN 't8' THEN 'Quarterfinal' WHEN 't4' THEN 'Semifinal' WHEN 't2' THEN 'Final' WHEN 'bronze' THEN 'Bronze Medal Bout' ELSE round_canonical END AS display_en,
           CASE WHEN bout_type = 'Pool' THEN 5 ELSE 15 END AS max_score FROM d""")
def round_terms(t):
    """All names of rounds, as they are, in capitals between spaces, and with capitals at their beginnings."""
    rows = t("orders").select("o_orderkey", _of(ROUND_WORDS, F.col("o_orderkey")).alias("term"), (F.col("o_custkey") % 20).cast("int").alias("a"), (F.col("o_custkey") % 7).cast("int").alias("b"))
    info = rows.withColumn("info", M.bout_info("term", "a", "b"))
    return info.select("o_orderkey", M.round_type("term").alias("round_type"), M.round_code("term").alias("round_code"), "info.*")


ORGANISATION_NAMES = {"서울체육고등학교": "Seoul Sports High School", "SK fencing LAB": "SK fencing LAB", "부산광역시청": "Busan Metropolitan City Hall", "강릉 여자중학교": "Gangneung Girls' Middle School", "가나 O-neil고 클럽": "Gana O-Neilgo Club", "경기 서울 협회": "Gyeonggi Seoul Association", "": ""}
TEAM_REGIONS = ["서울", "", None, "경기"]


@query(f"""
    WITH n AS (SELECT o_orderkey, {_sql_of(list(ORGANISATION_NAMES), "o_orderkey")} AS name, {_sql_of(TEAM_REGIONS, "o_custkey")} AS region, {_sql_of(["김소윤", "박가", "", None, "뷁나다"], "o_custkey")} AS person FROM orders)
    SELECT o_orderkey, CASE name {" ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in ORGANISATION_NAMES.items())} END AS english, CASE WHEN region IS NULL OR region = '' THEN '전국' ELSE region END || '(클럽)' AS team, coalesce(region, '전국') || '(클럽)' AS stored_team,
           CASE person WHEN '김소윤' THEN ['Soyun Kim', 'Kim Soyun', 'KIM Soyun', 'Soyun Gim', 'Gim Soyun', 'GIM Soyun'] WHEN '박가' THEN ['Ga Park', 'Park Ga', 'PARK Ga', 'Ga Pak', 'Pak Ga', 'PAK Ga', 'Ga Bak', 'Bak Ga', 'BAK Ga'] WHEN '뷁나다' THEN ['Nada Bwek', 'Bwek Nada', 'BWEK Nada'] ELSE CAST([] AS VARCHAR[]) END AS names FROM n""")
def organisation_terms(t):
    """English names of organisations, teams without their names in both ways, and romanised names in three styles."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    region, person = _of(TEAM_REGIONS, c), _of(["김소윤", "박가", "", None, "뷁나다"], c)
    return t("orders").select(
        "o_orderkey", korean.organisation_english(_of(list(ORGANISATION_NAMES), k)).alias("english"), korean.anonymous_team(F.lit("club"), region).alias("team"), korean.anonymous_team(F.lit("club"), region, True).alias("stored_team"),
        M.romanised_names(person).alias("names"),
    )


_RESULT_SQL = """r AS (SELECT o_orderkey, ['Y12', 'Y14', 'SR', 'E1'][CAST(o_custkey % 4 AS INT) + 1] AS age_group, ['PRO', 'CLUB'][CAST(o_orderkey % 2 AS INT) + 1] AS category, CASE WHEN o_orderkey % 7 = 0 THEN '국가대표 선발대회' WHEN o_orderkey % 11 > 0 THEN '회장배' END AS competition FROM orders)"""


def _results(t):
    age, kind = _of(["Y12", "Y14", "SR", "E1"], F.col("o_custkey")), _of(["PRO", "CLUB"], F.col("o_orderkey"))
    title = F.when(F.col("o_orderkey") % 7 == 0, "국가대표 선발대회").when(F.col("o_orderkey") % 11 > 0, "회장배")
    return t("orders").select("o_orderkey", age.alias("age_group"), kind.alias("category"), title.alias("competition"))


@query(f"""
    WITH {_RESULT_SQL} SELECT 'NT' AS ranking, o_orderkey FROM r WHERE category = 'PRO' AND competition LIKE '%국가대표%' UNION ALL SELECT 'Y12', o_orderkey FROM r WHERE age_group = 'Y12'
    UNION ALL SELECT 'Y14', o_orderkey FROM r WHERE age_group = 'Y14' AND category = 'PRO' UNION ALL SELECT 'SR', o_orderkey FROM r WHERE age_group = 'SR' AND category = 'CLUB'""")
def ranking_defaults(t):
    """Results that four rankings count, by the rules for the national team, for categories, and for ages without them."""
    asked = (("NT", None), ("Y12", "CLUB"), ("Y14", None), ("SR", "CLUB"))
    parts = [rankings.ranking_rows(_results(t), age, kind).select(F.lit(age).alias("ranking"), "o_orderkey") for age, kind in asked]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"WITH {_RESULT_SQL} SELECT competition IS NOT NULL AND competition LIKE '%국가대표%' AS national, o_orderkey FROM r")
def listed_events(t):
    rows = _results(t)
    some = lambda own: rankings.listed_events(rows, own).select(F.lit(own).alias("national"), "o_orderkey")
    return some(True).union(some(False))


@query("""
    SELECT o_orderkey, CAST(pow(2, ceil(log2(n))) AS INT) AS open_size, CASE WHEN size = 4 THEN '준결승' WHEN size IN (8, 16, 32, 64, 128) THEN size || '강' ELSE '32강' END AS start_round,
           CASE WHEN n = 1 THEN '결승_승자' WHEN n = 2 THEN '결승' WHEN n <= 4 THEN '준결승' WHEN n <= 8 THEN '8강' WHEN n <= 16 THEN '16강' WHEN n <= 32 THEN '32강' WHEN n <= 64 THEN '64강' ELSE '128강' END AS lost_in
    FROM (SELECT o_orderkey, CAST(o_custkey % 300 + 1 AS INT) AS n, CAST(pow(2, o_orderkey % 8 + 1) AS INT) AS size FROM orders)""")
def bracket_terms(t):
    n, size = (F.col("o_custkey") % 300 + 1).cast("int"), F.pow(F.lit(2), F.col("o_orderkey") % 8 + 1).cast("int")
    return t("orders").select("o_orderkey", M.open_bracket_size(n).alias("open_size"), M.start_round(size).alias("start_round"), M.lost_in(n).alias("lost_in"))


@query("""
    SELECT size, place, seed, seed + mate = size + 1 AS adds_up FROM (
        SELECT size, place, seed, CASE WHEN place % 2 = 1 THEN lead(seed) OVER w ELSE lag(seed) OVER w END AS mate FROM (
            SELECT 16 AS size, unnest(range(1, 17)) AS place, unnest([1, 16, 8, 9, 5, 12, 4, 13, 3, 14, 6, 11, 7, 10, 2, 15]) AS seed
            UNION ALL SELECT 32, unnest(range(1, 33)), unnest([1, 32, 16, 17, 9, 24, 8, 25, 5, 28, 12, 21, 13, 20, 4, 29, 3, 30, 14, 19, 11, 22, 6, 27, 7, 26, 10, 23, 15, 18, 2, 31])
            UNION ALL SELECT 4, unnest(range(1, 5)), unnest([1, 4, 2, 3]) UNION ALL SELECT 2, unnest(range(1, 3)), unnest([1, 2]))
        WINDOW w AS (PARTITION BY size ORDER BY place))""")
def seed_positions(t):
    sizes = t("region").where("r_regionkey < 4").select(_of([2, 4, 16, 32], F.col("r_regionkey")).alias("size"))
    rows = sizes.select("size", F.posexplode(K.seed_positions(F.col("size"))).alias("at", "seed"), K.match_pairs(F.col("size")).alias("pairs"), K.seed_positions(F.col("size")).alias("seeds"))
    pair = F.element_at("pairs", (F.col("at") / 2).cast("int") + 1)
    total = F.element_at("seeds", pair["first"]) + F.element_at("seeds", pair["second"])
    return rows.select("size", (F.col("at") + 1).cast("bigint").alias("place"), "seed", (total == F.col("size") + 1).alias("adds_up"))


@query("""
    SELECT c_custkey, coalesce(n, '') || '|' || coalesce(team, '') AS key, coalesce(split_part(coalesce(n, '') || '|' || coalesce(team, ''), '|', 1), '') AS name,
           substr(coalesce(n, '') || '|' || coalesce(team, ''), strpos(coalesce(n, '') || '|' || coalesce(team, ''), '|') + 1) AS team
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN 'P' || c_custkey END AS n, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'A|B' ELSE c_mktsegment END AS team FROM customer)""")
def player_keys(t):
    name = F.when(F.col("c_custkey") % 7 > 0, F.concat(F.lit("P"), F.col("c_custkey").cast("string")))
    team = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 5 == 1, F.lit("A|B")).otherwise(F.col("c_mktsegment"))
    rows = t("customer").select("c_custkey", M.player_key(name, team).alias("key"))
    return rows.withColumn("p", M.key_parts("key")).select("c_custkey", "key", "p.name", "p.team")


AGE_CODES = ["E1", "E2", "E3", "MS", "HS", "UNI", "SR", "U17", "X"]
AGE_NAMES = ["여중", "남고", "대학부", "일반부", "U11", "초등고", "", "무명"]


@query(f"""
    WITH r AS (SELECT o_orderkey, {_sql_of(AGE_CODES, "o_orderkey")} AS code, {_sql_of(AGE_NAMES, "o_orderkey")} AS old_age, {_sql_of(AGE_NAMES, "o_custkey")} AS new_age, o_orderdate AS old_date, o_orderdate + INTERVAL 1 DAY * (CAST(o_custkey % 3 AS INT) - 1) AS new_date,
                      CAST(1995 + o_custkey % 20 AS INT) AS born, {_sql_of(["u9 epee", "Foil U 17", "U20", "senior", "U13 U9"], "o_orderkey")} AS event FROM orders),
    l AS (SELECT *, CASE old_age WHEN '여중' THEN 6 WHEN '남고' THEN 7 WHEN '대학부' THEN 8 WHEN '일반부' THEN 9 WHEN 'U11' THEN 2 WHEN '초등고' THEN 5 ELSE 0 END AS l1,
                    CASE new_age WHEN '여중' THEN 6 WHEN '남고' THEN 7 WHEN '대학부' THEN 8 WHEN '일반부' THEN 9 WHEN 'U11' THEN 2 WHEN '초등고' THEN 5 ELSE 0 END AS l2,
                    CASE regexp_extract(event, 'U *([0-9]+)', 1, 'i') WHEN '' THEN NULL ELSE 'U' || regexp_extract(event, 'U *([0-9]+)', 1, 'i') END AS category FROM r)
    SELECT o_orderkey, CASE code WHEN 'E1' THEN 'Y8' WHEN 'E2' THEN 'Y10' WHEN 'E3' THEN 'Y12' WHEN 'MS' THEN 'Y14' WHEN 'HS' THEN 'Cadet' WHEN 'U17' THEN 'Cadet' WHEN 'UNI' THEN 'Junior' WHEN 'SR' THEN 'Veteran' ELSE code END AS global_code,
           CASE code WHEN 'MS' THEN ['MS', 'U17'] WHEN 'HS' THEN ['HS', 'U17'] WHEN 'U17' THEN ['HS', 'U17'] ELSE [code] END AS legacy_codes,
           NOT (l1 > 0 AND l2 > 0 AND l2 < l1 AND new_date > old_date) AS valid, category,
           CASE WHEN category = 'U17' THEN CASE WHEN 2020 - born <= 15 THEN 'Y14' ELSE 'Cadet' END WHEN category = 'U9' THEN 'Y8' WHEN category = 'U13' THEN 'Y12' WHEN category = 'U20' THEN 'Junior' ELSE category END AS international,
           CASE WHEN l1 = 9 OR l2 = 9 THEN '일반' WHEN l1 = 8 OR l2 = 8 THEN '대학' WHEN l1 = 7 OR l2 = 7 THEN '고등' WHEN l1 = 6 OR l2 = 6 THEN '중등' WHEN l1 IN (2, 5) OR l2 IN (2, 5) THEN '초등' ELSE '일반' END AS highest
    FROM l""")
def age_terms(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    old, new, code = _of(AGE_NAMES, k), _of(AGE_NAMES, c), _of(AGE_CODES, k)
    later = F.date_add("o_orderdate", (c % 3).cast("int") - 1)
    category = M.age_category(_of(["u9 epee", "Foil U 17", "U20", "senior", "U13 U9"], k))
    return t("orders").select(
        "o_orderkey", M.global_code(code).alias("global_code"), M.legacy_codes(M.global_code(code)).alias("legacy_codes"), M.valid_progression(old, F.col("o_orderdate").cast("date"), new, later).alias("valid"), category.alias("category"),
        M.international_age(category, (F.lit(1995) + c % 20).cast("int"), 2020).alias("international"), M.highest_category(F.array(old, new)).alias("highest"),
    )


@query("""
    SELECT o_custkey, count(DISTINCT g) FILTER (g <> '') <= 1 AS one_gender FROM (SELECT o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN '' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END END AS g FROM orders) GROUP BY 1""")
def consistent_genders(t):
    g = F.when(F.col("o_orderkey") % 5 == 0, F.lit("F")).when(F.col("o_orderkey") % 5 == 1, F.lit("")).otherwise(F.when(F.col("o_custkey") % 2 == 0, F.lit("F")).otherwise(F.lit("M")))
    return t("orders").groupBy("o_custkey").agg(M.one_gender(F.collect_set(g)).alias("one_gender"))


@query("""
    WITH r AS (SELECT s_suppkey, lower(replace(trim(s_name), ' ', '')) AS x, lower(replace(trim(n_name), ' ', '')) AS y FROM supplier JOIN nation ON s_suppkey % 25 = n_nationkey)
    SELECT s_suppkey, y LIKE '%' || x || '%' OR x LIKE '%' || y || '%' OR len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(y, '')))) / greatest(length(x), length(y)) >= 0.3 AS alike FROM r""")
def name_similarity(t):
    rows = t("supplier").join(t("nation"), F.col("s_suppkey") % 25 == F.col("n_nationkey"))
    return rows.select("s_suppkey", M.names_match("s_name", "n_name", 0.3).alias("alike"))


KOREAN = ["김민수", "박민수", "한민수"]
ENGLISH = ["Minsu Kim", "Gim Minsu", "Park X Minsu", "Han", "Nobody", "Kim Minsu"]


@query(f"""
    WITH r AS (SELECT c_custkey, {_sql_of(KOREAN, "c_custkey")} AS name, {_sql_of(ENGLISH, "c_custkey // 3")} AS english FROM customer),
    v AS (SELECT * FROM (VALUES ('김민수', 'Kim', 0), ('김민수', 'Gim', 1), ('박민수', 'Park', 0), ('박민수', 'Pak', 1), ('박민수', 'Bak', 2), ('한민수', 'Han', 0)) AS v(name, surname, n)),
    c AS (SELECT name, 'Minsu ' || surname AS full_name, surname, n * 2 AS i, round(0.7 - 0.1 * n, 2) AS sure FROM v UNION ALL SELECT name, surname || ' Minsu', surname, n * 2 + 1, round(0.65 - 0.1 * n, 2) FROM v),
    m AS (SELECT r.c_custkey, min_by(CASE WHEN lower(full_name) = lower(english) THEN sure WHEN list_contains(string_split(lower(english), ' '), lower(surname)) AND list_contains(string_split(lower(english), ' '), 'minsu') THEN sure * 0.9 END,
                         CASE WHEN lower(full_name) = lower(english) OR list_contains(string_split(lower(english), ' '), lower(surname)) AND list_contains(string_split(lower(english), ' '), 'minsu') THEN i END) AS sure,
                 bool_or(lower(english) LIKE '%' || lower(surname) || '%') AS listed, count(*) AS candidates FROM r JOIN c USING (name) GROUP BY 1)
    SELECT r.c_custkey, candidates, CASE r.name WHEN '김민수' THEN 'Minsu Kim' WHEN '박민수' THEN 'Minsu Park' ELSE 'Minsu Han' END AS best,
           CASE WHEN r.c_custkey % 10 = 0 THEN CASE WHEN lower(english) = 'minsu kim' THEN 1.0 WHEN lower(english) LIKE '%minsu%' OR lower(english) LIKE '%kim%' THEN 0.8 ELSE round(coalesce(sure, CASE WHEN listed THEN 0.5 END, 0.0), 4) END
                ELSE round(coalesce(sure, CASE WHEN listed THEN 0.5 END, 0.0), 4) END::DOUBLE AS score
    FROM r JOIN m USING (c_custkey)""")
def name_candidates(t):
    rows = t("customer").select("c_custkey", _of(KOREAN, F.col("c_custkey")).alias("name"), _of(ENGLISH, F.floor(F.col("c_custkey") / 3)).alias("english"), F.when(F.col("c_custkey") % 10 == 0, F.lit("Minsu Kim")).alias("verified"))
    made = M.name_candidates("name")
    return rows.select("c_custkey", F.size(made).cast("bigint").alias("candidates"), M.best_name(made)["full_name"].alias("best"), M.name_score("name", "english", F.col("verified")).alias("score"))


@query("""
    WITH r AS (SELECT c_custkey, ' ' || c_mktsegment || ' ' AS a, trim(c_mktsegment) AS b, CASE WHEN c_custkey % 3 > 0 THEN 'x' END AS c, CASE WHEN c_custkey % 2 > 0 THEN 'x' END AS d FROM customer)
    SELECT c_custkey, 'team' AS field, a AS old, b AS new FROM r UNION ALL SELECT c_custkey, 'weapon', c, d FROM r WHERE c IS DISTINCT FROM d""")
def field_changes(t):
    rows = t("customer").select("c_custkey", F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("a"), F.when(F.col("c_custkey") % 3 > 0, F.lit("x")).alias("c"), F.when(F.col("c_custkey") % 2 > 0, F.lit("x")).alias("d"))
    changes = M.changed_fields({"team": F.col("a"), "weapon": F.col("c")}, {"team": F.trim("a"), "weapon": F.col("d")})
    return rows.select("c_custkey", F.explode(changes).alias("field", "v")).select("c_custkey", "field", "v.old", "v.new")


STATES, CODES = ["예정", "진행", "진행중", "종료", "취소"], ["V", "a", "F", "", "p"]
BIRTHS, LEGAL = [None, "1995", "1995-01-01", "unk"], ["(재) Club", "(주)Club ", " (사) Club", "Club (주)"]


@query(f"""
    SELECT o_orderkey, CASE {_sql_of(STATES, "o_orderkey")} WHEN '예정' THEN 'scheduled' WHEN '진행' THEN 'in_progress' WHEN '진행중' THEN 'in_progress' WHEN '종료' THEN 'completed' ELSE 'unknown' END AS competition_state,
           CASE upper({_sql_of(CODES, "o_custkey")}) WHEN 'V' THEN 'victory' WHEN 'A' THEN 'abandon' WHEN 'F' THEN 'forfeit' WHEN 'P' THEN 'penalty' ELSE 'unknown' END AS match_state,
           coalesce(try_cast(substr({_sql_of(BIRTHS, "o_orderkey")}, 1, 4) AS INT), try_cast(substr({_sql_of(BIRTHS, "o_custkey")}, 1, 4) AS INT)) AS birth_year,
           CASE WHEN o_orderkey % 4 = 3 THEN 'Club (주)' ELSE 'Club' END AS bare_name, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN CAST(o_custkey % 40 + 3 AS INT) ELSE 12 END AS pages, CAST(o_custkey AS VARCHAR) AS posted
    FROM orders""")
def parser_terms(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    listed = F.concat(F.lit('<ul class="pagination"><li><a href="#">1</a><a> 3 </a><a onclick="funcPage('), (c % 40 + 3).cast("string"), F.lit(')">마지막</a></li></ul>'))
    page = F.when(k % 3 == 0, F.lit("<p>none</p>")).when(k % 3 == 1, listed).otherwise(F.lit('<ul class="pagination"><a>2</a><a>12</a><a>next</a></ul>'))
    body = F.concat(F.lit("a=1&b&a="), c.cast("string"), F.lit("&c=x=y"))
    return t("orders").select(
        "o_orderkey", M.competition_state(_of(STATES, k)).alias("competition_state"), M.match_state(_of(CODES, c)).alias("match_state"), M.birth_year(_of(BIRTHS, k), _of(BIRTHS, c)).alias("birth_year"), M.without_prefix(_of(LEGAL, k)).alias("bare_name"),
        M.page_count(page).alias("pages"), M.form_fields(body)["a"].alias("posted"),
    )


# -- stored answers ------------------------------------------------------------------------------------


def _answers(t):
    """Every order as a stored answer: its lines are matches, the order an event with a player and a rank."""
    line = F.struct(
        F.lit("8강").alias("roundNm"), F.col("l_returnflag").alias("grpNm"), F.col("l_linenumber").cast("string").alias("matchNo"), F.when(F.col("l_suppkey") % 9 > 0, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("upPlyNm"), F.col("l_quantity").cast("int").cast("string").alias("upScore"),
        F.when(F.col("l_partkey") % 9 > 0, F.concat(F.lit(" P"), F.col("l_partkey").cast("string"))).alias("downPlyNm"), F.lit("x").alias("downScore"), F.when(F.col("l_linestatus") == "O", F.lit("v")).otherwise(F.lit("Q")).alias("winGbn"),
    )
    return t("lineitem").groupBy(F.col("l_orderkey").alias("event_cd")).agg(F.to_json(F.struct(F.collect_list(line).alias("matchInfoList"))).alias("body"))


@query("""
    SELECT l_orderkey AS event_cd, '8강' AS round_name, l_returnflag AS group_name, CAST(l_linenumber AS INT) AS match_number, CASE WHEN l_suppkey % 9 > 0 THEN 'S' || l_suppkey ELSE '' END AS player1_name, CAST(l_quantity AS INT) AS player1_score,
           CASE WHEN l_partkey % 9 > 0 THEN 'P' || l_partkey ELSE '' END AS player2_name, CAST(NULL AS INT) AS player2_score, CASE WHEN l_linestatus = 'O' THEN 'victory' ELSE 'unknown' END AS match_status
    FROM lineitem WHERE l_suppkey % 9 > 0 OR l_partkey % 9 > 0""")
def endpoint_matches(t):
    return E.matches(_answers(t))


@query("""
    WITH m AS (SELECT l_orderkey, count(*) AS n, max(CAST(l_quantity AS INT)) AS top FROM lineitem WHERE l_suppkey % 9 > 0 OR l_partkey % 9 > 0 GROUP BY 1)
    SELECT o_orderkey AS event_cd, 'E' || o_orderkey % 10 AS sub_event_cd, o_orderpriority AS event_name, 1 AS players, 1980 + CAST(o_custkey % 30 AS INT) AS born, CASE WHEN o_custkey % 4 > 0 THEN 1 ELSE 0 END AS ranks, coalesce(n, 0) AS matches, top
    FROM orders LEFT JOIN m ON o_orderkey = l_orderkey""")
def endpoint_composite(t):
    orders = t("orders").select(F.col("o_orderkey").alias("event_cd"), "o_custkey", "o_orderpriority")
    year = (F.lit(1980) + F.col("o_custkey") % 30).cast("string")
    body = lambda *fields: F.to_json(F.array(F.struct(*fields))).alias("body")
    events = E.events(orders.select("event_cd", body(F.concat(F.lit("E"), (F.col("event_cd") % 10).cast("string")).alias("subEventCd"), F.col("o_orderpriority").alias("subEventNm"))))
    people = E.players(orders.select("event_cd", body(F.lit(" A ").alias("playerNm"), F.lit("T").alias("teamNm"), F.lit("").alias("birthYear"), F.concat(year, F.lit("-02-03")).alias("birthDate"))))
    ranks = E.ranks(orders.select("event_cd", body(F.when(F.col("o_custkey") % 4 > 0, F.lit("1")).otherwise(F.lit("-")).alias("rank"), F.lit("A").alias("playerNm"), F.lit("T").alias("teamNm"))))
    whole = E.competition(events, people, E.matches(_answers(t)), ranks, ["event_cd"])
    top = F.array_max(F.transform("matches", lambda m: m["player1_score"]))
    return whole.select("event_cd", "sub_event_cd", "event_name", F.size("players").alias("players"), F.element_at("players", 1)["birth_year"].alias("born"), F.size("ranks").alias("ranks"), F.size("matches").cast("bigint").alias("matches"), top.alias("top"))


@query("SELECT o_orderkey, [o_orderpriority, '결승'] AS rounds, CASE WHEN o_orderkey % 2 = 0 THEN ['A'] ELSE [] END AS groups FROM orders")
def endpoint_tableau(t):
    groups = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("A")))
    return E.tableau(t("orders").select("o_orderkey", F.to_json(F.struct(F.array("o_orderpriority", F.lit("결승")).alias("roundNmList"), groups.alias("groupKindList"))).alias("body")))


@query("SELECT event_type AS path, count(*) AS calls, substr(arg_min(props, (ts, props)), 1, 20) AS sample FROM events GROUP BY 1")
def endpoint_calls(t):
    return E.endpoint_report(t("events").withColumnRenamed("event_type", "path"), "path", "props", "ts", 20)


@query("""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'running' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(CASE WHEN o_orderkey % 6 = 0 THEN 'ok' END, o_comment) ELSE o_comment END AS note FROM (SELECT *, o_orderpriority AS o_comment FROM orders)""")
def job_log(t):
    entries = t("orders").select(F.col("o_orderkey").alias("id"), F.lit("running").alias("status"), F.col("o_orderpriority").alias("note"))
    updates = t("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("done").alias("status"), F.when(F.col("o_orderkey") % 6 == 0, F.lit("ok")).alias("note"))
    return E.job_log(entries, updates, "id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS bracket, o_orderpriority AS title FROM orders")
def merged_brackets(t):
    rows = t("orders").select("o_orderkey", F.struct(F.col("o_orderpriority").alias("title"), F.lit("old").alias("bracket")).alias("raw"))
    new = t("orders").where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("new").alias("bracket"))
    return E.with_bracket(rows, new, "o_orderkey").select("o_orderkey", "raw.bracket", "raw.title")


# -- brackets held against ranks -------------------------------------------------------------------------

_RANKS_SQL = """
    k AS (SELECT o_custkey AS e, 'N' || row_number() OVER w AS name, CAST(CASE WHEN row_number() OVER w = 4 THEN 3 ELSE row_number() OVER w END AS INT) AS rank FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    b AS (SELECT e, 1 AS number, '준결승' AS round, 'N1' AS winner, 'N3' AS loser FROM k WHERE name = 'N3' UNION ALL SELECT e, 2, '준결승', 'N2', 'N4' FROM k WHERE name = 'N4'
          UNION ALL SELECT e, 3, '결승', CASE WHEN e % 5 = 0 THEN 'N2' ELSE 'N1' END, CASE WHEN e % 5 = 0 THEN 'N1' ELSE 'N2' END FROM k WHERE name = 'N2' AND e % 7 > 0
          UNION ALL SELECT e, 4, '결승', 'N1', 'N4' FROM k WHERE name = 'N4' AND e % 3 = 0)"""


def _ranks(t):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = t("orders").select(F.col("o_custkey").alias("e"), n.alias("n"))
    ranks = rows.select("e", F.concat(F.lit("N"), F.col("n").cast("string")).alias("name"), F.when(F.col("n") == 4, 3).otherwise(F.col("n")).alias("rank"))
    bout = lambda number, name, winner, loser: F.struct(F.lit(number).alias("number"), F.lit(name).alias("round"), F.lit(winner).alias("winner"), F.lit(loser).alias("loser"))
    final = F.when(F.col("e") % 5 == 0, bout(3, "결승", "N2", "N1")).otherwise(bout(3, "결승", "N1", "N2"))
    made = F.array_compact(F.array(
        F.when(F.col("n") == 3, bout(1, "준결승", "N1", "N3")), F.when(F.col("n") == 4, bout(2, "준결승", "N2", "N4")), F.when((F.col("n") == 2) & (F.col("e") % 7 > 0), final), F.when((F.col("n") == 4) & (F.col("e") % 3 == 0), bout(4, "결승", "N1", "N4")),
    ))
    return ranks, rows.select("e", F.explode(made).alias("b")).select("e", "b.*")


@query(f"""
    WITH {_RANKS_SQL},
    f AS (SELECT k.e, max(CASE WHEN number = 3 THEN winner END) AS w3, max(CASE WHEN number = 3 THEN loser END) AS l3, max(CASE WHEN number = 4 THEN winner END) AS w4, max(CASE WHEN number = 4 THEN loser END) AS l4, count(number) AS bouts, count(w) AS finals
          FROM (SELECT DISTINCT e FROM k) k LEFT JOIN (SELECT *, CASE WHEN round = '결승' THEN winner END AS w FROM b) b USING (e) GROUP BY 1),
    u AS (SELECT *, CASE WHEN w3 = 'N1' THEN w3 WHEN w4 = 'N1' THEN w4 ELSE w3 END AS w, CASE WHEN w3 = 'N1' THEN l3 WHEN w4 = 'N1' THEN l4 ELSE l3 END AS l FROM f)
    SELECT e, bouts > 0 AND finals > 0 AND w = 'N1' AS valid, w AS final_winner,
           list_filter([CASE WHEN bouts = 0 THEN 'nothing to compare' END, CASE WHEN bouts > 0 AND finals = 0 THEN 'no final' END, CASE WHEN finals > 0 AND w <> 'N1' THEN 'champion is not first' END], lambda x: x IS NOT NULL) AS issues,
           list_filter([CASE WHEN finals > 1 THEN 'several finals' END, CASE WHEN l <> 'N2' THEN 'finalist is not second' END], lambda x: x IS NOT NULL) AS warnings FROM u""")
def bracket_against_ranks(t):
    ranks, bouts = _ranks(t)
    got = K.against_ranks(bouts, ranks, ["e"])
    return got.withColumn("valid", F.coalesce("valid", F.lit(False)))


@query(f"""
    WITH {_RANKS_SQL}, o AS (SELECT e, least(winner, loser) AS low, greatest(winner, loser) AS high, winner FROM b)
    SELECT e, low, high, winner AS old_winner, CASE WHEN winner = low THEN high ELSE low END AS new_winner FROM o WHERE e % 2 = 0""")
def changed_winners(t):
    _, bouts = _ranks(t)
    swap = F.col("e") % 2 == 0
    after = bouts.select("e", F.when(swap, F.col("loser")).otherwise(F.col("winner")).alias("winner"), F.when(swap, F.col("winner")).otherwise(F.col("loser")).alias("loser"))
    return K.changed_winners(bouts, after, ["e"])


@query(f"""
    WITH {_RANKS_SQL}, n AS (SELECT e, count(*) AS n FROM k GROUP BY 1)
    SELECT e, '결승' AS round, 'N1' AS winner, 'N2' AS loser, true AS inferred FROM n WHERE n >= 2 UNION ALL SELECT e, '준결승', 'N1', 'N3', true FROM n WHERE n >= 3 UNION ALL SELECT e, '준결승', 'N2', 'N4', true FROM n WHERE n >= 4""")
def inferred_finals(t):
    return K.inferred_finals(_ranks(t)[0], ["e"])


@query("""
    SELECT o_orderkey, '8강' AS round, 1 + a AS winner_seed, 'A' || (1 + a) AS winner_name, 15 AS winner_score, 2 - a AS loser_seed, 'A' || (2 - a) AS loser_name, 7 AS loser_score, 1 AS rounds, 15 AS listed
    FROM (SELECT o_orderkey, CAST(o_orderkey % 2 AS INT) AS a FROM orders WHERE o_custkey % 4 > 0)""")
def full_bouts(t):
    second = F.col("o_orderkey") % 2 == 1
    rows = t("orders").select(
        "o_orderkey", F.lit("8강").alias("round"), F.lit(1).alias("seed1"), F.lit("A1").alias("name1"), F.when(second, 7).otherwise(15).alias("score1"), F.lit(2).alias("seed2"), F.when(F.col("o_custkey") % 4 > 0, F.lit("A2")).alias("name2"),
        F.when(second, 15).otherwise(7).alias("score2"), F.when(second, 2).otherwise(1).alias("winner_seed"),
    )
    full = K.full_bouts(rows, ["o_orderkey"])
    legacy = K.legacy_rounds(full, ["o_orderkey"])
    return full.join(legacy.select("o_orderkey", F.size("results_by_round").alias("rounds"), F.element_at("results_by_round", "8강")[0]["score"].alias("listed")), "o_orderkey")


# -- rules ---------------------------------------------------------------------------------------------

EVENT_NAMES = ["남자 에뻬", "여자 단체", "사브르 개인", "", "마라톤"]


@query(f"""
    WITH r AS (SELECT o_orderkey, {_sql_of(EVENT_NAMES, "o_orderkey")} AS n, CAST(o_custkey % 10 AS INT) - 1 AS p FROM orders)
    SELECT o_orderkey, n <> '' AND p >= 0 AS can_save, CASE WHEN n = '' THEN 1 ELSE 0 END + CASE WHEN p < 0 THEN 1 ELSE 0 END + CASE n WHEN '여자 단체' THEN 1 WHEN '사브르 개인' THEN 1 WHEN '마라톤' THEN 2 ELSE 0 END AS problems FROM r""")
def event_checks(t):
    rows = t("orders").select("o_orderkey", _of(EVENT_NAMES, F.col("o_orderkey")).alias("event_name"), ((F.col("o_custkey") % 10) - 1).cast("int").alias("participants"))
    named = rows.withColumn("f", korean.event_fields("event_name")).select("*", "f.weapon", "f.gender")
    return Q.validate(named, Q.event_rules()).select("o_orderkey", "can_save", F.size("errors").alias("problems"))


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN '' ELSE 'C' || l_orderkey END AS name, CAST(l_shipdate AS DATE) AS s, CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_receiptdate AS DATE) - CASE WHEN l_linenumber = 2 THEN 40 ELSE 0 END END AS e
               FROM (SELECT *, l_shipdate + INTERVAL 20 DAY AS l_receiptdate FROM lineitem))
    SELECT l_orderkey, l_linenumber, name <> '' AND NOT coalesce(e < s, false) AS can_save, CASE WHEN e < DATE '1998-06-01' THEN '종료' WHEN s <= DATE '1998-06-01' THEN '진행중' ELSE '예정' END AS status FROM r""")
def competition_checks(t):
    end = F.date_sub(F.date_add(F.col("l_shipdate").cast("date"), 20), F.when(F.col("l_linenumber") == 2, 40).otherwise(0))
    rows = t("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("comp_idx"), F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(F.concat(F.lit("C"), F.col("l_orderkey").cast("string"))).alias("comp_name"),
        F.col("l_shipdate").cast("date").alias("start_date"), F.when(F.col("l_linenumber") != 6, end).alias("end_date"),
    )
    checked = Q.validate(rows, Q.competition_rules())
    return checked.select("l_orderkey", "l_linenumber", "can_save", Q.competition_status("start_date", "end_date", "1998-06-01", F.lit("unknown")).alias("status"))


@query("""
    WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'M' ELSE 'F' END AS gender, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS weapon FROM orders),
    s AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS g, '1-URGENT' AS w FROM customer WHERE c_custkey % 5 > 0)
    SELECT o_orderkey, 'gender' AS field, g AS old, gender AS new FROM r JOIN s ON o_custkey = c_custkey WHERE g <> gender UNION ALL SELECT o_orderkey, 'weapon', w, weapon FROM r JOIN s ON o_custkey = c_custkey WHERE w <> weapon AND weapon <> ''""")
def inconsistent_fields(t):
    rows = t("orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("M")).otherwise(F.lit("F")).alias("gender"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("weapon"))
    stored = t("customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.lit("M")).otherwise(F.lit("F")).alias("gender"), F.lit("1-URGENT").alias("weapon"))
    keyed = rows.join(stored.withColumnsRenamed({"gender": "g", "weapon": "w"}), "o_custkey").select("o_orderkey", F.col("g").alias("gender"), F.col("w").alias("weapon"))
    return Q.inconsistent(rows.drop("o_custkey"), keyed, "o_orderkey", ["gender", "weapon"])


@query("SELECT l_suppkey, l_partkey, count(*) AS times FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_matches(t):
    return Q.repeated(t("lineitem"), ["l_suppkey", "l_partkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-15' - INTERVAL 14 YEAR + INTERVAL 11 YEAR AND o_custkey % 3 = 0")
def guardian_missing(t):
    rows = t("orders").select("o_orderkey", F.add_months(F.col("o_orderdate").cast("date"), -132).alias("born"), F.when(F.col("o_custkey") % 3 > 0, F.lit("G")).alias("guardian"))
    return Q.guardian_missing(rows, "born", "guardian", "2000-01-15").select("o_orderkey")


@query("""
    SELECT event_id, CASE WHEN valid AND c >= 0.85 AND (expected = '' OR matched) THEN 'approved' WHEN c < 0.6 OR NOT valid THEN 'rejected' ELSE 'pending' END AS decision
    FROM (SELECT event_id, event_id % 11 > 0 AS valid, (event_id % 100) / 100.0 AS c, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Kim' END AS expected, event_id % 4 > 0 AS matched FROM events)""")
def verification_decisions(t):
    k = F.col("event_id")
    named = F.when(k % 4 > 0, F.lit("kim ")).otherwise(F.lit("Zzz"))
    return t("events").select("event_id", M.verification(k % 11 > 0, (k % 100) / 100, named, F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("Kim"))).alias("decision"))


@query("SELECT event_id, user_id % 5 = 0 AS acknowledged, (event_id % 1000) * 10 AS latency FROM events")
def alerts(t):
    rows = t("events").select("event_id", "user_id", Q.latency_ms("ts", F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) + F.col("event_id") % 1000 * 10)).alias("latency"))
    done = rows.where("user_id % 5 = 0").select("event_id")
    return Q.acknowledged(rows, "event_id", done).select("event_id", "acknowledged", "latency")
