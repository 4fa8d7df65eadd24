"""Vocabularies and constants that results depend on, in their order of precedence."""

# Points: base of each tier, share of each rank, factor of participants, weight of age groups.
TIER_POINTS = {"S": 1000, "A": 800, "B": 500, "C": 300, "D": 400}
UNKNOWN_TIER_POINTS = 300
RANK_RATIOS = [(1, 1.00), (2, 0.80), (3, 0.65), (4, 0.55), (8, 0.40), (16, 0.25), (32, 0.15), (64, 0.08)]
OTHER_RATIO = 0.04
PARTICIPANT_FACTORS = [(64, 1.0), (32, 0.9), (16, 0.8), (8, 0.6)]
FEW_FACTOR = 0.4
AGE_WEIGHTS = {
    "Y8": 0.4, "E1": 0.4, "Y10": 0.5, "E2": 0.5, "Y12": 0.6, "E3": 0.6, "Y14": 0.7, "MS": 0.7,
    "U17": 0.75, "Cadet": 0.8, "HS": 0.8, "Junior": 0.9, "UNI": 0.9, "Veteran": 1.0, "SR": 1.0,
}

# Keywords of competition tiers; the first hit wins, else C.
TIER_KEYWORDS = [
    ("S", ["전국체전", "회장배", "대통령배"]),
    ("A", ["선수권", "챔피언십", "Championship"]),
    ("D", ["인터내셔널", "International", "국제"]),
    ("B", ["시도대항", "협회장배", "도지사배", "시장배"]),
]
CLUB_KEYWORDS = ["클럽", "동호인", "생활체육", "아마추어", "Club", "Amateur", "동호회"]
AMATEUR_KEYWORDS = ["동호인", "클럽", "생활체육", "아마추어", "Club", "Amateur"]
NATIONAL_KEYWORD = "국가대표"

# Age codes by keyword; the first hit wins.
LEGACY_AGE_KEYWORDS = [
    ("E1", ["9세이하", "U9", "9세", "1-2학년", "1~2학년", "초등1", "초등2"]),
    ("E2", ["11세이하", "U11", "11세", "3-4학년", "3~4학년", "초등3", "초등4"]),
    ("E3", ["13세이하", "U13", "13세", "5-6학년", "5~6학년", "초등5", "초등6"]),
    ("U17", ["17세이하", "U17"]),
    ("MS", ["중등", "중학", "U15", "남중", "여중"]),
    ("HS", ["고등", "고교", "U18", "남고", "여고"]),
]
LEGACY_TO_GLOBAL = {"E1": "Y8", "E2": "Y10", "E3": "Y12", "MS": "Y14", "HS": "Cadet", "UNI": "Junior", "SR": "Veteran"}
AGE_LEVELS = [
    (["U9", "Y9"], 1), (["U11", "Y11"], 2), (["U13", "Y13"], 3), (["초등저"], 4), (["초등고", "초등부"], 5),
    (["U14", "Y14", "여중", "남중", "중등부"], 6), (["U17", "Y17", "여고", "남고", "고등부"], 7),
    (["U20", "Y20", "대학", "청년부"], 8), (["일반부", "일반"], 9), (["시니어"], 10),
]
AGE_TOKENS = [
    "(여중|남중|여고|남고|여대|남대)",
    r"(\d+세이하부)",
    "(초등부|중등부|고등부|대학부|일반부|초등저|초등고)",
    r"([UY]\d+)",
    "(시니어|주니어|마스터|일반)",
]

# Rounds of elimination: order, and the place of those who lose in them.
ROUND_ORDER = {"128강": 1, "64강": 2, "32강": 3, "16강": 4, "8강": 5, "준결승": 6, "4강": 6, "결승": 7, "3-4위": 8}
ROUND_PLACES = {"준결승": 3, "8강": 5, "16강": 9, "32강": 17, "64강": 33, "128강": 65}
ROUND_BOUTS = {"결승": 1, "준결승": 2, "8강": 4, "16강": 8, "32강": 16, "64강": 32}
FINAL, SEMIFINAL, THIRD_PLACE = "결승", "준결승", "3-4위"

# Teams by the end of their name, and the ladder of schools.
TEAM_TYPES = [("elementary", "(초등학교|초교)$"), ("middle", "(중학교|중)$"), ("high", "(고등학교|고|체고)$"), ("university", "(대학교|대학|대)$")]
SCHOOL_LEVELS = {"elementary": 1, "middle": 2, "high": 3, "university": 4, "club": 0}
