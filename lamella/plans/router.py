"""Questions to queries: ordered intent patterns, as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Intents in order of precedence.
INTENTS = [
    ("rival", r"(?i)rival|versus|\bvs\b|라이벌|상대전적"),
    ("ranking", r"(?i)rank|top \d+|랭킹|순위"),
    ("competition", r"(?i)competition|tournament|event|대회"),
    ("stats", r"(?i)how many|count|total|통계|몇"),
    ("player", r"(?i)who is|player|선수"),
]


def intent(text: Column | str, table: list[tuple[str, str]] | None = None) -> Column:
    """The first intent whose pattern is found, else ``search``."""
    text, out = F.col(text) if isinstance(text, str) else text, None
    for name, pattern in table or INTENTS:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("search")


def subject(text: Column | str) -> Column:
    """The words of a question without those that ask: stop words, particles and signs go."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    c = F.regexp_replace(c, r"[?!.,]+", " ")
    c = F.regexp_replace(c, r"(?<=[가-힣])(은|는|이|가|을|를|의|와|과)(?=\s|$)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\b(who|is|the|what|how|many|of|show|me|a|an|for)\b", " "), r"\s+", " "))
