"""SQL (DuckDB) of the search and of conversation repair, by brute force: every document scored, every state of every turn kept."""

from __future__ import annotations

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _terms(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


SEARCH = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms("text")} AS ts FROM documents),
    c AS (SELECT count(*) FILTER (len(ts) > 0) AS docs, CAST(sum(len(ts)) AS BIGINT) AS words FROM d),
    p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2.0 * docs + 2) / (2.0 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), c),
    q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_terms("text")}) AS term FROM benchmark)),
    s AS (SELECT q.item_id, p.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY q.item_id, p.r, p.doc_id)
    SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


def _after(state: str, cost: str, letter: str, line: str | None = None, when: str = "true") -> str:
    lines = f"{state}.t" if line is None else f"list_append({state}.t, {line})"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {lines}}} END"


def _least(*found: str) -> str:
    return f"list_min([{', '.join(found)}])"


def _repair() -> str:
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    bits = "flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform(range(0, 8), lambda j: CAST((ascii(substr(k, CAST(i AS INT), 1)) >> CAST(j AS INT)) & 1 AS BIGINT))))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda x, y: xor(x >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295)"
    own = "role || ':' || text"
    keep = lambda state, initial: _after(state, "cut", "K", own, f"alive AND initial = '{initial}'")
    rerole = lambda state, role: _after(state, "2 + cut", "R", f"'{role}:' || text", "alive")
    gone = lambda state: _after(state, "3", "D")
    user = [f(s, a) for s in ("s0", "s1", "s3") for f, a in ((keep, "u"), (rerole, "user"))]
    one = f"{gone('s0')} AS n0, {_least(gone('s1'), keep('s0', 's'))} AS n1, {_least(gone('s2'), *user)} AS n2, {_least(gone('s3'), keep('s2', 'a'), rerole('s2', 'assistant'))} AS n3"
    inserted = [_after(s, "2", "I", "'user:'") for s in ("n0", "n1", "n3")]
    two = f"n0 AS s0, n1 AS s1, {_least('n2', *inserted)} AS s2, {_least('n3', _after('n2', '2', 'I', chr(39) + 'assistant:' + chr(39)))} AS s3"
    kind = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    return f"""
    WITH RECURSIVE k AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {key} AS k FROM conversations),
    f AS (SELECT *, {crc} % 20 AS fault FROM k),
    g AS (SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS nth FROM f WHERE fault <> 0),
    h AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, nth) AS pos FROM g),
    m AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS again, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS open, lag(role) OVER (PARTITION BY conv ORDER BY pos) AS before FROM h),
    r AS (SELECT *, again AND NOT blank AS duplicate, open AND NOT blank AND NOT again AS truncated, NOT blank AND NOT again AS alive, CASE WHEN open AND NOT blank AND NOT again THEN 1 ELSE 0 END AS cut, substr(role, 1, 1) AS initial,
                 before IS NOT NULL AND substr(before, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM m),
    c AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(pos) AS turns FROM r GROUP BY 1),
    dp AS (
        SELECT conv, CAST(0 AS BIGINT) AS pos, CAST({{'c': 0, 'a': '', 't': []}} AS {kind}) AS s0, CAST(NULL AS {kind}) AS s1, CAST({{'c': 2, 'a': 'I', 't': ['user:']}} AS {kind}) AS s2, CAST(NULL AS {kind}) AS s3 FROM c
        UNION ALL SELECT conv, pos, {two} FROM (SELECT dp.conv, dp.pos + 1 AS pos, {one} FROM dp JOIN r ON dp.conv = r.conv AND r.pos = dp.pos + 1)),
    e AS (SELECT c.*, {_least("s0", "s3")} AS best FROM c JOIN dp ON c.conv = dp.conv AND c.turns = dp.pos)
    SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
           sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv, conv_id FROM k) v LEFT JOIN e ON v.conv = e.conv"""


REPAIR = _repair()
