import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle import connect, same

from lamella.llm import conversations, queries

SF = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NEXT, FULL = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault, got = zlib.crc32(name.encode()) % 20, out[conv]
        text = "" if fault == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if fault == 2 else text
        got += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def cheapest(turns, kinds):
    """(cost, audit, lines) by trying every edit at every turn, from every state, the least of each state kept."""

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                new = (cost + 2, audit + "I", (*lines, (FULL[NEXT[state]], "")))
                if NEXT[state] not in best or new[:2] < best[NEXT[state]][:2]:
                    best[NEXT[state]] = new
        return best

    best = inserted({"": (0, "", ())})
    for (_, role, text), kind in zip(turns, kinds, strict=True):
        new = {}

        def put(state, found):
            if state not in new or found[:2] < new[state][:2]:
                new[state] = found

        for state, (cost, audit, lines) in best.items():
            put(state, (cost + 3, audit + "D", lines))
            if kind not in ("blank", "duplicate"):
                cost += kind == "truncated"
                if role[:1] == NEXT[state] or (state == "" and role[:1] == "s"):
                    put(role[:1], (cost, audit + "K", (*lines, (role, text))))
                put(NEXT[state], (cost + 2, audit + "R", (*lines, (FULL[NEXT[state]], text))))
        best = inserted(new)
    return min((best[s] for s in ("", "a") if s in best), key=lambda v: v[:2])


def brute(rows):
    found = {}
    for conv, turns in damaged(rows).items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        kinds, seen = [], set()
        for _, role, text in turns:
            plain = text.rstrip(SPACE)
            kinds.append("blank" if not plain else "duplicate" if (role, text) in seen else "" if plain[-1] in ".!?" else "truncated")
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, lines = cheapest(turns, kinds)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        found[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return found


def held_against_brute(table):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    got = conversations.repair(conversations.damage(table)).collect()
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.conv_id], r.conv_id
    return want


def odd_table(spark, seed):
    rnd, rows = random.Random(seed), {}
    for conv in [None, *range(1, 300)]:
        turn = 0
        for i in range(rnd.choice([1, 2, 3, 4, 5, 7, 9, 12, 33])):
            turn += rnd.choice([1, 1, 1, 5])
            text = rnd.choice(["Hi.", "So", "Yes!  ", " \t", None, "x?", "abc", "é 🙂."])
            text = text if text is None or rnd.random() < 0.5 else f"{i}{text}"
            place = None if i == 0 and rnd.random() < 0.3 else turn
            rows[conv, place] = (conv, place, rnd.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), text, 5, "x")
    return spark.createDataFrame(list(rows.values()), "conv_id long, turn long, role string, text string, d1 long, conv string")


def test_tables_equal_brute_force(spark):
    held_against_brute(spark.read.parquet(f"{SF}/conversations.parquet"))


@pytest.mark.parametrize("step", [3, 1 << 14])
def test_odd_rows_equal_brute_force(spark, monkeypatch, step):
    """Nulls in any column, long texts, roles of other initials, gaps; costs stored at every third turn or none."""
    monkeypatch.setattr(conversations.solve, "__defaults__", (step,))
    want = held_against_brute(odd_table(spark, step))
    assert {len(v[6]) for v in want.values()} > {0, 1, 2, 3} and any("I" in v[6] for v in want.values()) and any("R" in v[6] for v in want.values())


def test_buckets_of_any_size_agree():
    rnd = random.Random(3)
    codes = [np.array([rnd.choice([0, 1, 2, 3, 4, 8, 9, 10, 5]) for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 70]))], dtype=np.uint8) for _ in range(200)]
    costs, audits = conversations.solve_all(codes)
    for c, cost, audit in zip(codes, costs, audits, strict=True):
        turns = [(i, "uasx"[k & 3], "t") for i, k in enumerate(c)]
        kinds = ["blank" if k & 4 else "truncated" if k & 8 else "" for k in c]
        assert (cost, audit) == cheapest(turns, kinds)[:2]


def test_repeated_rows_and_long_conversations(spark):
    long = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}." if i % 7 else "again.") for i in range(30_000)]
    rows = [*long, (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (3, 5, "user", "word " * 200_000 + "end."), (3, 6, "assistant", "Yes.")]
    want = held_against_brute(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert want[2][2] >= 1 and len(want[1][6]) > 25_000


def test_conversations_without_rows_and_empty_tables(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in conversations.repair(conversations.damage(one)).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", empty)]
    assert conversations.repair(conversations.damage(one.where("false"))).count() == 0


def test_repaired_rows_give_the_digest(spark):
    table = odd_table(spark, 5)
    rows = conversations.damage(table)
    want, lines = brute([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]), defaultdict(list)
    for r in conversations.repaired_rows(rows, conversations.plan(rows)).collect():
        lines[r.conv_id].append((r.position, r.role, r.text, r.edit))
    for conv, found in want.items():
        mine = sorted(lines[conv])
        assert [p for p, *_ in mine] == list(range(len(mine))) and "".join(e for *_, e in mine) == found[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t, _ in mine).encode()).hexdigest() == found[7]


def test_query_equals_sql(spark):
    same(queries.op12_conversation_repair(spark, SF), connect(SF), queries.ORACLE_SQL["op12_conversation_repair"])


def test_query_has_the_columns(spark):
    got = queries.op12_conversation_repair(spark, SF)
    assert got.columns == ["conv_id", *COLUMNS] and got.count() == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
