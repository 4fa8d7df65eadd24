"""Conversation structure repair: cheapest edits by a time-major dynamic program over many conversations at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: What a turn is to the program: its role's initial (user, assistant, system, any other), with marks.
USER, ASSISTANT, SYSTEM, OTHER, INITIAL, DOOMED, CUT, PAD = 0, 1, 2, 3, 3, 4, 8, 16
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: State of the repaired roles: nothing yet, behind a system turn, behind a user's, behind an assistant's.
START, SYS, ASKED, ANSWERED = range(4)
#: The next user or assistant turn leads from each state to this one, by writing this role.
NEXT = np.array([ASKED, ASKED, ANSWERED, ASKED])
ROLE_BEHIND = np.array(["", "", "user", "assistant"], dtype=object)
FAR = 1 << 40
#: Turns of one step of the program; what lies between two steps is computed anew on the way back.
STEP_TURNS = 1 << 14
#: Turns of a bucket of conversations, padding included.
BUCKET_TURNS = 1 << 18
SPACE = " \t\n\x0b\x0c\r"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows with the faults that crc32 of ``conv_id:turn`` modulo 20 names.

    0 marks the row as dropped, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 sets
    the role user. A null role or text is one space before that, and in the hash a null id or turn is.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("dropped"), F.explode(times).alias("nth")).drop("nth")


def _key() -> Column:
    """The conversation as text: empty for a null id."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")


def _with_ids(out: DataFrame, kind: str) -> DataFrame:
    """``out`` with the ids of ``_key`` in their own type."""
    return out.withColumn("conv_id", F.when(F.col("conv_id") != "", F.expr("substring(conv_id, 2)")).cast(kind))


def _digests() -> list[Column]:
    """128 bits by which role and text are told apart."""
    return [F.xxhash64(F.lit(i), "role", "text").alias(f"d{i}") for i in (1, 2)]


#: Order of the turns of a conversation (Spark puts nulls first).
ORDER = ["dropped", "turn", "role", "d1", "d2"]


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, d1, d2, dropped, seen, code, blank, truncated: each turn without its text."""
    plain = F.rtrim("text", F.lit(SPACE))
    last = F.substring(plain, -1, 1)
    rows = rows.select("conv_id", "turn", "role", "dropped", *_digests(), (plain == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    earlier = Window.partitionBy("conv_id", "d1", "d2", "dropped").orderBy("turn")
    rows = rows.withColumn("seen", (F.row_number().over(earlier) > 1) & ~F.col("blank"))
    rows = rows.withColumn("truncated", F.col("open") & ~F.col("blank") & ~F.col("seen")).drop("open")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "u", USER).when(initial == "a", ASSISTANT).when(initial == "s", SYSTEM).otherwise(OTHER)
    code = code + F.when(F.col("blank") | F.col("seen"), DOOMED).otherwise(0) + F.when(F.col("truncated"), CUT).otherwise(0)
    return rows.withColumn("code", code.cast("int"))


def _moves(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one turn of every conversation and each state: where Keep leads, what it costs, what Rerole costs (FAR: not allowed)."""
    initial, cut = codes & INITIAL, np.where(codes & CUT, TRUNCATED, 0)
    to = np.broadcast_to(NEXT, (len(codes), 4)).copy()
    fits = initial[:, None] == np.array([USER, USER, ASSISTANT, USER])
    fits[:, START] |= initial == SYSTEM
    to[initial == SYSTEM, START] = SYS
    alive = (codes & (DOOMED | PAD)) == 0
    keep = np.where(fits & alive[:, None], cut[:, None], FAR)
    rerole = np.where(alive, REROLE + cut, FAR)[:, None]
    return to, keep, rerole


def _behind(codes: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Costs [conversation, state] before a turn, from those after it.

    One inserted turn at a place is enough: two lead on to where the first state's own moves lead,
    for 4; only behind a system turn they reach more, and deleting that turn costs 3.
    """
    to, keep, rerole = _moves(codes)
    every = np.arange(len(codes))[:, None]
    best = np.minimum(keep + later[every, to], rerole + later[:, NEXT])
    best = np.minimum(best, DELETE + later)
    best = np.where((codes & PAD != 0)[:, None], later, best)
    return np.minimum(best, INSERT + best[:, NEXT])


def solve(codes: np.ndarray, step: int = STEP_TURNS) -> tuple[np.ndarray, list[bytes]]:
    """Least cost and ASCII-least cheapest audit of each conversation; ``codes`` is [turn, conversation], padded at the end with PAD.

    Costs go back from the last turn, all conversations at once, and only every ``step``-th row of
    them stays; on the way forward the rows between are computed again and edits are read off:
    of those that still reach the least cost the first of D, I, K, R, which gives the ASCII-least audit.
    """
    turns, n = codes.shape
    end = np.full((n, 4), FAR)
    end[:, [START, ANSWERED]] = 0
    end = np.minimum(end, INSERT + end[:, NEXT])  # a turn may be inserted behind the last one
    starts = list(range(0, turns, step))
    stored, now = [end], end
    for a in reversed(starts):
        for t in range(min(a + step, turns) - 1, a - 1, -1):
            now = _behind(codes[t], now)
        stored.append(now)
    cost, state, each = now[:, START].copy(), np.zeros(n, dtype=np.int64), np.arange(n)
    parts: list[list[bytes]] = [[] for _ in range(n)]
    for i, a in enumerate(starts):
        b = min(a + step, turns)
        rows = np.empty((b - a + 1, n, 4), dtype=np.int64)
        rows[-1] = stored[len(starts) - 1 - i]
        for t in range(b - 1, a - 1, -1):
            rows[t - a] = _behind(codes[t], rows[t - a + 1])
        letters = np.zeros((2 * (b - a), n), dtype=np.uint8)
        for t in range(a, b):
            here, later = rows[t - a], rows[t - a + 1]
            to, keep, rerole = _moves(codes[t])
            pad = codes[t] & PAD != 0
            deletes = ~pad & (DELETE + later[each, state] == here[each, state])
            inserts = ~pad & ~deletes & (INSERT + here[each, NEXT[state]] == here[each, state])
            state = np.where(inserts, NEXT[state], state)
            letters[2 * (t - a)] = np.where(inserts, ord("I"), 0)
            left = here[each, state]
            deletes = ~pad & (DELETE + later[each, state] == left)
            kept = ~pad & ~deletes & (keep[each, state] + later[each, to[each, state]] == left)
            changed = ~pad & ~deletes & ~kept
            letters[2 * (t - a) + 1] = np.select([deletes, kept, changed], [ord("D"), ord("K"), ord("R")], 0)
            state = np.where(kept, to[each, state], np.where(changed, NEXT[state], state))
        for c in range(n):
            column = letters[:, c]
            parts[c].append(column[column != 0].tobytes())
    final = ~np.isin(state, (START, ANSWERED))
    return cost, [b"".join(p) + (b"I" if f else b"") for p, f in zip(parts, final, strict=True)]


def solve_all(codes: list[np.ndarray]) -> tuple[list[int], list[str]]:
    """``solve`` in buckets of conversations of like length: powers of two, so padding at most doubles them."""
    costs, audits = [0] * len(codes), [""] * len(codes)
    buckets: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        if len(c):
            buckets.setdefault((len(c) - 1).bit_length(), []).append(i)
    for size, members in buckets.items():
        width = max(1, BUCKET_TURNS >> size)
        for a in range(0, len(members), width):
            some = members[a : a + width]
            table = np.full((max(len(codes[i]) for i in some), len(some)), PAD, dtype=np.uint8)
            for c, i in enumerate(some):
                table[: len(codes[i]), c] = codes[i]
            for i, cost, audit in zip(some, *solve(table), strict=True):
                costs[i], audits[i] = int(cost), audit.decode()
    return costs, audits


LEGAL = (SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER)
COUNTS = ["blank", "duplicate", "truncated", "illegal", "distinct"]


class _Open:
    """Conversations of a stream of rows ordered by conversation: codes and counts, the last one unfinished."""

    def __init__(self) -> None:
        self.ids, self.codes, self.counts, self.low, self.high = [], [], [], [], []

    def add(self, conv: object, codes: np.ndarray, counts: np.ndarray, low: float, high: float, begins: bool) -> None:
        if begins:
            self.ids.append(conv), self.codes.append([codes]), self.counts.append(counts), self.low.append(low), self.high.append(high)
        else:
            self.codes[-1].append(codes)
            self.counts[-1] = self.counts[-1] + counts
            self.low[-1], self.high[-1] = (b if a is None else a if b is None else pick(a, b) for a, b, pick in ((self.low[-1], low, min), (self.high[-1], high, max)))

    def take(self, n: int) -> pd.DataFrame:
        """The first ``n`` conversations, solved, and forgotten."""
        costs, audits = solve_all([np.concatenate(c) for c in self.codes[:n]])
        out = pd.DataFrame(np.array(self.counts[:n], dtype=np.int64).reshape(n, len(COUNTS)), columns=COUNTS)
        spans = [0 if a is None else b - a + 1 for a, b in zip(self.low[:n], self.high[:n], strict=True)]
        out["gaps"] = np.array(spans, dtype=np.int64) - out.pop("distinct")
        out["cost"], out["audit"], out["conv_id"] = costs, audits, self.ids[:n]
        for part in (self.ids, self.codes, self.counts, self.low, self.high):
            del part[:n]
        return out[["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]]


def _plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts, cost and audit of each conversation of one task, whose rows come in order."""
    open_, last, waiting = _Open(), None, 0
    for batch in batches:
        if not len(batch):
            continue
        conv, lost = batch["conv"].to_numpy(), batch["dropped"].to_numpy(dtype=bool)
        code, null = batch["code"].to_numpy(dtype=np.uint8), batch["no_turn"].to_numpy(dtype=bool)
        turn = batch["turn"].to_numpy(dtype=np.int64)
        new = np.empty(len(batch), dtype=bool)
        new[1:] = conv[1:] != conv[:-1]
        new[0] = last is None or last[0] != conv[0]
        initial = (code & INITIAL).astype(np.int64)
        held = (0, 0, True) if last is None else last[1:]
        before, at, at_null = np.r_[held[0], initial[:-1]], np.r_[held[1], turn[:-1]], np.r_[held[2], null[:-1]]
        illegal = ~new & ~lost & ~np.isin(before * 4 + initial, LEGAL)
        distinct = ~lost & ~null & (new | at_null | (at != turn))
        flags = np.stack([batch["blank"].to_numpy(dtype=bool) & ~lost, batch["seen"].to_numpy(dtype=bool) & ~lost, batch["truncated"].to_numpy(dtype=bool) & ~lost, illegal, distinct], axis=1)
        bounds = np.r_[np.flatnonzero(new | (np.arange(len(new)) == 0)), len(new)]
        sums = np.add.reduceat(flags.astype(np.int64), bounds[:-1], axis=0)
        for a, b, s in zip(bounds[:-1], bounds[1:], sums, strict=True):
            stay = ~lost[a:b]
            turns = turn[a:b][stay & ~null[a:b]]
            low, high = (int(turns[0]), int(turns[-1])) if len(turns) else (None, None)
            open_.add(conv[a], code[a:b][stay], s, low, high, bool(new[a]))
        last, waiting = (conv[-1], initial[-1], turn[-1], null[-1]), waiting + len(batch)
        if waiting >= BUCKET_TURNS and len(open_.ids) > 1:
            yield open_.take(len(open_.ids) - 1)
            waiting = len(open_.codes[0])
    if open_.ids:
        yield open_.take(len(open_.ids))


def plan(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of the conversations of ``rows`` (conv_id, turn, role, text, dropped).

    Only narrow rows without text are shuffled: once to find turns said before, once to bring a
    conversation's turns together in order. A task keeps one byte a turn of what it hasn't solved.
    """
    kind = dict(rows.dtypes)["conv_id"]
    turns = coded(rows).withColumn("conv", _key()).repartition("conv").sortWithinPartitions("conv", *ORDER, "seen")
    no_turn = F.col("turn").isNull()
    narrow = turns.select("conv", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), no_turn.alias("no_turn"), "dropped", "blank", "seen", "truncated", "code")
    out = narrow.mapInPandas(_plan, "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return _with_ids(out, kind)


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[object, str, str, str]]]]:
    """For each batch of a stream in order: the rows with plans, and (conv, edit, role, text) of every edit so far."""
    audit, at, state = "", 0, START
    for batch in batches:
        out, heads = [], batch["head"].to_numpy(dtype=bool)
        for conv, head, planned, role, text in zip(batch["conv"], heads, batch["audit"], batch["role"], batch["text"], strict=True):
            if head:
                audit, at, state = planned, 0, START
                continue
            while at < len(audit):
                letter = audit[at]
                at += 1
                if letter == "K" and state == START and role[:1] == "s":
                    state = SYS
                elif letter != "D":
                    state = int(NEXT[state])
                if letter == "K":
                    out.append((conv, letter, role, text))
                elif letter == "R":
                    out.append((conv, letter, ROLE_BEHIND[state], text))
                elif letter == "I":
                    out.append((conv, letter, ROLE_BEHIND[state], ""))
                if letter != "I":
                    break
            if at == len(audit) - 1 and audit[at] == "I":  # behind the last turn
                out.append((conv, "I", ROLE_BEHIND[NEXT[state]], ""))
        yield batch, out


def _stream(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans and turns of a conversation in one partition, the plan first, the turns in order."""
    heads = plans.select(_key(), F.lit(False).alias("dropped"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), F.lit(True).alias("head"), "audit")
    turns = rows.where("not dropped").select(_key(), "dropped", F.col("turn").cast("long").alias("turn"), "role", "text", *_digests(), F.lit(False).alias("head"), F.lit("").alias("audit"))
    return heads.unionByName(turns).repartition("conv").sortWithinPartitions("conv", F.desc("head"), *ORDER).select("conv", "head", "audit", "role", "text")


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, position, edit, role, text: the repaired conversations, turn by turn (deleted turns are gone)."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n = None, 0
        for _, edits in _edited(batches):
            places = []
            for conv, *_ in edits:
                last, n = conv, n + 1 if conv == last else 0
                places.append(n)
            out = pd.DataFrame(edits, columns=["conv_id", "edit", "role", "text"])
            out.insert(1, "position", np.array(places, dtype=np.int64))
            yield out

    out = _stream(rows, plans).mapInPandas(run, "conv_id string, position long, edit string, role string, text string")
    return _with_ids(out, kind)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 per conversation of ``rows`` (see ``damage``).

    Turns are taken in order of turn, nulls first, then role, then a hash of role and text; rows
    that only repeat stay side by side. A null id is a conversation. ``role`` and ``text`` aren't
    null behind ``damage``; roles with other initials can be rewritten or deleted. Texts of any
    length are streamed through the hash, so a task never holds a conversation's texts, and of its
    turns it holds a byte each. Other columns are ignored; an empty table gives an empty result.
    Role and text are told apart by 128 bits of hashes. The plans are a table in the shared folder,
    written when this is called.
    """
    plans = materialize(plan(rows), "conversation-plans")
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, hashed, empty = None, None, True
        for batch, edits in _edited(batches):
            done, heads, k = [], batch["head"].to_numpy(dtype=bool), 0
            names = batch["conv"].to_numpy()[heads]
            for name in [None, *names]:
                if name is not None:
                    if conv is not None:
                        done.append((conv, hashed.hexdigest()))
                    conv, hashed, empty = name, hashlib.sha256(), True
                while k < len(edits) and edits[k][0] == conv:
                    hashed.update(f"{'' if empty else '\n'}{edits[k][2]}:{edits[k][3]}".encode())
                    empty, k = False, k + 1
            yield pd.DataFrame(done, columns=["conv_id", "repaired_sha256"])
        if conv is not None:
            yield pd.DataFrame([(conv, hashed.hexdigest())], columns=["conv_id", "repaired_sha256"])

    hashes = _with_ids(_stream(rows, plans).mapInPandas(run, "conv_id string, repaired_sha256 string"), kind)
    return plans.alias("a").join(hashes.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select("a.*", "b.repaired_sha256")
