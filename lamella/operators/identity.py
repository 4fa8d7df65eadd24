"""Person resolution: which appearances under one name are one person."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.korean import ORGANISATION_CODES, organisation_english, organisation_type, region
from ..functions.scalar import age_level, age_token, gender, lookup, school_level, team_type
from ..sources.tables import numbered, written

PROFILE = "name string, part int, teams array<string>, weapons array<string>, current_team string, first_seen string, last_seen string, appearances int"


def appearances(documents: DataFrame) -> DataFrame:
    """name, team, comp, date, event, weapon, rank, kind of every pool, ranking and seeding row; empty names are left out."""
    events = documents.select("competition", F.explode("events").alias("e"))
    base = ["competition", "e"]
    pools = events.select(*base, F.explode("e.pool_rounds").alias("p")).select(*base, F.explode("p.results").alias("r"), F.lit("pool").alias("kind"))
    ranks = events.select(*base, F.explode("e.final_rankings").alias("r"), F.lit("ranking").alias("kind"))
    seeds = events.select(*base, F.explode("e.seeding").alias("r")).where("r.name <> '-'")
    seeds = seeds.select(*base, F.struct("r.name", "r.team", F.lit(None).cast("int").alias("rank")).alias("r"), F.lit("de_seeding").alias("kind"))
    rows = None
    for part in (pools, ranks, seeds):
        part = part.select(
            F.trim("r.name").alias("name"), F.trim(F.coalesce("r.team", F.lit(""))).alias("team"), F.col("competition.event_cd").alias("comp"),
            F.coalesce("competition.start_date", F.lit("")).alias("date"), F.col("e.name").alias("event"), F.col("e.weapon").alias("weapon"), F.col("r.rank").cast("int").alias("rank"), "kind",
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows.where(F.coalesce(F.col("name"), F.lit("")) != "")


def _team_rows(rows: DataFrame) -> DataFrame:
    """One row per name, side (age and gender) and team: spans, weapons and competitions, aggregated by Spark."""
    level = age_level(F.coalesce(age_token("event"), F.lit("")))
    rows = rows.withColumn("level", level)
    order = Window.partitionBy("name").orderBy("date", "comp", "team", "kind", "event")
    aged = rows.where("level > 0").select("name", "date", "level", F.lag("level").over(order).alias("l0"), F.lag("date").over(order).alias("d0"))
    splits = aged.where("d0 < date and l0 - level >= 2").groupBy("name").agg(F.min("date").alias("split"))
    rows = rows.join(splits, "name", "left").withColumn("side", F.when(F.col("split").isNotNull() & (F.col("date") >= F.col("split")), 1).otherwise(0))
    sex = gender("event")
    known = rows.where(sex != "").groupBy("name", "side", "team").agg(F.min(sex).alias("g0"), F.max(sex).alias("g1"))
    all_of = rows.where(sex != "").groupBy("name", "side").agg(F.min(sex).alias("h0"), F.max(sex).alias("h1"))
    rows = rows.join(known, ["name", "side", "team"], "left").join(all_of, ["name", "side"], "left")
    guess = F.when(sex != "", sex).when(F.col("g0") == F.col("g1"), F.col("g0")).when(F.col("g0").isNull() & (F.col("h0") == F.col("h1")), F.col("h0")).otherwise("")
    rows = rows.withColumn("sex", guess)
    return rows.groupBy("name", "side", "sex", "team").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.array_sort(F.collect_set("weapon")).alias("weapons"),
        F.array_sort(F.collect_set("comp")).alias("comps"), F.count(F.lit(1)).cast("int").alias("n"),
    ).withColumn("kind", team_type("team")).withColumn("level", school_level("team"))


class _Team(NamedTuple):
    name: str
    team: str
    first: str
    last: str
    school: bool
    level: int
    weapons: frozenset[str]
    comps: frozenset[str]
    n: int


def _year(date: str) -> int:
    return int(date[:4]) if date[:4].isdigit() else 0


def _follows(a: _Team, b: _Team, years: int) -> bool:
    """Whether b begins when a has ended, at most so many calendar years later."""
    return a.last <= b.first and _year(b.first) - _year(a.last) <= years


def _same_person(a: _Team, b: _Team) -> bool:
    """Whether two teams can belong to one career."""
    if a.weapons and b.weapons and not a.weapons & b.weapons or not (a.last and b.last):
        return False
    if a.school != b.school:
        return False
    if a.school:
        if a.level == b.level:
            return (a.last <= b.first or b.last <= a.first) and abs(_year(b.first) - _year(a.last)) <= 1
        low, high = (a, b) if a.level < b.level else (b, a)
        return high.level - low.level == 1 and _follows(low, high, 1)
    if a.last <= b.first or b.last <= a.first:
        return _follows(a, b, 2) or _follows(b, a, 2)
    return a.weapons == b.weapons and _year(min(a.last, b.last)) - _year(max(a.first, b.first)) <= 1


def _by_weapon(teams: list[_Team]) -> list[list[_Team]]:
    """Teams in groups that share weapons, directly or through others; those without any are one group."""
    groups: list[tuple[set[str], list[_Team]]] = []
    for t in teams:
        met = [g for g in groups if (g[0] & t.weapons if t.weapons else not g[0])]
        groups = [g for g in groups if g not in met]
        groups.append((set(t.weapons).union(*(g[0] for g in met)), [x for g in met for x in g[1]] + [t]))
    return [sorted(g[1], key=lambda t: (t.first or "9999", t.team)) for g in groups]


def _careers(teams: list[_Team]) -> list[list[_Team]]:
    """Teams, in order of their first date, dealt out to persons; sets are bit masks over their places."""
    clash = [0] * len(teams)
    at: dict[str, int] = {}
    for i, t in enumerate(teams):
        for c in t.comps:
            at[c] = at.get(c, 0) | 1 << i
    for i, t in enumerate(teams):
        for c in t.comps:
            clash[i] |= at[c] & ~(1 << i)
    if not any(clash):
        schools = [t for t in teams if t.level >= 2]
        apart = any(a.level == b.level and max(a.first, b.first) <= min(a.last, b.last) for i, a in enumerate(schools) for b in schools[:i])
        return [[t] for t in teams] if apart else [teams]
    owner, members, barred = list(range(len(teams))), [1 << i for i in range(len(teams))], clash[:]
    for i, a in enumerate(teams):
        for j in range(i + 1, len(teams)):
            p, q = owner[i], owner[j]
            if p == q or barred[p] & members[q] or not _same_person(a, teams[j]):
                continue
            members[p] |= members[q]
            barred[p] |= barred[q]
            owner = [p if o == q else o for o in owner]
    return [[teams[i] for i in range(len(teams)) if owner[i] == p] for p in sorted(set(owner))]


def _resolve(rows: pd.DataFrame) -> pd.DataFrame:
    """Profiles of one name; its rows are teams, so the group is small however often the person appears."""
    out, sides = [], {}
    for r in rows.itertuples(index=False):
        team = _Team(r.name, r.team, r.first or "", r.last or "", r.kind != "club", int(r.level), frozenset(w for w in r.weapons if w), frozenset(r.comps), int(r.n))
        sides.setdefault((r.side, r.sex), []).append(team)
    for _, teams in sorted(sides.items()):
        for group in _by_weapon(teams):
            for mine in _careers(group):
                newest = max(mine, key=lambda t: (t.first, t.team))
                seen = [t.first for t in mine if t.first], [t.last for t in mine if t.last]
                out.append((mine[0].name, [t.team for t in mine], sorted(set().union(*(t.weapons for t in mine))), newest.team, min(seen[0], default=None), max(seen[1], default=None), sum(t.n for t in mine)))
    out.sort(key=lambda p: (p[4] or "", p[1]))
    return pd.DataFrame([(p[0], i, *p[1:]) for i, p in enumerate(out)], columns=["name", "part", "teams", "weapons", "current_team", "first_seen", "last_seen", "appearances"])


def resolve_people(rows: DataFrame) -> DataFrame:
    """Profiles per name: teams, weapons, current team, span and number of appearances.

    An age regression of two levels splits a name once; then gender; then groups of teams that share
    weapons. Teams of one competition can't be one person; without such, schools of one level at
    once keep all teams of the name apart; without those, all are one person. Otherwise teams
    join greedily in order of their first date: schools one level up, or level with no overlap,
    within a calendar year; clubs within two. Rows are aggregated to teams before a name meets in
    one task.
    """
    return _team_rows(rows).groupBy("name").applyInPandas(_resolve, PROFILE)


def _year_of(date: Column) -> Column:
    return F.coalesce(F.regexp_extract(date, "^([0-9]{4})", 1).try_cast("int"), F.lit(0))


def _may_be_one(a: str, b: str) -> Column:
    """``_same_person`` as a condition on two rows of teams."""
    first, last, school, level, weapons = ((F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in ("first", "last", "school", "level", "weapons"))
    disjoint = (F.size(weapons[0]) > 0) & (F.size(weapons[1]) > 0) & ~F.arrays_overlap(*weapons)
    follows = lambda x, y, years: (last[x] <= first[y]) & (_year_of(first[y]) - _year_of(last[x]) <= years)
    apart = (last[0] <= first[1]) | (last[1] <= first[0])
    same_level = apart & (F.abs(_year_of(first[1]) - _year_of(last[0])) <= 1)
    up = ((level[1] - level[0] == 1) & follows(0, 1, 1)) | ((level[0] - level[1] == 1) & follows(1, 0, 1))
    overlap = (weapons[0] == weapons[1]) & (_year_of(F.least(*last)) - _year_of(F.greatest(*first)) <= 1)
    clubs = F.when(apart, follows(0, 1, 2) | follows(1, 0, 2)).otherwise(overlap)
    schools = F.when(level[0] == level[1], same_level).otherwise(up)
    return ~disjoint & (last[0] != "") & (last[1] != "") & (school[0] == school[1]) & F.when(school[0], schools).otherwise(clubs)


def merged_under_bars(edges: DataFrame, bars: DataFrame) -> DataFrame:
    """node, label: nodes merged along ``edges`` (a, b, by) in the order of ``by``, a struct unique to each edge, unless ``bars`` (a, b) keep their groups apart.

    What one pass over all edges in order would give, in rounds of joins: an edge that is the least one left at both
    of its groups is decided as that pass would decide it, for no edge before it touches them. Each
    round drops edges inside a group and between barred groups, merges along all such least edges, which form
    a matching, and hands the bars of both groups on. Rounds are written to the shared folder; a chain whose edges
    come in order takes as many as it has edges. Nodes without an edge don't appear.
    """
    edges = written(edges.select("a", "b", "by"), "bar-edges")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "bar-labels")
    bars = written(bars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "bars")
    final = labels
    while True:
        barred = edges.select("a", "b", "by", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).where("a <> b")
        left = written(barred.alias("e").join(bars.alias("s"), (F.col("e.x") == F.col("s.a")) & (F.col("e.y") == F.col("s.b")), "left_anti").select("a", "b", "by"), "bar-left")
        if left.isEmpty():
            return final
        best = left.select("by", F.explode(F.array("a", "b")).alias("group")).groupBy("group").agg(F.min("by").alias("by"))
        twice = best.groupBy("by").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("by")
        step = written(left.join(twice, "by").select(F.greatest("a", "b").alias("old"), F.least("a", "b").alias("new")), "bar-step")  # a matching: each group once

        def moved(rows: DataFrame, column: str, step: DataFrame = step) -> DataFrame:
            met = rows.alias("r").join(step.alias("s"), F.col(f"r.{column}") == F.col("s.old"), "left")
            return met.select(*[(F.coalesce("s.new", f"r.{c}") if c == column else F.col(f"r.{c}")).alias(c) for c in rows.columns])

        edges = written(moved(moved(left, "a"), "b"), "bar-edges")
        final = written(moved(final, "label"), "bar-labels")
        raised = moved(moved(bars, "a"), "b")
        bars = written(raised.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "bars")


def resolve_people_in_rounds(rows: DataFrame) -> DataFrame:
    """The profiles of ``resolve_people``, for names of any number of teams: no task holds a whole name.

    Groups of teams that share weapons are connected components; clashes (two teams in one
    competition) are pairs from a self-join; the greedy joining of teams is ``merged_under_bars``. Teams
    are numbered in ranges. Pairs of teams that might be one person are listed, spread over
    tasks, so work grows with the square of a name's teams, not of its rows. Written when it is called.
    """
    teams = _team_rows(rows).withColumns({"first": F.coalesce("first", F.lit("")), "last": F.coalesce("last", F.lit("")), "school": F.col("kind") != "club", "weapons": F.filter("weapons", lambda w: w != "")})
    key = F.concat_ws("\x1f", "name", F.col("side").cast("string"), "sex")
    teams = written(teams.withColumns({"key": key, "node": F.concat_ws("\x1f", key, F.lit("t"), "team")}), "teams")
    shared = teams.select(F.col("node").alias("a"), "key", F.explode("weapons").alias("weapon")).select("a", F.concat_ws("\x1f", "key", F.lit("w"), "weapon").alias("b"))
    groups = components(shared, "a", "b") if not shared.isEmpty() else shared.select(F.col("a").alias("node"), F.col("b").alias("component"))
    teams = teams.join(groups, "node", "left").withColumn("group", F.coalesce("component", "key")).drop("component")
    teams = numbered(teams, ["group"], [F.coalesce(F.nullif("first", F.lit("")), F.lit("9999")), "team"], "i")
    teams = written(teams, "teams")
    met = teams.select("group", "node", F.explode("comps").alias("comp"))
    clashes = met.alias("x").join(met.alias("y"), (F.col("x.group") == F.col("y.group")) & (F.col("x.comp") == F.col("y.comp")) & (F.col("x.node") < F.col("y.node")))
    clashes = written(clashes.select(F.col("x.group").alias("group"), F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "clashes")
    torn = clashes.select("group").distinct()
    # groups without a clash: all one, or all apart where schools of a level overlap
    so_far = Window.partitionBy("group", "level").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    whole = teams.join(torn, "group", "left_anti")
    over = whole.where("level >= 2").withColumn("until", F.max("last").over(so_far)).where("first <= until").select("group").distinct().withColumn("apart", F.lit(True))
    easy = whole.join(over, "group", "left").select("node", F.when(F.col("apart"), F.col("node")).otherwise(F.col("group")).alias("label"))
    hard = teams.join(torn, "group", "left_semi")
    pair = hard.alias("x").join(hard.alias("y"), (F.col("x.group") == F.col("y.group")) & (F.col("x.i") < F.col("y.i")) & _may_be_one("x", "y"))
    edges = pair.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.struct(F.col("x.group").alias("group"), F.col("x.i").alias("i"), F.col("y.i").alias("j")).alias("by"))
    joined = merged_under_bars(edges, clashes)
    found = hard.join(joined, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    profiles = teams.join(easy.unionByName(found), "node").groupBy("name", "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "team"))), lambda t: t["team"]).alias("teams"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("weapons")))).alias("weapons"),
        F.max_by("team", F.struct("first", "team")).alias("current_team"), F.min(F.nullif("first", F.lit(""))).alias("first_seen"), F.max(F.nullif("last", F.lit(""))).alias("last_seen"), F.sum("n").cast("int").alias("appearances"),
    )
    out = numbered(profiles, ["name"], [F.coalesce("first_seen", F.lit("")), "teams"], "part")
    return out.select("name", (F.col("part") - 1).cast("int").alias("part"), "teams", "weapons", "current_team", "first_seen", "last_seen", "appearances")


def organisations(rows: DataFrame, team: str = "team", date: str = "date", person: str = "name", country: str = "KO") -> DataFrame:
    """One row per organisation: id, name, type, English name, region, span, rows and people.

    Ids number the organisations of a type by first date, then name.
    """
    named = rows.where(F.trim(F.coalesce(F.col(team), F.lit(""))) != "")
    seen = named.groupBy(F.trim(team).alias("organisation")).agg(F.min(date).alias("first_seen"), F.max(date).alias("last_seen"), F.count(F.lit(1)).alias("rows"), F.countDistinct(person).alias("people"))
    seen = numbered(seen.withColumn("kind", organisation_type("organisation")), ["kind"], ["first_seen", "organisation"], "number")
    code = lookup("kind", ORGANISATION_CODES)
    found = seen.withColumn("id", F.concat(F.lit(country), code, F.format_string("%04d", "number"))).drop("number")
    return found.withColumn("english", organisation_english("organisation")).withColumn("region", region("organisation"))


def homonyms(rows: DataFrame, name: str = "name", team: str = "team") -> DataFrame:
    """Names with more than one team."""
    return rows.groupBy(name).agg(F.array_sort(F.collect_set(team)).alias("teams")).where(F.size("teams") > 1)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component of an undirected graph: least label spreading with label jumps; each round is written to the shared folder."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    pairs = written(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component"))
    labels = written(labels, "labels")
    while True:
        heard = pairs.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        spread = labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        moved = spread.join(jump, "via", "left").select("node", "old", F.least("via", F.coalesce("far", "via")).alias("component"))
        moved = written(moved, "labels")
        done = moved.where("component < old").limit(1).count() == 0
        labels = moved.select("node", "component")
        if done:
            return labels
