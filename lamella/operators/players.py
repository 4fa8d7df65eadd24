"""Players, clubs and their histories: indexes, searches, rosters, composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import letter_rating, win_rate


def player_index(rows: DataFrame, name: str, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """name, records: each name's records in order, the first of those that share ``key``."""
    first = Window.partitionBy(name, *key).orderBy(*order)
    kept = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    at = [F.col(c).alias(f"__{i}") for i, c in enumerate(order)]
    held = F.sort_array(F.collect_list(F.struct(*at, F.struct(*fields).alias("record"))))
    return kept.groupBy(name).agg(F.transform(held, lambda r: r["record"]).alias("records"))


def competition_history(results: DataFrame, events: DataFrame, bouts: DataFrame, keys: list[str]) -> DataFrame:
    """A player's events with rank, bouts, wins and rate; events without a bout count none.

    results has keys, rank; bouts has keys, won. Bouts are counted per key before the join.
    """
    counts = bouts.groupBy(*keys).agg(F.count(F.lit(1)).alias("bouts"), F.count_if("won").alias("wins"))
    rows = results.join(events, [k for k in keys if k in events.columns]).join(counts, keys, "left")
    rows = rows.withColumns({"bouts": F.coalesce("bouts", F.lit(0)), "wins": F.coalesce("wins", F.lit(0))})
    return rows.withColumn("win_rate", win_rate(F.col("wins"), F.col("bouts")))


def with_counts(rows: DataFrame, key: str, parts: DataFrame, name: str = "participants") -> DataFrame:
    """Rows with the number of their parts; 0 without any."""
    counts = parts.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return rows.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def with_parts(rows: DataFrame, key: str, parts: DataFrame, fields: list[str], name: str = "parts") -> DataFrame:
    """Rows with their parts as a sorted array of structs; empty without any."""
    held = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return rows.join(held, key, "left").withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))


def totals_by(rows: DataFrame, year: Column, weapon: Column, weapons: list[str]) -> DataFrame:
    """year, weapon, n: counts of every year for each of the listed weapons, 0 where there is none."""
    spark = rows.sparkSession
    counts = rows.groupBy(year.alias("year"), weapon.alias("weapon")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.explode(F.array(*map(F.lit, weapons))).alias("weapon")
    return counts.select("year").distinct().select("year", listed).join(counts, ["year", "weapon"], "left").fillna(0, ["n"]) if weapons else spark.createDataFrame([], "year int, weapon string, n long")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def bracket_stats(bouts: DataFrame, player: str, event: str, won: str) -> DataFrame:
    """Events, rounds won and the mean of rounds won per event, to two places."""
    rows = bouts.groupBy(player).agg(F.count_distinct(event).alias("events"), F.count_if(won).alias("rounds_won"))
    return rows.withColumn("mean_rounds", F.bround(F.col("rounds_won") / F.col("events"), 2))


def composite(base: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    """A profile joined of aggregates; counts that a player doesn't have are 0."""
    out = base
    for part in parts:
        out = out.join(part, key, "left").fillna(0, [c for c, t in part.dtypes if c != key and t in ("bigint", "int", "double")])
    return out


def activity(rows: DataFrame, last: str, as_of: str, months: int = 3) -> DataFrame:
    """Rows marked active if last seen within ``months`` of 30 days; never seen is inactive."""
    since = F.date_sub(F.lit(as_of).cast("date"), 30 * months)
    return rows.withColumn("active", F.coalesce(F.col(last).cast("date") >= since, F.lit(False)))


def tab_counts(rows: DataFrame, category: str, active: str, every: str = "전체") -> DataFrame:
    """tab, players, active_players: counts per category and for all together."""
    tabs = rows.withColumn("tab", F.explode(F.array(F.lit(every), F.col(category))))
    return tabs.groupBy("tab").agg(F.count(F.lit(1)).alias("players"), F.count_if(active).alias("active_players"))


def compared(profiles: DataFrame, key: str, ids: list) -> DataFrame:
    """The profiles of two to ten players."""
    if not 2 <= len(set(ids)) <= 10:
        raise ValueError("two to ten players can be compared")
    return profiles.where(F.col(key).isin(list(set(ids))))


def latest_rows(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, numbered by ``rn``."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n)


def latest_nested(rows: DataFrame, by: list[str], order: list[Column], n: int, fields: list[str], name: str) -> DataFrame:
    """The first ``n`` rows of each key as an array of structs, in order."""
    held = F.sort_array(F.collect_list(F.struct("rn", F.struct(*fields).alias("row"))))
    return latest_rows(rows, by, order, n).groupBy(*by).agg(F.transform(held, lambda r: r["row"]).alias(name))


def player_answer(rows: DataFrame, name: str, rank: str, order: list[Column], fields: list[str], n: int = 5) -> DataFrame:
    """Best and average rank (to one place), records, and the latest ``n`` of them."""
    sums = rows.groupBy(name).agg(F.min(rank).alias("best"), F.bround(F.avg(rank), 1).alias("average"), F.count(F.lit(1)).alias("records"))
    return sums.join(latest_nested(rows, [name], order, n, fields, "latest"), name)


def recent_podium(rows: DataFrame, player: str, season: str, rank: str, title: str) -> DataFrame:
    """player, podium: the best title of the last season with a podium, as ``title rank``."""
    best = F.min_by(F.concat_ws(" ", title, F.col(rank).cast("string")), F.struct(-F.col(season), F.col(rank), F.col(title)))
    return rows.where(F.col(rank) <= 3).groupBy(player).agg(best.alias("podium"))


def ordered_search(rows: DataFrame, key: str, fields: list[Column], limit: int, order: list[Column]) -> DataFrame:
    """Rows that a field's condition takes, earlier conditions first, then by ``order``."""
    place = F.coalesce(*[F.when(f, F.lit(i)) for i, f in enumerate(fields)])
    return rows.withColumn("priority", place).where("priority is not null").orderBy("priority", *order, key).limit(limit)


def tracked(players: DataFrame, listed: DataFrame) -> DataFrame:
    """name, club, team of the listed players (name, club): the first of their teams that holds the club's name, else the club."""
    met = listed.join(players, "name", "left")
    first = F.min(F.when(F.col("team").contains(F.col("club")), F.col("team")))
    return met.groupBy("name", "club").agg(F.coalesce(first, F.col("club")).alias("team"))


def allowed(rows: DataFrame, name: str, team: str, clubs: list[tuple[str, list[str]]]) -> DataFrame:
    """Rows of the listed clubs: all of a club's, or those with a listed name where it lists names."""
    ok = F.lit(False)
    for club, names in clubs:
        here = F.col(team).contains(club)
        ok = ok | (here & F.col(name).isin(names) if names else here)
    return rows.where(ok)


def similar_names(names: DataFrame, name: str, wanted: str, n: int = 10) -> DataFrame:
    """Names inside the wanted one, around it, or with its first character, in order."""
    c = F.col(name)
    near = c.contains(wanted) | F.lit(wanted).contains(c) | (F.substring(c, 1, 1) == wanted[:1])
    return names.where(near & (c != wanted)).select(name).distinct().orderBy(name).limit(n)


def any_word(rows: DataFrame, text: str, phrase: str) -> DataFrame:
    """Rows whose text holds any word of a phrase."""
    ok = F.lit(False)
    for word in phrase.split():
        ok = ok | F.col(text).contains(word)
    return rows.where(ok)


def merged_names(listed: DataFrame, met: DataFrame, keys: list[str]) -> DataFrame:
    """The listed players, and after them those that only matches name; ``listed`` says which."""
    more = met.select(*keys).distinct().join(listed.select(*keys), keys, "left_anti")
    return listed.select(*keys, F.lit(True).alias("listed")).union(more.select(*keys, F.lit(False)))


def split_player(rows: DataFrame, key: str, player: list[str], moved: DataFrame, old: object, new: object) -> DataFrame:
    """The rows listed in ``moved`` (key) get the new id wherever they had the old one."""
    marked = rows.join(moved.select(key).distinct().withColumn("__moved", F.lit(True)), key, "left")
    swap = lambda c: F.when(F.col("__moved") & (F.col(c) == old), F.lit(new)).otherwise(F.col(c)).alias(c)
    return marked.select(*[swap(c) if c in player else F.col(c) for c in rows.columns])


def with_names(people: DataFrame, name: str, english: DataFrame) -> DataFrame:
    """People with the English name of a dimension (name, english), null where it has none."""
    return people.join(english.select(F.col("name").alias(name), "english"), name, "left")


def with_team_ids(people: DataFrame, key: str, team: str, organisations: DataFrame) -> DataFrame:
    """key, teams: each person's teams in order with the ids of ``organisations`` (organisation, id)."""
    ids = organisations.select(F.col("organisation").alias(team), F.col("id").alias("team_id"))
    rows = people.join(ids, team, "left")
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(team, "team_id"))).alias("teams"))


def player_pages(results: DataFrame, player: str, season: str, weapon: str, rank: str, date: str, team: str, latest: int = 5, shown: int = 10, tie: tuple[str, ...] = ()) -> DataFrame:
    """One row per player: medals, records, teams, years, weapons, podiums by season, ratings by weapon and their history.

    Places 1 to 3 are medals, 4 to 8 the top eight. A weapon's rating is the letter of the best place in it and the player's
    latest year. The history has those of the ``latest`` results of each weapon that are among the top eight, weapon
    by weapon, ``shown`` at most. Results without a season count for no medal and no season, as in the reference, but
    are records. Results are added up per season and weapon before a player's meet; arrays are as long as a career has seasons, weapons and teams.
    """
    rows = results.select(F.col(player).alias("player"), F.col(season).cast("int").alias("season"), F.col(weapon).alias("weapon"), F.col(rank).cast("int").alias("rank"), F.col(date).alias("date"), F.col(team).alias("team"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie)])
    at = lambda low, high: F.count_if(F.col("season").isNotNull() & F.col("rank").between(low, high))
    parts = rows.groupBy("player", "season", "weapon").agg(at(1, 1).alias("gold"), at(2, 2).alias("silver"), at(3, 3).alias("bronze"), at(4, 8).alias("top8"), F.count(F.lit(1)).alias("total"), F.min("rank").alias("best"), F.collect_set("team").alias("teams"))
    sums = [F.sum(c).alias(c) for c in ("gold", "silver", "bronze", "top8", "total")]
    seasons = parts.where("season is not null").groupBy("player", "season").agg(*sums).groupBy("player").agg(F.sort_array(F.collect_list(F.struct("season", "gold", "silver", "bronze", "top8", "total")), asc=False).alias("podiums"))
    weapons = parts.where("weapon is not null").groupBy("player", "weapon").agg(F.min("best").alias("best")).groupBy("player").agg(F.array_sort(F.collect_list(F.struct("weapon", "best"))).alias("bests"))
    whole = parts.groupBy("player").agg(*[F.sum(c).alias(c) for c in ("gold", "silver", "bronze", "top8")], F.sum("total").alias("records"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("teams")))).alias("teams"), F.max("season").alias("latest"))
    newest = Window.partitionBy("player", "weapon").orderBy(F.desc("date"), *[f"t{i}" for i in range(len(tie))])
    recent = rows.where("weapon is not null").withColumn("rn", F.row_number().over(newest)).where(f"rn <= {latest} and rank between 1 and 8")
    history = recent.groupBy("player").agg(F.slice(F.array_sort(F.collect_list(F.struct("weapon", "rn", "date"))), 1, shown).alias("recent"))  # ``latest`` rows of each weapon
    met = whole.join(seasons, "player", "left").join(weapons, "player", "left").join(history, "player", "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(dict(met.dtypes)[c]))
    ratings = F.transform(none("bests"), lambda w: F.struct(w["weapon"].alias("weapon"), F.coalesce(letter_rating(F.coalesce(w["best"], F.lit(999)), F.col("latest")), F.lit("U")).alias("rating")))
    met = met.withColumn("ratings", ratings)
    rated = F.transform(none("recent"), lambda h: F.struct(h["weapon"].alias("weapon"), h["date"].alias("date"), F.get(F.filter("ratings", lambda r: r["weapon"] == h["weapon"]), F.lit(0))["rating"].alias("rating")))
    return met.select("player", "gold", "silver", "bronze", "top8", "records", "teams", F.transform(none("podiums"), lambda s: s["season"]).alias("years"), none("podiums").alias("podiums"), "ratings", rated.alias("history"))
