"""Rows of stored JSON answers, captured requests and job logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms

EVENTS = "array<struct<subEventCd:string,subEventNm:string>>"
PLAYERS = "array<struct<playerNm:string,teamNm:string,birthYear:string,birthYr:string,birthDate:string>>"
MATCHES = "struct<matchInfoList:array<struct<roundNm:string,grpNm:string,matchNo:string,upPlyNm:string,upScore:string,downPlyNm:string,downScore:string,winGbn:string>>>"
RANKS = "array<struct<rank:string,playerNm:string,teamNm:string>>"
TABLEAU = "struct<roundNmList:array<string>,groupKindList:array<string>>"


def _whole(field: str) -> Column:
    """A whole number, or null."""
    return F.trim(field).try_cast("int")


def _exploded(answers: DataFrame, body: str, items: Column) -> DataFrame:
    rest = [c for c in answers.columns if c != body]
    return answers.select(*rest, F.explode(items).alias("item"))


def events(answers: DataFrame, body: str = "body") -> DataFrame:
    """The answers' other columns with sub_event_cd, event_name; malformed and null bodies have no row."""
    rows = _exploded(answers, body, F.from_json(body, EVENTS))
    return rows.select(*rows.columns[:-1], F.col("item.subEventCd").alias("sub_event_cd"), F.col("item.subEventNm").alias("event_name"))


def players(answers: DataFrame, body: str = "body") -> DataFrame:
    """name, team, birth_year (from the first field that holds a year); items without a name go."""
    rows = _exploded(answers, body, F.from_json(body, PLAYERS))
    year = terms.birth_year("item.birthYear", "item.birthYr", "item.birthDate")
    return rows.select(*rows.columns[:-1], F.trim("item.playerNm").alias("name"), F.trim("item.teamNm").alias("team"), year.alias("birth_year")).where("name <> ''")


def matches(answers: DataFrame, body: str = "body") -> DataFrame:
    """Round, group, number, players, scores and status of each match; items without both names go."""
    rows = _exploded(answers, body, F.from_json(body, MATCHES)["matchInfoList"])
    item, number = F.col("item"), _whole("item.matchNo")
    name = lambda c: F.coalesce(F.trim(item[c]), F.lit(""))
    rows = rows.select(
        *rows.columns[:-1], item["roundNm"].alias("round_name"), item["grpNm"].alias("group_name"), F.when(number > 0, number).alias("match_number"), name("upPlyNm").alias("player1_name"),
        _whole("item.upScore").alias("player1_score"), name("downPlyNm").alias("player2_name"), _whole("item.downScore").alias("player2_score"), terms.match_state(F.coalesce(item["winGbn"], F.lit(""))).alias("match_status"),
    )
    return rows.where("player1_name <> '' or player2_name <> ''")


def ranks(answers: DataFrame, body: str = "body") -> DataFrame:
    """rank, name, team; items without a whole rank or a name go."""
    rows = _exploded(answers, body, F.from_json(body, RANKS))
    rows = rows.select(*rows.columns[:-1], _whole("item.rank").alias("rank"), F.trim("item.playerNm").alias("name"), F.trim("item.teamNm").alias("team"))
    return rows.where("rank is not null and name <> ''")


def tableau(answers: DataFrame, body: str = "body") -> DataFrame:
    """rounds, groups of a tournament's structure; empty lists where the body has none."""
    found = F.from_json(body, TABLEAU)
    none = F.array().cast("array<string>")
    rest = [c for c in answers.columns if c != body]
    return answers.select(*rest, F.coalesce(found["roundNmList"], none).alias("rounds"), F.coalesce(found["groupKindList"], none).alias("groups"))


def competition(event_rows: DataFrame, player_rows: DataFrame, match_rows: DataFrame, rank_rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per event with its players, matches and ranks as arrays of structs; empty where there are none."""
    out = event_rows
    for name, rows in (("players", player_rows), ("matches", match_rows), ("ranks", rank_rows)):
        fields = [c for c in rows.columns if c not in keys]
        held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(held, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))
    return out


def endpoint_report(captures: DataFrame, path: str, body: str, ts: str, sample_chars: int = 1000) -> DataFrame:
    """path, calls, sample: how often each endpoint was called, and the start of its first body."""
    return captures.groupBy(path).agg(F.count(F.lit(1)).alias("calls"), F.substring(F.min_by(body, F.struct(ts, body)), 1, sample_chars).alias("sample"))


def job_log(entries: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Log entries with the fields of their update, where there is one; fields that it leaves null stay."""
    fields = [c for c in updates.columns if c != key]
    renamed = updates.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in fields])
    joined = entries.join(renamed, key, "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in entries.columns])


def export_top(rankings: DataFrame, path: str, category: str, rank: str, n: int = 100) -> None:
    """Writes the first ``n`` ranks of every category as JSON lines, a folder per category."""
    rankings.where(F.col(rank) <= n).write.mode("overwrite").partitionBy(category).json(path)


def truncate(rows: DataFrame, path: str) -> None:
    """Leaves a table with its schema and no rows."""
    rows.limit(0).write.mode("overwrite").parquet(path)


def with_bracket(events_: DataFrame, brackets: DataFrame, key: str, raw: str = "raw", bracket: str = "bracket") -> DataFrame:
    """Events whose nested ``raw`` gets the new bracket where there is one; the others are as they were."""
    new = brackets.select(F.col(key), F.col(bracket).alias("__new"))
    merged = F.when(F.col("__new").isNotNull(), F.col(raw).withField(bracket, F.col("__new"))).otherwise(F.col(raw))
    return events_.join(new, key, "left").select(*[merged.alias(raw) if c == raw else F.col(c) for c in events_.columns])
