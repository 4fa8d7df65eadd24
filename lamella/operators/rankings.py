"""Rankings by the sum of the best results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..sources.tables import numbered


def flatten_results(documents: DataFrame, as_of: str) -> DataFrame:
    """Result rows of nested competition documents, with their three ordinals.

    Events whose name holds ``단`` are left out, as are rows without name or rank. A date that
    can't be read becomes ``as_of``.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("comp_ord"), "competition", F.posexplode_outer("events").alias("event_ord", "event"))
    rows = rows.select("comp_ord", "competition", "event_ord", "event", F.posexplode_outer("event.final_rankings").alias("row_ord", "r"))
    keep = ~F.coalesce(F.col("event.name").contains("단"), F.lit(False)) & (F.coalesce(F.col("r.name"), F.lit("")) != "") & (F.coalesce(F.col("r.rank"), F.lit(0)) != 0)
    return rows.where(keep).select(
        "comp_ord", "event_ord", "row_ord", F.col("competition.name").alias("comp_name"),
        F.coalesce(F.try_to_date("competition.start_date", "yyyy-MM-dd"), F.lit(as_of).cast("date")).alias("comp_date"),
        F.col("event.name").alias("event_name"), F.col("event.weapon").alias("weapon"), F.col("event.gender").alias("gender"), F.col("event.age_group").alias("age_group"),
        F.col("event.total_participants").alias("participants"), F.col("r.name").alias("name"), F.col("r.team").alias("team"), F.col("r.rank").alias("rank"),
    )


def best_n_ranking(rows: DataFrame, cell: list[str], player: str, points: str, rank: str, order: list[str], n: int = 4) -> DataFrame:
    """cell, player, total, gold, silver, bronze, competitions, best (list), position.

    The total is of the best n rows (ties: first in ``order``); medals and competitions count
    all rows. Positions are sequential: total, medals and competitions descending, then the
    player. The n best rows are cut before the shuffle and the counts combine before theirs,
    so a player with very many rows is no large task; positions are counted in ranges, so a cell
    with very many players is none either. Null points count as none.
    """
    by = [*cell, player]
    best = Window.partitionBy(*by).orderBy(F.desc_nulls_last(points), *order)
    top = rows.select(*by, points, *order).withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= n)
    top = top.groupBy(*by).agg(
        F.bround(F.coalesce(F.sum(F.col(points).cast("decimal(18,2)")), F.lit(0)).cast("double"), 2).alias("total"),
        F.transform(F.array_sort(F.collect_list(F.struct("__n", points))), lambda x: x[points]).alias("best"),
    )
    medals = {"gold": 1, "silver": 2, "bronze": 3}
    counts = rows.groupBy(*by).agg(*[F.count_if(F.col(rank) == k).alias(m) for m, k in medals.items()], F.count(F.lit(1)).alias("competitions"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by]
    joined = top.alias("t").join(counts.alias("c"), same).select(*[f"t.{c}" for c in by], "total", "gold", "silver", "bronze", "competitions", "best")
    place = [F.desc("total"), F.desc("gold"), F.desc("silver"), F.desc("bronze"), F.desc("competitions"), player]
    return numbered(joined, cell, place, "position")


def in_cells(rows: DataFrame, memberships: Column, name: str = "cell") -> DataFrame:
    """Each row once for every cell of the array ``memberships``: one grouping instead of one per cell."""
    return rows.withColumn(name, F.explode(memberships))


def recent_rows(rows: DataFrame, date: str, as_of: str, months: int = 12) -> DataFrame:
    """Rows of the last ``months`` of 30 days."""
    return rows.where(F.col(date) >= F.date_sub(F.lit(as_of).cast("date"), 30 * months))


def podium_by_season(rows: DataFrame, player: str, season: Column, rank: str) -> DataFrame:
    """Medals and other places up to 8 of each player and season."""
    return rows.groupBy(player, season.alias("season")).agg(
        F.count_if(F.col(rank) == 1).alias("gold"), F.count_if(F.col(rank) == 2).alias("silver"), F.count_if(F.col(rank) == 3).alias("bronze"),
        F.count_if(F.col(rank).between(4, 8)).alias("top8"), F.count(F.lit(1)).alias("entries"),
    )


#: Age groups that have categories, and the one of the national team.
CATEGORY_AGES = ("Y14", "Cadet", "Junior", "Veteran", "MS", "HS", "UNI", "SR", "U17", "NT")
NATIONAL_AGE, PROFESSIONAL = "NT", "PRO"


def ranking_rows(rows: DataFrame, age_group: str, category: str | None = None, age: str = "age_group", kind: str = "category", title: str = "competition") -> DataFrame:
    """The results that a ranking of an age group counts.

    The national team counts professional results of all ages in its own competitions. Groups with
    categories count professional results unless told otherwise; the others take no notice of categories.
    """
    if age_group == NATIONAL_AGE:
        return rows.where((F.col(kind) == PROFESSIONAL) & F.contains(title, F.lit(V.NATIONAL_KEYWORD)))
    rows = rows.where(F.col(age) == age_group)
    return rows.where(F.col(kind) == (category or PROFESSIONAL)) if age_group in CATEGORY_AGES else rows


def listed_events(rows: DataFrame, national: bool, title: str = "competition") -> DataFrame:
    """Events of the list: those of the national team alone, or all others; a null title is no competition of theirs."""
    own = F.coalesce(F.contains(title, F.lit(V.NATIONAL_KEYWORD)), F.lit(False))
    return rows.where(own if national else ~own)
