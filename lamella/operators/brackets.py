"""Elimination brackets: placement, validation and reconstruction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scalar import lookup
from ..functions.vocabulary import FINAL, SEMIFINAL


def placement(bouts: DataFrame, pool: DataFrame, keys: list[str], event_rank: str = "rank") -> DataFrame:
    """keys, name, place: the full order of an event.

    ``bouts`` has keys, round, winner, loser; ``pool`` keys, name, rank. The winner of the final is
    1 and its loser 2; losers of earlier rounds take their round's place, the best if a name lost
    more than once; pool members not placed follow in pool order. Events without bouts keep the pool order.
    """
    final = bouts.where(F.col("round") == V.FINAL)
    sides = F.explode(F.array(F.struct(F.col("winner").alias("name"), F.lit(1).alias("place")), F.struct(F.col("loser").alias("name"), F.lit(2).alias("place"))))
    top = final.select(*keys, sides.alias("s")).select(*keys, "s.*")
    lost = bouts.where(F.col("round").isin(*V.ROUND_PLACES)).select(*keys, F.col("loser").alias("name"), lookup("round", V.ROUND_PLACES).alias("place"))
    placed = top.unionByName(lost).where(F.coalesce(F.col("name"), F.lit("")) != "").groupBy(*keys, "name").agg(F.min("place").alias("place"))
    rest = pool.select(*keys, "name", event_rank).join(placed, [*keys, "name"], "left_anti")
    most = placed.groupBy(*keys).agg(F.max("place").alias("__most"))
    order = Window.partitionBy(*keys).orderBy(event_rank, "name")
    rest = rest.withColumn("__n", F.row_number().over(order)).join(most, keys, "left")
    rest = rest.select(*keys, "name", F.when(F.col("__most").isNull(), F.col(event_rank)).otherwise(F.col("__most") + F.col("__n")).cast("int").alias("place"))
    return placed.unionByName(rest)


def bracket_issues(bouts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, issues: missing rounds, rounds under half their bouts, no semifinal or final, several finals."""
    counts = bouts.groupBy(*keys).pivot("round", list(V.ROUND_BOUTS)).count()
    start = reduce(lambda a, b: F.greatest(a, b), [F.when(F.col(f"`{r}`") > 0, n).otherwise(0) for r, n in V.ROUND_BOUTS.items()])
    found = []
    for name, expected in V.ROUND_BOUTS.items():
        n = F.coalesce(F.col(f"`{name}`"), F.lit(0))
        due = F.col("__start") >= expected
        found.append(F.when(due & (n == 0), F.lit(f"missing {name}")).when(due & (n * 2 < expected), F.lit(f"incomplete {name}")))
    found.append(F.when(F.coalesce(F.col(f"`{V.FINAL}`"), F.lit(0)) > 1, F.lit("several finals")))
    return counts.withColumn("__start", start).select(*keys, F.array_compact(F.array(*found)).alias("issues"))


def reconstruct(entries: DataFrame, keys: list[str], seed: str = "seed", rank: str = "rank", name: str = "name") -> DataFrame:
    """keys, round_size, winner, loser: the bouts that lead from seeds to final ranks.

    For sizes 32, 16, 8, 4 and 2: with more survivors than the size the first 2*size - n by seed
    have byes and the rest pair high with low; with as many, all pair; with fewer the size is
    skipped. The lower rank wins, on a tie the one seeded behind. Rows stay in place and carry
    whether they are still in, so an event is read and shuffled once for all rounds.
    """
    rows = entries.select(*keys, F.col(seed).alias("seed"), F.col(rank).alias("rank"), F.col(name).alias("name")).withColumn("__in", F.lit(True))
    event, bouts = Window.partitionBy(*keys), []
    for size in (32, 16, 8, 4, 2):
        n, at = F.col("__n"), F.col("__at")
        rows = rows.withColumns({"__n": F.count_if("__in").over(event), "__at": F.row_number().over(event.orderBy(~F.col("__in"), "seed", "name"))})
        byes = F.when(n > size, F.greatest(F.lit(0), 2 * size - n)).when(n == size, F.lit(0)).otherwise(n)
        rows = rows.withColumns({"__slot": at - byes, "__field": n - byes})
        slot, field = F.col("__slot"), F.col("__field")
        rows = rows.withColumn("__plays", F.col("__in") & (slot > 0) & (slot * 2 != field + 1))
        rows = rows.withColumns({"__pair": F.when(F.col("__plays"), F.least(slot, field + 1 - slot)).otherwise(-at), "__best": F.struct("rank", (-F.col("seed")).alias("behind"), "name", "__at")})
        pair = Window.partitionBy(*keys, "__pair")
        rows = rows.withColumns({"__w": F.min("__best").over(pair), "__l": F.max("__best").over(pair)})
        won = F.col("__plays") & (F.col("__w.__at") == at)
        bout = F.when(won, F.struct(F.lit(size).alias("round_size"), F.col("__w.name").alias("winner"), F.col("__l.name").alias("loser")))
        rows = rows.withColumns({f"__b{size}": bout, "__in": F.col("__in") & (~F.col("__plays") | won)})
        bouts.append(f"__b{size}")
    return rows.select(*keys, F.explode(F.array_compact(F.array(*bouts))).alias("b")).select(*keys, "b.*")


def incomplete_rounds(rounds: Column, required: list[str]) -> Column:
    """The required rounds that are missing."""
    return F.array_except(F.array(*map(F.lit, required)), rounds)


def against_ranks(bouts: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, valid, final_winner, issues, warnings: a bracket held against the final ranks.

    bouts has keys, number, round, winner, loser; ranks has keys, rank, name. The champion must be
    first; among several finals the first one whose winner is counts, and their number is a
    warning. A losing finalist who isn't second and losers of semifinals who aren't third are
    warnings. Without bouts or ranks an event is invalid.
    """
    first = ranks.where("name <> ''").groupBy(*keys).agg(*[F.collect_set(F.when(F.col("rank") == r, F.trim("name"))).alias(f"r{r}") for r in (1, 2, 3)])
    finals = F.sort_array(F.collect_list(F.when(F.col("round") == FINAL, F.struct("number", "winner", "loser"))))
    losers = F.sort_array(F.collect_set(F.when(F.col("round") == SEMIFINAL, F.col("loser"))))
    met = bouts.groupBy(*keys).agg(finals.alias("finals"), losers.alias("losers")).join(first, keys, "full")
    won = F.filter("finals", lambda f: F.array_contains(F.col("r1"), f["winner"]))
    used = F.coalesce(F.get(won, F.lit(0)), F.get(F.col("finals"), F.lit(0)))
    none = F.col("finals").isNull() | F.col("r1").isNull()
    issues = F.array_compact(F.array(F.when(none, "nothing to compare"), F.when(~none & (F.size("finals") == 0), "no final"), F.when(~none & (F.size("finals") > 0) & (F.size(won) == 0), "champion is not first")))
    third = F.transform(F.filter("losers", lambda n: ~F.array_contains(F.col("r3"), n)), lambda n: F.concat(F.lit("not third: "), n))
    several = F.when(~none & (F.size("finals") > 1), F.lit("several finals"))
    second = F.when(~none & used["loser"].isNotNull() & ~F.array_contains(F.col("r2"), used["loser"]), F.lit("finalist is not second"))
    warnings = F.when(none, F.array().cast("array<string>")).otherwise(F.concat(F.array_compact(F.array(several, second)), third))
    return met.select(*keys, (F.size(issues) == 0).alias("valid"), used["winner"].alias("final_winner"), issues.alias("issues"), warnings.alias("warnings"))


def changed_winners(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, low, high, old_winner, new_winner of bouts of the same two whose winner differs; both have keys, winner, loser."""
    old, new = (b.select(*keys, F.least("winner", "loser").alias("low"), F.greatest("winner", "loser").alias("high"), F.col("winner").alias(n)) for b, n in ((before, "old_winner"), (after, "new_winner")))
    return old.join(new, [*keys, "low", "high"]).where("old_winner <> new_winner")


def seed_positions(size: Column) -> Column:
    """array of seeds by place: neighbours meet first, their seeds adding up to size + 1, and the best meet last.

    Sizes are powers of two from 2 on; the order of 16 and 32 is the customary one, and the other sizes follow its rule.
    """
    rounds = F.slice(F.sequence(F.lit(1), F.greatest(F.log2(size).cast("int"), F.lit(2))), 2, F.greatest(F.log2(size).cast("int") - 2, F.lit(0)))

    def doubled(held: Column, r: Column) -> Column:
        other = lambda s: F.pow(F.lit(2), r).cast("int") + 1 - s
        return F.flatten(F.transform(held, lambda s, i: F.when(i % 2 == 0, F.array(s, other(s))).otherwise(F.array(other(s), s))))

    order = F.aggregate(rounds, F.array(F.lit(1), F.lit(2)), doubled)
    return F.when(size == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.flatten(F.transform(order, lambda s: F.array(s, size + 1 - s))))


def match_pairs(round_size: Column) -> Column:
    """array of (first, second): the places that meet in a round."""
    return F.transform(F.sequence(F.lit(1), round_size - 1, F.lit(2)), lambda i: F.struct(i.alias("first"), (i + 1).alias("second")))


def inferred_finals(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, round, winner, loser, inferred: final and semifinals that ranks 1 to 3 (3 twice) stand for.

    The first of the two thirds by name is taken to have lost to the champion. Events without a first and a second have none.
    """
    named = ranks.where("name is not null and rank <= 4").groupBy(*keys).agg(
        F.min(F.when(F.col("rank") == 1, F.col("name"))).alias("one"), F.min(F.when(F.col("rank") == 2, F.col("name"))).alias("two"), F.sort_array(F.collect_list(F.when(F.col("rank") >= 3, F.struct("rank", "name")))).alias("lost"),
    )
    bout = lambda name, a, b: F.struct(F.lit(name).alias("round"), a.alias("winner"), b.alias("loser"))
    third = lambda i: F.get(F.col("lost"), F.lit(i))["name"]
    semis = F.array(F.when(third(0).isNotNull(), bout(SEMIFINAL, F.col("one"), third(0))), F.when(third(1).isNotNull(), bout(SEMIFINAL, F.col("two"), third(1))))
    rows = named.where("one is not null and two is not null").select(*keys, F.explode(F.array_compact(F.concat(semis, F.array(bout(FINAL, F.col("one"), F.col("two")))))).alias("b"))
    return rows.select(*keys, "b.round", "b.winner", "b.loser", F.lit(True).alias("inferred"))


def full_bouts(bouts: DataFrame, keys: list[str]) -> DataFrame:
    """Bouts of two sides as winner and loser with their scores; byes and undecided bouts go.

    bouts has keys, round, seed1, name1, score1, seed2, name2, score2, winner_seed.
    """
    one = F.col("winner_seed") == F.col("seed1")
    side = lambda yes: [F.when(yes, F.col(f"{c}1")).otherwise(F.col(f"{c}2")) for c in ("seed", "name", "score")]
    names = [f"{who}_{c}" for who in ("winner", "loser") for c in ("seed", "name", "score")]
    rows = bouts.where("name1 is not null and name2 is not null and winner_seed in (seed1, seed2)")
    return rows.select(*keys, "round", *[c.alias(n) for c, n in zip([*side(one), *side(~one)], names, strict=True)])


def legacy_rounds(full: DataFrame, keys: list[str]) -> DataFrame:
    """keys, results_by_round: map of round to its winner rows (seed, name, scores), by seed."""
    rows = full.groupBy(*keys, "round").agg(F.sort_array(F.collect_list(F.struct(F.col("winner_seed").alias("seed"), F.col("winner_name").alias("name"), F.col("winner_score").alias("score"), F.col("loser_score").alias("against")))).alias("rows"))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("round", "rows")))).alias("results_by_round"))
