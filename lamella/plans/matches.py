"""The index of all bouts and head-to-head records over the benchmark tables, beside the same results in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bouts as B
from .pages import _LINES_SQL, _lines
from .registry import query


def event_documents(t, dated: bool = True) -> DataFrame:
    """event, day (if ``dated``) and the nested arrays of an event for each order: a pool of its lines, and a bracket of neighbours in one of four shapes.

    Every other bracket of a tree stores its first bout twice: the earlier one with the winner's and loser's places exchanged.
    """
    rows = _lines(t)
    if dated:
        rows = rows.join(t("orders").select(F.col("o_orderkey").alias("event"), F.col("o_orderdate").cast("date").alias("day")), "event")
    name = lambda e: F.concat(F.lit("P"), (e["partkey"] % 40).cast("string"), F.lit("/"), e["pos"].cast("string"))
    who = lambda e, score: F.struct(name(e).alias("name"), F.concat(F.lit("T"), e["suppkey"].cast("string")).alias("team"), e["pos"].alias("seed"), score.cast("int").alias("score"))
    cheap = lambda x, y: F.when(x["price"] >= y["price"], y).otherwise(x)
    dear = lambda x, y: F.when(x["price"] >= y["price"], x).otherwise(y)

    def cell(me: Column, other: Column) -> Column:
        won = (me["price"] > other["price"]) | ((me["price"] == other["price"]) & (me["pos"] < other["pos"]))
        return F.when(me["pos"] == other["pos"], F.lit(None)).when(won, F.when(other["qty"] % 2 == 0, "V").otherwise('{"type":"V","score":4}')).otherwise((me["qty"] % 4).cast("string"))

    results = F.transform("es", lambda me: F.struct(name(me).alias("name"), F.lit("T").alias("team"), me["pos"].alias("rank"), F.transform("es", lambda o: cell(me, o)).alias("scores")))
    both = lambda r: F.array(*[F.struct(F.lit(1).alias("round_number"), F.lit(n).alias("pool_number"), x.alias("results")) for n, x in ((1, r), (2, F.reverse(r)))])
    pools = F.get(F.transform(F.array(results), both), F.lit(0))  # results are built once
    pairs = F.expr("if(size(es) > 1, transform(sequence(0, size(es) - 2, 2), i -> struct(es[i] as x, es[i + 1] as y)), slice(transform(es, e -> struct(e as x, e as y)), 1, 0))")
    rows = rows.withColumn("pairs", pairs).withColumn("shape", F.col("event") % 4)
    lost = lambda p: cheap(p["x"], p["y"])["qty"] % 14

    def tree(p: Column, i: Column, turned: bool) -> Column:
        a, b = dear(p["x"], p["y"]), cheap(p["x"], p["y"])
        a, b = (b, a) if turned else (a, b)
        return F.struct(F.lit("32강").alias("round"), (i if turned else i + 100).alias("table_index"), who(a, F.lit(15)).alias("winner"), who(b, lost(p)).alias("loser"), F.struct(F.lit(15).alias("winner_score"), lost(p).cast("int").alias("loser_score")).alias("score"))

    full = F.concat(F.transform("pairs", lambda p, i: tree(p, i, False)), F.when(F.col("event") % 8 == 0, F.transform(F.slice("pairs", 1, 1), lambda p, i: tree(p, i, True))).otherwise(F.slice(F.transform("pairs", lambda p, i: tree(p, i, True)), 1, 0)))
    x = lambda p: who(p["x"], F.when(p["x"]["price"] >= p["y"]["price"], 15).otherwise(lost(p)))
    y = lambda p: who(p["y"], F.when(p["x"]["price"] >= p["y"]["price"], lost(p)).otherwise(15))
    won = lambda p: name(dear(p["x"], p["y"]))
    flat = F.transform("pairs", lambda p, i: F.struct(F.lit("32강").alias("round"), (i + 1).alias("match_number"), x(p).alias("player1"), y(p).alias("player2"), won(p).alias("winner_name"), F.lit(False).alias("is_bye")))
    empty = {f"player{i}_{c}": "int" if c in ("seed", "score") else "string" for i in (1, 2) for c in ("seed", "name", "team", "score")}
    nested = F.transform("pairs", lambda p: F.struct(x(p).alias("player1"), y(p).alias("player2"), F.lit(None).cast("string").alias("winnerName"), F.lit(None).cast("boolean").alias("isBye"), *[F.lit(None).cast(k).alias(c) for c, k in empty.items()], F.lit(None).cast("string").alias("winner_name"), F.lit(None).cast("boolean").alias("is_bye")))
    entry = lambda e, i, score: F.struct(F.lit("32강").alias("round"), i.alias("table_index"), e["pos"].alias("seed"), name(e).alias("name"), F.concat(F.lit("T"), e["suppkey"].cast("string")).alias("team"), F.lit(True).alias("is_match_result"), score.alias("score"))
    winner_score = lambda p, own: F.when(own, F.lit("15")).otherwise(F.concat(F.lit('{"loser_score":'), lost(p).cast("string"), F.lit("}")))
    legacy = F.flatten(F.transform("pairs", lambda p, i: F.array(entry(p["y"], i, winner_score(p, p["x"]["price"] < p["y"]["price"])), entry(p["x"], i, winner_score(p, p["x"]["price"] >= p["y"]["price"])))))
    ranks = F.transform(F.filter("es", lambda e: e["pos"] != 3), lambda e: F.struct((F.lit(100) - e["pos"]).alias("rank"), name(e).alias("name"), F.lit("T").alias("team")))
    shapes = {
        "pool_rounds": pools, "final_rankings": ranks, "full_bouts": F.when(F.col("shape") == 0, full), "bouts": F.when(F.col("shape") == 1, flat),
        "bouts_by_round": F.when(F.col("shape") == 2, F.map_from_arrays(F.array(F.lit("32강")), F.array(nested))), "results_by_round": F.when(F.col("shape") == 3, F.map_from_arrays(F.array(F.lit("32강")), F.array(legacy))),
    }
    return rows.select("event", *["day"] * dated, *[c.alias(n) for n, c in shapes.items()])


_SIDES_SQL = f"""
    {_LINES_SQL}, p AS (SELECT event, pos, lines, price, qty, 'P' || l_partkey % 40 || '/' || pos AS name, 'T' || l_suppkey AS team, CASE WHEN pos <> 3 THEN 100 - pos END AS rank FROM lines),
    pool AS (SELECT a.event, 'pool' AS kind, 'Pool' AS round, 0 AS table_index, a.name, 'T' AS team, b.name AS opponent, 'T' AS opponent_team, a.rank, b.rank AS opponent_rank, a.price > b.price OR (a.price = b.price AND a.pos < b.pos) AS is_win, a.qty AS q1, b.qty AS q2
             FROM p a JOIN p b ON a.event = b.event AND a.pos <> b.pos WHERE a.lines <= 12),
    pairs AS (SELECT a.event, a.pos, a.name AS n1, a.team AS t1, a.rank AS r1, a.pos AS s1, b.name AS n2, b.team AS t2, b.rank AS r2, a.price >= b.price AS first, CASE WHEN a.price >= b.price THEN b.qty ELSE a.qty END % 14 AS lost
              FROM p a JOIN p b ON a.event = b.event AND b.pos = a.pos + 1 WHERE a.pos % 2 = 1),
    bracket AS (
        SELECT event, CASE WHEN event % 4 = 0 THEN 'tree' ELSE 'rounds' END AS kind, '32강' AS round, CASE WHEN event % 4 = 0 THEN CAST((pos - 1) // 2 + 100 AS INT) ELSE 0 END AS table_index, n1 AS name, t1 AS team, n2 AS opponent, t2 AS opponent_team, r1 AS rank, r2 AS opponent_rank, first AS is_win,
               CASE WHEN first THEN 15 ELSE lost END AS score, CASE WHEN first THEN lost ELSE 15 END AS opponent_score FROM pairs
        UNION ALL SELECT event, CASE WHEN event % 4 = 0 THEN 'tree' ELSE 'rounds' END, '32강', CASE WHEN event % 4 = 0 THEN CAST((pos - 1) // 2 + 100 AS INT) ELSE 0 END, n2, t2, n1, t1, r2, r1, NOT first, CASE WHEN first THEN lost ELSE 15 END, CASE WHEN first THEN 15 ELSE lost END FROM pairs),
    sides AS (
        SELECT event, kind, round, table_index, name, team, opponent, opponent_team, rank, opponent_rank, is_win, CASE WHEN is_win THEN CASE WHEN q2 % 2 = 0 THEN 5 ELSE 4 END ELSE q1 % 4 END AS score, CASE WHEN is_win THEN q2 % 4 ELSE CASE WHEN q1 % 2 = 0 THEN 5 ELSE 4 END END AS opponent_score FROM pool
        UNION ALL SELECT event, kind, round, table_index, name, team, opponent, opponent_team, rank, opponent_rank, is_win, score, opponent_score FROM bracket)"""


@query(f"WITH {_SIDES_SQL} SELECT * FROM sides")
def bout_index(t):
    """Every bout of every stored shape; of the pools the second repeats the first and goes."""
    return B.bout_index(event_documents(t, dated=False), ["event"])


@query(f"""
    WITH {_SIDES_SQL}, right_ AS (SELECT s.*, o_orderdate AS day, CASE WHEN kind = 'tree' AND rank IS NOT NULL AND opponent_rank IS NOT NULL THEN rank < opponent_rank ELSE is_win END AS won FROM sides s JOIN orders ON event = o_orderkey),
    met AS (SELECT event, CAST(day AS DATE) AS day, name, opponent, kind, round, opponent_team, won, CASE WHEN won = is_win THEN score ELSE opponent_score END AS mine, CASE WHEN won = is_win THEN opponent_score ELSE score END AS theirs FROM right_),
    n AS (SELECT split_part(name, '/', 1) AS player, split_part(opponent, '/', 1) AS rival, * FROM met WHERE split_part(name, '/', 1) <> split_part(opponent, '/', 1)),
    d AS (SELECT DISTINCT ON (event, player, rival, kind, k) * FROM (SELECT *, CASE WHEN kind <> 'tree' THEN round || mine || '-' || theirs END AS k, CASE WHEN kind = 'tree' THEN CAST(split_part(least(name, opponent), '/', 2) AS INT) ELSE 0 END AS place FROM n)
          ORDER BY event, player, rival, kind, k, place DESC, won DESC, mine DESC, theirs DESC, round DESC, opponent_team DESC),
    o AS (SELECT *, row_number() OVER (PARTITION BY player, rival ORDER BY day DESC, event DESC, won DESC, mine DESC, theirs DESC, round DESC) AS rn FROM d)
    SELECT player, rival, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, round_even(count(*) FILTER (won) * 100.0::DOUBLE / count(*), 1) AS win_rate, max(day) FILTER (rn = 1) AS last_day, max(CAST(won AS INT)) FILTER (rn = 1) = 1 AS last_won,
           max(mine || '-' || theirs) FILTER (rn = 1) AS last_score, max(round) FILTER (rn = 1) AS last_round FROM o GROUP BY 1, 2""")
def head_to_head_settled(t):
    """Records of players, with stored results that the final ranks contradict, and bouts stored twice."""
    base = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(1))
    docs = event_documents(t)
    rows = B.bout_index(docs, ["event", "day"]).withColumn("player", base("name")).withColumn("rival", base("opponent"))
    met = B.meetings(rows, ["event", "day"], "player", "rival")
    out = B.head_to_head_records(met, "day", "player", "rival", tie=("event",))
    return out.select("player", "rival", "wins", "losses", "win_rate", F.col("last.date").alias("last_day"), F.col("last.is_win").alias("last_won"), F.concat_ws("-", "last.score", "last.opponent_score").alias("last_score"), F.col("last.round").alias("last_round"))
