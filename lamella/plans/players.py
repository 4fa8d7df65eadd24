"""Player, club and history operators over the benchmark tables, beside the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms as M
from ..operators import players as P
from .registry import query


@query("""
    SELECT o_custkey AS name, list(o_orderkey ORDER BY o_orderkey) AS keys, list(o_totalprice ORDER BY o_orderkey) AS prices FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1 GROUP BY 1""")
def player_index(t):
    rows = t("orders").withColumnRenamed("o_custkey", "name")
    got = P.player_index(rows, "name", ["o_orderpriority"], ["o_orderkey"], ["o_orderkey", "o_totalprice"])
    return got.select("name", F.col("records.o_orderkey").alias("keys"), F.col("records.o_totalprice").alias("prices"))


@query("""
    WITH b AS (SELECT l_suppkey AS player, l_orderkey AS event, count(*) AS bouts, count(*) FILTER (l_quantity > 25) AS wins FROM lineitem GROUP BY 1, 2),
    r AS (SELECT DISTINCT l_suppkey AS player, l_orderkey AS event, CAST(l_suppkey % 8 + 1 AS INT) AS rank FROM lineitem UNION ALL SELECT -1, o_orderkey, 1 FROM orders WHERE o_orderkey % 10 = 0)
    SELECT r.event, r.player, rank, o_orderpriority AS title, coalesce(bouts, 0) AS bouts, coalesce(wins, 0) AS wins, coalesce(round_even(wins * 100.0::DOUBLE / bouts, 1), 0) AS win_rate FROM r JOIN orders ON event = o_orderkey LEFT JOIN b USING (player, event)""")
def competition_history(t):
    lines = t("lineitem").select(F.col("l_suppkey").alias("player"), F.col("l_orderkey").alias("event"), (F.col("l_quantity") > 25).alias("won"))
    results = lines.select("player", "event").distinct().withColumn("rank", (F.col("player") % 8 + 1).cast("int"))
    results = results.union(t("orders").where("o_orderkey % 10 = 0").select(F.lit(-1).cast("bigint"), "o_orderkey", F.lit(1)))
    events = t("orders").select(F.col("o_orderkey").alias("event"), F.col("o_orderpriority").alias("title"))
    return P.competition_history(results, events, lines, ["player", "event"]).select("event", "player", "rank", "title", "bouts", "wins", "win_rate")


@query("""
    SELECT s_suppkey, s_name, n_name AS coach, coalesce(n, 0) AS participants FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey""")
def lessons_with_counts(t):
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", F.col("n_name").alias("coach"))
    return P.with_counts(rows, "s_suppkey", t("lineitem").select(F.col("l_suppkey").alias("s_suppkey")))


@query("""
    SELECT o_orderkey, coalesce(a, []) AS lines, coalesce(b, []) AS amounts FROM orders
    LEFT JOIN (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_quantity) AS a, list(l_quantity ORDER BY l_linenumber, l_quantity) AS b FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def lesson_detail(t):
    parts = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    rows = P.with_parts(t("orders").select("o_orderkey"), "o_orderkey", parts, ["l_linenumber", "l_quantity"])
    return rows.select("o_orderkey", F.col("parts.l_linenumber").alias("lines"), F.col("parts.l_quantity").alias("amounts"))


@query("SELECT 'orders' AS \"table\", count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'nation', count(*) FROM nation")
def table_counts(t):
    return P.table_counts({name: t(name) for name in ("orders", "lineitem", "nation")})


@query("""
    WITH w AS (SELECT unnest(['1-URGENT', '5-LOW', 'none']) AS weapon), y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders)
    SELECT y.year, w.weapon, count(o_orderkey) AS n FROM y CROSS JOIN w LEFT JOIN orders ON year(o_orderdate) = y.year AND o_orderpriority = w.weapon GROUP BY 1, 2""")
def totals_by_year(t):
    return P.totals_by(t("orders"), F.year("o_orderdate"), F.col("o_orderpriority"), ["1-URGENT", "5-LOW", "none"])


_STATS_SQL = "SELECT l_suppkey AS player, count(DISTINCT l_orderkey) AS events, count(*) FILTER (l_quantity > 25) AS rounds_won, round_even(count(*) FILTER (l_quantity > 25) / count(DISTINCT l_orderkey)::DOUBLE, 2) AS mean_rounds FROM lineitem GROUP BY 1"


def _stats(t):
    lines = t("lineitem").select(F.col("l_suppkey").alias("player"), "l_orderkey", (F.col("l_quantity") > 25).alias("won"))
    return P.bracket_stats(lines, "player", "l_orderkey", "won")


@query(_STATS_SQL)
def bracket_player_stats(t):
    return _stats(t)


_PROFILE_SQL = f"""
    SELECT s_suppkey AS player, s_name, coalesce(events, 0) AS events, coalesce(rounds_won, 0) AS rounds_won, coalesce(mean_rounds, 0) AS mean_rounds, coalesce(golds, 0) AS golds FROM supplier
    LEFT JOIN ({_STATS_SQL}) s ON s_suppkey = s.player LEFT JOIN (SELECT o_custkey, count(*) AS golds FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = s_suppkey"""


def _profiles(t):
    golds = t("orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("player")).agg(F.count(F.lit(1)).alias("golds"))
    return P.composite(t("supplier").select(F.col("s_suppkey").alias("player"), "s_name"), "player", [_stats(t), golds])


@query(_PROFILE_SQL)
def player_composite(t):
    return _profiles(t)


@query(f"SELECT * FROM ({_PROFILE_SQL}) WHERE player IN (3, 5, 8)")
def compared_players(t):
    return P.compared(_profiles(t), "player", [3, 5, 8, 5])


_ROSTER_SQL = """
    SELECT c_custkey, c_name, c_mktsegment, last, coalesce(CAST(last AS DATE) >= DATE '2001-06-01' - 90, false) AS active FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal > 0"""


def _roster(t):
    last = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    students = t("customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    return P.activity(students.join(last, "c_custkey", "left"), "last", "2001-06-01")


@query(_ROSTER_SQL)
def roster(t):
    return _roster(t)


@query(f"""
    WITH r AS ({_ROSTER_SQL}) SELECT c_mktsegment AS tab, count(*) AS players, count(*) FILTER (active) AS active_players FROM r GROUP BY 1 UNION ALL SELECT '전체', count(*), count(*) FILTER (active) FROM r""")
def roster_tabs(t):
    return P.tab_counts(_roster(t), "c_mktsegment", "active")


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
    SELECT o_custkey, min(CAST(substr(o_orderpriority, 1, 1) AS INT)) AS best, round_even(avg(CAST(substr(o_orderpriority, 1, 1) AS INT)), 1) AS average, count(*) AS records,
           list(o_orderkey ORDER BY rn) FILTER (rn <= 5) AS latest FROM r GROUP BY 1""")
def player_answer(t):
    rows = t("orders").withColumn("rank", F.substring("o_orderpriority", 1, 1).cast("int"))
    got = P.player_answer(rows, "o_custkey", "rank", [F.desc("o_orderdate"), F.col("o_orderkey")], ["o_orderkey"])
    return got.withColumn("latest", F.col("latest.o_orderkey"))


@query("""
    SELECT o_custkey, arg_min(o_orderstatus || ' ' || substr(o_orderpriority, 1, 1), (-year(o_orderdate), substr(o_orderpriority, 1, 1), o_orderstatus)) AS podium FROM orders WHERE CAST(substr(o_orderpriority, 1, 1) AS INT) <= 3 GROUP BY 1""")
def recent_podium(t):
    rows = t("orders").select("o_custkey", F.year("o_orderdate").alias("season"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"), "o_orderstatus")
    return P.recent_podium(rows, "o_custkey", "season", "rank", "o_orderstatus")


@query("""
    SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 15 GROUP BY 1""")
def latest_bouts(t):
    got = P.latest_nested(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 15, ["o_orderkey"], "rows")
    return got.select("o_custkey", F.col("rows.o_orderkey").alias("keys"))


@query("""
    SELECT o_custkey, o_orderkey, CAST(n AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 5 AND CAST(substr(o_orderpriority, 1, 1) AS INT) <= 3""")
def weapon_records(t):
    """The latest five records of each weapon, and of those the ones with a good rank: the order matters."""
    rows = P.latest_rows(t("orders"), ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.col("o_orderkey")], 5)
    return rows.where(F.substring("o_orderpriority", 1, 1).cast("int") <= 3).select("o_custkey", "o_orderkey", "rn")


@query("SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 100")
def bounded_history(t):
    return P.latest_rows(t("events"), ["event_type"], [F.desc("ts"), F.col("event_id")], 100).select("event_type", "event_id", "ts")


@query("""
    SELECT c_custkey, c_name, CASE WHEN c_name LIKE '%12%' THEN 0 WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS priority FROM customer
    WHERE c_name LIKE '%12%' OR c_mktsegment = 'BUILDING' OR c_nationkey = 3 ORDER BY priority, c_acctbal DESC, c_custkey LIMIT 60""")
def identity_search(t):
    fields = [F.col("c_name").contains("12"), F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") == 3]
    return P.ordered_search(t("customer"), "c_custkey", fields, 60, [F.desc("c_acctbal")]).select("c_custkey", "c_name", "priority")


@query("""
    WITH l AS (SELECT DISTINCT CAST(o_custkey % 50 AS VARCHAR) AS name, CASE WHEN o_custkey % 2 = 0 THEN 'BUILD' ELSE 'ZZZ' END AS club FROM orders), p AS (SELECT CAST(c_custkey % 60 AS VARCHAR) AS name, c_mktsegment AS team FROM customer)
    SELECT l.name, club, coalesce(min(team) FILTER (team LIKE '%' || club || '%'), club) AS team FROM l LEFT JOIN p USING (name) GROUP BY 1, 2""")
def tracked_players(t):
    listed = t("orders").select((F.col("o_custkey") % 50).cast("string").alias("name"), F.when(F.col("o_custkey") % 2 == 0, F.lit("BUILD")).otherwise(F.lit("ZZZ")).alias("club")).distinct()
    return P.tracked(t("customer").select((F.col("c_custkey") % 60).cast("string").alias("name"), F.col("c_mktsegment").alias("team")), listed)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment LIKE '%BUILD%' OR c_mktsegment LIKE '%AUTO%' AND c_name IN ('Customer#00000001', 'Customer#000000001', 'Customer#000000007')")
def allowed_players(t):
    clubs = [("BUILD", []), ("AUTO", ["Customer#00000001", "Customer#000000001", "Customer#000000007"])]
    return P.allowed(t("customer"), "c_name", "c_mktsegment", clubs).select("c_custkey", "c_name")


@query("SELECT DISTINCT n_name FROM nation WHERE (n_name LIKE '%NATION_1%' OR 'NATION_1' LIKE '%' || n_name || '%' OR substr(n_name, 1, 1) = 'N') AND n_name <> 'NATION_1' ORDER BY n_name LIMIT 10")
def similar_names(t):
    return P.similar_names(t("nation"), "n_name", "NATION_1")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE '%BUILD%' OR c_mktsegment LIKE '%FURN%'")
def competitions_by_word(t):
    return P.any_word(t("customer"), "c_mktsegment", "BUILD FURN").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey AS k, true AS listed FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, false FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def merged_names(t):
    listed = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return P.merged_names(listed, t("orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey = 3 AND l_orderkey % 2 = 0 THEN -3 ELSE l_suppkey END AS l_suppkey, CASE WHEN l_partkey = 3 AND l_orderkey % 2 = 0 THEN -3 ELSE l_partkey END AS l_partkey FROM lineitem")
def split_player(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return P.split_player(rows, "l_orderkey", ["l_suppkey", "l_partkey"], t("orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey")), 3, -3)


@query("""
    SELECT c_custkey, CASE WHEN c_name = 'Customer#000000007' AND list_contains(teams, 'BUILDING') THEN 'S1' WHEN c_name = 'Customer#000000009' AND (list_contains(teams, 'MACHINERY') OR list_contains(teams, 'x')) THEN 'S2' ELSE 'P' || c_custkey END AS id,
           n_name AS english FROM (SELECT *, [c_mktsegment, 'BUILDING'] AS teams FROM customer) LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0""")
def special_ids(t):
    rows = t("customer").withColumn("teams", F.array("c_mktsegment", F.lit("BUILDING")))
    fixed = [("S1", "Customer#000000007", ["BUILDING"]), ("S2", "Customer#000000009", ["MACHINERY", "x"])]
    named = t("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("name"), F.col("n_name").alias("english"))
    got = P.with_names(rows, "c_nationkey", named)
    return got.select("c_custkey", M.special_id("c_name", "teams", fixed, F.concat(F.lit("P"), F.col("c_custkey").cast("string"))).alias("id"), "english")


@query("SELECT o_custkey, list(DISTINCT team ORDER BY team) AS teams, coalesce(list(DISTINCT id ORDER BY id) FILTER (id IS NOT NULL), []) AS ids FROM (SELECT o_custkey, o_orderpriority AS team, CASE WHEN o_orderpriority <> '5-LOW' THEN 'K' || substr(o_orderpriority, 1, 1) END AS id FROM orders) GROUP BY 1")
def team_ids(t):
    organisations = t("orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("organisation"), F.concat(F.lit("K"), F.substring("o_orderpriority", 1, 1)).alias("id")).distinct()
    got = P.with_team_ids(t("orders").select("o_custkey", F.col("o_orderpriority").alias("team")), "o_custkey", "team", organisations)
    return got.select("o_custkey", F.col("teams.team").alias("teams"), F.array_compact(F.col("teams.team_id")).alias("ids"))


@query("""
    WITH r AS (SELECT o_custkey AS player, CASE WHEN o_orderkey % 13 > 0 THEN CAST(year(o_orderdate) AS INT) END AS season, CASE WHEN o_orderkey % 17 > 0 THEN o_orderstatus END AS weapon, CAST(substr(o_orderpriority, 1, 1) AS INT) + CAST(o_orderkey % 9 AS INT) * 2 - 2 AS rank, o_orderdate AS date, o_orderkey, 'T' || o_orderkey % 3 AS team FROM orders),
    s AS (SELECT player, season, count(*) FILTER (rank = 1) AS g, count(*) FILTER (rank = 2) AS s, count(*) FILTER (rank = 3) AS b, count(*) FILTER (rank BETWEEN 4 AND 8) AS e, count(*) AS t FROM r WHERE season IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT player, list(season ORDER BY season DESC) AS years, list(season || ':' || g || '-' || s || '-' || b || '-' || e || '-' || t ORDER BY season DESC) AS podiums FROM s GROUP BY 1),
    a AS (SELECT player, count(*) FILTER (season IS NOT NULL AND rank = 1) AS gold, count(*) FILTER (season IS NOT NULL AND rank = 2) AS silver, count(*) FILTER (season IS NOT NULL AND rank = 3) AS bronze, count(*) FILTER (season IS NOT NULL AND rank BETWEEN 4 AND 8) AS top8, count(*) AS records,
                 list_sort(list(DISTINCT team)) AS teams, max(season) AS latest FROM r GROUP BY 1),
    w AS (SELECT r.player, weapon, min(rank) AS best, max(latest) AS latest FROM r JOIN a ON r.player = a.player WHERE weapon IS NOT NULL GROUP BY 1, 2),
    l AS (SELECT *, coalesce(CASE WHEN best = 1 THEN 'A' WHEN best = 2 THEN 'B' WHEN best <= 4 THEN 'C' WHEN best <= 8 THEN 'D' WHEN best <= 16 THEN 'E' ELSE 'U' END || lpad(CAST(latest % 100 AS VARCHAR), 2, '0'), 'U') AS rating FROM w),
    h AS (SELECT *, row_number() OVER (PARTITION BY player, weapon ORDER BY date DESC, o_orderkey) AS rn FROM r WHERE weapon IS NOT NULL),
    k AS (SELECT h.player, list(h.weapon || ' ' || l.rating || ' ' || h.rn ORDER BY h.weapon, h.rn)[1:10] AS history FROM h JOIN l ON h.player = l.player AND h.weapon = l.weapon WHERE rn <= 5 AND rank BETWEEN 1 AND 8 GROUP BY 1)
    SELECT a.player, gold, silver, bronze, top8, records, teams, coalesce(years, []) AS years, coalesce(podiums, []) AS podiums, coalesce((SELECT list(weapon || ' ' || rating ORDER BY weapon) FROM l WHERE l.player = a.player), []) AS ratings, coalesce(len(history), 0) AS history
    FROM a LEFT JOIN p ON a.player = p.player LEFT JOIN k ON a.player = k.player""")
def player_pages(t):
    """The page of every player in one row, from results with missing seasons and weapons."""
    k = F.col("o_orderkey")
    rows = t("orders").select(
        "o_custkey", "o_orderkey", F.when(k % 13 > 0, F.year("o_orderdate")).alias("season"), F.when(k % 17 > 0, F.col("o_orderstatus")).alias("weapon"),
        (F.substring("o_orderpriority", 1, 1).cast("int") + (k % 9).cast("int") * 2 - 2).alias("rank"), F.col("o_orderdate").alias("date"), F.concat(F.lit("T"), (k % 3).cast("string")).alias("team"),
    )
    got = P.player_pages(rows, "o_custkey", "season", "weapon", "rank", "date", "team", tie=("o_orderkey",))
    said = lambda s: F.concat(s["season"].cast("string"), F.lit(":"), F.concat_ws("-", *[s[c].cast("string") for c in ("gold", "silver", "bronze", "top8", "total")]))
    rated = F.transform("ratings", lambda r: F.concat_ws(" ", r["weapon"], r["rating"]))
    return got.withColumns({"podiums": F.transform("podiums", said), "ratings": rated, "history": F.size("history").cast("long")})
