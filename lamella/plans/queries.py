"""Every operator applied to the benchmark tables, beside the same result in SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import addresses as A
from ..operators import bouts as B
from ..operators import brackets as K
from ..operators import identity as I
from ..operators import quality as Q
from ..operators import rankings as R
from ..operators import relations as L
from ..sources import pages as P
from ..sources import tables as T
from ..streaming import changes as C
from . import router
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
from .registry import query as _query

AS_OF = "2001-09-01"


def _money(c: str) -> F.Column:
    return F.col(c).cast("decimal(18,2)")


def _total(c: F.Column) -> F.Column:
    return F.bround(F.sum(c).cast("double"), 2)


# -- rankings ------------------------------------------------------------------------------------


@_query("""
    WITH r AS (SELECT c_mktsegment AS cell, o_custkey AS player, CAST(substr(o_orderpriority, 1, 1) AS INT) AS place, CAST(o_totalprice AS DECIMAL(18, 2)) AS p,
                      row_number() OVER (PARTITION BY c_mktsegment, o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n
               FROM orders JOIN customer ON o_custkey = c_custkey),
         a AS (SELECT cell, player, CAST(round_even(CAST(coalesce(sum(p) FILTER (n <= 4), 0) AS DOUBLE), 2) AS DOUBLE) AS total, count(*) FILTER (place = 1) AS gold,
                      count(*) FILTER (place = 2) AS silver, count(*) FILTER (place = 3) AS bronze, count(*) AS competitions FROM r GROUP BY cell, player)
    SELECT *, row_number() OVER (PARTITION BY cell ORDER BY total DESC, gold DESC, silver DESC, bronze DESC, competitions DESC, player) AS position FROM a""")
def best_n_ranking(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_mktsegment").alias("cell"), F.col("o_custkey").alias("player"), "o_orderkey", F.col("o_totalprice").alias("points"), F.substring("o_orderpriority", 1, 1).cast("int").alias("place"))
    return R.best_n_ranking(rows, ["cell"], "player", "points", "place", ["o_orderkey"], 4).drop("best")


@_query("""
    WITH m AS (SELECT unnest(CASE WHEN o_orderstatus = 'P' THEN ['open', 'finished'] WHEN o_orderstatus = 'F' THEN ['finished'] ELSE ['open'] END) AS cell, o_custkey AS player,
                      o_orderkey, o_totalprice, CAST(substr(o_orderpriority, 1, 1) AS INT) AS place FROM orders),
         r AS (SELECT *, row_number() OVER (PARTITION BY cell, player ORDER BY o_totalprice DESC, o_orderkey) AS n FROM m),
         a AS (SELECT cell, player, round_even(CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (n <= 3), 0) AS DOUBLE), 2) AS total, count(*) FILTER (place = 1) AS gold,
                      count(*) FILTER (place = 2) AS silver, count(*) FILTER (place = 3) AS bronze, count(*) AS competitions FROM r GROUP BY cell, player)
    SELECT *, row_number() OVER (PARTITION BY cell ORDER BY total DESC, gold DESC, silver DESC, bronze DESC, competitions DESC, player) AS position FROM a""")
def all_category_rankings(t):
    cells = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("open"), F.lit("finished"))).when(F.col("o_orderstatus") == "F", F.array(F.lit("finished"))).otherwise(F.array(F.lit("open")))
    rows = R.in_cells(t("orders"), cells).select("cell", F.col("o_custkey").alias("player"), "o_orderkey", F.col("o_totalprice").alias("points"), F.substring("o_orderpriority", 1, 1).cast("int").alias("place"))
    return R.best_n_ranking(rows, ["cell"], "player", "points", "place", ["o_orderkey"], 3).drop("best")


@_query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round_even(CASE CAST(l_linenumber AS INT) % 6 WHEN 0 THEN 1000 WHEN 1 THEN 800 WHEN 2 THEN 500 WHEN 3 THEN 300 WHEN 4 THEN 400 ELSE 300 END
             * CASE WHEN q < 1 THEN 0.04 WHEN q <= 1 THEN 1.0 WHEN q <= 2 THEN 0.8 WHEN q <= 3 THEN 0.65 WHEN q <= 4 THEN 0.55 WHEN q <= 8 THEN 0.4 WHEN q <= 16 THEN 0.25 WHEN q <= 32 THEN 0.15 WHEN q <= 64 THEN 0.08 ELSE 0.04 END::DOUBLE
             * CASE WHEN z >= 64 THEN 1.0 WHEN z >= 32 THEN 0.9 WHEN z >= 16 THEN 0.8 WHEN z >= 8 THEN 0.6 ELSE 0.4 END::DOUBLE
             * CASE l_returnflag WHEN 'A' THEN 0.7 WHEN 'N' THEN 0.8 ELSE 1.0 END::DOUBLE, 2) AS points
    FROM (SELECT *, CAST(l_quantity AS INT) AS q, CAST(l_suppkey % 80 AS INT) AS z FROM lineitem)""")
def points_formula(t):
    tiers = {0: "S", 1: "A", 2: "B", 3: "C", 4: "D"}
    tier = S.lookup(F.col("l_linenumber") % 6, tiers, F.lit("?"))
    age = S.lookup("l_returnflag", {"A": "MS", "N": "HS"}, F.lit("other"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.points(tier, F.col("l_quantity").cast("int"), F.col("l_suppkey") % 80, age).alias("points"))


@_query("""
    SELECT o_custkey AS player, CAST(year(o_orderdate) AS INT) AS season, count(*) FILTER (k = 1) AS gold, count(*) FILTER (k = 2) AS silver, count(*) FILTER (k = 3) AS bronze,
           count(*) FILTER (k BETWEEN 4 AND 8) AS top8, count(*) AS entries
    FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INT) AS k FROM orders) GROUP BY 1, 2""")
def podium_by_season(t):
    rows = t("orders").withColumn("k", F.substring("o_orderpriority", 1, 1).cast("int")).withColumnRenamed("o_custkey", "player")
    return R.podium_by_season(rows, "player", F.year("o_orderdate"), "k")


@_query("""
    SELECT o_custkey AS player, min(k) AS best, CASE WHEN min(k) = 1 THEN 'A' WHEN min(k) = 2 THEN 'B' WHEN min(k) <= 4 THEN 'C' WHEN min(k) <= 8 THEN 'D' WHEN min(k) <= 16 THEN 'E' ELSE 'U' END
           || lpad(CAST(max(year(o_orderdate)) % 100 AS VARCHAR), 2, '0') AS rating
    FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INT) AS k FROM orders) GROUP BY 1""")
def letter_rating(t):
    rows = t("orders").groupBy(F.col("o_custkey").alias("player")).agg(F.min(F.substring("o_orderpriority", 1, 1).cast("int")).alias("best"), F.max(F.year("o_orderdate")).alias("y"))
    return rows.select("player", "best", S.letter_rating("best", "y").alias("rating"))


@_query(f"""
    SELECT o_custkey AS player, count(*) AS entries FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - 360 GROUP BY 1""")
def rolling_year(t):
    return R.recent_rows(t("orders"), "o_orderdate", AS_OF, 12).groupBy(F.col("o_custkey").alias("player")).agg(F.count(F.lit(1)).alias("entries"))


# -- names and scalars ---------------------------------------------------------------------------


@_query("""
    SELECT p_partkey, CASE WHEN contains(p_name, 'gear') OR contains(p_name, 'bolt') THEN 'S' WHEN contains(p_name, 'widget') THEN 'A' WHEN contains(p_name, 'ring') THEN 'B' ELSE 'C' END AS tier,
           CASE WHEN contains(p_type, 'PROMO') OR contains(p_type, 'ECONOMY') THEN 'CLUB' ELSE 'PRO' END AS class
    FROM part""")
def tier_classify(t):
    tiers = [("S", ["gear", "bolt"]), ("A", ["widget"]), ("B", ["ring"])]
    return t("part").select("p_partkey", S.keyword_case("p_name", tiers, "C").alias("tier"), S.keyword_case("p_type", [("CLUB", ["PROMO", "ECONOMY"])], "PRO").alias("class"))


@_query("""
    SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'license' WHEN contains(text, 'password') OR contains(text, '@') THEN 'private' WHEN contains(text, '|') THEN 'table' ELSE 'prose' END AS category FROM documents""")
def keyword_category(t):
    return t("documents").select("doc_id", S.keyword_case("text", [("license", ["License"]), ("private", ["password", "@"]), ("table", ["|"])], "prose").alias("category"))


@_query(r"""
    SELECT page_id, nullif(regexp_extract(url, '^https?://([^/:?#]+)', 1), '') AS host, nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '') AS path,
           TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS INT) AS page FROM pages""")
def regex_extract_fields(t):
    return t("pages").select("page_id", P.url_parts("url").alias("u")).select("page_id", "u.*")


@_query("""
    SELECT o_orderkey, CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'now' WHEN '2-high' THEN 'soon' WHEN '5-low' THEN 'later' ELSE trim(o_orderpriority) END AS priority FROM orders""")
def alias_normalize(t):
    return t("orders").select("o_orderkey", S.alias("o_orderpriority", {"1-URGENT": "now", "2-HIGH": "soon", "5-LOW": "later"}).alias("priority"))


@_query("""
    SELECT c_custkey, upper(substr(c_name, 1, 1)) || '.' || substr(string_split(c_name, '#')[2], 1, 1) || '.' AS initials,
           substr(mail, 1, 2) || repeat('*', length(string_split(mail, '@')[1]) - 2) || '@' || string_split(mail, '@')[2] AS mail,
           CASE WHEN length(regexp_replace(c_name, '[^0-9]', '', 'g')) >= 7 THEN left(regexp_replace(c_name, '[^0-9]', '', 'g'), 3) || '-****-' || right(regexp_replace(c_name, '[^0-9]', '', 'g'), 4) ELSE '****' END AS phone
    FROM (SELECT *, replace(lower(c_name), '#', '') || '@example.org' AS mail FROM customer)""")
def mask_email_phone_name(t):
    mail = F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("")), F.lit("@example.org"))
    return t("customer").select("c_custkey", S.initials("c_name").alias("initials"), S.mask_email(mail).alias("mail"), S.mask_phone("c_name").alias("phone"))


@_query(f"""
    SELECT o_orderkey, CAST(date_diff('year', CAST(o_orderdate AS DATE), DATE '{AS_OF}')
             - CASE WHEN strftime(o_orderdate, '%m%d') > strftime(DATE '{AS_OF}', '%m%d') THEN 1 ELSE 0 END AS INT) AS years FROM orders""")
def age_years(t):
    return t("orders").select("o_orderkey", S.full_years("o_orderdate", F.lit(AS_OF)).alias("years"))


@_query("""
    SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM events""")
def json_props(t):
    k = F.from_json("props", "k int")["k"]
    return t("events").select("event_id", k.alias("k"), F.when(k % 2 == 0, "even").otherwise("odd").alias("parity"))


@_query("""
    SELECT user_id, CASE WHEN count(*) > 64 THEN 128 WHEN count(*) > 32 THEN 64 WHEN count(*) > 16 THEN 32 WHEN count(*) > 8 THEN 16 WHEN count(*) > 4 THEN 8 ELSE 4 END AS size,
           CASE WHEN count(*) <= 1 THEN '결승' WHEN count(*) <= 2 THEN '준결승' WHEN count(*) <= 4 THEN '8강' WHEN count(*) <= 8 THEN '16강' WHEN count(*) <= 16 THEN '32강' ELSE '64강' END AS round
    FROM events GROUP BY user_id""")
def bracket_sizes(t):
    n = t("events").groupBy("user_id").count()
    return n.select("user_id", S.bracket_size("count").alias("size"), S.round_by_count("count").alias("round"))


@_query(r"""
    SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'license' WHEN regexp_matches(text, '\?') THEN 'question' WHEN regexp_matches(text, '(?i)^(le|la|les) ') THEN 'french' ELSE 'search' END AS intent
    FROM conversations""")
def router_intent(t):
    table = [("license", "(?i)licen[sc]e"), ("question", r"\?"), ("french", "(?i)^(le|la|les) ")]
    return t("conversations").select("conv_id", "turn", router.intent("text", table).alias("intent"))


# -- bouts ---------------------------------------------------------------------------------------

_BOUTS_SQL = """
    bout AS (SELECT a.l_orderkey AS o, a.l_suppkey AS s1, b.l_suppkey AS s2, CAST(a.l_quantity AS INT) AS q1, CAST(b.l_quantity AS INT) AS q2, a.l_shipdate AS d
             FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber % 2 = 1 AND b.l_linenumber = a.l_linenumber + 1 AND a.l_suppkey <> b.l_suppkey AND a.l_quantity <> b.l_quantity),
    v AS (SELECT o, d, s1 AS id, q1 AS score, s2 AS other, q2 AS other_score, q1 > q2 AS won FROM bout UNION ALL SELECT o, d, s2, q2, s1, q1, q2 > q1 FROM bout)"""


def _bouts(t) -> DataFrame:
    """Each two lines of an order that follow each other as a bout of their suppliers, by quantity; both sides as rows."""
    rows = t("lineitem").select("l_orderkey", F.floor((F.col("l_linenumber") - 1) / 2).alias("pair"), (F.col("l_linenumber") % 2 == 1).alias("first"), "l_suppkey", F.col("l_quantity").cast("int").alias("q"), "l_shipdate")
    one = rows.where("first").select("l_orderkey", "pair", F.col("l_suppkey").alias("s1"), F.col("q").alias("q1"), F.col("l_shipdate").alias("d"))
    two = rows.where("not first").select("l_orderkey", "pair", F.col("l_suppkey").alias("s2"), F.col("q").alias("q2"))
    met = one.join(two, ["l_orderkey", "pair"]).where("s1 <> s2 and q1 <> q2")
    return B.perspectives(met, ["l_orderkey", "d"], {"id": "s1", "score": "q1"}, {"id": "s2", "score": "q2"}, F.col("q1") > F.col("q2"))


@_query(f"""
    WITH {_BOUTS_SQL}
    SELECT id, other AS opponent_id, count(*) AS bouts, count(*) FILTER (won) AS wins, max(d) AS last, count(*) - count(*) FILTER (won) AS losses,
           round_even(count(*) FILTER (won) * 100.0::DOUBLE / count(*), 1) AS rate FROM v GROUP BY 1, 2""")
def h2h_perspective(t):
    return B.head_to_head(_bouts(t), "id", "opponent_id", F.col("is_win"), F.col("d"))


@_query(f"""
    WITH {_BOUTS_SQL},
    r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier),
    x AS (SELECT v.*, CASE WHEN m.k % 3 > 0 AND y.k % 3 > 0 THEN m.k < y.k ELSE won END AS fixed FROM v JOIN r m ON m.s_suppkey = id JOIN r y ON y.s_suppkey = other)
    SELECT id, other AS opponent_id, count(*) AS bouts, count(*) FILTER (fixed) AS wins, max(d) AS last, count(*) - count(*) FILTER (fixed) AS losses,
           round_even(count(*) FILTER (fixed) * 100.0::DOUBLE / count(*), 1) AS rate FROM x GROUP BY 1, 2 HAVING count(*) >= 2""")
def h2h_rank_corrected(t):
    order = t("supplier").select((-F.col("s_acctbal")).alias("behind"), "s_suppkey")
    ranks = T.with_surrogate_ids(order, ["behind", "s_suppkey"], id_col="k").select("s_suppkey", "k").withColumn("k", F.when(F.col("k") % 3 > 0, F.col("k")))
    rows = _bouts(t).join(ranks.select(F.col("s_suppkey").alias("id"), F.col("k").alias("mine")), "id").join(ranks.select(F.col("s_suppkey").alias("opponent_id"), F.col("k").alias("yours")), "opponent_id")
    return B.head_to_head(rows.withColumn("fixed", B.corrected_result(F.col("is_win"), F.col("mine"), F.col("yours"))), "id", "opponent_id", F.col("fixed"), F.col("d"), 2)


@_query("""
    SELECT least(l_suppkey, l_partkey) AS low, greatest(l_suppkey, l_partkey) AS high, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def symmetric_pair(t):
    return t("lineitem").groupBy(S.pair_key("l_suppkey", "l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).select("k.low", "k.high", "n")


@_query(f"""
    WITH {_BOUTS_SQL},
    f AS (SELECT *, score - other_score AS diff, o % 2 = 0 AS pool FROM v),
    g AS (SELECT *, greatest(score, other_score) >= CASE WHEN pool THEN 5 ELSE 15 END AS full_, abs(diff) >= CASE WHEN pool THEN 3 ELSE 5 END AS blow FROM f),
    a AS (SELECT id, count(*) AS n, count(*) FILTER (won) AS w, count(*) FILTER (pool) AS pn, count(*) FILTER (pool AND won) AS pw, count(*) FILTER (full_) AS fn, count(*) FILTER (full_ AND won) AS fw,
                 count(*) FILTER (NOT full_) AS tn, count(*) FILTER (NOT full_ AND won) AS tw, sum(abs(diff)) FILTER (won) AS wm, sum(abs(diff)) FILTER (NOT won) AS lm,
                 count(*) FILTER (won AND blow) AS bw, count(*) FILTER (NOT won AND blow) AS bl FROM g GROUP BY id),
    b AS (SELECT *, coalesce(round_even(fw * 100.0::DOUBLE / nullif(fn, 0), 1), 0) AS fr, coalesce(round_even(tw * 100.0::DOUBLE / nullif(tn, 0), 1), 0) AS tr FROM a)
    SELECT id, n AS bouts, w AS wins, coalesce(round_even(w * 100.0::DOUBLE / nullif(n, 0), 1), 0) AS win_rate, pn AS pool_bouts, coalesce(round_even(pw * 100.0::DOUBLE / nullif(pn, 0), 1), 0) AS pool_rate,
           coalesce(round_even((w - pw) * 100.0::DOUBLE / nullif(n - pn, 0), 1), 0) AS bracket_rate, fr AS full_rate, tr AS timeout_rate,
           coalesce(round_even(wm::DOUBLE / nullif(w, 0), 1), 0) AS win_margin, coalesce(round_even(lm::DOUBLE / nullif(n - w, 0), 1), 0) AS loss_margin, bw AS blowout_wins, bl AS blowout_losses,
           CASE WHEN fn >= 3 AND tn >= 3 THEN CASE WHEN fr - tr >= 15 THEN 'full' WHEN fr - tr <= -15 THEN 'timeout' ELSE 'balanced' END WHEN tn > 0 THEN 'few' ELSE 'none' END AS finish
    FROM b""")
def player_profile_stats(t):
    return B.bout_profile(_bouts(t).withColumn("pool", F.col("l_orderkey") % 2 == 0), ["id"], "score", "opponent_score", "is_win", "pool")


@_query(f"""
    WITH {_BOUTS_SQL},
    a AS (SELECT id, count(*) FILTER (abs(score - other_score) = 1) AS clutch, count(*) FILTER (abs(score - other_score) = 1 AND won) AS clutch_wins FROM v GROUP BY id),
    b AS (SELECT *, CASE WHEN clutch >= 3 THEN round_even(clutch_wins * 100.0::DOUBLE / clutch, 1) ELSE 0 END AS clutch_rate FROM a)
    SELECT *, CASE WHEN clutch < 3 THEN 'unknown' WHEN clutch_rate >= 60 THEN 'high' WHEN clutch_rate >= 40 THEN 'middle' ELSE 'low' END AS clutch_grade FROM b""")
def clutch_finish_margin(t):
    return B.clutch(_bouts(t), ["id"], F.col("score") - F.col("opponent_score"), F.col("is_win"))


@_query("""
    WITH r AS (SELECT user_id, value >= 25 AS won, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
    a AS (SELECT user_id, count(*) AS seen, count(*) FILTER (won AND n <= 6) AS w1, count(*) FILTER (won AND n > 6) AS w2, count(*) FILTER (n <= 6) AS c1 FROM r WHERE n <= 12 GROUP BY user_id),
    b AS (SELECT user_id, seen, round_even(w1 * 100.0::DOUBLE / c1, 1) AS recent_rate, CASE WHEN seen >= 12 THEN round_even(w2 * 100.0::DOUBLE / 6, 1) END AS earlier_rate FROM a)
    SELECT *, CASE WHEN seen < 12 THEN 'unknown' WHEN recent_rate - earlier_rate >= 10 THEN 'up' WHEN recent_rate - earlier_rate <= -10 THEN 'down' ELSE 'flat' END AS trend FROM b""")
def recent_trend(t):
    return B.recent_trend(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("value") >= 25)


@_query("""
    SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS bouts, count(*) FILTER (o_orderstatus = 'F') AS wins, count(*) - count(*) FILTER (o_orderstatus = 'F') AS losses,
           round_even(count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*), 1) AS rate FROM orders GROUP BY 1, 2""")
def monthly_history(t):
    return B.monthly_history(t("orders"), ["o_custkey"], "o_orderdate", F.col("o_orderstatus") == "F")


# -- brackets ------------------------------------------------------------------------------------

_ENTRY_SQL = "entry AS (SELECT n_regionkey AS event, s_suppkey AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS rank, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS seed FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _entries(t) -> DataFrame:
    """The suppliers of a region as an event: ranked by balance, seeded by key."""
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("event"), F.col("s_suppkey").alias("name"), "s_acctbal")
    rank, seed = Window.partitionBy("event").orderBy(F.desc("s_acctbal"), "name"), Window.partitionBy("event").orderBy("name")
    return rows.select("event", "name", F.row_number().over(rank).alias("rank"), F.row_number().over(seed).alias("seed"))


@_query(f"""
    WITH {_ENTRY_SQL}
    SELECT event, name, CAST(CASE WHEN rank <= 2 THEN rank WHEN rank <= 4 THEN 3 WHEN rank <= 8 THEN 5 WHEN rank <= 16 THEN 9
           ELSE coalesce(max(CASE WHEN rank <= 2 THEN rank WHEN rank <= 4 THEN 3 WHEN rank <= 8 THEN 5 WHEN rank <= 16 THEN 9 END) OVER (PARTITION BY event), 0) + rank - 16 END AS INT) AS place FROM entry""")
def bracket_placement(t):
    rows = _entries(t)
    rounds = F.when(F.col("rank") <= 4, "준결승").when(F.col("rank") <= 8, "8강").otherwise("16강")
    lost = rows.where("rank between 3 and 16").select("event", rounds.alias("round"), F.lit(None).cast("bigint").alias("winner"), F.col("name").alias("loser"))
    final = rows.where("rank <= 2").groupBy("event").agg(F.min_by("name", "rank").alias("winner"), F.max_by("name", "rank").alias("loser")).select("event", F.lit("결승").alias("round"), "winner", "loser")
    cast = lambda df: df.withColumn("winner", F.col("winner").cast("string")).withColumn("loser", F.col("loser").cast("string"))
    placed = K.placement(cast(final).unionByName(cast(lost)), rows.select("event", F.col("name").cast("string").alias("name"), "rank"), ["event"])
    return placed.withColumn("name", F.col("name").cast("bigint"))


def _reconstruct_sql() -> str:
    steps, alive = [_ENTRY_SQL], "entry"
    for size in (32, 16, 8, 4, 2):
        steps += [
            f"s{size} AS (SELECT *, count(*) OVER (PARTITION BY event) AS n, row_number() OVER (PARTITION BY event ORDER BY seed, name) AS pos FROM {alive})",
            f"b{size} AS (SELECT *, pos - byes AS slot, n - byes AS field FROM (SELECT *, CASE WHEN n > {size} THEN greatest(0, {2 * size} - n) WHEN n = {size} THEN 0 ELSE n END AS byes FROM s{size}))",
            f"m{size} AS (SELECT event, least(slot, field + 1 - slot) AS pair, min((rank, -seed, name)) AS w, max((rank, -seed, name)) AS l FROM b{size} WHERE slot > 0 AND slot * 2 <> field + 1 GROUP BY 1, 2)",
            f"a{size} AS (SELECT event, name, rank, seed FROM b{size} WHERE slot <= 0 OR slot * 2 = field + 1 UNION ALL SELECT event, w[3], w[1], -w[2] FROM m{size})",
        ]
        alive = f"a{size}"
    legs = " UNION ALL ".join(f"SELECT event, {size} AS round_size, w[3] AS winner, l[3] AS loser FROM m{size}" for size in (32, 16, 8, 4, 2))
    return f"WITH {', '.join(steps)} {legs}"


@_query(_reconstruct_sql())
def bracket_reconstruct(t):
    return K.reconstruct(_entries(t), ["event"])


@_query(f"""
    WITH {_ENTRY_SQL}, c AS (SELECT event, least(1, count(*) FILTER (rank = 1)) AS f, count(*) FILTER (rank BETWEEN 2 AND 3) AS s, count(*) FILTER (rank BETWEEN 4 AND 7 AND name % 2 = 0) AS q FROM entry GROUP BY event)
    SELECT event, CAST((CASE WHEN f = 0 THEN 1 ELSE 0 END) + (CASE WHEN s = 0 AND q > 0 THEN 1 ELSE 0 END) + (CASE WHEN s * 2 < 2 AND s > 0 THEN 1 ELSE 0 END) + (CASE WHEN q > 0 AND q * 2 < 4 THEN 1 ELSE 0 END) AS INT) AS issues FROM c""")
def bracket_validation(t):
    rows = _entries(t).where("rank <= 3 or (rank between 4 and 7 and name % 2 = 0)")
    rounds = rows.select("event", F.when(F.col("rank") == 1, "결승").when(F.col("rank") <= 3, "준결승").otherwise("8강").alias("round"))
    return K.bracket_issues(rounds, ["event"]).select("event", F.size("issues").alias("issues"))


# -- relations -----------------------------------------------------------------------------------


@_query("""
    SELECT o_orderkey, c_name, o_orderdate, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus IN ('F', 'P') AND (contains(lower(c_name), '00001') OR contains(lower(c_mktsegment), '00001')) ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20""")
def filter_search_page(t):
    rows = L.search(t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")), {"o_orderstatus": ["F", "P"], "o_orderpriority": None}, "00001", ["c_name", "c_mktsegment"])
    return L.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 2, 20).select("o_orderkey", "c_name", "o_orderdate", "o_totalprice")


@_query("""
    SELECT DISTINCT field, value FROM (SELECT 'o_orderstatus' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) WHERE value IS NOT NULL""")
def distinct_filter_options(t):
    return L.domains(t("orders"), ["o_orderstatus", "o_orderpriority"])


@_query("""
    SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1, 2""")
def latest_per_key(t):
    return L.latest_per_key(t("events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "ts"])


@_query("""
    SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value > 40) DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def dedup_pref_scored(t):
    return L.first_per_key(t("events"), ["user_id", "event_type"], [F.desc(F.col("value") > 40), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@_query("""
    WITH s AS (SELECT o_custkey AS customer, o_orderpriority AS name, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1, 2)
    SELECT x.customer, x.name AS first, y.name AS second FROM s x JOIN s y ON x.customer = y.customer AND x.name < y.name AND greatest(x.a, y.a) <= least(x.b, y.b)""")
def interval_overlap_pairs(t):
    spans = t("orders").groupBy(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("name")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return L.overlapping_pairs(spans, ["customer"], "name", "a", "b")


@_query("""
    WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
    SELECT x.l_suppkey AS first, y.l_suppkey AS second, count(*) AS together FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2""")
def cooccurrence_pairs(t):
    return L.cooccurring(t("lineitem"), ["l_orderkey"], "l_suppkey")


@_query("""
    SELECT p_partkey, key FROM part JOIN (VALUES ('gear'), ('ring'), ('red'), ('small')) k(key) ON contains(p_name, key)""")
def theta_contains(t):
    return L.matching_any(t("part"), "p_name", ["gear", "ring", "red", "small"]).select("p_partkey", "key")


@_query("""
    WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 400 = 7 THEN '' WHEN c_custkey % 5 = 0 THEN 'red bolt ' || c_custkey % 50 || ' shop' ELSE CAST(c_custkey % 997 AS VARCHAR) END AS a FROM customer),
    r AS (SELECT p_partkey, CASE WHEN p_partkey % 300 = 5 THEN NULL ELSE p_name || ' ' || p_partkey % 300 END AS b FROM part)
    SELECT c_custkey, p_partkey FROM l JOIN r ON (b LIKE '%' || a || '%' OR a LIKE '%' || b || '%') WHERE a <> ''""")
def names_within_names(t):
    """Customers and parts by names of which one holds the other, without comparing all with all."""
    k, p = F.col("c_custkey"), F.col("p_partkey")
    name = F.when(k % 400 == 7, "").when(k % 5 == 0, F.concat(F.lit("red bolt "), (k % 50).cast("string"), F.lit(" shop"))).otherwise((k % 997).cast("string"))
    other = F.when(p % 300 != 5, F.concat("p_name", F.lit(" "), (p % 300).cast("string")))
    pairs = L.containing_pairs(t("customer").select("c_custkey", name.alias("a")), "c_custkey", "a", t("part").select("p_partkey", other.alias("b")), "p_partkey", "b")
    return pairs.withColumnRenamed("left", "c_custkey").withColumnRenamed("right", "p_partkey")


@_query("""
    SELECT c_custkey, count(o_orderkey) AS orders, coalesce(round_even(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE), 2), 0) AS spent, min(o_orderdate) AS first, count(DISTINCT o_orderpriority) AS priorities
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def left_join_stats(t):
    orders = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), _total(_money("o_totalprice")).alias("spent"), F.min("o_orderdate").alias("first"), F.countDistinct("o_orderpriority").alias("priorities"))
    out = t("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"), "first", F.coalesce("priorities", F.lit(0)).alias("priorities"))


@_query("""
    SELECT c_mktsegment, l_returnflag, count(*) AS lines, count(DISTINCT o_custkey) AS customers, count(*) FILTER (l_linenumber <= 3) AS podium,
           round_even(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def weapon_stats(t):
    """Summed by order and by customer first, in tasks that don't grow with the table, so that customers are counted without a distinct count; merges, as keys compress to what Spark would broadcast."""
    tasks = T.tasks_for(t("lineitem"))
    lines = t("lineitem").repartition(tasks, "l_orderkey").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_linenumber") <= 3).alias("podium"), F.sum(_money("l_extendedprice")).alias("total"))
    bought = lines.join(t("orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_returnflag", "lines", "podium", "total")
    bought = bought.repartition(tasks, "o_custkey").groupBy("o_custkey", "l_returnflag").agg(*[F.sum(c).alias(c) for c in ("lines", "podium", "total")])
    segments = t("customer").repartition(tasks, "c_custkey").groupBy("c_custkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return bought.join(segments.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "l_returnflag").agg(
        F.sum(F.col("lines") * F.col("n")).alias("lines"), F.count(F.lit(1)).alias("customers"), F.sum(F.col("podium") * F.col("n")).alias("podium"), _total(F.col("total") * F.col("n")).alias("total")
    )


@_query("""
    SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest FROM customer""")
def correlated_latest(t):
    latest = L.latest_per_key(t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"])
    return t("customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("latest"))


@_query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def semi_members(t):
    urgent = t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return t("customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'MACHINERY')")
def anti_orphans(t):
    return L.orphans(t("orders"), "o_custkey", t("customer").where("c_mktsegment <> 'MACHINERY'"), "c_custkey").select("o_orderkey", "o_custkey")


@_query("SELECT p_partkey AS k FROM part EXCEPT SELECT o_custkey FROM orders")
def except_keys(t):
    return t("part").select(F.col("p_partkey").alias("k")).subtract(t("orders").select("o_custkey"))


@_query("SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45")
def intersect_keys(t):
    return t("lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).intersect(t("lineitem").where("l_returnflag = 'A' and l_quantity > 45").select("l_suppkey"))


@_query("SELECT 'customer' AS source, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def union_sources(t):
    both = t("customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("nation")).unionByName(t("supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("nation")))
    return both.groupBy("source", "nation").agg(F.count(F.lit(1)).alias("n"))


@_query("""
    WITH r AS (SELECT user_id, ts, CAST(floor(value) AS INT) // 20 AS level, lag(CAST(floor(value) AS INT) // 20) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT user_id, min(ts) AS first_drop, count(*) AS drops FROM r WHERE before - level >= 2 GROUP BY user_id""")
def lag_regression(t):
    rows = t("events").withColumn("level", F.floor(F.floor("value") / 20).cast("int"))
    return L.lag_drops(rows, "user_id", ["ts", "event_id"], "level", "ts", 2)


@_query("""
    WITH known AS (SELECT o_custkey, min(o_orderpriority) AS one FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1)
    SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, one) AS team FROM orders LEFT JOIN known USING (o_custkey)""")
def team_imputation(t):
    rows = t("orders").select("o_orderkey", F.col("o_custkey").alias("name"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("team"))
    return L.filled_names(rows, "name", "team").select("o_orderkey", "team")


@_query("""
    SELECT o_orderkey, CASE WHEN o_custkey % 50 = 7 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders""")
def merge_people(t):
    moves = t("customer").where("c_custkey % 50 = 7").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1).alias("new"))
    return L.remap(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], moves)


# -- nested data ---------------------------------------------------------------------------------


@_query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def nested_roundtrip(t):
    lines = T.spread(t("lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("lines"))
    kept = lines.select("l_orderkey", F.inline("lines"))
    return kept.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT o_custkey, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2")
def map_roundtrip(t):
    counted = t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    maps = counted.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    return maps.select("o_custkey", F.explode("m").alias("priority", "n"))


@_query("""
    SELECT page_id, CAST(pos - 1 AS INT) AS pos, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(tag, '<[^>]+>', '', 'g')) AS text
    FROM (SELECT page_id, unnest(tags) AS tag, unnest(generate_series(1, len(tags))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>', 0, 'is') AS tags FROM pages))""")
def html_scan(t):
    return P.links(t("pages"), "html", ["page_id"])


# -- quality and writes --------------------------------------------------------------------------


@_query("""
    SELECT o_orderkey, e1 + e2 + e3 AS errors, e1 + e2 = 0 AS can_save FROM (
        SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END AS e1, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS e2, CASE WHEN o_totalprice < 5000 THEN 1 ELSE 0 END AS e3 FROM orders)""")
def validation_errors(t):
    rules = [
        Q.Rule("o_totalprice", "CRITICAL", "range", F.col("o_totalprice") > 450000),
        Q.Rule("o_orderstatus", "HIGH", "pending", (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")),
        Q.Rule("o_totalprice", "WARNING", "small", F.col("o_totalprice") < 5000),
    ]
    return Q.validate(t("orders"), rules).select("o_orderkey", F.size("errors").alias("errors"), "can_save")


@_query(f"""
    WITH m AS (SELECT 'pass_rate' AS metric, avg(CASE WHEN o_totalprice <= 450000 THEN 1.0 ELSE 0 END)::DOUBLE AS v, 0.95 AS threshold, true AS at_least FROM orders
               UNION ALL SELECT 'freshness_days', date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '{AS_OF}')::DOUBLE, 24.0, false FROM orders
               UNION ALL SELECT 'integrity', 1.0 - count(*) FILTER (c_custkey IS NULL)::DOUBLE / count(*), 0.999, true FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
    SELECT metric, round_even(v, 6) AS value, threshold::DOUBLE AS threshold, CASE WHEN at_least THEN v >= threshold ELSE v <= threshold END AS healthy,
           CASE WHEN (at_least AND v >= threshold) OR (NOT at_least AND v <= threshold) THEN 'ok' WHEN abs(v - threshold) / threshold > 0.5 THEN 'critical' WHEN abs(v - threshold) / threshold > 0.2 THEN 'error'
                WHEN abs(v - threshold) / threshold > 0.1 THEN 'warning' ELSE 'info' END AS severity FROM m""")
def quality_metrics(t):
    orders = t("orders")
    ok = orders.agg(F.avg((F.col("o_totalprice") <= 450000).cast("int")).alias("v")).select(Q.metric("pass_rate", F.col("v"), 0.95, True).alias("m"))
    fresh = orders.agg(F.datediff(F.lit(AS_OF).cast("date"), F.to_date(F.max("o_orderdate"))).alias("v")).select(Q.metric("freshness_days", F.col("v"), 24.0, False).alias("m"))
    known = t("customer").select("c_custkey", F.lit(1).alias("one"))
    whole = orders.join(known, F.col("o_custkey") == F.col("c_custkey"), "left").agg((1 - F.count_if(F.col("one").isNull()) / F.count(F.lit(1))).alias("v")).select(Q.metric("integrity", F.col("v"), 0.999, True).alias("m"))
    return ok.unionByName(fresh).unionByName(whole).select("m.*").withColumn("value", F.bround("value", 6))


@_query("""
    SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS duplicates, round_even((count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::DOUBLE / count(*), 6) AS rate FROM lineitem""")
def duplicate_rate(t):
    return Q.duplicate_rate(t("lineitem"), ["l_orderkey", "l_linenumber"])


@_query("""
    SELECT user_id, strftime(ts, '%Y-%m') AS month, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS entries, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1, 2""")
def attendance_distinct_days(t):
    return Q.attendance(t("events"), ["user_id"], "ts", {"views": F.col("event_type") == "view", "purchases": F.col("event_type") == "purchase"})


@_query("""
    SELECT o_orderpriority, round_even(CAST(coalesce(sum(m) FILTER (o_orderstatus = 'F'), 0) AS DOUBLE), 2) AS paid, round_even(CAST(coalesce(sum(m) FILTER (o_orderstatus IN ('O', 'P')), 0) AS DOUBLE), 2) AS due,
           round_even(CAST(sum(m) AS DOUBLE), 2) AS billed, count(*) AS fees,
           round_even(round_even(CAST(coalesce(sum(m) FILTER (o_orderstatus = 'F'), 0) AS DOUBLE), 2) * 100 / round_even(CAST(sum(m) AS DOUBLE), 2), 1) AS collected_rate
    FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18, 2)) AS m FROM orders) GROUP BY 1""")
def fee_summary(t):
    return Q.fee_summary(t("orders"), ["o_orderpriority"], "o_totalprice", "o_orderstatus", {"paid": ["F"], "due": ["O", "P"]})


@_query(f"SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS INT) AS overdue_days FROM orders WHERE o_orderstatus = 'O' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') > 0")
def overdue_days(t):
    return Q.overdue(t("orders"), "o_orderdate", AS_OF, F.col("o_orderstatus") == "O").select("o_orderkey", "overdue_days")


@_query("""
    WITH e AS (SELECT l_returnflag, l_suppkey, round_even(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS r, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, count(*) AS members, CAST(sum(n) AS BIGINT) AS rows, round_even(avg(r), 4) AS mean_rate FROM e GROUP BY 1""")
def team_analytics_two_level(t):
    return Q.mean_of_means(t("lineitem"), ["l_returnflag"], "l_suppkey", (F.col("l_quantity") > 25).cast("int"))


@_query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS INT) AS version FROM orders""")
def merge_latest(t):
    old = t("orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("version"))
    new = t("orders").where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(2).alias("version"))
    return T.merged(old, new, ["o_orderkey"], "version")


@_query("SELECT c_mktsegment, c_nationkey, row_number() OVER (ORDER BY c_mktsegment, c_nationkey) AS id FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)")
def surrogate_ids(t):
    return T.with_surrogate_ids(t("customer"), ["c_mktsegment", "c_nationkey"])


@_query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def purge_old(t):
    return T.purge(t("events"), "ts", "2024-01-31", 10).select("event_id", "ts")


# -- graphs, people and streams --------------------------------------------------------------------


def _components_sql(b: str) -> str:
    return f"""
    WITH RECURSIVE e AS (SELECT o_custkey AS a, {b} AS b FROM orders UNION SELECT {b}, o_custkey FROM orders),
    cc(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION (
        SELECT e.a, min(cc.component) FROM cc JOIN e ON cc.node = e.b JOIN recurring.cc AS old ON old.node = e.a WHERE cc.component < old.component GROUP BY e.a))
    SELECT node, component FROM cc"""


@_query(_components_sql("1000000 + o_custkey // 8 * 2 + o_orderkey % 2"))
def connected_components(t):
    """All orders as edges: customers, eight by eight, meet in two nodes each."""
    b = F.lit(1_000_000) + F.floor(F.col("o_custkey") / 8) * 2 + F.col("o_orderkey") % 2
    return I.components(t("orders").select(F.col("o_custkey").alias("a"), b.cast("bigint").alias("b")), "a", "b")


@_query(_components_sql("1000000 + o_orderkey % 997"))
def connected_components_whole(t):
    """All orders as edges of one large component."""
    edges = t("orders").select(F.col("o_custkey").alias("a"), (F.lit(1_000_000) + F.col("o_orderkey") % 997).cast("bigint").alias("b"))
    return I.components(edges, "a", "b")


def _career_rows(t) -> DataFrame:
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    weapon = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = orders.select(
        F.concat(F.lit("P"), (F.col("c_custkey") % 400).cast("string")).alias("name"), F.concat(F.lit("club "), F.col("c_nationkey").cast("string")).alias("team"), F.date_format("o_orderdate", "yyyyMM").alias("comp"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("").alias("event"), weapon.alias("weapon"), F.lit(1).alias("rank"), F.lit("ranking").alias("kind"),
    )
    return rows


@_query()
def entity_resolution(t):
    return I.resolve_people(_career_rows(t))


@_query()
def entity_resolution_in_rounds(t):
    """The same profiles, for names of any number of teams."""
    return I.resolve_people_in_rounds(_career_rows(t))


@_query("""
    WITH r AS (SELECT 'P' || o_custkey % 300 AS name, CASE WHEN o_custkey % 3 = 0 THEN 'T' || o_custkey % 7 || '클럽' ELSE 'T' || o_custkey % 11 || '고등학교' END AS team, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders),
    k AS (SELECT name, team, min(date) AS first, max(date) AS last, count(*) AS n, team LIKE '%고등학교' AS school FROM r GROUP BY 1, 2),
    apart AS (SELECT DISTINCT a.name FROM k a JOIN k b ON a.name = b.name AND a.team < b.team AND a.school AND b.school AND greatest(a.first, b.first) <= least(a.last, b.last)),
    p AS (SELECT k.name, CASE WHEN apart.name IS NULL THEN '' ELSE team END AS label, list(team ORDER BY first, team) AS teams, arg_max(team, (first, team)) AS current_team, min(first) AS first_seen, max(last) AS last_seen, CAST(sum(n) AS INT) AS appearances
          FROM k LEFT JOIN apart ON k.name = apart.name GROUP BY 1, 2)
    SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY first_seen, teams) - 1 AS INT) AS part, teams, ['a'] AS weapons, current_team, first_seen, last_seen, appearances FROM p""")
def people_without_clashes(t):
    """Names whose teams never meet in a competition: one person, or as many as teams where schools of a level overlap."""
    k = F.col("o_custkey")
    team = F.when(k % 3 == 0, F.concat(F.lit("T"), (k % 7).cast("string"), F.lit("클럽"))).otherwise(F.concat(F.lit("T"), (k % 11).cast("string"), F.lit("고등학교")))
    rows = t("orders").select(
        F.concat(F.lit("P"), (k % 300).cast("string")).alias("name"), team.alias("team"), F.col("o_orderkey").cast("string").alias("comp"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.lit("").alias("event"), F.lit("a").alias("weapon"), F.lit(1).alias("rank"), F.lit("ranking").alias("kind"),
    )
    return I.resolve_people_in_rounds(rows)


@_query("SELECT name, list_sort(list(DISTINCT c_nationkey)) AS teams FROM (SELECT 'P' || (c_custkey % 400) AS name, c_nationkey FROM customer) GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
def homonym_flags(t):
    return I.homonyms(t("customer").select(F.concat(F.lit("P"), (F.col("c_custkey") % 400).cast("string")).alias("name"), F.col("c_nationkey").alias("team")))


@_query("""
    WITH o AS (SELECT 'Team ' || (user_id % 40) AS organisation, min(strftime(ts, '%Y-%m-%d')) AS first_seen, max(strftime(ts, '%Y-%m-%d')) AS last_seen, count(*) AS rows, count(DISTINCT user_id) AS people FROM events GROUP BY 1)
    SELECT *, printf('KOX%04d', row_number() OVER (ORDER BY first_seen, organisation)) AS id, 'unknown' AS kind FROM o""")
def organisation_ids(t):
    rows = t("events").select(F.col("user_id").alias("name"), F.concat(F.lit("Team "), (F.col("user_id") % 40).cast("string")).alias("team"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return I.organisations(rows).drop("english", "region")


def _addresses(t):
    """Customers as teams, suppliers as the registry and nations as the map."""
    teams = t("customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 50).alias("team"), F.when(F.col("c_custkey") % 11 == 0, F.lit("known")).alias("address"))
    registry = t("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("address"))
    places = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("address"))
    return A.look_up(teams, "team", [("registry", registry), ("map", places)])


_ADDRESS_SQL = """
    SELECT c_custkey, c_mktsegment, coalesce(address, s_name, n_name) AS found, CASE WHEN address IS NOT NULL THEN NULL WHEN s_name IS NOT NULL THEN 'registry' WHEN n_name IS NOT NULL THEN 'map' END AS source,
           CASE WHEN address IS NOT NULL THEN 'skipped' WHEN coalesce(s_name, n_name) IS NOT NULL THEN 'collected' ELSE 'failed' END AS status
    FROM (SELECT c_custkey, c_mktsegment, c_custkey % 50 AS team, CASE WHEN c_custkey % 11 = 0 THEN 'known' END AS address FROM customer)
    LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) ON s_suppkey = team LEFT JOIN nation ON n_nationkey = team"""


@_query(_ADDRESS_SQL)
def address_lookup(t):
    return _addresses(t).select("c_custkey", "c_mktsegment", "found", "source", "status")


@_query(f"""
    SELECT c_mktsegment, count(*) AS total, count(*) FILTER (status = 'collected') AS collected, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
           round_even(count(*) FILTER (status = 'collected') * 100.0::DOUBLE / count(*), 1) AS success_rate FROM ({_ADDRESS_SQL}) GROUP BY 1""")
def address_report(t):
    return A.report(_addresses(t), "c_mktsegment")


@_query("SELECT event_type, count(*) AS changes, max(ts) AS last FROM events GROUP BY 1")
def stream_counts(t):
    return _streamed(t("events"))


def _streamed(events: DataFrame) -> DataFrame:
    """The table as a stream, counted by an availableNow run into a memory table."""
    spark = events.sparkSession
    root = T.shared_folder(spark)
    name = f"counts_{os.urandom(6).hex()}"
    events.write.parquet(f"{root}/{name}/in")
    stream = C.read_changes(spark, f"{root}/{name}/in", events.schema.simpleString()[7:-1].replace(":", " "))
    return C.run_available(C.counts(stream, ["event_type"], "ts"), name, f"{root}/{name}/state")
