"""Bouts: flattening of pools and brackets, perspectives, analytics and head-to-head."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scalar import round_label, round_order, win_rate


def clean_pools(pools: DataFrame, event: list[str], order: str, results: str = "results", most: int = 12) -> DataFrame:
    """Drops summary pools (over ``most`` rows, or names of digits only) and repeated ones, and renumbers.

    Pools of an event are the same if they have the same names in any order; the first stays.
    """
    named = pools.withColumn("__names", F.array_sort(F.transform(F.col(results), lambda r: r["name"])))
    kept = named.where((F.size(results) <= most) & ~F.exists("__names", lambda n: F.coalesce(n.rlike("^[0-9]+$"), F.lit(False))))
    first = Window.partitionBy(*event, "__names").orderBy(order)
    kept = kept.withColumn("__first", F.row_number().over(first)).where("__first = 1")
    return kept.withColumn("pool_number", F.row_number().over(Window.partitionBy(*event).orderBy(order))).drop("__names", "__first")


def pool_bouts(pools: DataFrame, keys: list[str], results: str = "results") -> DataFrame:
    """Two perspective rows per pool bout, from a matrix of cells.

    A cell is text: ``{"type":"V","score":5}``, ``V`` or digits. Empty and null cells, cells
    beyond the last row and bouts of a person with himself are skipped. The opponent's score is in
    the mirrored cell, 0 when missing. The opponent is fetched from the same array, so the matrix needs no join.
    """
    rows = pools.select(*keys, F.col(results).alias("all"), F.posexplode(results).alias("i", "me"))
    cells = rows.select(*keys, "all", "i", "me", F.posexplode("me.scores").alias("j", "cell")).where(F.coalesce(F.trim("cell"), F.lit("")) != "")
    cells = cells.withColumn("other", F.get("all", F.col("j"))).where(F.col("other").isNotNull())
    cells = cells.where(~(F.col("me.name").eqNullSafe(F.col("other.name")) & F.col("me.team").eqNullSafe(F.col("other.team"))))

    back = F.get("other.scores", F.col("i"))
    found = cells.select(
        *keys, F.col("me.name").alias("name"), F.col("me.team").alias("team"), F.col("other.name").alias("opponent"), F.col("other.team").alias("opponent_team"),
        _touches(F.col("cell")).alias("score"), F.coalesce(_touches(back), F.lit(0)).alias("opponent_score"), (_kind(F.col("cell")) == "V").alias("is_win"), _kind(F.col("cell")).alias("kind"),
    )
    return found.where(F.col("kind").isNotNull()).drop("kind")


def _json(c: Column, path: str) -> Column:
    """A value of an object; other texts aren't parsed, as what is no JSON at all would be thrown and caught."""
    return F.when(F.contains(c, F.lit("{")), F.get_json_object(c, path))


def _kind(c: Column) -> Column:
    """V or L of a pool's cell; null where it is neither."""
    return F.coalesce(_json(c, "$.type"), F.when(c == "V", "V").when(c.rlike("^[0-9]+$"), "L"))


def _touches(c: Column) -> Column:
    return F.coalesce(_json(c, "$.score").try_cast("int"), F.when(c == "V", 5), c.try_cast("int"))


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _side(name: Column, team: Column, seed: Column, score: Column) -> Column:
    return F.struct(name.alias("name"), team.alias("team"), seed.cast("int").alias("seed"), score.cast("int").alias("score"))


def _bout(kind: str, ord_: Column, round_: Column, p1: Column, p2: Column, winner: Column, bye: Column, table: Column | None = None) -> Column:
    """One bout as all shapes give it; ``kind`` is tree (``full_bouts``), rounds, win (the other side isn't known) or pool (a cell, seen from its row)."""
    return F.struct(
        F.lit(kind).alias("kind"), ord_.cast("long").alias("ord"), round_.alias("round"), p1.alias("p1"), p2.alias("p2"), winner.alias("winner"), bye.alias("is_bye"),
        F.coalesce(F.lit(0) if table is None else table, F.lit(0)).alias("table_index"),
    )


def _tree(full: Column) -> Column:
    """Bouts of ``full_bouts``."""

    def one(b: Column, i: Column) -> Column:
        side = lambda who, score: _side(b[who]["name"], b[who]["team"], b[who]["seed"], score)
        return _bout("tree", i, b["round"], side("winner", b["score"]["winner_score"]), side("loser", b["score"]["loser_score"]), b["winner"]["name"], F.lit(False), b["table_index"])

    return F.transform(full, one)


def _nested(bouts: Column) -> Column:
    """Bouts of ``bouts``."""

    def one(b: Column, i: Column) -> Column:
        side = lambda who: _side(b[who]["name"], b[who]["team"], b[who]["seed"], b[who]["score"])
        return _bout("rounds", i, b["round"], side("player1"), side("player2"), b["winner_name"], F.coalesce(b["is_bye"], F.lit(False)))

    return F.transform(bouts, one)


def _by_round(rounds: Column) -> Column:
    """Bouts of ``bouts_by_round``, nested or flat; won by name, else by score; ties and missing names go, byes stay."""

    def one(round_: Column, r: Column, b: Column, j: Column) -> Column:
        side = lambda i: _side(*[F.coalesce(b[f"player{i}"][c], b[f"player{i}_{c}"]) for c in ("name", "team", "seed", "score")])
        p1, p2, bye = side(1), side(2), F.coalesce(b["isBye"], b["is_bye"], F.lit(False))
        said, x, y = F.coalesce(b["winnerName"], b["winner_name"]), F.coalesce(p1["score"], F.lit(0)), F.coalesce(p2["score"], F.lit(0))
        winner = F.when((said == p1["name"]) | (said == p2["name"]) | bye, said).when(x > y, p1["name"]).when(y > x, p2["name"])
        return _bout("rounds", r * 100_000 + j, round_, p1, p2, winner, bye)

    every = F.flatten(F.transform(F.map_entries(rounds), lambda e, r: F.transform(F.coalesce(e["value"], F.slice(e["value"], 1, 0)), lambda b, j: one(e["key"], r, b, j))))
    named = lambda p: F.coalesce(p["name"], F.lit("")) != ""
    return F.filter(every, lambda b: (named(b["p1"]) & named(b["p2"]) & b["winner"].isNotNull()) | b["is_bye"])


def _entry_scores(c: Column, part: int) -> Column:
    """Winner's (1) or loser's (2) score of text: an object, ``15-12`` or the winner's alone."""
    name = ("$.winner_score", "$.loser_score")[part - 1]
    found = lambda pattern, group: F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(0))  # noqa: E731  # null, not empty: a cast of an empty text costs an exception
    alone = F.when(F.lit(part == 1), found(r"^([0-9]+)(\.[0-9]+)?$", 1))
    pair = found(r"^([0-9]+)\s*[-:]\s*([0-9]+)", part)
    return F.coalesce(_json(c, name).try_cast("int"), pair.try_cast("int"), alone.try_cast("int"))


def _legacy(rounds: Column) -> Column:
    """Bouts of ``results_by_round``: the results of a table in order of seed, two at a time; who has a winner's score won."""

    def entries(results: Column) -> Column:
        """Results with their table, in order of table, seed and place."""
        key = lambda b, j: F.struct(F.coalesce(b["table_index"], F.lit(0)).alias("table"), F.coalesce(b["seed"], F.lit(999)).alias("by"), j.alias("j"), b["name"].alias("name"), b["team"].alias("team"), b["seed"].alias("seed"), _entry_scores(b["score"], 1).alias("won"), _entry_scores(b["score"], 2).alias("lost"), b["is_match_result"].alias("is"))
        return F.array_sort(F.filter(F.transform(results, key), lambda s: s["is"]))

    def pairs(sorted_: Column) -> Column:
        """An entry whose number within its table is even meets the next one of the table."""
        at = F.transform(sorted_, lambda s, i: F.struct(s.alias("x"), F.when(F.get(sorted_, i + 1)["table"] == s["table"], F.get(sorted_, i + 1)).alias("y"), (F.size(F.filter(F.slice(sorted_, 1, i), lambda o: o["table"] == s["table"])) % 2 == 0).alias("opens")))
        return F.filter(at, lambda m: m["opens"])

    def one(round_: Column, r: Column, m: Column, n: Column) -> Column:
        x, y = m["x"], F.when(~m["x"]["name"].eqNullSafe(m["y"]["name"]), m["y"])
        first, second = x["won"].isNotNull(), x["won"].isNull() & y["won"].isNotNull()
        side = lambda s, won: _side(s["name"], s["team"], s["seed"], F.when(won, s["won"]).otherwise(s["lost"]))
        return _bout("rounds", r * 100_000 + n + 1, round_, side(x, first), side(y, second), F.when(first, x["name"]).when(second, y["name"]), y.isNull())

    return F.flatten(F.transform(F.map_entries(rounds), lambda e, r: F.transform(F.flatten(F.transform(F.array(entries(F.coalesce(e["value"], F.slice(e["value"], 1, 0)))), pairs)), lambda m, n: one(e["key"], r, m, n))))


def _wins(matches: Column) -> Column:
    """Wins of ``de_matches``, whose other side isn't known; without a score, or 0:0, they go."""

    def one(b: Column, i: Column) -> Column:
        x, y = F.coalesce(_entry_scores(b["score"], 1), F.lit(0)), F.coalesce(_entry_scores(b["score"], 2), F.lit(0))
        return F.struct(_bout("win", i, b["round"], _side(b["name"], b["team"], b["seed"], x), _side(F.lit("(상대)"), F.lit(""), F.lit(None), y), b["name"], F.lit(False)).alias("b"), (b["is_match_result"] & (F.coalesce(b["name"], F.lit("")) != "") & ((x != 0) | (y != 0))).alias("ok"))

    return F.transform(F.filter(F.transform(matches, one), lambda s: s["ok"]), lambda s: s["b"])


def _bracket_array(events: DataFrame) -> Column:
    """All bouts of an event's bracket, from the first shape that has any, and its wins."""
    found = None
    shapes = (("full_bouts", _tree), ("bouts", _nested), ("bouts_by_round", _by_round), ("results_by_round", _legacy))
    for shape, read in shapes:
        if shape in events.columns:
            has = F.coalesce(F.size(shape), F.lit(0)) > 0
            found = F.when(has, read(F.col(shape))) if found is None else found.when(has, read(F.col(shape)))
    none = F.array().cast(BOUTS)
    bouts = F.coalesce(found, none) if found is not None else none
    return F.concat(bouts, F.coalesce(_wins(F.col("de_matches")), none)) if "de_matches" in events.columns else bouts


SIDE = "struct<name:string,team:string,seed:int,score:int>"
BOUTS = f"array<struct<kind:string,ord:bigint,round:string,p1:{SIDE},p2:{SIDE},winner:string,is_bye:boolean,table_index:int>>"


def _settled(bouts: Column, double_count: bool) -> Column:
    """The bouts of a bracket, each once, in rounds by their right names, in order of these names; all within the row that holds them."""

    def read(b: Column, i: Column) -> Column:
        pair = F.sort_array(F.array(F.trim(F.coalesce(b["p1"]["name"], F.lit(""))), F.trim(F.coalesce(b["p2"]["name"], F.lit("")))))
        return F.struct(round_label(b["round"]).alias("round"), pair.alias("pair"), b["ord"].alias("ord"), i.alias("i"), F.trim(b["winner"]).alias("won"), b.alias("b"))

    won = lambda x: F.struct(x["round"], x["won"])
    alone = lambda x: x["b"]["kind"] == "win"

    def once(every: Column) -> Column:
        """Without wins that others of the same round tell (wins are few, or all there is)."""
        return _held(F.transform(F.filter(every, lambda x: ~alone(x)), won), lambda known: F.filter(every, lambda x: ~alone(x) | ~F.array_contains(known, won(x))))

    def first(sorted_: Column) -> Column:
        before = lambda i: F.get(sorted_, i - 1)
        return F.filter(sorted_, lambda x, i: ~(before(i)["pair"].eqNullSafe(x["pair"]) & before(i)["round"].eqNullSafe(x["round"])))

    def named(kept: Column) -> Column:
        rounds = F.transform(F.array_distinct(F.transform(kept, lambda x: x["round"])), lambda r: F.struct(r.alias("round"), F.size(F.filter(kept, lambda x: x["round"].eqNullSafe(r))).alias("n")))
        return _held(F.transform(rounds, right), lambda names: F.transform(kept, lambda x: x["b"].withField("round", F.get(F.filter(names, lambda r: r["round"].eqNullSafe(x["round"])), F.lit(0))["right"])))

    def right(r: Column) -> Column:
        expected, n = F.lit(None).cast("int"), r["n"]
        for name, count in V.ROUND_BOUTS.items():
            expected = F.when(r["round"] == name, count).otherwise(expected)
        wrong = ~r["round"].isin(V.FINAL, V.SEMIFINAL) & (n >= 2 * expected)
        better = F.when(n.between(3, 4), "8강").when(n.between(5, 8), "16강").when(n.between(9, 16), "32강").when(n.between(17, 32), "64강").otherwise(r["round"])
        return F.struct(r["round"].alias("round"), F.when(wrong, better).otherwise(r["round"]).alias("right"))

    every = F.transform(bouts, read)
    return _held(F.sort_array(every if double_count else _held(every, once)), lambda sorted_: _held(first(sorted_), named))


def bracket_bouts(events: DataFrame, keys: list[str], double_count: bool = False) -> DataFrame:
    """Bouts of an elimination bracket given in any of its shapes; the events are read once.

    Uses ``full_bouts`` (round, table_index, winner, loser, score) where there are any; else
    ``bouts`` (round, match_number, player1, player2, winner_name, is_bye); else the maps
    ``bouts_by_round``; else ``results_by_round``. Wins of ``de_matches`` are added, unless
    one of these has the winner's win of that round (``double_count`` adds them all). Columns
    of the last three may be missing. Of bouts between the
    same two names of a round, the first stays. A round with twice its bouts or more takes the
    name for that number, unless it is a final or semifinal.
    """
    both = events.select(*keys, F.explode_outer(_settled(_bracket_array(events), double_count)).alias("b")).where("b is not null").select(*keys, "b.*")
    return both.withColumn("round_order", round_order("round")).drop("kind", "table_index")


def _rank(ranks: str | None, name: Column) -> Column:
    """The final rank of a name, of equal ones the last one's."""
    if ranks is None:
        return F.lit(None).cast("int")
    mine = F.filter(ranks, lambda r: r["name"] == name)
    return F.get(mine, F.size(mine) - 1)["rank"]


#: A row ``i`` of a pool with all of that pool, or (without ``i``) a bracket's bout with its two sides.
ITEM = "struct<i:int,kind:string,round:string,table_index:int,winner:string,rows:array<struct<name:string,team:string,rank:int,score:int,scores:array<string>>>>"


def _pool_items(pools: Column, most: int, ranks: str | None) -> Column:
    """The rows of the pools that ``clean_pools`` leaves, each as its place among all rows of its pool, with ranks."""
    kept = F.filter(pools, lambda p: (F.size(p["results"]) <= most) & ~F.exists(p["results"], lambda r: F.coalesce(r["name"].rlike("^[0-9]+$"), F.lit(False))))
    named = F.transform(kept, lambda p: F.struct(p["results"].alias("results"), F.sort_array(F.transform(p["results"], lambda r: r["name"])).alias("names")))
    own = _held(named, lambda a: F.filter(a, lambda p, i: ~F.exists(F.slice(a, 1, i), lambda q: q["names"] == p["names"])))
    none = F.lit(None)
    row = lambda r: F.struct(r["name"].alias("name"), r["team"].alias("team"), _rank(ranks, r["name"]).alias("rank"), none.cast("int").alias("score"), r["scores"].alias("scores"))
    item = lambda rows, i: F.struct(i.alias("i"), F.lit("pool").alias("kind"), F.lit("Pool").alias("round"), F.lit(0).alias("table_index"), none.cast("string").alias("winner"), rows.alias("rows"))
    return F.flatten(F.transform(own, lambda p: _held(F.transform(p["results"], row), lambda rows: F.transform(rows, lambda r, i: item(rows, i)))))


def _bracket_items(bouts: Column, ranks: str | None) -> Column:
    """Bouts of a bracket that have a winner and are no byes."""
    none = F.lit(None)
    row = lambda p: F.struct(p["name"].alias("name"), p["team"].alias("team"), _rank(ranks, p["name"]).alias("rank"), p["score"].alias("score"), none.cast("array<string>").alias("scores"))
    item = lambda b: F.struct(none.cast("int").alias("i"), b["kind"].alias("kind"), b["round"].alias("round"), b["table_index"].alias("table_index"), b["winner"].alias("winner"), F.array(row(b["p1"]), row(b["p2"])).alias("rows"))
    return F.transform(F.filter(bouts, lambda b: ~b["is_bye"] & b["winner"].isNotNull()), item)


def bout_index(events: DataFrame, keys: list[str], most: int = 12, double_count: bool = False) -> DataFrame:
    """All bouts of pools and brackets as rows of a player: one scan of the nested events.

    keys, kind, round, table_index, name, team, score, opponent, opponent_team, opponent_score, is_win, rank,
    opponent_rank. Pools are cleaned as in ``clean_pools`` and give the rows of ``pool_bouts``; brackets those of ``bracket_bouts``,
    seen from both sides; byes, and bouts without a winner, aren't bouts of a player. Ranks are those of ``final_rankings`` (of equal names the last
    one's). Columns that hold shapes may be missing; null arrays are empty. A row is an event, and its bouts are settled within it, so that no bout is sorted.
    Cells of pools, far more than all else, are read behind the explodes, in expressions that Spark compiles.
    """
    ranks = "final_rankings" if "final_rankings" in events.columns else None
    every = _bracket_items(_settled(_bracket_array(events), double_count), ranks)
    if "pool_rounds" in events.columns:
        every = F.concat(F.coalesce(_pool_items(F.col("pool_rounds"), most, ranks), F.array().cast(f"array<{ITEM}>")), every)
    items = events.select(*keys, F.explode_outer(every).alias("x")).where("x is not null")  # outer: an inferred filter would build the array twice
    i, rows = F.col("x.i"), F.col("x.rows")
    pool = i.isNotNull()
    views = F.when(pool, F.size(F.get(rows, i)["scores"])).when(F.col("x.kind") == "win", 1).otherwise(2)

    def seen(j: Column) -> Column:
        me, other = F.get(rows, F.coalesce(i, j)), F.get(rows, F.when(pool, j).otherwise(1 - j))
        return F.struct(me.alias("me"), other.alias("other"), F.get(me["scores"], j).alias("cell"), F.get(other["scores"], i).alias("back"))

    sides = items.select(*keys, "x.kind", "x.round", "x.table_index", "x.winner", pool.alias("pool"), F.explode_outer(F.when(views > 0, F.transform(F.sequence(F.lit(0), views - 1), seen))).alias("s"))
    me, other, cell = F.col("s.me"), F.col("s.other"), F.col("s.cell")
    same = me["name"].eqNullSafe(other["name"]) & me["team"].eqNullSafe(other["team"])
    cells = sides.where("s is not null").where(~F.col("pool") | (other.isNotNull() & ~same)).withColumn("met", F.when(F.col("pool"), _kind(cell)).otherwise(""))
    winner = F.when(~F.col("pool"), F.col("winner")).when(F.col("met") == "V", me["name"]).otherwise(other["name"])
    score = lambda cell, row: F.when(F.col("pool"), _touches(cell)).otherwise(row["score"])
    return cells.where(F.col("met").isNotNull() & winner.isNotNull()).select(
        *keys, "kind", "round", "table_index", me["name"].alias("name"), me["team"].alias("team"), score(cell, me).alias("score"),
        other["name"].alias("opponent"), other["team"].alias("opponent_team"), F.when(F.col("pool"), F.coalesce(_touches(F.col("s.back")), F.lit(0))).otherwise(other["score"]).alias("opponent_score"),
        me["rank"].alias("rank"), other["rank"].alias("opponent_rank"), (winner == me["name"]).alias("is_win"),
    )


def meetings(rows: DataFrame, event: list[str], me: str = "name", other: str = "opponent") -> DataFrame:
    """Each bout of ``rows`` (see ``bout_index``) once for each side, with the result that the evidence supports.

    Where both have a final rank in the event, the better one has won a bout of an elimination tree; if the stored
    result differs, it is turned round and the scores are exchanged. In a tree the same two meet once: of
    several stored bouts the one of the highest ``table_index`` counts. In pools and lists of rounds bouts of the same round and
    score are the same bout. Bouts without an opponent or against oneself go. One ordered aggregation, the rows are read once.
    """
    tree, both = F.col("kind") == "tree", F.col("rank").isNotNull() & F.col("opponent_rank").isNotNull()
    right = F.when(tree & both, F.col("rank") < F.col("opponent_rank")).otherwise(F.col("is_win"))
    turned = right != F.col("is_win")
    score, against = (F.coalesce(F.when(turned, a).otherwise(b), F.lit(0)) for a, b in ((F.col("opponent_score"), F.col("score")), (F.col("score"), F.col("opponent_score"))))
    found = rows.where(F.col(other).isNotNull() & (F.col(other) != F.col(me))).select(
        *event, me, other, "kind", "table_index", F.struct(right.alias("is_win"), score.alias("score"), against.alias("opponent_score"), F.col("round"), F.col("opponent_team")).alias("m"),
    )
    same = F.when(F.col("kind") != "tree", F.struct("m.round", "m.score", "m.opponent_score"))
    found = found.withColumn("same", same)
    order = F.struct("table_index", "m.is_win", "m.score", "m.opponent_score", "m.round", "m.opponent_team")
    return found.groupBy(*event, me, other, "kind", "same").agg(F.max_by("m", order).alias("m")).select(*event, me, other, "kind", "m.*")


def head_to_head_records(met: DataFrame, date: str, me: str = "name", other: str = "opponent", tie: tuple[str, ...] = ()) -> DataFrame:
    """wins, losses, win_rate and last (date, is_win, score, opponent_score, round, opponent_team) per pair of ``meetings``; ties in date by ``tie``."""
    last = F.struct(F.col(date).alias("date"), "is_win", "score", "opponent_score", "round", "opponent_team")
    order = F.struct(date, *tie, "is_win", "score", "opponent_score", "round")
    out = met.groupBy(me, other).agg(F.count_if("is_win").alias("wins"), F.count_if(~F.col("is_win")).alias("losses"), F.max_by(last, order).alias("last"))
    return out.withColumn("win_rate", win_rate(F.col("wins"), F.col("wins") + F.col("losses")))


def perspectives(bouts: DataFrame, keys: list[str], one: dict[str, str], two: dict[str, str], win: Column) -> DataFrame:
    """Two rows per bout, one from each side; ``one`` and ``two`` name the same output columns.

    An OR-join on either side becomes an equi-join on the result.
    """
    def view(me: dict[str, str], other: dict[str, str], won: Column) -> Column:
        return F.struct(*[F.col(c).alias(k) for k, c in me.items()], *[F.col(c).alias(f"opponent_{k}") for k, c in other.items()], won.alias("is_win"))

    rows = bouts.select(*keys, F.explode(F.array(view(one, two, win), view(two, one, ~win))).alias("v"))
    return rows.select(*keys, "v.*")


def clutch(rows: DataFrame, by: list[str], diff: Column, won: Column, least: int = 3) -> DataFrame:
    """Bouts decided by one: number, wins, rate (0 below ``least``) and a grade."""
    close = F.abs(diff) == 1
    out = rows.groupBy(*by).agg(F.count_if(close).alias("clutch"), F.count_if(close & won).alias("clutch_wins"))
    rate = F.when(F.col("clutch") >= least, win_rate(F.col("clutch_wins"), F.col("clutch"))).otherwise(F.lit(0.0))
    grade = F.when(F.col("clutch") < least, "unknown").when(F.col("clutch_rate") >= 60, "high").when(F.col("clutch_rate") >= 40, "middle").otherwise("low")
    return out.withColumn("clutch_rate", rate).withColumn("clutch_grade", grade)


def bout_profile(rows: DataFrame, by: list[str], score: str, opponent_score: str, won: str, pool: str) -> DataFrame:
    """One row per key: totals by phase, clutch, finish types, margins and blow-outs, in one pass.

    A bout is to 5 in pools and 15 in brackets; one that ends below is a timeout.
    """
    diff, is_pool, win = F.col(score) - F.col(opponent_score), F.col(pool), F.col(won)
    full = F.greatest(score, opponent_score) >= F.when(is_pool, 5).otherwise(15)
    blow = F.abs(diff) >= F.when(is_pool, 3).otherwise(5)
    cents = F.abs(diff).cast("decimal(18,4)")
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bouts"), F.count_if(win).alias("wins"), F.count_if(is_pool).alias("pool_bouts"), F.count_if(is_pool & win).alias("pool_wins"),
        F.count_if(full).alias("full_bouts"), F.count_if(full & win).alias("full_wins"), F.count_if(~full).alias("timeout_bouts"), F.count_if(~full & win).alias("timeout_wins"),
        F.sum(F.when(win, cents)).alias("__wm"), F.sum(F.when(~win, cents)).alias("__lm"), F.count_if(win & blow).alias("blowout_wins"), F.count_if(~win & blow).alias("blowout_losses"),
    )
    mean = lambda total, n: F.coalesce(F.bround(F.try_divide(F.col(total).cast("double"), n), 1), F.lit(0.0))
    c = F.col
    gap = win_rate(c("full_wins"), c("full_bouts")) - win_rate(c("timeout_wins"), c("timeout_bouts"))
    insight = F.when((c("full_bouts") >= 3) & (c("timeout_bouts") >= 3), F.when(gap >= 15, "full").when(gap <= -15, "timeout").otherwise("balanced")).when(c("timeout_bouts") > 0, "few").otherwise("none")
    return out.select(
        *by, "bouts", "wins", win_rate(c("wins"), c("bouts")).alias("win_rate"), "pool_bouts", win_rate(c("pool_wins"), c("pool_bouts")).alias("pool_rate"),
        win_rate(c("wins") - c("pool_wins"), c("bouts") - c("pool_bouts")).alias("bracket_rate"), win_rate(c("full_wins"), c("full_bouts")).alias("full_rate"),
        win_rate(c("timeout_wins"), c("timeout_bouts")).alias("timeout_rate"), mean("__wm", c("wins")).alias("win_margin"), mean("__lm", c("bouts") - c("wins")).alias("loss_margin"),
        "blowout_wins", "blowout_losses", insight.alias("finish"),
    )


def recent_trend(rows: DataFrame, by: list[str], newest: list[Column], won: Column, span: int = 6) -> DataFrame:
    """Rate of the last ``span`` rows, of those before, and the trend at 10 points."""
    latest = Window.partitionBy(*by).orderBy(*newest)
    some = rows.withColumn("__won", won).withColumn("__n", F.row_number().over(latest)).where(F.col("__n") <= 2 * span)
    out = some.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("__won") & (F.col("__n") <= span)).alias("__new"),
        F.count_if(F.col("__won") & (F.col("__n") > span)).alias("__old"), F.count_if(F.col("__n") <= span).alias("__news"),
    )
    out = out.withColumn("recent_rate", win_rate(F.col("__new"), F.col("__news"))).withColumn("earlier_rate", F.when(F.col("seen") >= 2 * span, win_rate(F.col("__old"), F.lit(span))))
    gap = F.col("recent_rate") - F.col("earlier_rate")
    trend = F.when(F.col("seen") < 2 * span, "unknown").when(gap >= 10, "up").when(gap <= -10, "down").otherwise("flat")
    return out.withColumn("trend", trend).drop("__new", "__old", "__news")


def monthly_history(rows: DataFrame, by: list[str], date: str, won: Column) -> DataFrame:
    month = F.date_format(date, "yyyy-MM")
    out = rows.where(F.col(date).isNotNull()).groupBy(*by, month.alias("month")).agg(F.count(F.lit(1)).alias("bouts"), F.count_if(won).alias("wins"))
    return out.withColumn("losses", F.col("bouts") - F.col("wins")).withColumn("rate", win_rate(F.col("wins"), F.col("bouts")))


def head_to_head(rows: DataFrame, me: str, other: str, won: Column, newest: Column, least: int = 1) -> DataFrame:
    """Wins, losses, rate and latest meeting per pair of perspectives, from ``least`` bouts on."""
    out = rows.groupBy(me, other).agg(F.count(F.lit(1)).alias("bouts"), F.count_if(won).alias("wins"), F.max(newest).alias("last"))
    out = out.where(F.col("bouts") >= least).withColumn("losses", F.col("bouts") - F.col("wins"))
    return out.withColumn("rate", win_rate(F.col("wins"), F.col("bouts")))


def corrected_result(won: Column, my_rank: Column, other_rank: Column) -> Column:
    """Where both have a final rank, the better one won; equal ranks count as a loss."""
    return F.when(my_rank.isNotNull() & other_rank.isNotNull(), my_rank < other_rank).otherwise(won)
