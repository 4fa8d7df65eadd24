"""Stored result pages, the index of all bouts, and head-to-head records from conflicting evidence."""

from pyspark.sql import functions as F

from lamella.operators import bouts
from lamella.sources import result_pages, tables

BOX = '<tr class="user_box"><td><span class="num">{}</span><div class="info"><span class="user_name">{}</span><span class="user_aff">{}</span></div></td></tr>'


def page(*columns, extra=""):
    cells = "".join(f'<td class="row_table row0{i}"><table>{"".join(BOX.format(*e) for e in c)}</table></td>' for i, c in enumerate(columns, 1))
    return f'<div>{extra}<table id="A_table"><tr>{cells}</tr></table></div>'


def test_bracket_pages(spark):
    """Byes on either side, missing neighbours, scores of the next column, exchanged ones, stale tabs, a size given by the page alone."""
    first = [(1, "A &amp; B", "red"), (8, "", ""), (5, "C", "blue"), (4, "D", ""), ("", "", ""), (6, "E", "x"), (7, "F", "y"), (2, "G", "z"), (9, "H", "w")]
    tab8 = page(first, [(1, "A &amp; B", "red"), (4, "D", "V 15 : 9"), (6, "E", "x"), (2, "G", "15:14")], [(4, "D", "10 : 15"), (2, "G", "15 : 1")], [(2, "G", "15 : 12")])
    stale = page([], [(1, "Ghost", "15 : 0"), (2, "Ghoul", "")])
    small = page([], [(1, "X", ""), (2, "Y", "")], [(2, "Y", "V 15:3")], extra="<input name=firstGrpSize value='4'>")
    pages = spark.createDataFrame([("e", 8, tab8), ("e", 16, stale), ("p", 16, small), ("n", 8, None), ("n", 16, "<p>no bracket</p>")], "event string, tab int, html string")
    got = {(r.event, r["round"], r.match): (r.p1 and r.p1.name, r.p2 and r.p2.name, r.p1_score, r.p2_score, r.winner, r.is_bye) for r in result_pages.page_bouts(pages, ["event"]).collect()}
    assert got == {
        ("e", "8강", 1): ("A & B", None, None, None, "A & B", True), ("e", "8강", 2): ("C", "D", 9, 15, "D", False), ("e", "8강", 3): (None, "E", None, None, "E", True), ("e", "8강", 4): ("F", "G", 14, 15, "G", False), ("e", "8강", 5): ("H", None, None, None, "H", True),
        ("e", "준결승", 1): ("A & B", "D", 15, 10, "A & B", False), ("e", "준결승", 2): ("E", "G", 1, 15, "G", False), ("e", "결승", 1): ("D", "G", 12, 15, "G", False),
        ("p", "8강", 1): ("X", "Y", 3, 15, "Y", False), ("p", "준결승", 1): ("Y", None, None, None, "Y", True),
    }
    need = {(r.event, r.tab): r["size"] for r in result_pages.needed_pages(pages, ["event"]).collect()}
    assert need == {("e", 8): 9, ("p", 16): 16, ("n", 8): 8}
    seeds = {(r.seed, r.name, r.team, r.is_bye) for r in result_pages.seeding(pages, ["event"]).collect()}
    assert (1, "A & B", "red", False) in seeds and (8, None, None, True) in seeds and len(seeds) == 8
    assert [(r.event, r.seed, r.name) for r in result_pages.champions(pages, ["event"]).collect()] == [("e", 2, "G")]
    assert result_pages.page_bouts(pages.limit(0), ["event"]).count() == 0


def test_brackets_are_read_once_and_by_no_expression(spark):
    """Size and columns come from one pass over a page, malformed ones too; no page is sorted with its bracket."""
    box = "<tr CLASS='a user_box'><td><i class=\"num\">{}</i><b class = 'user_name'>{}</b><b class='user_aff'>{}"
    html = f"<TD class='row_table row01'>{box.format('3 x', 'K <i>&amp; L</i>', 'red</b>')}{box.format('-2', 'M', 'no end')}<td class='row_table row04'>{box.format(3, 'K', '15 : 2</b>')}{box.format(4, 'N', '</b>')}"
    pages = spark.createDataFrame([("e", 8, html), ("e", 16, None), ("o", 8, "")], "event string, tab int, html string")
    seeds, best, met = (f(pages, ["event"]) for f in (result_pages.seeding, result_pages.champions, result_pages.page_bouts))
    assert [tuple(r) for r in seeds.collect()] == [("e", 3, "K & L", "red", False)] and [tuple(r) for r in best.collect()] == [("e", 3, "K")]
    assert sorted((r["round_size"], r.match, r.p1.name, r.p2.name, r.p1_score) for r in met.collect()) == [(1, 1, "K", "N", None), (8, 1, "K & L", "M", None)]
    for plan in (d._jdf.queryExecution().optimizedPlan().toString() for d in (seeds, best, met)):
        assert plan.count("user_boxes") == 1 and "split(" not in plan


def test_plain_pages_are_read_by_their_classes(spark, monkeypatch):
    """Boxes of plain tags are told without a search in each; odd ones as before."""
    from lamella.sources import page_parts

    made = []
    monkeypatch.setattr(page_parts.F, "arrow_udf", lambda kind: lambda f: made.append(f) or (lambda c: c))
    page_parts.boxed_columns(None, result_pages.ENTITIES)
    odd = ["<td class=row_table></td>", '<td class="row_table row01"><TR CLASS="user_box"><b class="num">3</b>', '<td class="row_table row2"><tr class="user_box"><b class="user_name">A <i>x</i></b><b class="num user_aff">4</b>', '<td class="row_table">row3<tr class="user_box" class="num">5</b>']
    plain = [page([(1, "A &amp;  B", "red"), ("", "", "")], [(1, "A &amp; B", "15 : 3")]), page([]), "", None]
    read = lambda pages: made[0](page_parts.pa.array(pages, page_parts.pa.string())).to_pylist()
    fast = read(plain)
    entry = lambda seed=0, name=None, aff=None: {"seed": seed, "name": name, "aff": aff}
    assert [(c["col"], c["entries"]) for c in fast[0]["columns"]] == [(1, [entry(1, "A & B", "red"), entry()]), (2, [entry(1, "A & B", "15 : 3")])]
    assert [[c["entries"] for c in p["columns"]] for p in read(odd)] == [[], [[entry(3)]], [[entry(4, "A x", "4")]], [[entry(5)]]]
    searched = lambda *_: (_ for _ in ()).throw(AssertionError)
    monkeypatch.setattr(page_parts, "_parts", searched)
    assert read(plain) == fast


def test_the_same_bout_in_two_tabs(spark):
    """With a score the smaller tab counts, without any the greater."""
    big = page([(i, f"p{i}", "t") for i in range(1, 17)], [(i, f"p{2 * i - 1}", "15 : 3") for i in range(1, 9)], [(i, f"p{4 * i - 3}", "15 : 4") for i in range(1, 5)], [])
    low = page([(i, f"q{2 * i - 1}", "15 : 3") for i in range(1, 9)], [(1, "q1", "15 : 5")], [], [])
    rows = result_pages.page_bouts(spark.createDataFrame([("e", 16, big), ("e", 8, low)], "event string, tab int, html string"), ["event"]).where("round_size = 8").collect()
    assert {r.match: (r.p1.name, r.p1_score) for r in rows} == {1: ("q1", 15), 2: ("p5", 15), 3: ("p9", 15), 4: ("p13", 15)}


def test_pool_pages(spark):
    def tr(*cells):
        return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"

    head = "<thead><tr>" + "".join(f"<th>{c}</th>" for c in ["No", "이름", "소속", 1, 2, 3, "승률", "지수", "득점", "랭킹"]) + "</tr></thead>"
    body = tr(1, "Kim", "a", "V", "V4", "v", "2/2", 8, 9, "1") + tr(2, "Lee", "b", "3", "", "", "0/2", "-2", 3, 3) + tr(3, "", "c", *range(7)) + tr(4, "77", "c", *range(7)) + tr("x", "Park", "c", "-", "V5", "1", "1/2", "", "", "") + tr(1, "short")
    html = f"<ul><li>뿔 12</li><li>삐스트 A3</li><li>심판 Choi</li></ul><p>x</p><table>{head}<tbody>{body}</tbody></table><ul><li>menu</li></ul><table><tr><td>1</td></tr></table>"
    pools = result_pages.pool_matrices(spark.createDataFrame([("e", html), ("n", None), ("o", "<ul><li>뿔 1</li></ul>")], "event string, html string"), ["event"])
    (pool,) = pools.collect()
    assert (pool.pool_number, pool.piste, pool.time, pool.referee) == (12, "A3", "", "Choi")
    cells = lambda r: [c and (c.type, c.score) for c in r.scores]
    assert [(r.position, r.name, r.wins, r.losses, r.indicator, r["rank"]) for r in pool.results] == [(1, "Kim", 2, 0, 8, 1), (2, "Lee", 0, 2, -2, 3), (5, "Park", 1, 1, 0, 0)]
    assert [cells(r) for r in pool.results] == [[None, ("V", 4), ("V", 5)], [("L", 3), None, ("L", 0)], [("L", 0), ("V", 5), ("L", 1)]]
    got = {(r.p1.name, r.p2.name, r.p1_score, r.p2_score, r.winner) for r in result_pages.matrix_bouts(pools, ["event"]).collect()}
    assert got == {("Kim", "Lee", 4, 3, "Kim"), ("Kim", "Park", 5, 0, "Kim"), ("Lee", "Park", 0, 5, "Park")}


def test_pool_results_are_read_without_the_matrix(spark):
    """The rows of a pool's results, from malformed pages too, with the page read once and outside of higher-order functions."""
    heads = "".join(f"<th>{c}</th>" for c in ["No", "이름", "소속", 1, 2, 3, "승률", "지수", "득점", "랭킹"])
    row = "<TR><td>1</TD><td class=x> <b>Kim</b>&nbsp;&amp; a < b</td><td>t</td><td>9</td><td>V</td><td></td><td>{}/{}</td><td>-3</td><td>x</td><td>99999999999</td></TR>"
    html = f"<UL><li>뿔 4</li></UL><table><tr>{heads}</tr>{row.format(2, 3)}<tr><td>7</td></tr>{row.format('', '')}</table>"
    pages = spark.createDataFrame([("e", html), ("n", None), ("o", ""), ("u", html.replace("</table>", ""))], "event string, html string")
    rows = result_pages.pool_results(pages, ["event"])
    assert [tuple(r) for r in rows.collect()] == [("e", 4, 1, "Kim & a < b", "t", 2, 1, -3, 0, 0), ("e", 4, 1, "Kim & a < b", "t", 0, 0, -3, 0, 0)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tables_behind_lists") == 1 and "regexp_extract_all" not in plan and "split(" not in plan


def test_rankings_and_winner_cells(spark):
    html = "<table><tr><td>a</td><td>b</td></tr></table><table><tr><td>2위</td><td>Kim</td><td>x</td></tr><tr><td>0</td><td>no</td><td>x</td></tr><tr><td>-</td><td>no</td><td>x</td></tr></table>"
    pages = spark.createDataFrame([("e", html, "<td>1 Kim 서울 15 : 3</td><td>Lee 15:2</td><td>2 Park 1:15</td>"), ("n", None, None)], "event string, html string, cells string")
    assert [tuple(r) for r in result_pages.ranking_rows(pages, ["event"]).collect()] == [("e", 2, "Kim", "x")]
    assert [tuple(r) for r in result_pages.winner_cells(pages, ["event"], "cells").collect()] == [("e", 0, 1, "Kim", "서울", 15, 3), ("e", 2, 2, "Park", "", 1, 15)]


DOCS = """[{"competition":{"event_cd":"C"},"events":[
    {"event_cd":"full","final_rankings":[{"rank":1,"name":"A"},{"rank":2,"name":"B"},{"rank":3,"name":"C"}],
     "full_bouts":[{"round":"결승","table_index":1,"winner":{"name":"B","score":15},"loser":{"name":"A","score":9},"score":{"winner_score":15,"loser_score":9}},
                   {"round":"8강","table_index":0,"winner":{"name":"A"},"loser":{"name":"B"},"score":{"winner_score":15,"loser_score":2}},
                   {"round":"준결승","table_index":0,"winner":{"name":"B"},"loser":{"name":"D"},"score":{"winner_score":15,"loser_score":7}}],
     "pool_rounds":[{"pool_number":1,"results":[{"name":"A","team":"t","scores":[null,"V"]},{"name":"B","team":"u","scores":["3",null]}]},
                    {"pool_number":2,"results":[{"name":"B","team":"u","scores":[null,"3"]},{"name":"A","team":"t","scores":["V",null]}]},
                    {"pool_number":3,"results":[{"name":"11","team":"","scores":[]}]}]},
    {"event_cd":"map","bouts_by_round":{"4강":[{"player1":{"name":"A","score":9},"player2":{"name":"C","score":15}},{"player1":{"name":"H"},"isBye":true,"winnerName":"H"}]}},
    {"event_cd":"wins","de_matches":[{"round":"8강","name":"W","is_match_result":true,"score":"15-3"}]},
    {"event_cd":"none"}]}]"""


def test_index_of_all_bouts_equals_the_union_of_its_parts(spark, tmp_path):
    (tmp_path / "d.json").write_text(DOCS)
    events = tables.read_documents(spark, str(tmp_path)).select(F.explode("events").alias("e")).select("e.*")
    path = str(tmp_path / "events")
    events.write.parquet(path)
    events = spark.read.parquet(path)
    index = bouts.bout_index(events, ["event_cd"])
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("Generate explode") == 2  # the shapes, and the two sides
    pools = events.select("event_cd", F.posexplode("pool_rounds").alias("i", "p")).select("event_cd", "i", "p.results")
    want = [(r.event_cd, "Pool", r.name, r.opponent, r.score, r.opponent_score, r.is_win) for r in bouts.pool_bouts(bouts.clean_pools(pools, ["event_cd"], "i"), ["event_cd"]).collect()]
    for r in bouts.bracket_bouts(events, ["event_cd"]).collect():
        if not r.is_bye and r.winner:
            want.append((r.event_cd, r["round"], r.p1.name, r.p2.name, r.p1.score, r.p2.score, r.winner == r.p1.name))
            if r.p2.name != "(상대)":
                want.append((r.event_cd, r["round"], r.p2.name, r.p1.name, r.p2.score, r.p1.score, r.winner == r.p2.name))
    got = [(r.event_cd, r["round"], r.name, r.opponent, r.score, r.opponent_score, r.is_win) for r in index.collect()]
    assert sorted(got) == sorted(want) and len(got) == 2 + 6 + 2 + 1
    assert {(r.name, r["rank"], r.opponent_rank) for r in index.where("event_cd = 'full' and kind = 'tree'").collect()} == {("A", 1, 2), ("B", 2, 1), ("B", 2, None), ("D", None, 2)}


def test_meetings_follow_the_evidence(spark, tmp_path):
    (tmp_path / "d.json").write_text(DOCS)
    docs = tables.read_documents(spark, str(tmp_path)).select(F.explode("events").alias("e")).select("e.*")
    met = bouts.meetings(bouts.bout_index(docs, ["event_cd"]), ["event_cd"])
    got = {(r.event_cd, r.kind, r.name, r.opponent): (r.is_win, r.score, r.opponent_score, r["round"]) for r in met.collect()}
    assert got["full", "tree", "A", "B"] == (True, 15, 9, "결승") and got["full", "tree", "B", "A"] == (False, 9, 15, "결승")  # turned round
    assert got["full", "tree", "B", "D"] == (True, 15, 7, "준결승") and got["full", "pool", "A", "B"] == (True, 5, 3, "Pool")
    records = {(r.name, r.opponent): (r.wins, r.losses, r.win_rate, r.last.date, r.last.is_win) for r in bouts.head_to_head_records(met, "event_cd").collect()}
    assert records["A", "B"] == (2, 0, 100.0, "full", True) and records["C", "A"] == (1, 0, 100.0, "map", True) and records["A", "C"][1] == 1


def test_pages_are_parsed_once(spark):
    """A filter moved below an explode would parse the page again."""
    pages = spark.createDataFrame([(1, 8, "<p></p>")], "event int, tab int, html string")
    pool = result_pages.pool_matrices(pages, ["event"])._jdf.queryExecution().optimizedPlan().toString()
    assert pool.count("뿔\\s*") == 1
    best = result_pages.champions(pages, ["event"])._jdf.queryExecution().optimizedPlan().toString()
    assert best.count("user_box") == 1
    need = result_pages.needed_pages(pages, ["event"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in need


def test_entries_of_a_table_are_sorted_once(spark):
    events = spark.createDataFrame([], "event_cd string, " + tables.EVENT[len("struct<event_cd:string,"):-1]).select("event_cd", "results_by_round")
    plan = bouts.bracket_bouts(events, ["event_cd"])._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_sort(filter(") == 1


def test_tasks_do_not_grow_with_the_table(spark):
    rows = spark.range(4000).withColumn("k", F.col("id") % 100)
    parts = tables.spread(rows, "k", each=100)
    assert parts.rdd.getNumPartitions() == 40 and parts.count() == 4000


def test_bouts_are_settled_within_their_event(spark, tmp_path):
    """No bout is sorted or shuffled, items aren't rebuilt by casts, and a row of a pool without scores takes no other with it."""
    (tmp_path / "d.json").write_text(DOCS.replace('{"name":"B","team":"u","scores":["3",null]}', '{"name":"B","team":"u"}'))
    docs = tables.read_documents(spark, str(tmp_path)).select(F.explode("events").alias("e")).select("e.*")
    index = bouts.bout_index(docs, ["event_cd"])
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan and "as array<struct<i" not in plan
    assert [(r.name, r.opponent, r.score, r.opponent_score, r.is_win) for r in index.where("kind = 'pool'").collect()] == [("A", "B", 5, 0, True)]


def test_head_to_head_sorts_no_bouts_before_they_are_meetings(spark):
    from lamella.plans import matches

    plan = matches.head_to_head_settled(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan
