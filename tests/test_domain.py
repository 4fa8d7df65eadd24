"""Competition semantics on small fixtures."""

import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.functions import korean as K
from lamella.functions import scalar as S
from lamella.operators import addresses, bouts, brackets, identity, players, quality, rankings, relations
from lamella.sources import endpoints, pages, tables


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def each(spark, texts, fn):
    return [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn("t").alias("v")).orderBy("i").collect()]


def test_points(spark):
    rows = spark.createDataFrame([("A", 3, 50, "UNI"), ("S", 1, 64, "SR"), ("?", 65, 1, None), ("D", 0, 8, "E1")], "t string, r int, n int, a string")
    assert [r.p for r in rows.select(S.points("t", "r", "n", "a").alias("p")).collect()] == [421.2, 1000.0, 4.8, 3.84]


def test_competition_names(spark):
    names = ["제1회 회장배", "협회장배 대회", "선수권", "국제 대회", "시장배", "오픈"]
    assert each(spark, names, S.competition_tier) == ["S", "S", "A", "D", "B", "C"]
    assert each(spark, ["생활체육 클럽", "전국"], S.club_or_pro) == ["CLUB", "PRO"]
    assert each(spark, ["국가대표 선발", "동호인", "x"], S.competition_class) == ["NATIONAL", "AMATEUR", "ELITE"]
    assert each(spark, ["19세이하", "남중 에뻬", "여고", "U17 남자", "대학부", "남대 에뻬", "x"], S.legacy_age) == ["E1", "MS", "HS", "U17", "UNI", "UNI", "SR"]
    assert each(spark, ["여자 남자", "남고", "x"], S.gender) == ["F", "M", ""]
    assert each(spark, ["서울중학교", "서울고", "한국대", "펜싱클럽", "서초교"], S.team_type) == ["middle", "high", "university", "club", "elementary"]


def test_event_fields(spark):
    cases = {
        "남자 중등부 에뻬 개인전": ("에뻬", "남", "MS", "개인전"), "초등부(1-2학년) 남자 플러레": ("플러레", "남", "E1", None), "남고 에뻬(개)": ("에뻬", "남", "HS", None),
        "여중 플러레(단)": ("플러레", "여", "MS", None), "남일 사브르(개)": ("사브르", "남", "SR", None), "남초 에뻬(단)": ("에뻬", "남", "E3", None), "엘리트부 남자 플러레(개)": ("플러레", "남", "SR", None),
        "U13 남자 에뻬": ("에뻬", "남", "E3", None), "U15 여자 플러레": ("플러레", "여", "MS", None), "남자 플러레(개)": ("플러레", "남", None, None),
    }
    got = each(spark, list(cases), K.event_fields)
    assert [(g.weapon, g.gender, g.age_group, g.event_type) for g in got] == list(cases.values())
    row = spark.createDataFrame([(None, "남자", None, "PRO", "남고 에페(개)")], "w string, g string, a string, c string, n string").select(K.normalised("w", "g", "a", "c", "n").alias("v")).first().v
    assert (row.weapon, row.weapon_source, row.gender, row.gender_source, row.age_group, row.age_group_source, row.category) == ("에뻬", "extracted", "남", "given", "HS", "extracted", "전문")
    assert each(spark, ["19세이하", "9세이하", "U17 여자", "남중", "초등부", "x"], K.global_age) == ["Veteran", "Y8", "U17", "Y14", "Y12", "Veteran"]


def test_privacy_and_romanisation(spark):
    assert each(spark, ["홍길동", "김철수", "Park Soyun", "", "이영"], K.masked_name) == ["H.G.D.", "G.C.S.", "P.A.R.K.S.O.Y.U.N.", "", ""]
    assert each(spark, ["홍길동", "a서b"], K.romanised) == ["honggildong", "aseob"]
    assert value(spark, K.anonymous_team(F.lit("club"), F.lit("서울"))) == "서울(클럽)" and value(spark, K.anonymous_team(F.lit("x"), F.lit(None))) == "전국(기타)"
    assert value(spark, S.mask_email(F.lit("someone@example.org"))) == "so*****@example.org" and value(spark, S.mask_phone(F.lit("010-1234-5678"))) == "010-****-5678"
    assert value(spark, K.is_minor(F.lit("2010-05-02"), F.lit("2024-05-01"))) and not value(spark, K.is_minor(F.lit("2010-05-01"), F.lit("2024-05-01")))
    assert value(spark, S.ip_allowed(F.array(F.lit("10.0.*"), F.lit("1.2.3.4")), F.lit("10.0.7.7"))) and not value(spark, S.ip_allowed(F.array(F.lit("10.0.*")), F.lit("10.1.7.7")))


def test_scores_and_rounds(spark):
    assert each(spark, ['{"score": 5}', "7", "15-12", "3:1", "x", None], S.score_of) == [5, 7, 15, 3, None, None]
    assert each(spark, ["8강전", "준결승전", "4강", "결승", "3-4위", "?"], S.round_order) == [5, 6, 6, 7, 8, 99]


POOL = "event string, pool_number int, results array<struct<name:string,team:string,scores:array<string>>>"


def test_pool_bouts(spark):
    results = [("A", "t", [None, '{"type":"V","score":5}', "V"]), ("B", "u", ['{"type":"L","score":3}', "", "2", "9"]), ("C", "v", ["4", "V", None])]
    got = {(r.name, r.opponent): (r.score, r.opponent_score, r.is_win) for r in bouts.pool_bouts(spark.createDataFrame([("e", 1, results)], POOL), ["event"]).collect()}
    assert got == {("A", "B"): (5, 3, True), ("A", "C"): (5, 4, True), ("B", "A"): (3, 5, False), ("B", "C"): (2, 5, False), ("C", "A"): (4, 5, False), ("C", "B"): (5, 2, True)}


def test_summary_and_repeated_pools_go(spark):
    pool = lambda *names: [(n, "t", []) for n in names]
    rows = [("e", 1, pool(*map(chr, range(65, 78)))), ("e", 2, pool("A", "B")), ("e", 3, pool("B", "A")), ("e", 4, pool("1", "2")), ("e", 5, pool("C", "D"))]
    got = bouts.clean_pools(spark.createDataFrame(rows, POOL), ["event"], "pool_number").orderBy("pool_number").collect()
    assert [(r.pool_number, [x.name for x in r.results]) for r in got] == [(1, ["A", "B"]), (2, ["C", "D"])]


def test_bracket_shapes(spark):
    side = lambda n: (n, "t", 1, None)
    full = [("결승", 0, side("A"), side("B"), (15, 10)), ("결승", 1, side("B "), side("A"), (15, 10))] + [("32강", i, side(f"w{i}"), side(f"l{i}"), (15, 3)) for i in range(4)]
    flat = [("준결승전", 1, side("A"), side("B"), "A", False), ("준결승전", 2, side("C"), None, "C", True)]
    schema = f"event string, full_bouts {tables.EVENT.split('full_bouts:')[1].split(',bouts:')[0]}, bouts {tables.EVENT.split(',bouts:')[1][:-1]}"
    got = bouts.bracket_bouts(spark.createDataFrame([("x", full, flat), ("y", [], flat), ("z", None, None)], schema), ["event"]).collect()
    assert sorted((r.event, r.round) for r in got) == sorted([("x", "결승")] + [("x", "32강")] * 4 + [("y", "준결승")] * 2)
    assert {r.is_bye for r in got if r.event == "y"} == {True, False} and all(r.round_order == 6 for r in got if r.event == "y")


def test_a_round_with_twice_its_bouts_is_renamed(spark):
    side = lambda n: (n, "t", 1, None)
    full = [("8강", i, side(f"w{i}"), side(f"l{i}"), (15, 3)) for i in range(8)]
    schema = f"event string, full_bouts {tables.EVENT.split('full_bouts:')[1].split(',bouts:')[0]}, bouts {tables.EVENT.split(',bouts:')[1][:-1]}"
    assert {r["round"] for r in bouts.bracket_bouts(spark.createDataFrame([("x", full, None)], schema), ["event"]).collect()} == {"16강"}


def test_clutch_and_profile(spark):
    rows = spark.createDataFrame([("p", 15, 14, True, False), ("p", 15, 14, True, False), ("p", 14, 15, False, False), ("q", 15, 10, True, False), ("q", 8, 15, False, False), ("q", 6, 15, False, False)], "name string, s int, o int, w boolean, pool boolean")
    got = {r.name: r for r in bouts.clutch(rows, ["name"], F.col("s") - F.col("o"), F.col("w")).collect()}
    assert (got["p"].clutch, got["p"].clutch_wins, got["p"].clutch_rate, got["p"].clutch_grade) == (3, 2, 66.7, "high") and got["q"].clutch_grade == "unknown"
    prof = {r.name: r for r in bouts.bout_profile(rows, ["name"], "s", "o", "w", "pool").collect()}
    assert prof["q"].blowout_losses == 2 and prof["q"].win_margin == 5.0 and prof["q"].loss_margin == 8.0


def test_placement_with_pool_remainder(spark):
    met = spark.createDataFrame([("e", "결승", "A", "B"), ("e", "준결승", "A", "C"), ("e", "준결승", "B", "D"), ("e", "8강", "A", None)], "event string, round string, winner string, loser string")
    pool = spark.createDataFrame([("e", n, i) for i, n in enumerate("ABCDEF", 1)] + [("f", "X", 1)], "event string, name string, rank int")
    got = {(r.event, r.name): r.place for r in brackets.placement(met, pool, ["event"]).collect()}
    assert got == {("e", "A"): 1, ("e", "B"): 2, ("e", "C"): 3, ("e", "D"): 3, ("e", "E"): 4, ("e", "F"): 5, ("f", "X"): 1}


def test_reconstruction_leads_to_the_ranks(spark):
    rows = spark.createDataFrame([(e, i, i, f"n{i}") for e, n in (("full", 16), ("part", 22)) for i in range(1, n + 1)], "event string, seed int, rank int, name string")
    got = brackets.reconstruct(rows, ["event"]).collect()
    full, part = ([r for r in got if r.event == e] for e in ("full", "part"))
    assert len(full) == 15 and {(r.winner, r.loser) for r in full if r.round_size == 2} == {("n1", "n2")}
    # sizes are those that remain where there are more: six bouts lead from 22 to 16, and two are left at the end
    assert len(part) == 20 and sum(r.round_size == 16 for r in part) == 6
    tied = brackets.reconstruct(rows.where("event = 'full' and seed <= 2").withColumn("rank", F.lit(1)), ["event"]).first()
    assert (tied.winner, tied.loser) == ("n2", "n1")


def test_best_n(spark):
    rows = spark.createDataFrame([("c", "p", float(x), r, i) for i, (x, r) in enumerate([(10, 1), (9, 2), (8, 3), (7, 9), (6, 1)])] + [("c", "q", 34.0, 1, 9)], "cell string, player string, points double, rank int, ord int")
    got = rankings.best_n_ranking(rows, ["cell"], "player", "points", "rank", ["ord"], 4).orderBy("position").collect()
    assert [(r.player, r.total, r.gold, r.competitions, r.best) for r in got] == [("p", 34.0, 2, 5, [10.0, 9.0, 8.0, 7.0]), ("q", 34.0, 1, 1, [34.0])]


DOC = [("C1", "2022-05-01"), ("C2", "2023-05-01")]


def people(spark, rows):
    return identity.resolve_people(spark.createDataFrame(rows, "name string, team string, comp string, date string, event string, weapon string, rank int, kind string")).collect()


def test_people(spark):
    one = [("N1", "T1", "C1", "2022-05-01", "남자 에뻬", "e", 1, k) for k in ("pool", "ranking")]
    rivals = [("N2", t, "C1", "2022-05-01", "x", "e", 1, "pool") for t in ("TA", "TB")]
    school = [("N3", "서울중학교", "C1", "2022-05-01", "여중", "e", 1, "pool"), ("N3", "서울고등학교", "C2", "2023-05-01", "여고", "e", 1, "pool")]
    got = people(spark, one + rivals + school)
    by = {n: [r for r in got if r.name == n] for n in ("N1", "N2", "N3")}
    assert [len(by[n]) for n in by] == [1, 2, 1]
    assert by["N1"][0].current_team == "T1" and by["N1"][0].appearances == 2 and by["N3"][0].teams == ["서울중학교", "서울고등학교"]


def test_people_by_calendar_years_weapons_and_levels(spark):
    """A clash of two clubs makes the greedy rules count: one name each."""

    def row(name, team, comp, date, weapon="e"):
        return (name, team, comp, date, "x", weapon, 1, "pool")

    clash = lambda name: [row(name, "KA", "Z", "2001-01-01"), row(name, "KB", "Z", "2001-01-01")]
    rows = clash("N4") + [row("N4", "서울중학교", "C1", "2022-05-01"), row("N4", "서울고등학교", "C2", "2023-06-01")]  # 13 months, but one calendar year
    rows += clash("N5") + [row("N5", "서울중학교", "C1", "2021-12-01"), row("N5", "서울고등학교", "C2", "2023-01-01")]  # 13 months, two calendar years
    rows += clash("N6") + [row("N6", "서울고등학교", "C1", "2020-01-01"), row("N6", "부산고등학교", "C2", "2020-06-01"), row("N6", "부산고등학교", "C3", "2019-06-01")]  # same level, at once
    rows += [row("N7", "TA", "C1", "2020-01-01", "e"), row("N7", "TB", "C2", "2021-01-01", "f"), row("N7", "TC", "C3", "2022-01-01", "f")]  # no common weapon
    rows += [row("N8", "서울고등학교", "C1", "2020-01-01"), row("N8", "부산고등학교", "C2", "2020-01-01"), row("N8", "KC", "C3", "2024-01-01")]  # level schools at once keep all apart
    rows += clash("N9") + [row("N9", "KC", "C2", "2003-12-01")]  # clubs within two calendar years
    got = {n: sorted(r.teams for r in people(spark, [r for r in rows if r[0] == n])) for n in ("N4", "N5", "N6", "N7", "N8", "N9")}
    assert ["서울중학교", "서울고등학교"] in got["N4"] and len(got["N4"]) == 3
    assert len(got["N5"]) == 4 and len(got["N6"]) == 4
    assert got["N7"] == [["TA"], ["TB", "TC"]] and len(got["N8"]) == 3
    assert ["KA", "KC"] in got["N9"] and len(got["N9"]) == 2


def test_organisations(spark):
    rows = spark.createDataFrame([("A", " 서울중학교 ", "2022"), ("B", "서울중학교", "2021"), ("C", "부산고등학교", "2020"), ("D", "한강클럽", "2020"), ("E", None, "2020"), ("F", "대전중학교", "2020")], "name string, team string, date string")
    got = {r.organisation: r for r in identity.organisations(rows).collect()}
    assert {k: r.id for k, r in got.items()} == {"대전중학교": "KOV0001", "서울중학교": "KOM0001", "부산고등학교": "KOH0001", "한강클럽": "KOC0001"}
    assert got["서울중학교"].people == 2 and got["서울중학교"].english == "Seoul Middle School" and got["부산고등학교"].region == "부산"


def test_age_regression_splits_a_name(spark):
    rows = [("N", "서울대학교", "C1", "2020-01-01", "대학부", "e", 1, "pool"), ("N", "부산중학교", "C2", "2022-01-01", "중등부", "e", 1, "pool")]
    assert len(people(spark, rows)) == 2


def test_documents_flatten(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '[{"competition":{"event_cd":"C1","name":"n","start_date":"2024-01-02"},"events":[{"name":"남자","final_rankings":[{"rank":1,"name":"A","team":"t"},{"rank":0,"name":"B"}]},{"name":"단체","final_rankings":[{"rank":1,"name":"C"}]}]},'
        '{"competition":{"name":"m","start_date":"bad"},"events":[{"name":"e","pool_rounds":[{"results":[{"name":" Z ","team":null}]}],"final_rankings":[{"rank":2,"name":"D"}]}]}]'
    )
    docs = tables.read_documents(spark, str(tmp_path))
    got = {(r.name, r.comp_date) for r in rankings.flatten_results(docs, "2024-06-01").collect()}
    assert got == {("A", datetime.date(2024, 1, 2)), ("D", datetime.date(2024, 6, 1))}
    assert {(r.name, r.kind) for r in identity.appearances(docs).collect()} == {("A", "ranking"), ("B", "ranking"), ("C", "ranking"), ("D", "ranking"), ("Z", "pool")}


def test_endpoints_skip_what_is_malformed(spark, tmp_path):
    bodies = spark.createDataFrame([(1, '[{"subEventCd":"A","subEventNm":"n"}]'), (2, "not json"), (3, None), (4, "[]")], "k int, body string")
    assert [tuple(r) for r in endpoints.events(bodies).collect()] == [(1, "A", "n")]
    assert endpoints.matches(bodies).count() == 0 and endpoints.ranks(bodies.limit(0)).count() == 0
    table = spark.createDataFrame([("a", 1), ("a", 200), ("b", 3)], "category string, rank int")
    endpoints.export_top(table, f"{tmp_path}/top", "category", "rank")
    assert {(r.category, r["rank"]) for r in spark.read.json(f"{tmp_path}/top").collect()} == {("a", 1), ("b", 3)}
    table.write.parquet(f"{tmp_path}/t")
    endpoints.truncate(table, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 0


def test_comparing_takes_two_to_ten(spark):
    table = spark.createDataFrame([(i,) for i in range(20)], "k int")
    assert players.compared(table, "k", [1, 2, 2]).count() == 2
    for ids in ([1], [1, 1], list(range(11))):
        with pytest.raises(ValueError):
            players.compared(table, "k", ids)


def test_validation_stages(spark):
    rows = spark.createDataFrame([("A", 2000), ("A", 2022), ("A1bcdefghijkl", 1990), ("Abc", 1990)], "name string, birth_year int")
    got = quality.validate(rows, quality.player_rules(2024)).collect()
    assert [r.can_save for r in got] == [False, False, True, True] and {e.message for e in got[2].errors} == {"digits", "long"}
    two = quality.two_stage(rows, quality.player_rules(2024)[:3], quality.player_rules(2024)[3:]).collect()
    assert [len(r.errors) for r in two] == [1, 3, 2, 0]


def test_writes_by_key(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "A", 1), (2, "B", 4), (3, "C", 1)], "k int, v string, n int")
    assert {(r.k, r.v) for r in tables.merged(old, new, ["k"], "n").collect()} == {(1, "A"), (2, "b"), (3, "C")}
    assert {(r.k, r.action) for r in tables.with_actions(old, new, ["k"]).collect()} == {(1, "updated"), (2, "updated"), (3, "created")}
    assert {(r.k, r.v) for r in tables.upsert(old, new.where("k > 1"), ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C")}
    tables.replace_partitions(old, str(tmp_path / "t"), ["k"])
    tables.replace_partitions(new.where("k = 1"), str(tmp_path / "t"), ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "A"), (2, "b")}
    known = tables.with_surrogate_ids(old, ["v"])
    more = tables.with_surrogate_ids(new.unionByName(old), ["v"], known)
    assert sorted(r.id for r in more.collect()) == [1, 2, 3, 4, 5] and {(r.v, r.id) for r in known.collect()} <= {(r.v, r.id) for r in more.collect()}


def test_landing_zone_and_quarantine(spark, tmp_path):
    raw = spark.createDataFrame([("u", "<html/>")], "url string, html string")
    tables.land(raw, str(tmp_path / "raw"), "url", "html", F.lit("2024-01-01"))
    key = spark.read.parquet(str(tmp_path / "raw")).first().scrape_id
    assert tables.read_landed(spark, str(tmp_path / "raw"), key).count() == 1
    checked = quality.validate(spark.createDataFrame([("A", 2000), ("Abc", 1990)], "name string, birth_year int"), quality.player_rules(2024))
    tables.save_validated(checked, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_pages(spark):
    page = '<table><tr><th>Name</th></tr><tr><td>A <b>B</b></td><td>2</td></tr></table><a class="x" href="/p?page=3">Next <i>one</i></a>'
    rows = spark.createDataFrame([(1, page)], "id int, html string")
    assert [r.cells for r in pages.table_rows(rows, keys=["id"]).orderBy("pos").collect()] == [["Name"], ["A B", "2"]]
    assert [(r.href, r.text) for r in pages.links(rows, keys=["id"]).collect()] == [("/p?page=3", "Next one")]
    assert [(str(r.start), str(r.end)) for r in each(spark, ["2024.01.02 ~ 2024.01.05", "2024-3-4"], pages.date_range)] == [("2024-01-02", "2024-01-05"), ("2024-03-04", "2024-03-04")]


def test_paged_source(spark):
    spark.dataSource.register(pages.paged_source("listing", "page int, name string", lambda n: [(n, f"c{n}a"), (n, f"c{n}b")]))
    got = spark.read.format("listing").option("pages", 3).load()
    assert got.rdd.getNumPartitions() == 3 and got.count() == 6


def test_streams(spark, tmp_path):
    from lamella.streaming import changes

    rows = spark.createDataFrame([("created", "event", i, i % 2, datetime.datetime(2024, 1, 1, i), "{}") for i in range(6)], changes.CHANGE)
    rows.write.parquet(str(tmp_path / "in"))
    got = changes.run_available(changes.counts(changes.read_changes(spark, str(tmp_path / "in")), ["parent_id"], "at"), "by_parent", str(tmp_path / "c1"))
    assert {(r.parent_id, r.changes) for r in got.collect()} == {(0, 3), (1, 3)}
    changes.ingest(changes.read_changes(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c2"))
    changes.ingest(changes.read_changes(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    seen = []
    changes.dispatch(changes.read_changes(spark, str(tmp_path / "in")), {"created": lambda df, n: seen.append(df.count()), "other": lambda df, n: seen.append(df.count())}, str(tmp_path / "c3"))
    assert sorted(seen) == [0, 6]


@pytest.mark.parametrize(("text", "intent"), [("Kim vs Lee", "rival"), ("top 5 foil", "ranking"), ("대회 일정", "competition"), ("Hong", "search")])
def test_router(spark, text, intent):
    from lamella.plans import router

    assert value(spark, router.intent(F.lit(text))) == intent


def test_subject(spark):
    from lamella.plans import router

    assert each(spark, ["Who is Kim?", "홍길동은 선수"], router.subject) == ["kim", "홍길동 선수"]


def test_relations_on_odd_rows(spark):
    rows = spark.createDataFrame([("a", "t"), ("a", None), ("b", "t"), ("b", "u"), ("b", ""), ("c", None)], "name string, team string")
    assert sorted(((r.name, r.team) for r in relations.filled_names(rows, "name", "team").collect()), key=str) == sorted([("a", "t"), ("a", "t"), ("b", "t"), ("b", "u"), ("b", None), ("c", None)], key=str)
    assert relations.orphans(rows, "team", rows.where("team = 't'"), "team").count() == 2


def test_school_names_and_address_order(spark):
    names = spark.createDataFrame([("가나중",), ("다라고",), ("마-바초",), ("사아대",), (None,)], "n string")
    got = [r[0] for r in names.select(addresses.full_school_name("n")).collect()]
    assert got == ["가나중학교", "다라고등학교", "마바초등학교", "사아대학교", None]
    teams = spark.createDataFrame([("a", None), ("b", " "), ("c", "here"), ("d", None), (None, None)], "team string, address string")
    one = spark.createDataFrame([("a", ""), ("b", "x"), ("b", "w")], "key string, address string")
    two = spark.createDataFrame([("a", "y"), ("b", "z")], "key string, address string")
    found = {r.team: (r.found, r.source, r.status) for r in addresses.look_up(teams, "team", [("one", one), ("two", two)]).collect()}
    assert found == {"a": ("y", "two", "collected"), "b": ("w", "one", "collected"), "c": ("here", None, "skipped"), "d": (None, None, "failed"), None: (None, None, "failed")}


def _union_find(edges):
    parent = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in list(parent)}


def test_components_equal_union_find(spark):
    """A long path, a star, a cycle, two nodes, a loop and a repeated edge."""
    edges = [(i + 1, i) for i in range(40)] + [(100, 100 + i) for i in range(1, 9)] + [(200, 201), (201, 202), (202, 200)] + [(301, 300), (300, 301), (301, 300), (400, 400)]
    got = identity.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == _union_find(edges)


def test_whole_components_take_every_order(spark):
    from lamella.plans.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    got = QUERIES["connected_components_whole"](spark, sf).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == _union_find((r.o_custkey, 1_000_000 + r.o_orderkey % 997) for r in orders)


def test_every_bracket_shape_is_read(spark, tmp_path):
    """bouts_by_round (nested and flat), results_by_round, de_matches beside and without full_bouts, and seeding."""
    (tmp_path / "d.json").write_text("""[{"competition":{"event_cd":"C"},"events":[
        {"event_cd":"map","bouts_by_round":{"결승":[{"player1":{"name":"A","team":"t","score":15},"player2":{"name":"B","team":"u","score":10},"winnerName":"A"}],
            "4강":[{"player1":{"name":"A","team":"t","score":9},"player2":{"name":"C","team":"u","score":15}},{"player1":{"name":"D","score":5},"player2":{"name":"E","score":5}},
                   {"player1_name":"F","player1_score":15,"player2_name":"G","player2_score":3,"winner_name":"F"},{"player1":{"name":"H"},"isBye":true,"winnerName":"H"}]},
            "results_by_round":{"8강":[{"name":"no","is_match_result":true,"score":"15-1"}]}},
        {"event_cd":"legacy","results_by_round":{"8강":[{"name":"Q","seed":8,"table_index":1,"is_match_result":true},{"name":"P","seed":1,"table_index":1,"is_match_result":true,"score":{"winner_score":15,"loser_score":7}},
            {"name":"S","seed":2,"table_index":2,"is_match_result":true,"score":"15-9"},{"name":"skip","seed":3,"table_index":2,"is_match_result":false}]}},
        {"event_cd":"wins","de_matches":[{"round":"8강","name":"W","team":"t","is_match_result":true,"score":{"winner_score":15,"loser_score":3}},{"round":"8강","name":"Z","is_match_result":true,"score":{"winner_score":0,"loser_score":0}}]},
        {"event_cd":"both","full_bouts":[{"round":"결승","winner":{"name":"A"},"loser":{"name":"B"},"score":{"winner_score":15,"loser_score":8}}],
            "de_matches":[{"round":"결승전","name":"A","is_match_result":true,"score":{"winner_score":15,"loser_score":8}},{"round":"8강","name":"A","is_match_result":true,"score":{"winner_score":15,"loser_score":2}}],
            "seeding":[{"seed":1,"name":"A","team":"t"},{"seed":2,"name":"-"}]}]}]""")
    docs = tables.read_documents(spark, str(tmp_path))
    events = docs.select(F.explode("events").alias("e")).select("e.*")
    seen = lambda rows: {(r.event_cd, r["round"], r.p1.name, r.p2 and r.p2.name, r.p1.score, r.p2 and r.p2.score, r.winner, r.is_bye) for r in rows.collect()}
    want = {
        ("map", "결승", "A", "B", 15, 10, "A", False), ("map", "준결승", "A", "C", 9, 15, "C", False), ("map", "준결승", "F", "G", 15, 3, "F", False), ("map", "준결승", "H", None, None, None, "H", True),
        ("legacy", "8강", "P", "Q", 15, None, "P", False), ("legacy", "8강", "S", None, 15, None, "S", True),
        ("wins", "8강", "W", "(상대)", 15, 3, "W", False), ("both", "결승", "A", "B", 15, 8, "A", False), ("both", "8강", "A", "(상대)", 15, 2, "A", False),
    }
    assert seen(bouts.bracket_bouts(events, ["event_cd"])) == want
    assert seen(bouts.bracket_bouts(events, ["event_cd"], True)) == want | {("both", "결승", "A", "(상대)", 15, 8, "A", False)}
    assert {(r.name, r.kind) for r in identity.appearances(docs).collect()} == {("A", "de_seeding")}


def test_numbers_over_ranges(spark):
    cell = F.when(F.col("id") % 7 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.lit("cold"))
    rows = spark.range(5000).select(cell.alias("cell"), (F.col("id") * 37 % 101).alias("v"), "id")
    rows = rows.withColumn("v", F.when(F.col("v") > 3, F.col("v")))
    order = [F.desc("v"), F.col("id")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # otherwise small tables are one range
    try:
        for by in (["cell"], []):
            want = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
            got = tables.numbered(rows, by, order, "n")
            assert {r.id: r for r in got.collect()} == {r.id: r for r in want.collect()}
            assert got.count() == 5000
            assert tables.numbered(rows.limit(0), by, order, "n").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pairs_are_counted_in_tasks_that_do_not_grow(spark):
    rows = spark.range(4000).select((F.col("id") % 500).alias("g"), (F.col("id") % 7).alias("n"))
    got = relations.cooccurring(rows, ["g"], "n", each=100)
    names = {}
    for g, n in rows.collect():
        names.setdefault(g, set()).add(n)
    want = {(a, b): sum({a, b} <= s for s in names.values()) for a in range(7) for b in range(a + 1, 7)}
    assert {(r["first"], r["second"]): r.together for r in got.collect()} == {k: v for k, v in want.items() if v}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3 and plan.count(", 40") >= 3  # groups of both sides, and pairs
