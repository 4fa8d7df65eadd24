"""Pace and failures of sources, page streams, kept totals, counted saves, substring joins, merging under bars, JSON trees."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lamella.functions import json_trees
from lamella.operators import identity, quality, relations
from lamella.sources import pages, tables
from lamella.streaming import changes


def test_attempts_pause_longer_each_time(monkeypatch):
    slept = []
    monkeypatch.setattr(time, "sleep", slept.append)

    def third(request, attempt):
        if attempt < 3:
            raise OSError(f"{request} {attempt}")
        return "body"

    assert pages.attempted(third, "p", 3, 2.0, 2.0) == ("body", 3, None) and slept == [2.0, 4.0]
    assert pages.attempted(third, "p", 2, 2.0, 2.0) == (None, 2, "OSError: p 2") and slept == [2.0, 4.0, 2.0]


def test_failed_pages_are_rows(spark):
    def server(request, attempt):
        if request["page"] % 4 == 1 or request["page"] % 2 == 0 and attempt == 1:
            raise ValueError("busy")
        return json.dumps([{"id": request["page"] * 10 + i} for i in range(2)])

    got = pages.fetch_pages(spark.range(1, 9).withColumnRenamed("id", "page"), "page", server, delay=0, attempts=2, pause=0).cache()
    assert sorted(r.id for r in pages.answered(got, "id long").collect()) == [p * 10 + i for p in (2, 3, 4, 6, 7, 8) for i in (0, 1)]
    assert sorted(map(tuple, pages.failed(got, "page").collect())) == [(1, 2, "ValueError: busy"), (5, 2, "ValueError: busy")]
    assert {r.page: r.attempts for r in got.where("error is null").collect()} == {2: 2, 3: 1, 4: 2, 6: 2, 7: 1, 8: 2}
    nested = pages.regrouped(spark.createDataFrame([(1, "a"), (2, "b")], "k int, n string"), spark.createDataFrame([(1, 5), (1, 3)], "k int, v int"), "k", "vs")
    assert sorted((r.k, [v.v for v in r.vs]) for r in nested.collect()) == [(1, [3, 5]), (2, [])]


def test_page_stream_goes_on_behind_its_last_commit(spark, tmp_path):
    def fetch(page, options):
        with open(f"{options['log']}/{page}", "a") as f:
            f.write("x")
        return [(page, i) for i in range(page)]

    (tmp_path / "log").mkdir()
    spark.dataSource.register(pages.paged_stream("growing_pages", "page long, i long", fetch))
    for newest in (3, 3, 7):
        stream = spark.readStream.format("growing_pages").option("newest", newest).option("log", str(tmp_path / "log")).option("pagesPerTask", 2).load()
        changes.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(p, i) for p in range(1, 8) for i in range(p)]
    assert {f.name: f.read_text() for f in (tmp_path / "log").iterdir()} == {str(p): "x" for p in range(1, 8)}


def totals_of(spark, path):
    return {r.key: (r.n, r.total) for r in spark.read.schema(changes.TOTAL).parquet(f"{path}/totals").where("n > 0").collect()}


def test_totals_follow_changes_and_repeated_batches(spark, tmp_path):
    rnd, path, state = random.Random(2), str(tmp_path / "kept"), {}
    schema = "id long, key string, value long, version long, gone boolean"
    for number in range(4):
        rows = [(rnd.randrange(40), f"k{rnd.randrange(6)}", rnd.randrange(100), rnd.randrange(1000) * 4 + number, rnd.random() < 0.2) for _ in range(60)]
        batch = spark.createDataFrame(rows, schema)
        for r in rows:
            if r[0] not in state or r[3] > state[r[0]][3]:
                state[r[0]] = r
        changes.apply_changes(batch, number, path, buckets=4)
        want = {}
        for _, key, value, _, gone in state.values():
            if not gone:
                n, total = want.get(key, (0, 0))
                want[key] = (n + 1, total + value)
        assert totals_of(spark, path) == want
        changes.apply_changes(batch, number, path, buckets=4)  # run again after a failure
        assert totals_of(spark, path) == want


def test_a_batch_whose_totals_failed_is_completed(spark, tmp_path, monkeypatch):
    schema, path = "id long, key string, value long, version long, gone boolean", str(tmp_path / "kept")
    changes.apply_changes(spark.createDataFrame([(1, "a", 5, 1, False), (2, "a", 7, 1, False)], schema), 0, path)
    second, real = spark.createDataFrame([(1, "b", 6, 2, False), (2, "a", 7, 2, True)], schema), changes.written

    def failing(rows, name):
        if name == "totals-next":
            raise RuntimeError("lost")
        return real(rows, name)

    monkeypatch.setattr(changes, "written", failing)
    with pytest.raises(RuntimeError):
        changes.apply_changes(second, 1, path)
    monkeypatch.setattr(changes, "written", real)
    assert totals_of(spark, path) == {"a": (2, 12)}
    changes.apply_changes(second, 1, path)
    assert totals_of(spark, path) == {"b": (1, 6)}


def test_counters_come_of_the_job_that_saves(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 3 > 0).alias("can_save"))
    group = "counted-save"
    spark.sparkContext.setJobGroup(group, "")
    got = tables.save_counted(rows, str(tmp_path / "t"), {"largest": F.max("id")})
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"total": 100, "saved": 60, "quarantined": 40, "largest": 99} and len(jobs) == 1
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("status").count().orderBy("status").collect() == [("quarantined", 40), ("saved", 60)]


def test_names_within_names_equal_all_pairs(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.choice([0, 1, 2, 3, 4, 7])))
    left, right = [(i, word() if i % 9 else None) for i in range(80)], [(i, word()) for i in range(90)] + [(90, "é🙂a"), (91, None)]
    left += [(80, "🙂"), (81, "xé🙂ab"), (82, "%"), (83, "_")]
    got = relations.containing_pairs(spark.createDataFrame(left, "l long, a string"), "l", "a", spark.createDataFrame(right, "r long, b string"), "r", "b")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(i, j) for i, a in left for j, b in right if a and b and (a in b or b in a)}
    rows = got.collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_copies_of_names_meet_as_classes(spark):
    """Keys with the same names are compared once and written out in blocks; no pairs of keys are deduplicated, no names broadcast."""
    left = [(i, "ab") for i in range(600)] + [(5, "abc"), (5, "ab"), (None, "b"), (700, "")]
    right = [(i, "xabc") for i in range(50)] + [(0, "b"), (50, "c"), (51, None)]
    got = relations.containing_pairs(spark.createDataFrame(left, "l long, a string"), "l", "a", spark.createDataFrame(right, "r long, b string"), "r", "b")
    want = {(i, j) for i, a in left for j, b in right if a and b and (a in b or b in a)}
    rows = got.collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) > 30_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Project") or plan.startswith("Generate")
    assert plan.count("strategy=broadcast") == 2 and plan.count("strategy=merge") == 8  # the sizes of large classes only


def test_copies_of_names_shuffle_far_less_than_their_pairs(spark):
    """2,000 x 1,000 copies: the left keys go over once for each 512 right ones, as plain keys, and no partition of the pairs is merged with others."""
    key = lambda n, seed: spark.range(n).select(F.xxhash64("id", F.lit(seed)).alias("k"), F.lit("ab").alias("t"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    got = relations.containing_pairs(key(2000, 1), "k", "t", key(1000, 2), "k", "t")
    before = written()
    assert got.agg(F.count(F.lit(1)), F.count_distinct("left"), F.count_distinct("right")).first() == (2_000_000, 2000, 1000)
    got.write.format("noop").mode("overwrite").save()
    plain = written()
    got.write.format("noop").mode("overwrite").save()
    assert before <= plain <= written() and written() - plain < 400_000
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2


def test_merging_under_bars_equals_one_pass_in_order(spark):
    rnd = random.Random(6)
    nodes = [f"n{i:02d}" for i in range(60)]
    edges = sorted({tuple(rnd.sample(nodes, 2)) for _ in range(150)})
    bars = {tuple(sorted(rnd.sample(nodes, 2))) for _ in range(40)}
    owner = {n: {n} for n in nodes}
    for a, b in edges:
        if owner[a] is not owner[b] and not any(tuple(sorted((x, y))) in bars for x in owner[a] for y in owner[b]):
            both = owner[a] | owner[b]
            for n in both:
                owner[n] = both
    table = spark.createDataFrame([(a, b, (i,)) for i, (a, b) in enumerate(edges)], "a string, b string, by struct<i:long>")
    got = {r.node: r.label for r in identity.merged_under_bars(table, spark.createDataFrame(sorted(bars), "a string, b string")).collect()}
    groups = {}
    for n, label in got.items():
        groups.setdefault(label, set()).add(n)
    assert all(owner[n] & set(got) == groups[label] for n, label in got.items())


def test_rounds_give_the_profiles_of_the_reference_function(spark):
    rnd, rows = random.Random(4), []
    for n in range(25):
        for _ in range(rnd.choice([1, 2, 4, 8, 14])):
            team = rnd.choice("가나다라") + rnd.choice(["클럽", "초등학교", "중학교", "고등학교", "대학교"])
            y, m = rnd.choice([2019, 2020, 2021, 2022]), rnd.choice(["01", "05", "09"])
            rows.append((f"n{n}", team, f"c{y}{m}{rnd.choice('ab')}", f"{y}-{m}-01" if rnd.random() < 0.95 else "", rnd.choice(["", "남자 에페", "여자 U13", "남고"]), rnd.choice(["a", "b", None, "a"]), 1, "pool"))
    table = spark.createDataFrame(rows, "name string, team string, comp string, date string, event string, weapon string, rank int, kind string")
    whole, rounds = identity.resolve_people(table), identity.resolve_people_in_rounds(table)
    assert sorted(map(str, whole.collect())) == sorted(map(str, rounds.select(*whole.columns).collect()))


def test_json_keys_at_any_depth(spark):
    text = '{"a": {"b": [{"a": "\\"a\\": x"}, "a", {"a" : null}]}, "ab": "a", "c": {"b": 1}}'
    rows = spark.createDataFrame([(text,), (None,), ("[]",)], "t string").select(json_trees.renamed_keys("t", {"a": "b", "b": "a", "c": "d.e"}).alias("t"), json_trees.every_key("t").alias("k")).collect()
    swap = lambda v: {{"a": "b", "b": "a", "c": "d.e"}.get(k, k): swap(x) for k, x in v.items()} if isinstance(v, dict) else [swap(x) for x in v] if isinstance(v, list) else v
    assert json.loads(rows[0].t) == swap(json.loads(text)) and rows[1].t is None and rows[2].t == "[]"
    assert rows[0].k == ["a", "b", "a", "a", "ab", "c", "b"]
    grouped = spark.createDataFrame([([("x", 1), (None, 2), ("x", 3)],)], "r array<struct<g:string,v:int>>").select(json_trees.grouped("r", "g", "?").alias("m")).first().m
    assert {k: [s.v for s in v] for k, v in grouped.items()} == {"x": [1, 3], "?": [2]} and list(grouped) == ["x", "?"]


def test_look_back_and_alerts(spark):
    rows = spark.createDataFrame([("m", 1.0, "2024-01-01 10:00:00"), ("m", 2.0, "2024-01-02 09:30:00"), ("m", 9.0, "2024-01-02 11:00:00"), ("k", 5.0, "2024-01-02 09:00:00")], "m string, v double, at string").withColumn("at", F.to_timestamp("at"))
    got = quality.look_back(rows, "m", "v", "at", "2024-01-02 10:00:00")
    assert {r.m: (r.latest, r.last_1h, r.last_24h) for r in got.collect()} == {"m": (2.0, 1, 1), "k": (5.0, 0, 1)}
    assert [(r.m, r.threshold) for r in quality.alerts(got, "m", {"m": (1.5, False), "k": (4.0, True)}, "2024-01-02 10:00:00").collect()] == [("m", 1.5)]
