import math
import re
from collections import Counter

import pytest
from oracle import connect, same

from lamella.llm import queries, ranking

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item, rank): (doc_id, score), every document scored against every item."""
    counted = [(doc, Counter(terms(text))) for doc, text in docs]
    n_docs, words = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    found = {}
    for item, mine in wanted.items():
        scored = []
        for doc, counts in counted:
            m = 10 + (90 * counts.total() * n_docs) // (words or 1)
            parts = ((math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))), counts[t]) for t in mine if t in counts)
            score = sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)) for w, tf in parts)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        for rank, (score, *_, doc) in enumerate(sorted(scored)[:k], 1):
            found[item, rank] = (doc, -score)
    return found


def searched(docs, items, wanted=True, **how):
    index = ranking.build_index(docs, ranking.item_terms(items) if wanted else None)
    rows = ranking.search(index, items, **how).collect()
    assert len({(r.item_id, r["rank"]) for r in rows}) == len(rows)
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}


def texts(table, key):
    return [(r[key], r.text) for r in table.collect()]


@pytest.mark.parametrize("wanted", [True, False])
def test_results_equal_brute_force(spark, monkeypatch, wanted):
    """With the items' terms indexed, and with all; in segments of 50 documents, so that bounds between them count."""
    monkeypatch.setattr(ranking, "SEGMENT_DOCS", 50)
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert searched(docs, items, wanted) == brute(texts(docs, "doc_id"), texts(items, "item_id"))


def planted(spark):
    """Many documents that share common words, and a few that hold an item whole: those are proven early."""
    common = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(common[(i * 7 + j) % 40] for j in range(3 + i % 60)), 1) for i in range(3000)]
    rows += [(5000 + i, "zeta eta theta iota kappa lambda mu nu " * (2 + i % 3), 1) for i in range(15)]
    items = [(1, "zeta eta theta iota kappa lambda mu nu w1 w2"), (2, "w1 w2 w3 w4"), (3, "nothing known"), (4, ""), (5, None), (None, "w5 zeta"), (2, "w9")]
    return spark.createDataFrame(rows, "doc_id long, text string, score long"), spark.createDataFrame(items, "item_id long, text string")


def test_only_items_without_proof_fall_through(spark, monkeypatch):
    docs, items = planted(spark)
    monkeypatch.setattr(ranking, "SEGMENT_DOCS", 100)
    met, real = [], ranking._pass

    def spy(segments, weights, tiers, k, floors, some):
        met.append((tiers, segments.selectExpr("explode(items)").count() if some else segments.count() * len(weights)))
        return real(segments, weights, tiers, k, floors, some)

    monkeypatch.setattr(ranking, "_pass", spy)
    assert searched(docs, items) == brute(texts(docs, "doc_id"), texts(items, "item_id"))
    assert met[0][0] == 1 and 0 < met[1][1] < met[0][1] * 0.7, met


def test_a_pass_reads_the_columns_of_its_tiers_only(spark):
    docs, items = planted(spark)
    index = ranking.build_index(docs)
    plan = ranking._pass(index.segments, {0: {"w1": 3}}, 1, 10, {}, False)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: (.*)", plan)[1]
    assert "places0" in schema and "places1" not in schema and "parts2" not in schema


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "Alpha BETA straße 東京"), (2, "word1 tail3 end"), (3, "!!!"), (None, "two lines")], "item_id long, text string")
    assert searched(odd_docs, items) == brute(texts(odd_docs, "doc_id"), texts(items, "item_id"))
    assert searched(odd_docs, items, k=2) == brute(texts(odd_docs, "doc_id"), texts(items, "item_id"), 2)
    assert searched(no_docs, items) == {} and searched(odd_docs, items.where("false")) == {}


def test_blocks_of_items_agree(spark, monkeypatch):
    docs, items = planted(spark)
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 5)
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 3)
    assert searched(docs, items) == brute(texts(docs, "doc_id"), texts(items, "item_id"))


def test_query_equals_sql(spark):
    same(queries.op13_tiered_search(spark, SF), connect(SF), queries.ORACLE_SQL["op13_tiered_search"])


def test_query_has_the_columns(spark):
    got = queries.op13_tiered_search(spark, SF)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
