from collections import Counter

import corpus_pipeline
from test_texts import brute_classes

import __spark_entry__
from lamella.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    every = docs.collect()
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in every} - {r.doc_id for r in kept.collect()}
    assert all(labels.get(i, 1) == 1 for i in gone)
    sure = corpus_pipeline.drop_unidentified(spark, kept, SF)
    assert sure.count() >= 0.98 * kept.count()
    unique = corpus_pipeline.drop_exact_copies(spark, sure, SF)
    last = {}
    for r in sure.collect():
        t = r.text.encode().lower()
        last[t] = max(last.get(t, -1), r.doc_id)
    assert Counter(r.doc_id for r in unique.collect()) == Counter(last.values())
    single = corpus_pipeline.drop_near_copies(spark, unique, SF)
    classes = brute_classes(unique.collect(), 5, 80, 100)
    assert Counter(r.doc_id for r in single.collect()) == Counter({c for _, _, c in classes})
    packed = corpus_pipeline.pack_sequences(spark, single, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in single.collect()}


def test_run_and_registration(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    found = __spark_entry__.queries()
    assert set(queries.QUERIES) < set(found) and "pipeline" in found
    assert found["pipeline"](spark, SF).count() > 0


def test_stages_take_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    """Nulls, repeats, long texts and clashing columns pass through every stage; nothing stays nothing."""
    for docs in (odd_docs, no_docs):
        rows = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns and out.count() <= rows.count()
            rows = spark.createDataFrame(out.collect(), docs.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
        assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in rows.collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, odd_docs, SF).collect()}
    assert kept == {r.doc_id for r in odd_docs.collect()}
    assert {3, 4, 9, 10}.isdisjoint(r.doc_id for r in corpus_pipeline.drop_unidentified(spark, odd_docs, SF).collect())
