"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, dedup, fingerprints, html, jaccard, langid, licenses, mixing, oracles, packing, ranking, sharding, toxicity
from .common import held_out


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(_read(spark, sf_dir, "documents"), shards=16, law="bytes")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_read(spark, sf_dir, "documents"), width=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"), html.trained())


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_check(_read(spark, sf_dir, "documents"), k=12, window=32)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    away = held_out("doc_id", 5, 0)
    model = toxicity.learn(docs.where(~away), _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", away).select("doc_id", "held_out", "score", "predicted", "clauses")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    away = held_out("doc_id", 4, 2)
    model = langid.learn(docs, ~away)
    return langid.identify(docs, model).withColumn("held_out", away).select("doc_id", "held_out", "lang_pred", "score", "confident")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), limit=3, shards=16, block=32)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(_read(spark, sf_dir, "conversations")))


def op13_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "benchmark")
    index = ranking.build_index(_read(spark, sf_dir, "documents"), wanted=ranking.item_terms(items))
    return ranking.search(index, items, k=10)


QUERIES = {
    "op1_hilbert_sharding": op1_hilbert_sharding,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_html_text": op4_html_text,
    "op7_license_scan": op7_license_scan,
    "op5_winnowing": op5_winnowing,
    "op6_byte_bpe": op6_byte_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_sainte_lague_mix": op11_sainte_lague_mix,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_tiered_search": op13_tiered_search,
}

ORACLE_SQL = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        WINDOW same AS (PARTITION BY norm)
    """,
    "op12_conversation_repair": oracles.REPAIR,
    "op13_tiered_search": oracles.SEARCH,
}
