"""The corpus pipeline: toxicity, language, exact copies, near copies, packing.

All stages but the last keep the columns of their input, whatever others it has. Null and empty
texts pass the toxicity stage and go in the language stage, which can't tell their language. Rows
that repeat share their fate in the filters; of them exact dedup keeps one. Empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lamella.llm import dedup, jaccard, langid, packing, toxicity
from lamella.llm.common import held_out, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores at 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.learn(docs.where(~held_out("doc_id", 5, 0)), labels))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language isn't told apart by a wide enough margin, go: also very short ones."""
    return langid.keep_identified(docs, langid.learn(docs, ~held_out("doc_id", 4, 2)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    return dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at similarity 0.8, the one with the least doc_id stays."""
    return jaccard.keep_one(docs, width=5, num=80, den=100)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("language id", drop_unidentified),
    ("exact dedup", drop_exact_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("best-fit packing", pack_sequences),
]
#: The stages learn models and call tokenizers; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each result written to shared files before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
