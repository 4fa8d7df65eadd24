"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Raw-content dictionary of each language, the most frequent language first.
Model = dict[str, bytes]
#: Share of the smaller size by which the second language must be larger.
MARGIN = 0.005
REST = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower case, with one space for all that isn't a letter."""
    return REST.sub(" ", text.lower())


def learn(docs: DataFrame, where: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_lang: int = 48) -> Model:
    """A raw-content dictionary per language, from ``per_lang`` whole texts at most of each.

    The sample is bounded by ``per_lang``: the texts of least hash in each language, which
    Spark cuts before the shuffle, so one common language is no large group. Null languages and
    texts without letters teach nothing; an empty table gives a model that knows no language.
    """
    known = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    mixed = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), mixed.alias("h"))
    first = Window.partitionBy("lang").orderBy("h", "text")
    taken = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_lang).select("lang", "h", "text")
    found: dict[str, list[tuple[int, str]]] = {}
    for row in taken.collect():  # per_lang rows of each language at most
        found.setdefault(row["lang"], []).append((row["h"], row["text"]))
    often = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    order = sorted(found, key=lambda lang: (-often[lang], lang))
    return {lang: " ".join(plain(text) for _, text in sorted(found[lang])).encode() for lang in order}


class Judge:
    """Predicts one text: its language, the score, and whether the margin is wide enough."""

    def __init__(self, model: Model, margin: float, chunk_chars: int):
        self.langs, self.tools = list(model), []
        self.margin, self.chunk = margin, chunk_chars
        for lang in self.langs:
            held = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(6, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False)
            held.precompute_compress(compression_params=how)
            self.tools.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how))

    def __call__(self, text: object) -> tuple[str, float, bool]:
        if not self.langs or not isinstance(text, str) or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        text = plain(text)
        sizes = np.zeros(len(self.langs))
        for a in range(0, len(text), self.chunk):
            raw = text[a : a + self.chunk].encode()
            sizes += [len(t.compress(raw)) for t in self.tools]
        best = int(sizes.argmin())
        rest = np.delete(sizes, best)
        gap = (rest.min() - sizes[best]) / sizes[best] if len(rest) else 1.0
        return self.langs[best], float(gap / (gap + 0.05)) if gap > 0 else 0.0, bool(gap >= self.margin)


def identify(docs: DataFrame, model: Model, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 2000) -> DataFrame:
    """doc_id, lang_pred, score, confident of every whole text.

    Every chunk of the text is compressed with each language's dictionary; the language of
    the smallest total wins, ties going to the more frequent. Case and signs are set aside before.
    ``score`` grows with the gap to the second, as a share of the smaller size. A gap below
    ``margin`` is narrow, whatever the text's length: the prediction isn't confident. One or two
    words often compress alike with every dictionary and are then rejected. Null texts and texts
    without a letter are ``und`` with score 0, as is all text if nothing was learned. Repeated
    rows repeat their result; other columns are ignored; an empty table gives an empty result.
    """
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double, confident boolean"
    carried = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(carried.value, margin, chunk_chars)
        for batch in batches:
            out = pd.DataFrame([judge(t) for t in batch["text"]], columns=["lang_pred", "score", "confident"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def keep_identified(docs: DataFrame, model: Model, margin: float = MARGIN, text_col: str = "text", chunk_chars: int = 2000) -> DataFrame:
    """The rows of ``docs`` whose language is predicted with confidence, with all their columns.

    Null texts, texts without a letter and narrow margins go; rows that repeat share their fate;
    an empty table stays empty.
    """
    carried = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def sure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Judge(carried.value, margin, chunk_chars)
        for batch in batches:
            yield pd.Series([judge(t)[2] for t in batch], dtype="bool")

    return docs.where(sure(F.col(text_col)))
