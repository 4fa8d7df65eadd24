"""Ranked lexical search over a tiered index: high-impact postings first, lower tiers only where exactness isn't proven."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Documents, and postings, after which a segment of the index is closed.
SEGMENT_DOCS, SEGMENT_POSTINGS = 4096, 1 << 20
#: Share of a term's list that ends the first and the second of three tiers; shorter lists lie in the first.
TIER_SHARES, WHOLE = (1 / 16, 1 / 4), 16
TIERS = 3
#: Terms of a block of items (all that the driver and a task hold of the queries), and rows up to which tables are broadcast.
BLOCK_TERMS, BROADCAST_ROWS = 200_000, 200_000
#: All bytes but digits, letters and those of other characters than ASCII part terms; A-Z are lower-cased.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: object) -> list[bytes]:
    """The terms of a text, with repeats, in UTF-8 (null: none)."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if isinstance(text, str) else []


@dataclass(frozen=True)
class Index:
    """Segments (a row each, a group of columns per tier), documents per term, and the two counts of the collection."""

    segments: DataFrame
    df: DataFrame
    docs: int
    words: int


def _packed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.int32)


class _Segment:
    """Documents and postings of one segment while it is filled."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.postings, self.size = [], [], {}, 0

    def add(self, doc_id: object, length: int, counts: dict[bytes, int]) -> None:
        at = len(self.ids)
        self.ids.append(doc_id), self.lengths.append(length)
        self.size += len(counts)
        for term, tf in counts.items():
            self.postings.setdefault(term, []).append((at, tf))

    def row(self, name: str) -> dict[str, object]:
        names = sorted(self.postings)
        lists = [self.postings[t] for t in names]
        flat = [p for one in lists for p in one]
        return {
            "segment": name, "ids": self.ids, "lengths": self.lengths, "terms": [t.decode("utf-8", "surrogatepass") for t in names], "sizes": [len(one) for one in lists],
            "places": [p for p, _ in flat], "tfs": [tf for _, tf in flat],
        }


def _tiers(places: np.ndarray, parts: np.ndarray, sizes: np.ndarray) -> dict[str, list]:
    """Each list by falling part, cut into tiers; ``rest`` is the greatest part that lies in lower tiers (0: none)."""
    out: dict[str, list] = {f"{what}{t}": [] for t in range(TIERS) for what in ("sizes", "places", "parts", "rest")}
    ends = np.cumsum(sizes)
    for a, b in zip(ends - sizes, ends, strict=True):
        order = a + np.argsort(-parts[a:b], kind="stable")
        n = b - a
        cuts = [0, *(n if n <= WHOLE else max(WHOLE, math.ceil(n * s)) for s in TIER_SHARES), n]
        for t in range(TIERS):
            mine = order[cuts[t] : cuts[t + 1]]
            out[f"sizes{t}"].append(len(mine)), out[f"places{t}"].append(places[mine]), out[f"parts{t}"].append(parts[mine])
            out[f"rest{t}"].append(parts[order[cuts[t + 1]]] if cuts[t + 1] < n else 0)
    for t in range(TIERS):
        for what in ("places", "parts"):
            out[f"{what}{t}"] = np.concatenate(out[f"{what}{t}"]) if out[f"{what}{t}"] else _packed([])
    return out


def build_index(docs: DataFrame, wanted: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", scale: int = 90) -> Index:
    """The tiered index of all rows of ``docs``; of ``wanted`` terms (column term) only, where their table may be broadcast.

    A task deals its documents into segments of bounded size; a segment holds its postings, so
    nothing is shuffled but one row per term and segment for the counts. With the counts of the
    collection known, a posting's part of the score is (10**9 tf) div (1000 tf + 8 m), where m is
    100 - scale + scale * n * N div L; lists are ordered by it and cut into three tiers of columns, so that a
    reader of the first tier reads those columns alone. With each term of a tier stands the
    greatest part that lies below. Null and empty texts are documents without terms; a row is a document, repeated or not.
    """
    kind = dict(docs.dtypes)[id_col]
    known = None
    if wanted is not None:
        some = wanted.select("term").distinct().limit(BROADCAST_ROWS + 1).collect()  # bounded; beyond it all terms are indexed
        if len(some) <= BROADCAST_ROWS:
            known = docs.sparkSession.sparkContext.broadcast({r["term"].encode("utf-8", "surrogatepass") for r in some})

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made, now = TaskContext.get().partitionId(), 0, _Segment()
        for batch in batches:
            ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            for doc_id, text in zip(ids, batch["text"], strict=True):
                words = terms(text)
                counts = Counter(words)
                if known is not None:
                    counts = {t: counts[t] for t in counts.keys() & known.value}
                now.add(doc_id, len(words), counts)
                if len(now.ids) >= SEGMENT_DOCS or now.size >= SEGMENT_POSTINGS:
                    yield pd.DataFrame([now.row(f"{task}-{made}")])
                    made, now = made + 1, _Segment()
        if now.ids:
            yield pd.DataFrame([now.row(f"{task}-{made}")])

    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        fill, f"segment string, ids array<{kind}>, lengths array<long>, terms array<string>, sizes array<int>, places array<int>, tfs array<int>"
    )
    raw = materialize(raw, "search-postings")
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    found = raw.select(F.size(F.filter("lengths", lambda n: n > 0)).alias("docs"), total.alias("words")).agg(F.sum("docs"), F.sum("words")).first()
    n_docs, n_words = found[0] or 0, found[1] or 0
    pairs = raw.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p"))
    df = materialize(pairs.groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.sizes").cast("long").alias("df")), "search-df")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                places, tfs = np.asarray(row.places, dtype=np.int64), np.asarray(row.tfs, dtype=np.int64)
                m = 100 - scale + scale * np.asarray(row.lengths, dtype=np.int64) * n_docs // max(1, n_words)
                parts = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[places])
                yield pd.DataFrame([{"segment": row.segment, "ids": row.ids, "terms": row.terms, **_tiers(places.astype(np.int32), parts.astype(np.int32), np.asarray(row.sizes, dtype=np.int64))}])

    columns = ", ".join(f"{what}{t} array<int>" for t in range(TIERS) for what in ("sizes", "places", "parts", "rest"))
    tiered = raw.mapInPandas(cut, f"segment string, ids array<{kind}>, terms array<string>, {columns}")
    return Index(materialize(tiered, "search-index"), df, n_docs, n_words)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term: the terms of each item, once each. Rows that share an id (or have none) are one item."""
    kind = dict(items.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(i, t.decode("utf-8", "surrogatepass")) for i, text in zip(batch["item_id"].astype(object).where(batch["item_id"].notna(), None), batch["text"], strict=True) for t in set(terms(text))]
            yield pd.DataFrame(pairs, columns=["item_id", "term"])

    return items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInPandas(run, f"item_id {kind}, term string").distinct()


def _best(scores: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores of ``where``; of equal ones the first places."""
    if len(where) > k:
        least = np.partition(scores[where], len(where) - k)[len(where) - k]
        where = where[scores[where] >= least]
    return where[np.lexsort((where, -scores[where]))][:k]


def _probe(row: object, weights: dict[int, dict[str, int]], tiers: int, k: int, floors: dict[int, int]) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(item, open bound, places, scores, exact) of each item in one segment, from its first ``tiers`` tiers.

    A document's score so far is a lower bound; with the rest of every term that it hasn't met, an
    upper one. Where both are equal the score is exact. The open bound is the greatest upper bound of a
    document whose score isn't.
    """
    names = {t: i for i, t in enumerate(row.terms)}
    size = len(row.ids)
    held = []
    for t in range(tiers):
        sizes = np.asarray(getattr(row, f"sizes{t}"), dtype=np.int64)
        held.append((np.r_[0, np.cumsum(sizes)], np.asarray(getattr(row, f"places{t}")), np.asarray(getattr(row, f"parts{t}"), dtype=np.int64)))
    rests = np.asarray(getattr(row, f"rest{tiers - 1}"), dtype=np.int64)
    out = []
    for item, mine in weights.items():
        score, gap = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for term, weight in mine.items():
            i = names.get(term)
            if i is None or not weight:
                continue
            rest = weight * int(rests[i])
            gap += rest
            for ends, places, parts in held:
                at = places[ends[i] : ends[i + 1]]
                score[at] += weight * parts[ends[i] : ends[i + 1]]
                gap[at] -= rest
        floor = max(1, floors.get(item, 0))
        loose = np.flatnonzero((gap > 0) & (score + gap >= floor))
        fast = np.flatnonzero((gap == 0) & (score >= floor))
        bound = int((score[loose] + gap[loose]).max()) if len(loose) else 0
        fast, loose = _best(score, fast, k), _best(score, loose[score[loose] > 0], k)
        both = np.r_[fast, loose]
        if len(both) or bound:
            out.append((item, bound, both, score[both], np.arange(len(both)) < len(fast)))
    return out


PROBED = "segment string, item int, bound long, docs array<struct<doc_id:{kind},score:long,exact:boolean>>"


def _pass(segments: DataFrame, weights: dict[int, dict[str, int]], tiers: int, k: int, floors: dict[int, int], items_col: bool) -> DataFrame:
    """What ``_probe`` finds in every segment, reading the columns of the first ``tiers`` tiers only."""
    columns = ["segment", "ids", "terms", *[f"{what}{t}" for t in range(tiers) for what in ("sizes", "places", "parts")], f"rest{tiers - 1}"]
    kind = dict(segments.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    carried = segments.sparkSession.sparkContext.broadcast((weights, floors))  # one block of items

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, given = carried.value
        least, best = dict(given), {}  # what the task's own segments show raises the floors
        for batch in batches:
            for row in batch.itertuples(index=False):
                mine = {i: every[i] for i in row.items} if items_col else every
                ids, found = list(row.ids), []
                for item, bound, places, scores, exact in _probe(row, mine, tiers, k, least):
                    best[item] = sorted([*best.get(item, []), *scores.tolist()])[-k:]
                    if len(best[item]) == k:
                        least[item] = max(least.get(item, 0), best[item][0])
                    docs = [{"doc_id": ids[p], "score": int(s), "exact": bool(e)} for p, s, e in zip(places, scores, exact, strict=True)]
                    found.append((row.segment, item, bound, docs))
                yield pd.DataFrame(found, columns=["segment", "item", "bound", "docs"])

    return segments.select(*columns, *(["items"] if items_col else [])).mapInPandas(run, PROBED.format(kind=kind))


def _search_block(index: Index, weights: dict[int, dict[str, int]], k: int) -> DataFrame:
    """item, doc_id, score: exact candidates that hold the ``k`` best of every item."""
    spark, floors, done, todo = index.segments.sparkSession, {}, None, index.segments
    for tiers in range(1, TIERS + 1):
        found = materialize(_pass(todo, weights, tiers, k, floors, tiers > 1), f"search-tier{tiers}")
        seen = found if done is None else done.unionByName(found)
        lists = seen.select("item", F.explode("docs").alias("d")).select("item", "d.score")
        ranked = lists.withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("n") == k)
        floors = {r["item"]: r["score"] for r in ranked.collect()}  # one number per item of the block
        if tiers == TIERS:
            done = seen
            break
        floor = spark.createDataFrame([(i, floors.get(i, 1)) for i in weights], "item int, floor long")
        judged = found.join(F.broadcast(floor), "item")
        proven = judged.where("bound < floor").drop("floor")
        done = materialize(proven if done is None else done.unionByName(proven), f"search-proven{tiers}")
        open_ = materialize(judged.where("bound >= floor").groupBy("segment").agg(F.collect_list("item").alias("items")), f"search-open{tiers}")
        if open_.isEmpty():
            break
        few = open_.count() <= BROADCAST_ROWS // 100
        todo = index.segments.join(F.broadcast(open_) if few else open_, "segment")
    return done.select("item", F.explode("docs").alias("d")).where("d.exact").select("item", "d.doc_id", "d.score")


def search(index: Index, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of greatest score above 0 for each item, exact.

    Every item first meets the top tier of every segment. A segment is done with an item when no
    document of inexact score can still reach the item's k-th best lower bound; otherwise the item
    falls through to the next tier there, and at last to the whole lists. Ties go to the smaller
    doc_id (null first). Items are searched in blocks, whose terms and weights the tasks hold.
    Weights are floor(1000 ln((2N + 2) / (2 df + 1))). Items without terms, and an empty index, give no rows.
    """
    spark, kind = items.sparkSession, dict(items.dtypes)[item_col]
    pairs = materialize(item_terms(items, item_col, text_col), "search-items")
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.docs + 2) / (2 * F.col("df") + 1))).cast("long")
    known = pairs.join(index.df, "term").select("item_id", "term", weight.alias("w"))
    blocks = math.ceil(pairs.count() / BLOCK_TERMS)
    known = materialize(known.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks)))), "search-weights")
    out = spark.createDataFrame([], f"item_id {kind}, doc_id {dict(index.segments.dtypes)['ids'][6:-1]}, score long")
    for block in range(blocks):
        rows = known.where(F.col("block") == block).collect()  # BLOCK_TERMS rows, about
        ids = {i: n for n, i in enumerate(sorted({r["item_id"] for r in rows}, key=lambda i: (i is not None, i)))}
        weights: dict[int, dict[str, int]] = {n: {} for n in ids.values()}
        for r in rows:
            weights[ids[r["item_id"]]][r["term"]] = r["w"]
        if not weights:
            continue
        names = spark.createDataFrame([(n, i) for i, n in ids.items()], f"item int, item_id {kind}")
        out = out.unionByName(_search_block(index, weights, k).join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
