"""Document fingerprints by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width

BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def kgram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit rolling hash of each run of k code points (of all of them, if fewer).

    The sum over a run rolls on: it is the difference of two running sums of code times
    BASE**position, divided by BASE to the power of the run's position.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    with np.errstate(over="ignore"):
        coded = (points.astype(np.uint64) + np.uint64(1)) * MIX
        coded ^= coded >> np.uint64(29)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(coded * _powers(BASE, n), out=total[1:])
        h = (total[k:] - total[: n - k + 1]) * _powers(pow(BASE, -1, 1 << 64), n - k + 1)
        h ^= h >> np.uint64(32)
        h *= MIX
    return h >> np.uint64(32)


def winnow(points: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions): the least hash of every window of hashes, its rightmost place on ties.

    Any common run of k + window - 1 code points leaves a common hash; no run shorter than k does.
    """
    h = kgram_hashes(points, k)
    n = len(h)
    if not n:
        return h, np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    value = h << np.uint64(32) | (low - np.arange(n, dtype=np.uint64))  # among equals, the rightmost is least
    w = min(window, n)
    # least of each window: suffix minima of one block meet prefix minima of the next
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = value
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    kept = least[np.r_[True, least[1:] != least[:-1]]]  # the places of the minima never go back
    return kept >> np.uint64(32), (low - (kept & low)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """``hash@position`` entries, in order of position."""
    return " ".join(f"{h:08x}@{p}" for h, p in zip(hashes.tolist(), positions.tolist(), strict=True))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fingerprints(docs: DataFrame, k: int = 12, window: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hashes array<long>, positions array<int> of every whole text; null and empty: none."""
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, hashes array<long>, positions array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [winnow(_points(t), k, window) for t in batch["text"].fillna("")]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "hashes": [h.astype(np.int64) for h, _ in found], "positions": [p.astype(np.int32) for _, p in found]})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def edit_check(docs: DataFrame, k: int = 12, window: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints every text and its edited text, and compares it with those and the next text.

    The edited text has its last quarter replaced by the start of the next document in ascending
    id (after the last: the first). Documents are dealt out in ranges of ids; the first row of a
    range also goes to the range before it, so neighbours meet without one global sort. Ids must be
    whole numbers, or texts that spell them: their order is that of the numbers. Null
    texts count as empty; a null id comes first; rows that repeat an id follow each other in
    order of their text's digest. A single document is its own next one. An empty table gives
    an empty result; other columns are ignored. Long texts are hashed whole; of equal least hashes
    of a window the rightmost is chosen.
    """
    kind, ranges = dict(docs.dtypes)[id_col], shuffle_width(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("tie", F.xxhash64("text"))
    cuts = rows.agg(F.percentile_approx("key", [i / ranges for i in range(ranges)], 10_000)).first()[0] or []  # one per range
    cuts = sorted(set(cuts))[1:]
    rows = rows.withColumn("at", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("key"))) if cuts else F.lit(0))
    heads = dict(rows.groupBy("at").agg(F.min("key")).collect())  # one per range
    used = sorted(heads)
    before = {at: used[i - 1] for i, at in enumerate(used)}
    slots = range(len(cuts) + 1)
    head = F.array(*[F.lit(heads.get(at)).cast("long") for at in slots])
    behind = F.array(*[F.lit(before.get(at)).cast("int") for at in slots])
    is_head = F.get(head, F.col("at")) == F.col("key")
    own = F.struct(F.col("at").alias("at"), F.lit(0).alias("ahead"))
    copy = F.when(is_head, F.struct(F.get(behind, F.col("at")).alias("at"), F.lit(1).alias("ahead")))
    dealt = rows.withColumn("place", F.explode(F.array_compact(F.array(own, copy)))).select("doc_id", "text", "key", "tie", "place.at", "place.ahead")
    dealt = dealt.repartitionById(len(cuts) + 1, "at").sortWithinPartitions("at", "ahead", "key", "tie")
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row whose next one isn't known yet
        columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            for a in range(0, len(batch), 200):  # few rows at a time bound a worker's memory
                some, out = batch.iloc[a : a + 200], []
                for doc_id, text, at, ahead in zip(some["doc_id"], some["text"], some["at"], some["ahead"], strict=True):
                    points = _points(text)
                    mine = winnow(points, k, window)
                    if held is not None and held[0] == at:
                        _, held_id, old, own = held
                        n = len(old)
                        cut = n // 4
                        edited = np.concatenate([old[: n - cut], points[:cut]])
                        changed = winnow(edited, k, window)
                        raw = edited.astype("<u4").tobytes().decode("utf-32-le").encode()
                        out.append((held_id, n, hashlib.sha256(raw).hexdigest(), written(*own), written(*changed), likeness(own[0], changed[0]), likeness(own[0], mine[0])))
                    held = None if ahead else (at, doc_id, points, mine)
                yield pd.DataFrame(out, columns=columns)

    return dealt.select("doc_id", "text", "at", "ahead").mapInPandas(run, schema)
