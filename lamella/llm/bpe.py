"""Byte-level BPE: splitting, encoding by ranked merges, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters split at once; bounds the arrays of a task whatever the size of its batches.
SPLIT_CHARS = 1 << 20
#: Words that a task remembers before it starts anew.
CACHE_WORDS = 400_000
LETTER, NUMBER, SPACE = 1, 2, 3
NONE = np.int64(1) << 40
#: Longer words are merged through a heap, the others in matrices of one length.
LONG_WORD = 128
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


def split_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Positions where a match of the public pattern begins, for texts laid end to end.

    The pattern is: 's 't 're 've 'm 'll 'd; then runs of letters, of numbers, of other
    characters, each with one space before it at most; then white space, of which the last
    character before a word stays apart.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[doc_starts[doc_starts < n]] = True
    first[n] = True
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    start[1:n] = (kind[1:] != kind[:-1]) | first[1:n]
    runs = np.flatnonzero(start)
    begin, end = runs[:-1], runs[1:]
    of = kind[begin]
    # white space before something else of the same text
    gaps = end[(of == SPACE) & ~first[end]]
    start[gaps - 1] = True
    start[gaps[points[gaps - 1] == 32]] = False
    # a lone apostrophe with letters behind it, and no space taken in before it
    lone = begin[(of == 0) & (end - begin == 1) & ~first[end]]
    lone = lone[(points[lone] == 39) & start[lone]]
    lone = lone[kind[lone + 1] == LETTER]
    if len(lone):
        one, after = points[lone + 1], np.minimum(lone + 2, n - 1)
        more = (lone + 2 < n) & ~first[np.minimum(lone + 2, n)]
        two = np.where(more, points[after], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[lone[short | pair] + 1] = False
        start[lone[short] + 2] = True
        start[lone[pair] + 3] = True
    return np.flatnonzero(start[:n])


def split_texts(texts: list[str]) -> Iterator[list[list[str]]]:
    """The matches of the pattern in each text, in order; some texts at a time."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= SPLIT_CHARS):
            size += len(texts[upto])
            upto += 1
        some = texts[at:upto]
        whole = "".join(some)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in some])
        starts = split_starts(points, ends[:-1] if len(ends) else ends)
        cuts = [0, *np.searchsorted(starts, ends).tolist()]
        places = [*starts.tolist(), len(whole)]
        every = [whole[a:b] for a, b in zip(places, places[1:], strict=False)]
        yield [every[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        at = upto


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merges:
    """Ranked merges, folded over the byte arrays of many different words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces = {r: p for p, r in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def fold(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: the adjacent pair of least rank merges, leftmost first, until none is left."""
        out: list[list[int]] = [[] for _ in words]
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, members in by_length.items():
            if length > LONG_WORD:
                for i in members:
                    out[i] = self._fold_long(words[i])
                continue
            for a in range(0, len(members), 1 << 15):
                some = members[a : a + (1 << 15)]
                raw = np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(len(some), length)
                for i, ids in zip(some, self._fold_matrix(self.byte_ids[raw]), strict=True):
                    out[i] = ids
        return out

    def _fold_matrix(self, ids: np.ndarray) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(ids)
        rows = np.arange(len(ids))
        rank = self.ranked(ids[:, :-1], ids[:, 1:])
        while len(rows):
            width = ids.shape[1]
            if width == 1:
                for r, left in zip(rows.tolist(), ids.tolist(), strict=True):
                    out[r] = left
                break
            at = rank.argmin(1)
            least = rank[np.arange(len(rows)), at]
            go = least < NONE
            if not go.all():
                for r, left in zip(rows[~go].tolist(), ids[~go].tolist(), strict=True):
                    out[r] = left
                rows, ids, rank, at, least = rows[go], ids[go], rank[go], at[go], least[go]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            col = np.arange(width - 1)[None, :]
            ids = np.where(col <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[every, at] = least
            if width == 2:
                rank = np.empty((len(rows), 0), np.int64)
                continue
            gap = np.arange(width - 2)[None, :]
            rank = np.where(gap < at[:, None], rank[:, :-1], rank[:, 1:])
            has = at > 0
            rank[every[has], at[has] - 1] = self.ranked(ids[every[has], at[has] - 1], least[has])
            has = at < width - 2
            rank[every[has], at[has]] = self.ranked(least[has], ids[every[has], at[has] + 1])
        return out

    def _fold_long(self, word: bytes) -> list[int]:
        ids: list[int | None] = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pairs[k], i, k) for i in range(n - 1) if (k := ids[i] << 20 | ids[i + 1]) in self.pairs]
        heapq.heapify(heap)
        while heap:
            rank, i, key = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or ids[i] << 20 | ids[j] != key:
                continue
            ids[i], ids[j] = rank, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (k := ids[a] << 20 | ids[b]) in self.pairs:
                    heapq.heappush(heap, (self.pairs[k], a, k))
        return [x for x in ids if x is not None]


class Encoder:
    """Encodes texts, remembering the different words that it has met."""

    def __init__(self, encode_words: Callable[[list[bytes]], list[list[int]]]):
        self.encode_words, self.known = encode_words, {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for some in split_texts(texts):
            met = set().union(*some)
            if len(self.known) + len(met) > CACHE_WORDS:
                self.known = {}
            fresh = [w for w in met if w not in self.known]
            for w, ids in zip(fresh, self.encode_words([w.encode() for w in fresh]), strict=True):
                self.known[w] = struct.pack(f"<{len(ids)}I", *ids)
            for words in some:
                yield b"".join(map(self.known.__getitem__, words))


@lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(load_ranks(path))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded binary: the ids of every text, and the bytes they stand for.

    Each task splits its texts by the public pattern, takes the different words that it has
    not met before and folds the ranked merges over their byte arrays together, so a word
    costs its merges once per task. A null or empty text has no ids. Repeated rows repeat
    their result; other columns are ignored; an empty table gives an empty result. There is no
    shuffle. ``ranks_path`` must be readable on every executor.
    """
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>, decoded binary"
    return _encoded(docs, ranks_path, id_col, text_col, schema, lambda raw, data: (np.frombuffer(raw, "<u4").astype(np.int32), data))


def encode_digest(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of ``encode``'s results.

    A null or empty text has no token and the digests of nothing. Long texts are encoded whole; of
    equal ranks the leftmost pair is merged. Rows that repeat repeat their result, ids may be null, other columns are
    ignored, and an empty table gives an empty result.
    """
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digest(raw: bytes, data: bytes) -> tuple:
        ids = np.frombuffer(raw, "<u4").tolist()
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest()

    return _encoded(docs, ranks_path, id_col, text_col, schema, digest)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, result: Callable) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = merges(path)
        encoder = Encoder(table.fold)
        for batch in batches:
            for a in range(0, len(batch), 1000):
                some = batch.iloc[a : a + 1000]
                texts = some["text"].fillna("").tolist()
                rows = []
                for raw in encoder.encode(texts):
                    data = b"".join(map(table.pieces.__getitem__, np.frombuffer(raw, "<u4").tolist()))
                    rows.append(result(raw, data))
                out = pd.DataFrame(rows, columns=names[1:])
                out.insert(0, "doc_id", some["doc_id"].to_numpy())
                yield out

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
