"""Hashed word shingles, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; bounds the arrays of a task.
CHUNK = 1 << 19
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return h ^ h >> np.uint64(31)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word between white space."""
    b = np.frombuffer(raw, np.uint8)
    white = _WHITE[b]
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * _powers(_BASE, len(b)), out=total[1:])
        return start, mix((total[end] - total[start]) * _powers(_INVERSE, len(b))[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct ``width``-word shingles.

    A-Z are lower-cased; words lie between space and \\t\\n\\v\\f\\r. A text with fewer words
    is one shingle of all of them; without words the set is empty.
    """
    at, raws = 0, [t.encode().lower() for t in texts]
    while at < len(raws):
        upto, size = at, 0
        while upto < len(raws) and (upto == at or size + len(raws[upto]) < CHUNK):
            size += len(raws[upto]) + 1
            upto += 1
        some = raws[at:upto]
        starts, words = _word_hashes(b" ".join(some))
        limits = np.cumsum([len(r) + 1 for r in some])
        doc = np.searchsorted(limits, starts, "right")
        counts = np.bincount(doc, minlength=len(some))
        ends = np.cumsum(counts)
        with np.errstate(over="ignore"):
            n = max(len(words) - width + 1, 0)
            h = np.zeros(n, np.uint64)
            for i in range(width):
                h = mix(h * _BASE + words[i : n + i])
        own = doc[:n] == doc[width - 1 : n + width - 1] if n else np.zeros(0, bool)
        h, owner = h[own], doc[:n][own]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[fresh], owner[fresh]
        cuts = np.searchsorted(owner, np.arange(len(some) + 1))
        for i in range(len(some)):
            if counts[i] >= width:
                yield h[cuts[i] : cuts[i + 1]]
            elif counts[i]:
                whole = np.uint64(counts[i])
                with np.errstate(over="ignore"):
                    for w in words[ends[i] - counts[i] : ends[i]]:
                        whole = mix(np.array([whole * _BASE + w]))[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
        at = upto


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    with np.errstate(over="ignore"):
        folded = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([folded]))[0].astype(np.int64))
