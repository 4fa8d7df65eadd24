"""Best-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import materialize

#: A sequence's content as (length, times) entries, and how many sequences have it.
Plan = list[tuple[list[tuple[int, int]], int]]
#: Pieces of one length that one task ranks, on average.
PART_ROWS = 1 << 16


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """Martello-Toth reduction on the histogram of lengths: fixed sequences, and what is left.

    From the longest length down, a set with that length is fixed when it dominates every
    feasible alternative: alone if nothing fits beside it; with a partner that fills the rest
    exactly; with the largest partner if no two others fit together, or if no two that fit sum
    to more than that partner and no three fit. As many copies are fixed at once as there are.
    """
    left, fixed = Counter({k: v for k, v in counts.items() if v > 0}), []
    sizes = sorted(left)

    def take(entries: list[tuple[int, int]], times: int) -> None:
        fixed.append((entries, times))
        for size, each in entries:
            left[size] -= each * times
            if not left[size]:
                del left[size]
                sizes.pop(bisect_left(sizes, size))

    for size in sorted(left, reverse=True):
        while left.get(size):
            room = capacity - size
            few = _smallest(left, sizes, size, 3)
            if not few or few[0] > room:
                take([(size, 1)], left[size])
                continue
            if room == size:
                if left[size] < 2:
                    break
                take([(size, 2)], left[size] // 2)
                continue
            if left.get(room):
                take([(size, 1), (room, 1)], min(left[size], left[room]))
                continue
            at = bisect_left(sizes, room + 1) - 1
            best = sizes[at]
            if best == size and left[size] < 2:
                if at == 0:
                    break
                best = sizes[at - 1]
            none_of_two = len(few) < 2 or sum(few[:2]) > room
            none_of_three = len(few) < 3 or sum(few) > room
            if not (none_of_two or none_of_three and _best_pair(left, sizes, size, room) <= best):
                break
            if best == size:
                take([(size, 2)], left[size] // 2)
            else:
                take([(size, 1), (best, 1)], min(left[size], left[best]))
    return fixed, dict(left)


def _smallest(left: Counter, sizes: list[int], mine: int, n: int) -> list[int]:
    """The n smallest lengths beside one of length mine."""
    found: list[int] = []
    for s in sizes:
        found += [s] * min(n - len(found), left[s] - (s == mine))
        if len(found) >= n:
            break
    return found


def _best_pair(left: Counter, sizes: list[int], mine: int, room: int) -> int:
    """The largest sum of two lengths that fits into room."""
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        total = sizes[i] + sizes[j]
        if total > room:
            j -= 1
            continue
        if i != j or left[sizes[i]] - (sizes[i] == mine) >= 2:
            best = max(best, total)
        i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on the histogram: each length goes to the fullest sequences that take it.

    Sequences of equal content are one group, so the work depends on the number of
    lengths, not of documents. Among sequences with the same room the one opened last is taken.
    """
    groups: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def put(room: int, entries: list[tuple[int, int]], times: int) -> None:
        if times:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((entries, times))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                entries, times = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, entries = capacity, []
                times = -(-n // (capacity // size))
            each = room // size
            full = min(times, n // each)
            put(room - each * size, [*entries, (size, each)], full)
            n -= full * each
            rest = times - full
            if rest and n:
                some = min(n, each)
                put(room - some * size, [*entries, (size, some)], 1)
                n -= some
                rest -= 1
            put(room, entries, rest)
    return [group for found in groups.values() for group in found]


def plan_rows(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """length, lo, hi, each, first sequence, offset: which ranks of a length go where."""
    used, rows, base = Counter(), [], 0
    for entries, times in plan:
        offset = 0
        for size, each in entries:
            rows.append((size, used[size], used[size] + each * times, each, base, offset))
            used[size] += each * times
            offset += size * each
        base += times
    return sorted(rows)


@lru_cache(2)
def _library(path: str):
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    vocab = whole.get_vocab()
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    byte_of = _byte_names()
    ranks = {bytes(byte_of[c] for c in name): i for name, i in vocab.items() if name not in special}
    core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return whole, special, core


def _byte_names() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for each piece of a document's ids.

    The ids are those of the tokenizers file without special tokens, then ``end_id``. The task
    splits texts by the byte-level pattern, and each different word is merged once; texts that
    hold the spelling of a special token go through the tokenizers library whole. Documents longer than
    ``capacity`` are cut from their end, so only the first piece is shorter.
    """
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long{', ids array<int>' if with_ids else ''}"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, special, core = _library(tokenizer_path)
        encoder = Encoder(lambda words: [core.encode_ordinary(w.decode()) for w in words])
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a in range(0, len(batch), 1000):
                some = batch.iloc[a : a + 1000]
                texts = some["text"].fillna("").tolist()
                rows = []
                for doc_id, text, raw in zip(some["doc_id"], texts, encoder.encode(texts), strict=True):
                    if any(s in text for s in special):
                        raw = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                    raw += tail
                    n = len(raw) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
                    for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        part = raw[4 * x : 4 * y]
                        rows.append((doc_id, i, x, y - x, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
                yield pd.DataFrame(rows, columns=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """The columns of ``pieces``, then sequence_id and offset.

    The plan is made from the histogram of lengths (``capacity`` rows at most). Each piece gets
    a rank among those of its length; ranks are counted within hash parts of a length, as many
    as its pieces need, so one very common length is no single task. A task looks its ranks up
    in the plan, whose size depends on ``capacity`` alone.
    """
    spark, names = pieces.sparkSession, pieces.columns
    pieces = materialize(pieces, "pack-pieces")
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # one per length
    bits = [(length, max(0, (n - 1) // PART_ROWS).bit_length()) for length, n in counts.items()]
    known = spark.createDataFrame(bits, "length long, __bits int")
    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    pieces = pieces.withColumn("__mixed", mixed).join(F.broadcast(known), "length")
    pieces = pieces.withColumn("__part", F.expr("if(__bits = 0, 0, cast(shiftrightunsigned(__mixed, 64 - __bits) as int))"))
    parts = materialize(pieces.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n")), "pack-parts")
    fixed, rest = reduce_instance(counts, capacity)
    rows = np.array(plan_rows(fixed + best_fit(rest, capacity)), np.int64).reshape(-1, 6)
    plan = spark.sparkContext.broadcast(rows)
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.join(offsets, ["length", "__part"]).withColumn("__rank", F.col("__before") + F.row_number().over(order) - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = plan.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(table[:, 0] << 44 | table[:, 1], length << 44 | rank, "right") - 1
        size, lo, _, each, base, offset = table[at].T
        return pd.DataFrame({"sequence_id": base + (rank - lo) // each, "offset": offset + (rank - lo) % each * size})

    placed = ranked.withColumn("__at", place("length", "__rank"))
    return placed.select(*names, "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document into as few sequences of ``capacity`` tokens as best fit finds.

    A null or empty text is the end id alone. Rows that repeat are packed each time. Texts of more
    tokens than fit are cut, whatever their length. Pieces of equal length may take each other's
    places: the plan is made for lengths. An empty table
    gives an empty result; other columns are ignored; ids may be null.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity)


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id, ids array<int>, pieces array<(offset, doc_id, piece, length)>: the sequences themselves.

    A group is one sequence, so it holds ``capacity`` ids at most. Nulls, repeated rows and empty
    tables are as in ``pack_documents``.
    """
    placed = pack(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids=True), capacity)
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("parts"))
    pieces = F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["length"].alias("length")))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), pieces.alias("pieces"))
