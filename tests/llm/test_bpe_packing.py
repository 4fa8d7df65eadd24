import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lamella.llm import bpe, packing

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def odd_texts():
    r = random.Random(3)
    bits = list(" \n\t'’sStredvml llaé1２3!- 　ñ日本🙂\r\u0085") + ["'s", "'re", "'ll", " 've", "  ", "\n\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    return [*texts, "", "a" * 1000, "ab" * 3000, "!" * 700, " " * 90, "it's we're I'll'd", "'", "x'", "'s", "'l", "'ll", "\n'r"]


def test_split_is_the_pattern():
    import regex

    pattern, texts = regex.compile(public_tokenizers.PATTERN), odd_texts()
    got = [words for some in bpe.split_texts(texts) for words in some]
    assert got == [pattern.findall(t) for t in texts]


def test_ids_equal_the_library(library):
    texts = odd_texts()
    got = bpe.Encoder(bpe.merges(RANKS).fold).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(t) for t in texts]


def test_encode_odd_rows_and_round_trip(odd_docs, no_docs, library):
    rows = odd_docs.collect()
    got = bpe.encode(odd_docs, RANKS).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == Counter((r.doc_id, tuple(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in rows)
    digest = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digest(odd_docs, RANKS).collect()}
    want = {(r.doc_id, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows for i in [library.encode_ordinary(r.text or "")]}
    assert digest == want and bpe.encode(no_docs, RANKS).count() == 0


def test_plan_holds_every_length_once():
    r = random.Random(5)
    for _ in range(300):
        cap = r.choice([10, 60, 64])
        counts = Counter(r.randint(1, cap) for _ in range(r.randint(1, 80)))
        fixed, rest = packing.reduce_instance(counts, cap)
        plan, used = fixed + packing.best_fit(rest, cap), Counter()
        for entries, times in plan:
            assert times > 0 and sum(s * n for s, n in entries) <= cap
            for s, n in entries:
                used[s] += n * times
        assert used == counts
        total = sum(n for _, n in plan)
        assert total <= 11 * -(-sum(s * n for s, n in counts.items()) // cap) / 9 + sum(2 * s > cap for s in counts.elements()) + 1


def fewest(lengths, cap):
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {rooms[j]: j for j in range(len(rooms)) if rooms[j] >= lengths[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, cap - lengths[i]])

    place(0, [])
    return best


def test_reduction_never_costs_a_sequence():
    r = random.Random(6)
    for _ in range(150):
        cap = 20
        lengths = sorted((r.randint(3, cap) for _ in range(r.randint(1, 9))), reverse=True)
        fixed, rest = packing.reduce_instance(Counter(lengths), cap)
        left = sorted(Counter(rest).elements(), reverse=True)
        assert sum(n for _, n in fixed) + (fewest(left, cap) if left else 0) == fewest(lengths, cap)


def test_pack_odd_rows(spark, odd_docs, no_docs):
    whole = Tokenizer.from_file(JSON)
    more = odd_docs.union(spark.createDataFrame([(20, "a<|endoftext|>b", "en", "z", 1, 1, "", 1, 1)], odd_docs.schema))
    rows, cap = more.collect(), 256
    got = packing.pack_documents(more, JSON, capacity=cap).collect()
    ids = {(r.doc_id, r.text): [*whole.encode(r.text or "", add_special_tokens=False).ids, 0] for r in rows}
    want = Counter()
    for r in rows:
        i = ids[r.doc_id, r.text]
        first = len(i) % cap or cap
        cuts = [0, *range(first, len(i) + 1, cap)] if len(i) > cap else [0, len(i)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(np.array(i[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and p[-1][0] + p[-1][1] <= cap
    assert packing.pack_documents(no_docs, JSON).count() == 0


def test_packed_sequences_hold_the_ids_of_their_pieces(odd_docs, no_docs):
    whole, cap = Tokenizer.from_file(JSON), 256
    got = packing.packed_sequences(odd_docs, JSON, capacity=cap).collect()
    found = Counter()
    for r in got:
        assert len(r.ids) == sum(p.length for p in r.pieces) <= cap
        for p in r.pieces:
            found[p.doc_id, p.piece, tuple(r.ids[p.offset : p.offset + p.length])] += 1
    want = Counter()
    for r in odd_docs.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % cap or cap
        cuts = [0, *range(first, len(ids) + 1, cap)] if len(ids) > cap else [0, len(ids)]
        want.update((r.doc_id, k, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert found == want
    assert packing.packed_sequences(no_docs, JSON).count() == 0
