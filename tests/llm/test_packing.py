"""Packing against the tokenizers library and exact packings of small sets."""

import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandmill.llm import packing

SCHEMA = "doc_id long, text string, piece string, sequence_id string, length int, offset int, __number int"


def rows_of():
    r = random.Random(3)
    words = ["alpha", "bêta", "gamma.", "δ", "  ", "\n", "don't", "<|endoftext|>", "12345"]
    texts = ["", None, "a", "x" * 5000, "long word " * 200_000, " \t\n ", *(" ".join(r.choices(words, k=r.choice([1, 5, 90, 700]))) for _ in range(120))]
    rows = [(i if i % 9 else None, t, "p", "s", 1, 2, 3) for i, t in enumerate(texts)]
    return rows + rows[:3] + [(500, "same text", "p", "s", 1, 2, 3)] * 40


def slow_pieces(rows, capacity, end_id=2):
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        first = len(ids) % capacity or capacity
        at = [0, *range(first, len(ids) + 1, capacity)]
        out += [(doc_id, k, a, z - a, zlib.crc32(ids[a:z].tobytes()), ids[a:z].tolist()) for k, (a, z) in enumerate(zip(at, at[1:]))]
    return out


def gapless(rows, capacity):
    """The number of sequences of (sequence, offset, length), each filled from 0 and not beyond the capacity."""
    held: dict = {}
    for sequence, offset, length in rows:
        held.setdefault(sequence, []).append((offset, length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.fixture(scope="module")
def tokenizer():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("capacity", [1024, 100])
def test_pack(spark, tokenizer, capacity):
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(3)
    got = packing.pack(df, tokenizer, 2, capacity, digests=True)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got, want = got.collect(), slow_pieces(rows_of(), capacity)
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted((w[:5] for w in want), key=str)
    n = gapless([(r.sequence_id, r.offset, r.length) for r in got], capacity)
    assert n <= -(-sum(w[3] for w in want) // capacity) + 1


def test_sequences_hold_the_ids(spark, tokenizer):
    df = spark.createDataFrame([r for r in rows_of() if len(r[1] or "") < 10_000], SCHEMA)
    packed = packing.pack(df, tokenizer, 2, 256)
    want = {(w[0], w[1], tuple(w[5])) for w in slow_pieces([tuple(r) for r in df.collect()], 256)}
    found = set()
    for r in packing.sequences(packed).collect():
        assert len(r.ids) <= 256
        ends = [p.offset for p in r.pieces[1:]] + [len(r.ids)]
        found |= {(p.id, p.piece, tuple(r.ids[p.offset : z])) for p, z in zip(r.pieces, ends)}
    assert found == want
    assert packing.pack(df.limit(0), tokenizer, 2).count() == 0


def test_string_ids(spark, tokenizer):
    got = packing.pack(spark.createDataFrame([("a", "one"), ("b", "two words"), (None, None)], "name string, body string"), tokenizer, 2, 8, "name", "body", digests=True).collect()
    assert {r.name for r in got} == {"a", "b", None} and gapless([(r.sequence_id, r.offset, r.length) for r in got], 8) == 1


def best(lengths, capacity):
    """The fewest bins, by trying every bin for every piece."""

    @cache
    def of(left, bins):
        if not left:
            return len(bins)
        k, rest = left[0], left[1:]
        found = of(rest, tuple(sorted((*bins, capacity - k))))
        for i, room in enumerate(bins):
            if room >= k and room not in bins[:i]:
                found = min(found, of(rest, tuple(sorted((*bins[:i], room - k, *bins[i + 1 :])))))
        return found

    return of(tuple(sorted(lengths, reverse=True)), ())


def test_plan_is_near_the_best():
    r, over = random.Random(5), 0
    for _ in range(60):
        lengths = [r.randint(1, 20) for _ in range(r.randint(0, 9))]
        combinations = packing.plan(Counter(lengths), 20)
        used = Counter()
        for times, chosen in combinations:
            assert sum(k * m for k, m in chosen.items()) <= 20
            for k, m in chosen.items():
                used[k] += m * times
        assert used == Counter(lengths)
        over += sum(t for t, _ in combinations) - best(lengths, 20)
    assert over <= 1


def test_plan_of_many_pieces():
    r = random.Random(6)
    for most in (1024, 300):
        counts = Counter(r.randint(1, most) for _ in range(50_000))
        combinations = packing.plan(counts, 1024)
        bound = -(-sum(k * n for k, n in counts.items()) // 1024)
        assert bound <= sum(t for t, _ in combinations) <= bound * 1.005
        assert len(combinations) < 5000
        again = packing.plan({k: n * 10**6 for k, n in counts.items()}, 1024)
        assert len(again) < 5000 and sum(t for t, _ in again) <= bound * 10**6 * 1.005


def test_fullest_takes_what_fits_most():
    r = random.Random(7)
    for _ in range(200):
        counts = {k: r.randint(1, 3) for k in r.sample(range(1, 30), 5)}
        room = r.randint(0, 60)
        chosen = packing.fullest(sorted(counts.items(), reverse=True), room)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        assert sum(k * m for k, m in chosen.items()) == max(s for s in sums if s <= room)
        assert all(m <= counts[k] for k, m in chosen.items())
