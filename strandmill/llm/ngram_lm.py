"""Language-model scoring with an Elias-Fano n-gram trie in shards.

Counts of words, pairs and triples are exact and cover every training document and word. The
model interpolates: words by add-one counts over the whole vocabulary, then pairs and triples
that occur ``LEAST`` times by absolute discounting, each with the mass it takes away given to
the next lower order. ``LEAST`` is a count, the same for every size of the corpus.

Tasks deal all n-grams, each with the rows that ask for it, once: to shards by the hash of
the word before the last. So a shard has every count of its contexts. Its task counts the
n-grams of training documents, writes the shard's trie, maps it into memory, looks up each
different n-gram in it once, in order, and answers the rows by that. A trie has the words of
the shard; under each word its next words, and the words before it; under each of these pairs
the next words. A level's ids are made monotone by adding the last value before each context,
and kept in Elias-Fano code, with monotone pointers, also in Elias-Fano code, to where each
context's ids start. Both parts of a code are read where they lie in the mapped file. Shares
and left masses are quantised to 16 bits.

A word that more than a shard's tokens follow is dealt out by the word before it. Its
pairs are counted first, in shards by the word after it, whose files its shards map as well.
The number of shards grows with the tokens. The driver sees numbers of shards and parts, and
a number for each word that is dealt out.

The most frequent words, at most ``TABLE_WORDS``, are known by a table that every worker holds;
the others by 61 bits of a hash, and they are counted by a join on the word.

A null or empty text is one end token. A null id counts as the text ""."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm._common import filesystem, fresh_dir, keep, prepare, raw, read_mapped, small, write_once

#: The end of a text, which no word equals.
END = b"\n"
#: Words in the table that every worker holds, at most.
TABLE_WORDS = 1 << 19
#: A pair or triple is held from this count on.
LEAST = 2
#: Tokens to a shard, and tokens that a task deals at once.
SHARD_TOKENS, CHUNK = 2_000_000, 1_000_000
#: N-grams that are looked up at once.
GROUP = 40_000
DISCOUNT = 0.75
#: Quantised values run from 0 to minus this.
RANGE = 16.0
#: Codes of words outside the table have this bit.
HASHED = 1 << 61
#: The code of all words that no n-gram with them can be held of: their count is below ``LEAST``.
SELDOM = 1 << 62


#: The place of the r-th bit that is set in a byte.
_PLACE = np.array([[([b for b in range(8) if x >> b & 1] + [0] * 8)[r] for r in range(8)] for x in range(256)], np.int64)

_BYTES = np.uint64(0x0101010101010101)


class EliasFano:
    """A monotone sequence: high parts in unary with counts of ones by word of 64 bits, low parts packed."""

    def __init__(self, data) -> None:
        self.n, self.low_bits, high_words, low_words, self.top = (int(x) for x in np.frombuffer(data, "<u8", 5))
        self.high = np.frombuffer(data, "<u8", high_words, 40)
        self.ones = np.frombuffer(data, "<i8", high_words + 1, 40 + 8 * high_words)
        self.low = np.frombuffer(data, "<u8", low_words, 48 + 16 * high_words)
        self.size = 48 + 8 * (2 * high_words + low_words)
        self.zeros = None

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        v = values.astype(np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        high = (v >> np.uint64(low_bits)).astype(np.int64)
        last = int(high[-1]) if n else 0
        bits = np.zeros(-(-(n + last + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            part = v & np.uint64((1 << low_bits) - 1)
            w, s = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, w, part << s)
            over = s > np.uint64(64 - low_bits)
            np.bitwise_or.at(low, w[over] + 1, part[over] >> (np.uint64(64) - s[over]))
        packed = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
        return np.array([n, low_bits, len(packed), len(low), last], "<u8").tobytes() + packed.tobytes() + ones.astype("<i8").tobytes() + low.astype("<u8").tobytes()

    def _bit(self, word: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The place of the r-th bit that is set in each word."""
        x = word - (word >> np.uint64(1) & np.uint64(0x5555555555555555))
        x = (x & np.uint64(0x3333333333333333)) + (x >> np.uint64(2) & np.uint64(0x3333333333333333))
        # byte k has the number of bits up to byte k
        upto = (x + (x >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
        r = r.astype(np.uint64)
        k = np.bitwise_count((r * _BYTES | _BYTES << np.uint64(7)) - upto & _BYTES << np.uint64(7))
        at = k.astype(np.uint64) << np.uint64(3)
        r -= (upto << np.uint64(8)) >> at & np.uint64(255)
        return 8 * k.astype(np.int64) + _PLACE[(word >> at & np.uint64(255)).astype(np.int64), r.astype(np.int64)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        w, s = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        over = np.where(s > 0, self.low[w + 1] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
        return (((self.low[w] >> s) | over) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        w = self.ones.searchsorted(i, "right") - 1
        high = 64 * w + self._bit(self.high[w], i - self.ones[w]) - i
        return high << self.low_bits | self._low(i)

    def _span(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values have a high part below ``h``, and how many one up to ``h``."""
        lo, hi = np.full(len(h), self.n), np.full(len(h), self.n)
        some = np.flatnonzero(h <= self.top)
        if len(some):
            if self.zeros is None:
                self.zeros = 64 * np.arange(len(self.ones)) - self.ones

            def zero(r):
                w = self.zeros.searchsorted(r, "right") - 1
                return 64 * w + self._bit(~self.high[w], r - self.zeros[w])

            g = h[some]
            # the zero before the first value of h, and the next one: mostly in the same word
            at = np.zeros(len(g), np.int64)
            later = np.flatnonzero(g > 0)
            at[later] = zero(g[later] - 1) + 1
            rest = ~self.high[at >> 6] >> (at & 63).astype(np.uint64)
            end = at + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1))
            far = np.flatnonzero(rest == 0)
            end[far] = zero(g[far])
            lo[some], hi[some] = at - g, end - g
        return lo, hi

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place from ``lo`` up to ``hi`` whose value is at least ``x``, and whether it equals ``x``."""
        h, low = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        a, b = self._span(h)
        a = np.clip(a, lo, hi)
        end = b = np.clip(b, a, hi)
        b = b.copy()
        # in between only low parts differ
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) // 2
            less = self._low(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        equal = np.zeros(len(x), bool)
        inside = np.flatnonzero(a < end)
        equal[inside] = self._low(a[inside]) == low[inside]
        return a, equal


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-log10, 0, RANGE) * (65535 / RANGE)).astype("<u2")


_PLAIN = np.append(10 ** (np.arange(65536) * (-RANGE / 65535)), 0.0)


def plain(quantised: np.ndarray) -> np.ndarray:
    """What was quantised, 0 for -1."""
    return _PLAIN[quantised]


class Level:
    """Words under contexts, with a quantised value each."""

    def __init__(self, data) -> None:
        self.pointers = EliasFano(data)
        self.ids = EliasFano(data[self.pointers.size :])
        at = self.pointers.size + self.ids.size
        self.value = np.frombuffer(data, "<u2", self.ids.n, at)
        self.size = -(-(at + 2 * self.ids.n) // 8) * 8

    @staticmethod
    def encode(contexts: int, context: np.ndarray, word: np.ndarray, log10: np.ndarray) -> bytes:
        """Items in order of context, then word."""
        pointers = np.searchsorted(context, np.arange(contexts + 1))
        # each context's ids go on from the last value before them
        last = np.zeros(contexts + 1, np.int64)
        ends = pointers[1:]
        some = ends > pointers[:-1]
        last[1:][some] = word[ends[some] - 1]
        data = EliasFano.encode(pointers) + EliasFano.encode(word + np.cumsum(last)[context]) + quantise(log10).tobytes()
        return data + b"\0" * (-len(data) % 8)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The places of words under contexts, -1 for those that are not there. Equal contexts stand together."""
        if not self.ids.n or not len(context):
            return np.full(len(word), -1)
        new = np.append(True, context[1:] != context[:-1])
        own, of = context[new], np.cumsum(new) - 1
        lo, hi = self.pointers[own], self.pointers[own + 1]
        before = np.where(lo > 0, self.ids[np.maximum(lo - 1, 0)], 0)
        at, equal = self.ids.successor(before[of] + word, lo[of], hi[of])
        return np.where(equal, at, -1)


def _place(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The places of values in a sorted array, -1 for those that are not there."""
    if not len(sorted_):
        return np.full(len(x), -1)
    at = np.minimum(sorted_.searchsorted(x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


def _mixed(*xs: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of each row of values."""
    out = np.zeros(len(xs[0]), np.uint64)
    for x in xs:
        out = out * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
        out ^= out >> np.uint64(31)
    return out


def _sums(n: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each different row of keys once, with the sum of ``n``: hashes in order, sums, keys."""
    h = _mixed(*keys)
    o = np.argsort(h)
    h, keys = h[o], [k[o] for k in keys]
    first = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], 0))) if len(o) else np.zeros(0, int)
    return h[first], np.add.reduceat(n[o], first) if len(first) else n, *(k[first] for k in keys)


def _ranks(arrays: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The different codes of arrays in order, and each array as places among them. Empties the list, to free memory."""
    far = [np.flatnonzero(x >= HASHED) for x in arrays]
    others = np.unique(np.concatenate([x[f] for x, f in zip(arrays, far)]))
    # those of the table, and -1, are marked instead of sorted
    seen = np.zeros(TABLE_WORDS + 2, bool)
    for x in arrays:
        seen[np.minimum(x, TABLE_WORDS) + 1] = True
    seen[-1] = False
    inside, place, out = np.flatnonzero(seen) - 1, (np.cumsum(seen) - 1).astype(np.int32), []
    while arrays:
        x, f = arrays.pop(0), far.pop(0)
        out.append(place[np.minimum(x, TABLE_WORDS) + 1])
        out[-1][f] = len(inside) + others.searchsorted(x[f])
    return np.concatenate([inside, others]), *out


class NGrams:
    """Each different n-gram once, in order of b, a and w, as places in ``words``, with the sum of its ``n``; and each different (b, w).

    ``at`` is where each given one went, ``pair`` where each different one's (b, w) is."""

    def __init__(self, codes: list[np.ndarray], n: np.ndarray) -> None:
        """Empties the list ``codes`` of b, a and w, to free memory."""
        self.words, b, a, w = _ranks(codes)
        first, o, self.at = self._groups(self._key(b, a, w))
        self.n = np.add.reduceat(n[o], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        some = o[first]
        self.b, self.a, self.w = b[some], a[some], w[some]
        del b, a, w, o
        first, o, self.pair = self._groups(self._key(self.b, self.w))
        self.pair_n = np.add.reduceat(self.n[o], first) if len(first) else self.n
        self.pair_b, self.pair_w = self.b[o[first]], self.w[o[first]]

    def _key(self, x: np.ndarray, *more: np.ndarray) -> np.ndarray:
        """A number for each row of places, in the order of the rows."""
        v = len(self.words)
        key = x.astype(np.int64)
        for i, y in enumerate(more):
            if i and v**3 >= 1 << 63:
                key = np.unique(key, return_inverse=True)[1]
            key *= v
            key += y
        return key

    @staticmethod
    def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where equal keys begin in order, the order, and each one's group."""
        o = np.argsort(key)
        key = key[o]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        del key
        at, number = np.empty(len(o), np.int32), np.cumsum(new, dtype=np.int32)
        number -= 1
        at[o] = number
        return np.flatnonzero(new), o, at

    def codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.words[self.b], self.words[self.a], self.words[self.w]


class Shard:
    """The trie of the contexts that are dealt to one task."""

    def __init__(self, data) -> None:
        data = memoryview(data)
        v = int(np.frombuffer(data, "<u8", 1)[0])
        self.words = np.frombuffer(data, "<i8", v, 8)
        # words are contexts by their places in the table of words
        at = 8 + 8 * v
        self.left = np.frombuffer(data, "<u2", v, at)
        at += -(-2 * v // 8) * 8
        self.pairs = Level(data[at:])
        self.before = Level(data[at + self.pairs.size :])
        self.triples = Level(data[at + self.pairs.size + self.before.size :])

    @staticmethod
    def encode(grams: NGrams, totals: np.ndarray | None = None) -> tuple[bytes, float]:
        """The trie of counted n-grams of training documents (a is -1 where a text begins), and the mass of the pairs that are held.

        With ``totals``, of each pair's context, only pairs are counted and they are all given."""
        v, fit = len(grams.words), grams.words != SELDOM
        total = np.bincount(grams.b, grams.n, v)[grams.pair_b] if totals is None else totals
        held2 = np.flatnonzero((grams.pair_n >= LEAST) & fit[grams.pair_w])
        b2, w2, share2 = grams.pair_b[held2], grams.pair_w[held2], (grams.pair_n[held2] - DISCOUNT) / total[held2]
        # n-grams stand in order of (b, a)
        new = np.append(True, (grams.b[1:] != grams.b[:-1]) | (grams.a[1:] != grams.a[:-1]))[: len(grams.b)]
        context = np.cumsum(new) - 1
        many = np.bincount(context, grams.n)
        held3 = np.flatnonzero((grams.n >= LEAST) & (grams.words[grams.a] >= 0) & fit[grams.w])
        a3, b3, w3, context = grams.a[held3], grams.b[held3], grams.w[held3], context[held3]
        share3 = (grams.n[held3] - DISCOUNT) / many[context]
        used = np.zeros(v, bool)
        for x in (b2, w2, a3, b3, w3):
            used[x] = True
        words, place = grams.words[used], np.cumsum(used) - 1
        b2, w2, a3, b3, w3 = (place[x] for x in (b2, w2, a3, b3, w3))
        rest = lambda of, share, m: np.log10(np.maximum(1 - np.bincount(of, share, m), 1e-16))
        head = np.array([len(words)], "<u8").tobytes() + words.astype("<i8").tobytes()
        left = quantise(rest(b2, share2, len(words))).tobytes()
        pairs = Level.encode(len(words), b2, w2, np.log10(share2))
        new = np.append(True, context[1:] != context[:-1])[: len(context)]
        of, nodes = np.cumsum(new) - 1, int(new.sum())
        before = Level.encode(len(words), b3[new], a3[new], rest(of, share3, nodes))
        triples = Level.encode(nodes, of, w3, np.log10(share3))
        return head + left + b"\0" * (-len(left) % 8) + pairs + before + triples, float(share2.sum())

    def places(self, x: np.ndarray) -> np.ndarray:
        """Where words stand in the table of words, -1 for those that are not in it."""
        return _place(self.words, x)

    def pair(self, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of places of words: quantised shares (-1 for pairs that are not held) and masses left by the contexts (0 where nothing is taken)."""
        return self._under(self.pairs, self.left, b, w)

    def triple(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of triples. Contexts that stand together are looked up once."""
        new = np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1]))[: len(b)]
        own_a, own_b = a[new], b[new]
        node = np.full(len(own_b), -1)
        some = np.flatnonzero((own_b >= 0) & (own_a >= 0))
        node[some] = self.before.find(own_b[some], own_a[some])
        return self._under(self.triples, self.before.value, node[np.cumsum(new) - 1], w)

    @staticmethod
    def _under(level: Level, left: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share, rest = np.full(len(context), -1), np.zeros(len(context), np.int64)
        has = np.flatnonzero(context >= 0)
        rest[has] = left[context[has]]
        both = has[word[has] >= 0]
        at = level.find(context[both], word[both])
        share[both[at >= 0]] = level.value[at[at >= 0]]
        return share, rest


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays end to end, compressed by place of the byte; whole numbers by their steps where they rise."""
    out = []
    for x in arrays:
        steps = x.dtype.kind == "i" and bool((x[1:] >= x[:-1]).all())
        x = np.diff(x, prepend=0) if steps else x
        planes = np.ascontiguousarray(x.astype("<i8" if x.dtype.kind == "i" else "<f8").view(np.uint8).reshape(-1, 8).T)
        out.append(bytes([steps, x.dtype.kind == "f"]) + len(x).to_bytes(6, "little") + planes.tobytes())
    data = b"".join(out)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at + 2 : at + 8], "little")
        x = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at + 8).reshape(8, n).T).view("<f8" if data[at + 1] else "<i8").reshape(n)
        out.append(np.cumsum(x) if data[at] else x)
        at += 8 + 8 * n
    return out


class Packets:
    """The n-grams of packets, each different one once, and what each packet asks."""

    def __init__(self) -> None:
        self.ngrams, self.of_words, self.asked, self.size, self.folds, self.different = [], [], [], 0, [], None

    def add(self, ngrams: bytes, asked: bytes) -> None:
        b, a, w, of_word, n = _unpack(ngrams)
        off = np.flatnonzero(of_word)
        self.of_words.append((w[off], of_word[off]))
        self.ngrams.append((b, a, w, n.astype(np.int32)))
        self.asked.append(asked)
        self.size += len(b)
        if self.size > 2 * CHUNK and (self.different is None or self.size > len(self.different.n)):
            self.fold()

    def fold(self) -> None:
        """Joins the n-grams that were added to the different ones so far."""
        if not self.ngrams:
            return
        known = 0
        if self.different is not None:
            known = len(self.different.n)
            self.ngrams.insert(0, (*self.different.codes(), self.different.n))
            self.of_words.append((self.different.words, self.of_word))
        lengths = [len(x[0]) for x in self.ngrams]
        columns, self.ngrams, self.different = list(zip(*self.ngrams)), [], None
        n = np.concatenate(columns.pop())
        codes = [np.concatenate(columns.pop(0)) for _ in range(3)]
        found = NGrams(codes, n)
        # a count belongs to the word, whichever n-gram brings it
        of_word = np.zeros(len(found.words), np.int64)
        for w, many in self.of_words:
            at = found.words.searchsorted(w)
            of_word[at] = np.maximum(of_word[at], many)
        self.of_word, self.of_words = of_word, []
        self.folds.append((known, lengths[1:] if known else lengths, self.asked, found.at))
        self.different, self.asked, self.size = found, [], 0

    def spread(self, value: np.ndarray) -> Iterator[tuple[bytes, np.ndarray]]:
        """What each packet asks, and the values of its n-grams from those of the different ones."""
        for known, lengths, asked, at in reversed(self.folds):
            end = known
            for question, length in zip(asked, lengths):
                yield question, value[at[end : end + length]]
                end += length
            value = value[at[:known]]


def _slices(first: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of the chosen ones' items, when each one's items lie end to end from its first."""
    some = sizes[which]
    return np.repeat(first[which] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts end to end, A-Z in lower case, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, many = parts.flatten(), pc.list_value_length(parts).to_numpy()
    full = pc.binary_length(words).to_numpy() > 0
    if not full.all():
        many = np.bincount(np.repeat(np.arange(len(many)), many)[full], minlength=len(many))
        words = words.filter(pa.array(full))
    return words.view(pa.binary()), many


def _counted(docs: DataFrame) -> DataFrame:
    """Each different word of the texts, and ``END``, with its number: (key, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 8000, 32 << 20):
            if b.num_rows:
                found = pc.value_counts(pa.concat_arrays([_split(b.column(0))[0], pa.array([END] * b.num_rows)]))
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["key", "n"])

    return docs.select(raw("text").alias("t")).mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _squeeze(codes: np.ndarray, codec: pa.Codec) -> bytes:
    """Unsigned 32-bit integers, compressed by place of the byte."""
    return codec.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def _spread(data: bytes, n: int, codec: pa.Codec) -> np.ndarray:
    planes = np.frombuffer(codec.decompress(data, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _hashed(word: Column) -> Column:
    """The code of a word that is not in the table."""
    return F.shiftrightunsigned(F.xxhash64(word), 3).bitwiseOR(F.lit(HASHED))


def _histories(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids two and one before each, -1 before a text."""
    b = np.append(-1, ids[:-1])
    a = np.append([-1, -1], ids[:-2])[: len(ids)]
    first = starts[:-1]
    b[first] = -1
    a[first] = -1
    second = first + 1
    a[second[second < len(ids)]] = -1
    return a, b


def _dealt(shard: np.ndarray, packed) -> Iterator[pa.RecordBatch]:
    """A row (shard, ngrams, rows) for each shard; ``packed`` packs the items at the given places."""
    order = np.argsort(shard, kind="stable")
    ends = np.flatnonzero(np.append(shard[order][1:] != shard[order][:-1], True)) + 1 if len(order) else []
    begin = 0
    for end in ends:
        which = order[begin:end]
        yield pa.RecordBatch.from_arrays([pa.array([int(shard[which[0]])], pa.int32()), *(pa.array([x], pa.binary()) for x in packed(which))], names=["shard", "ngrams", "rows"])
        begin = end


_DEALT = "shard int, ngrams binary, rows binary"


class Beside:
    """What is known of the words outside the table, by row: places in the row, codes and counts.

    It lies beside the coded rows, in a folder for each of their parts, and is read part by part."""

    def __init__(self, uri: str) -> None:
        self.uri, self.part, self.held = uri, None, {}

    def of(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if row >> 33 != self.part:
            from pyarrow import fs, parquet

            self.part, self.held = row >> 33, {}
            system, path = filesystem(f"{self.uri}/part={self.part}")
            for file in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if file.base_name.endswith(".parquet"):
                    table = parquet.read_table(file.path, filesystem=system, columns=["row", "known"], partitioning=None).combine_chunks()
                    known = table["known"].combine_chunks() if table.num_rows else None
                    if known is not None:
                        items, ends = known.flatten(), (known.offsets.to_numpy() - known.offsets[0].as_py()).tolist()
                        fields = [items.field(i).to_numpy(zero_copy_only=False) for i in range(3)]
                        for r, a, b in zip(table["row"].to_pylist(), ends, ends[1:]):
                            self.held[r] = tuple(x[a:b] for x in fields)
        return self.held.get(row)


def _chunks(batches: Iterator[pa.RecordBatch], use, beside: Beside | None = None) -> Iterator[pa.RecordBatch]:
    """Calls ``use(row, train, a, b, w, n)`` on stretches of tokens of coded rows: number of the row, whether it is
    of training, codes of the two tokens before (-1: none) and of the token, and its count if it is not in the table.

    Without ``beside`` the rows bring their words outside the table, as codes in order of their places."""
    parts, size = [], 0

    def emit() -> Iterator[pa.RecordBatch]:
        row, train, ids, n, lengths = (np.concatenate(x) for x in zip(*parts))
        a, b = _histories(ids, np.concatenate([[0], np.cumsum(lengths)]))
        row, train = np.repeat(row, lengths), np.repeat(train, lengths)
        for at in range(0, len(ids), CHUNK):
            yield from use(*(x[at : at + CHUNK] for x in (row, train, a, b, ids, n)))

    codec = pa.Codec("zstd")
    for batch in small(batches):
        row, held, many, codes = (batch.column(i) for i in range(4))
        for k, (r, h, m, c) in enumerate(zip(row.to_pylist(), held.to_pylist(), many.to_pylist(), codes)):
            ids = _spread(c.as_py(), m, codec)
            n = np.zeros(m, np.int64)
            off = np.flatnonzero(ids & 1)
            ids >>= 1
            if len(off):
                which = ids[off]
                if beside is None:
                    ids[off] = batch.column(4)[k].values.to_numpy()[which]
                else:
                    own, own_n = np.full(int(which.max()) + 1, SELDOM), np.zeros(int(which.max()) + 1, np.int64)
                    if (known := beside.of(r)) is not None:
                        own[known[0]], own_n[known[0]] = known[1:]
                    ids[off], n[off] = own[which], own_n[which]
            parts.append((np.array([r]), np.array([not h]), ids, n, np.array([len(ids)])))
            size += len(ids)
            if size >= CHUNK:
                yield from emit()
                parts, size = [], 0
    if parts:
        yield from emit()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, table_words: int = TABLE_WORDS) -> DataFrame:
    """Per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    if table_words > TABLE_WORDS:
        raise ValueError(f"a table holds {TABLE_WORDS} words at most")  # so that three codes make a 64-bit integer
    spark = prepare(docs.sparkSession)
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    training = rows.where(~F.col("held_out"))

    words = keep(_counted(training), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    denominator = total + distinct + 1
    # different counts are at most the square root of twice the tokens
    by_count = sorted(words.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["n"])
    upto = np.cumsum([r["k"] for r in by_count])
    inside = int((upto <= table_words).sum())
    table = words.where(F.col("n") >= by_count[inside - 1]["n"]).toPandas() if inside else words.limit(0).toPandas()
    names, counts = [bytes(x) for x in table["key"]], table["n"].to_numpy(np.int64)
    order = sorted(range(len(names)), key=lambda i: (-counts[i], names[i]))
    names, counts = [names[i] for i in order], counts[order]
    in_table = len(names)
    odds = (counts + 1) / denominator
    every, chances = sc.broadcast(({w: i for i, w in enumerate(names)}, odds)), sc.broadcast(odds)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, held_out boolean, row long, n_tokens long, n_known long, base_score double, codes binary, rare array<struct<word:binary,n:int>>"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, one = every.value
        logs, codec = np.log10(one), pa.Codec("zstd")
        for batch in small(batches, 2000, 8 << 20):
            if not batch.num_rows:
                continue
            words, many = _split(batch.column(3))
            words = words.dictionary_encode()
            names = [*words.dictionary.to_pylist(), END]
            at = np.insert(words.indices.to_numpy().astype(np.int64), np.cumsum(many), len(names) - 1)
            many = many + 1
            starts = np.concatenate([[0], np.cumsum(many)])
            ids = np.fromiter(map(index.get, names, repeat(-1)), np.int64, len(names))[at]
            base = np.where(ids >= 0, logs[ids] if len(logs) else 0.0, 0.0)
            # a word that is not in the table is known by its place among such words of the row
            off = np.flatnonzero(ids < 0)
            of = np.repeat(np.arange(len(many)), many)[off]
            found, which, times = np.unique(of * len(names) + at[off], return_inverse=True, return_counts=True)
            begins = np.searchsorted(found, np.arange(len(many) + 1) * len(names))
            codes = 2 * ids
            codes[off] = 2 * (which - begins[of]) + 1
            rare = pa.StructArray.from_arrays([pa.array([names[i] for i in (found % len(names)).tolist()], pa.binary()), pa.array(times, pa.int32())], names=["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array(many, pa.int64()),
                    pa.array(np.add.reduceat((ids >= 0).astype(np.int64), starts[:-1])),
                    pa.array(np.add.reduceat(base, starts[:-1])),
                    pa.array([_squeeze(codes[a:b], codec) for a, b in zip(starts[:-1], starts[1:])], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(begins, pa.int32()), rare),
                ],
                names=[id_col, "held_out", "row", "n_tokens", "n_known", "base_score", "codes", "rare"],
            )

    numbered = rows.select(id_col, "held_out", F.monotonically_increasing_id().alias("row"), raw("text").alias("t"))
    coded = keep(numbered.mapInArrow(code, schema), "coded")
    exploded = coded.select("row", F.posexplode("rare").alias("place", "r")).select("row", "place", F.col("r.word").alias("key"), F.col("r.n").alias("k"))
    found = F.coalesce("n", F.lit(0))
    seen = F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0).cast("long")
    held = F.when(F.col("n") >= LEAST, F.struct("place", _hashed(F.col("key")).alias("code"), "n"))
    rest = exploded.join(words, "key", "left").groupBy("row").agg(F.sum(F.col("k") * F.log10((found + 1) / F.lit(float(denominator)))).alias("rest"), F.sum(seen).alias("more"), F.collect_list(held).alias("known"))
    known, parted = fresh_dir(spark, "rest"), rest.withColumn("part", F.shiftright("row", 33))
    parted.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(known)
    rest = spark.read.schema(parted.schema).parquet(known)

    cold = max(sc.defaultParallelism, -(-total // shard_tokens))
    # words that more than a shard's tokens follow: fewer than there are shards
    ends = {END}
    hot = np.array([1 if w in ends else -(-2 * int(n) // shard_tokens) for w, n in zip(names, counts) if n > shard_tokens], np.int64)
    offset = np.concatenate([[0], np.cumsum(hot)])
    folder = fresh_dir(spark, "lm")

    def count_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def use(row, train, a, b, w, n):
            ok = np.flatnonzero((b >= 0) & (b < len(hot)))
            _, many, b, w = _sums(np.ones(len(ok), np.int64), b[ok], w[ok])
            part = offset[b] + (_mixed(w) % hot[b].astype(np.uint64)).astype(np.int64)
            yield from _dealt(part, lambda i: (_pack(b[i], w[i], many[i]), b""))

        yield from _chunks(batches, use)

    def build_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, part = [], 0, None
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts.append(_unpack(data.as_py()))
                size += len(parts[-1][0])
                if size > 4 * CHUNK and size > 2 * len(parts[0][0]):
                    _, n, b, w = _sums(*(np.concatenate([p[i] for p in parts]) for i in (2, 0, 1)))
                    parts, size = [[b, w, n]], len(n)
        if part is not None:
            b, w, n = (np.concatenate(x) for x in zip(*parts))
            grams = NGrams([b, np.full(len(b), -1), w], n)
            data, mass = Shard.encode(grams, counts[grams.words[grams.pair_b]])
            write_once(f"{folder}/hot-{part}.trie", data)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([mass])], names=["part", "mass"])

    hot_left = np.ones(len(hot))
    hot_built = set()
    if len(hot):
        each = F.transform("rare", lambda x: _hashed(x["word"]))
        dealt = coded.where(~F.col("held_out")).select("row", "held_out", "n_tokens", "codes", each.alias("rare")).mapInArrow(count_hot, _DEALT)
        for r in dealt.repartitionById(int(offset[-1]), F.col("shard")).mapInArrow(build_hot, "part int, mass double").collect():
            hot_built.add(r["part"])
            hot_left[offset.searchsorted(r["part"], "right") - 1] -= r["mass"]

    # rows by number of their part of the table: a few bytes each
    parts = coded.groupBy(F.shiftright("row", 33).alias("part")).agg((F.max("row").bitwiseAND((1 << 33) - 1) + 1).alias("n")).orderBy("part").collect()
    ends_of = np.cumsum([r["n"] for r in parts])
    part_of, begins = np.array([r["part"] for r in parts], np.int64), np.append(0, ends_of)[:-1].astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def use(row, train, a, b, w, n):
            # after a seldom word nothing is held, and the word's own logarithm stands
            ok = np.flatnonzero((b >= 0) & (b != SELDOM))
            if not len(ok):
                return
            number = begins[part_of.searchsorted(row[ok] >> 33)] + (row[ok] & ((1 << 33) - 1))
            a, b, w, n, train = a[ok], b[ok], w[ok], np.where(w[ok] == SELDOM, 0, n[ok]), train[ok].astype(np.int64)
            a[a == SELDOM] = -1
            # one number for three codes: those of the table as they are, the others by rank
            codes = np.concatenate([a, b, w]) + 1
            far = np.flatnonzero(codes > in_table)
            others, ranks = np.unique(codes[far], return_inverse=True)
            codes[far] = ranks + in_table + 1
            x, y, z = codes.reshape(3, len(ok))
            many_codes = in_table + 1 + len(others)
            key = (y * many_codes + x) * many_codes + z
            o = np.argsort(key)
            key, number = key[o], number[o]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            many, trained = np.diff(np.append(first, len(key))), np.add.reduceat(train[o], first)
            a, b, w, n = (v[o[first]] for v in (a, b, w, n))
            shard = (_mixed(b) % np.uint64(cold)).astype(np.int64)
            if len(hot):
                out = np.flatnonzero(b < len(hot))
                shard[out] = cold + offset[b[out]] + (_mixed(a[out]) % hot[b[out]].astype(np.uint64)).astype(np.int64)
            low, begin = int(number.min()), first

            def packed(i):
                mine = number[_slices(begin, many, i)]
                return _pack(b[i], a[i], w[i], n[i], trained[i]), _pack(many[i], mine - low, np.array([low]))

            yield from _dealt(shard, packed)

        yield from _chunks(batches, use, Beside(known))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = chances.value
        packets, shard = Packets(), None
        for batch in batches:
            for shard, ngrams, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                packets.add(ngrams.as_py(), asked.as_py())
        if shard is None:
            return
        packets.fold()
        grams = packets.different
        rank = int(offset.searchsorted(shard - cold, "right")) - 1 if shard >= cold else -1
        path = f"{folder}/{shard}.trie"
        write_once(path, Shard.encode(grams)[0])
        trie = Shard(read_mapped(path))
        files = {k: Shard(read_mapped(f"{folder}/hot-{k}.trie")) for k in range(offset[rank], offset[rank + 1]) if k in hot_built} if rank >= 0 else {}
        # each different n-gram is looked up once, and so is each pair; those of a context stand together
        there = (grams.words >= 0) & (grams.words < HASHED)
        p = (packets.of_word + 1) / denominator
        p[there] = one[grams.words[there]]
        place = trie.places(grams.words)
        below = np.empty(len(grams.pair_b))
        for i in range(0, len(below), GROUP):
            b, w = grams.pair_b[i : i + GROUP], grams.pair_w[i : i + GROUP]
            if rank < 0:
                two, left = trie.pair(place[b], place[w])
                left = plain(left)
            else:
                two, left = np.full(len(b), -1), hot_left[rank]
                part = offset[rank] + (_mixed(grams.words[w]) % np.uint64(hot[rank])).astype(np.int64)
                for k, file in files.items():
                    mine = np.flatnonzero(part == k)
                    two[mine] = file.pair(file.places(grams.words[b[mine]]), file.places(grams.words[w[mine]]))[0]
            below[i : i + GROUP] = plain(two) + left * p[w]
        # by how much the n-gram's logarithm differs from the word's
        gain = np.empty(len(grams.n))
        for i in range(0, len(gain), GROUP):
            b, a, w, pair = (x[i : i + GROUP] for x in (grams.b, grams.a, grams.w, grams.pair))
            share, left = trie.triple(place[a], place[b], place[w])
            gain[i : i + GROUP] = np.log10((plain(share) + plain(left) * below[pair]) / p[w])
        del grams, below, there, place
        out, rows_out = [], 0

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([low for low, _ in out], pa.int64()), pa.array([data for _, data in out], pa.binary())], names=["stretch", "gains"])

        packets.different = None
        for asked, gains in packets.spread(gain):
            many, number, low = _unpack(asked)
            sums = np.bincount(number, np.repeat(gains, many))
            some = np.flatnonzero(np.bincount(number))
            out.append((int(low[0]), _pack(some, sums[some])))
            rows_out += len(some)
            if rows_out > 200_000:
                yield emitted()
                out, rows_out = [], 0
        if out:
            yield emitted()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The gains of rows from the packets of all shards; a row that two stretches share is given by each of them."""
        parts, size = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            number, value = (np.concatenate(x) for x in zip(*parts))
            rows, at = np.unique(number, return_inverse=True)
            return rows, np.bincount(at, value)

        for batch in batches:
            for low, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                number, value = _unpack(data.as_py())
                parts.append((number + low, value))
                size += len(number)
                if size > 2 * CHUNK and size > 2 * len(parts[0][0]):
                    parts = [summed()]
                    size = len(parts[0][0])
        if parts:
            number, value = summed()
            for i in range(0, len(number), 200_000):
                n = number[i : i + 200_000]
                part = np.searchsorted(ends_of, n, "right")
                yield pa.RecordBatch.from_arrays([pa.array((part_of[part] << 33) + n - begins[part]), pa.array(value[i : i + 200_000])], names=["row", "gain"])

    asked = coded.select("row", "held_out", "n_tokens", "codes").mapInArrow(deal, _DEALT)
    answered = asked.repartitionById(cold + int(offset[-1]), F.col("shard")).mapInArrow(answer, "stretch long, gains binary")
    # a packet for each stretch that a shard answers; what the shards say of a stretch is summed in one task
    gains = answered.repartition(cold, "stretch").mapInArrow(gather, "row long, gain double").groupBy("row").agg(F.sum("gain").alias("gain"))
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z))
    base = F.col("base_score") + zero("rest", 0.0)
    return coded.drop("codes", "rare").join(rest.select("row", "rest", "more"), "row", "left").join(gains, "row", "left").select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("more", 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + zero("gain", 0.0)).alias("score"),
    )
