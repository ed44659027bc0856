"""Substring dedup: words covered by a window of words that also starts elsewhere are removed.

Windows are dealt to shards by content: by the smallest hash (of a few words) in the window,
a minimiser. Successive windows with one minimiser form a segment, and equal windows always
have equal minimisers, so each shard decides its windows alone and no document meets all
shards. Segments whose minimiser occurs once are done with at once; equal segments collapse
to one with a count. Each shard then holds its distinct segments in a compressed FM-index: a
suffix array by prefix doubling gives the Burrows-Wheeler transform, kept in a wavelet tree,
laid out level by level, of packed bits with counts. Segments that have no equal are streamed
through it by backward search; the matching statistics, how far to the left a text goes on
occurring twice, give the windows that occur again. A minimiser shared by many different
segments (as at the ends of a common passage) is split by whole windows, counted before they
are shuffled.

A null or empty text has no words. A text shorter than a window has no window. Repeated rows
are texts of their own, so each repeats the other. Overlapping occurrences in one text count."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm._common import keep, prepare, raw, small

#: Words of a minimiser.
GRAM = 5
#: Different segments of one minimiser beyond which its windows are dealt out one by one.
HOT = 256
#: Words of a shard, about.
SHARD_WORDS = 1_000_000
_PLACE = (1 << 22) - 1


class _Hashes(dict):
    """A worker's memory of word hashes."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A full mix of 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` successive values."""
    m, w = x, 1
    while 2 * w <= width:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    return np.minimum(m[: len(x) - width + 1], m[width - w :]) if w < width else m


def segments(texts: list[list[bytes]], window: int) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, minimiser hash, content hash) of all segments."""
    gram = min(GRAM, window)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = int(starts[-1])
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(texts)), np.uint64, n)
    g = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        g += h[i : n - gram + 1 + i] * np.uint64(2 * i + 0x9E3779B97F4A7C15)
    g = _mixed(g)
    # the leftmost of equal ones, so that it stands at the same place in equal windows
    key = (g & ~np.uint64(_PLACE)) | np.arange(len(g), dtype=np.uint64)
    at = (_least(key, window - gram + 1) & np.uint64(_PLACE)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    whole = np.flatnonzero(np.arange(len(at)) + window <= starts[1:][text])
    if not len(whole):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.append(True, (at[whole[1:]] != at[whole[:-1]]) | (text[whole[1:]] != text[whole[:-1]]))
    first = whole[new]
    count = np.diff(np.append(np.flatnonzero(new), len(whole)))
    # content: a polynomial over word hashes, from sums of prefixes and inverse powers
    base = np.uint64(0xF1357AEA2E62A9C5)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1], dtype=np.uint64)])
    content = _mixed((sums[first + count + window - 1] - sums[first]) * back[first] + count.astype(np.uint64))
    return text[first], first - starts[text[first]], count, g[at[first]].view(np.int64), content.view(np.int64)


class FMIndex:
    """Counts occurrences of a sequence of tokens (from 1) in texts, by backward search."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        gaps = len(texts)
        token = np.concatenate([x for t in texts for x in (t, [0])]).astype(np.int64)
        n = self.n = len(token)
        # gaps differ, so that suffixes do too, within the longest text
        rank = np.where(token == 0, np.cumsum(token == 0) - 1, token + gaps)
        rank = np.unique(rank, return_inverse=True)[1]
        h = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - h] = rank[h:] + 1
            key = rank * np.int64(n + 1) + after
            order = np.argsort(key)
            s = key[order]
            new = np.cumsum(np.append(False, s[1:] != s[:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1 or h >= n:
                break
            h *= 2
        last = token[order - 1]
        self.sigma = int(token.max(initial=0)) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=self.sigma))])[: self.sigma]
        self.levels = max(1, (self.sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (last >> level) & 1
            packed = np.packbits(np.append(bit.astype(np.uint8), np.zeros(64 + -n % 64, np.uint8)), bitorder="little").view("<u8")
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64))
            self.zeros.append(n - int(bit.sum()))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        self.base = self._down(np.arange(self.sigma), np.zeros(self.sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place ``i`` of the transform leads to on the last level, along the bits of ``c``."""
        for k in range(self.levels):
            word = i >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((c >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes from ``lo`` to ``hi``, each with ``c`` before it."""
        both = self._down(np.concatenate([c, c]), np.concatenate([lo, hi]))
        shift = self.before[c] - self.base[c]
        return both[: len(c)] + shift, both[len(c) :] + shift


def repeated_windows(index: FMIndex, queries: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each query, which of its windows occur at least twice in the index. Queries are texts of it."""
    sizes = np.array([len(q) for q in queries], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat = np.concatenate(queries) if queries else np.zeros(0, np.int64)
    found = np.zeros(len(flat), bool)
    m = len(queries)
    i = sizes - window  # the last window that is not decided
    end = i + window  # the text that is searched ends here
    at = end.copy()  # it starts here so far
    lo, hi = np.zeros(m, np.int64), np.full(m, index.n)
    # a text that was found once: where it starts, its end, the end of a shorter one that may be enough
    once, far, short = np.full(m, -1), np.zeros(m, np.int64), np.zeros(m, np.int64)
    live = np.flatnonzero(i >= 0)
    while live.size:
        at[live] -= 1
        lo[live], hi[live] = index.extend(flat[base[live] + at[live]], lo[live], hi[live])
        twice = hi[live] - lo[live] >= 2
        plain = once[live] < 0
        # a longer text that occurs twice: so does the window that it starts with
        ok = live[twice & plain]
        mark = ok[at[ok] <= i[ok]]
        found[base[mark] + at[mark]] = True
        ended = [ok[at[ok] == 0]]
        # a text that occurs once: no window that holds it occurs again
        no = live[~twice & plain]
        once[no], far[no] = at[no], end[no]
        i[no] = np.minimum(np.minimum(i[no], at[no]), end[no] - window - 1)
        short[no] = 4
        # is a shorter text from the same place enough? it would rule out more windows
        probe = live[~plain]
        seen = twice[~plain]
        fails = probe[~seen]
        i[fails] = np.minimum(i[fails], end[fails] - window - 1)
        once[fails] = -2
        whole = probe[seen & (at[probe] == once[probe])]
        short[whole] *= 2
        turn = np.concatenate([no, whole])
        more = turn[once[turn] + short[turn] < far[turn]]
        end[more] = once[more] + short[more]
        rest = np.concatenate([turn[once[turn] + short[turn] >= far[turn]], fails])
        once[rest] = -1
        end[rest] = i[rest] + window
        again = np.concatenate([more, rest])
        at[again], lo[again], hi[again] = end[again], 0, index.n
        ended.append(rest[i[rest] < 0])
        ended.append(more[i[more] < 0])
        live = np.setdiff1d(live, np.concatenate(ended), assume_unique=True)
    return [found[b : b + s - window + 1] for b, s in zip(base.tolist(), sizes.tolist())]


def _mask(bits: np.ndarray) -> int:
    return int(sum(1 << int(k) for k in np.flatnonzero(bits)))


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_words, n_removed and ``kept``, the words that are left, joined by single spaces."""
    return _removed(docs, window, id_col, text_col, digest=False)


def removal_digests(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``remove_repeats``, with the SHA-256 of what is kept in its place."""
    return _removed(docs, window, id_col, text_col, digest=True)


def _removed(docs: DataFrame, window: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    if not 1 <= window <= 60 + GRAM:
        raise ValueError("a segment's windows must fit in 64 bits")
    spark = prepare(docs.sparkSession)
    # a row is known by 80 bits of hashes, 64 of its id and text and 16 more of its text: rows that agree in both are equal
    data, id_ = raw(F.col(text_col)), F.col(id_col)
    text_bits = F.pmod(F.xxhash64(data), F.lit(1 << 16)).cast("long")
    rows = docs.select(id_, F.xxhash64(id_.isNull(), id_, data).alias("k"), text_bits.alias("t"), data.alias("raw"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            k, t = (b.column(c).to_numpy() for c in (0, 1))
            texts, first, size = [], 0, 0
            for at, data in enumerate(b.column(2)):
                texts.append(data.as_py().split())
                size += len(texts[-1])
                # a place in a batch must fit in its bits; a single longer text is taken in overlapping parts
                if size > 500_000 or at == len(k) - 1:
                    yield from emit(texts, k[first : at + 1], t[first : at + 1])
                    texts, first, size = [], at + 1, 0

    def emit(texts, k, t):
        part = 1_000_000
        owner, begin, parts = [], [], []
        for d, words in enumerate(texts):
            for a in range(0, max(1, len(words) - window + 1), part):
                owner.append(d)
                begin.append(a)
                parts.append(words[a : a + part + window - 1])
        group, total = [], 0
        for p in range(len(parts) + 1):
            if p == len(parts) or total + len(parts[p]) > 2_000_000:
                of, at, count, mh, sh = segments([parts[x] for x in group], window)
                if len(of):
                    where = np.array(group)[of]
                    d = np.array(owner)[where]
                    pos = ((at + np.array(begin)[where]) << 22) | (count << 16) | t[d]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mh, sh, k[d], pos)], names=["mh", "sh", "k", "pos"])
                group, total = [], 0
            if p < len(parts):
                group.append(p)
                total += len(parts[p])

    found = rows.select("k", "t", "raw").mapInArrow(cut_up, "mh long, sh long, k long, pos long")
    # written out, so that the join below is between two plain exchanges, which Spark may split where a minimiser is hot
    again = keep(found.groupBy("mh").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("mh"), "again")
    kept = keep(found.join(again, "mh"), "segments")
    distinct = keep(kept.groupBy("mh", "sh").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "pos")).alias("rep")), "distinct")
    per = distinct.groupBy("mh").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    n_words_of = F.shiftright(F.col("rep.pos"), 16).bitwiseAND(63) + window - 1
    indexed = distinct.join(per, "mh").withColumn("hot", F.col("d") > HOT)
    asked = indexed.groupBy(F.col("rep.k").alias("k"), F.col("rep.pos").bitwiseAND(0xFFFF).alias("t")).agg(F.collect_list(F.struct("mh", "sh", "n", "hot", F.shiftright("rep.pos", 22).alias("start"), n_words_of.cast("int").alias("size"))).alias("segments"))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        names = ["key", "mh", "sh", "n", "bit", "content"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in small(batches):
            for row in b.to_pylist():
                words, out = row["raw"].split(), []
                for s in row["segments"]:
                    own = words[s["start"] : s["start"] + s["size"]]
                    if s["hot"]:
                        for i in range(len(own) - window + 1):
                            out.append((xxh3_128_digest(b" ".join(own[i : i + window])), s["mh"], s["sh"], s["n"], i, None))
                    else:
                        out.append((None, s["mh"], s["sh"], s["n"], -1, b" ".join(own)))
                for a in range(0, len(out), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[a : a + 2000]), kinds)], names=names)

    met = rows.select("k", "t", "raw").join(asked, ["k", "t"])  # equal rows cut the same segment twice, which is undone below
    content = keep(met.select("raw", "segments").mapInArrow(contents, "key binary, mh long, sh long, n long, bit int, content binary"), "content")
    hot = content.where("key IS NOT NULL").dropDuplicates(["mh", "sh", "bit"])
    windows = hot.groupBy("key").agg(F.sum("n").alias("c")).where("c > 1").select("key")
    hot_masks = hot.join(windows, "key").groupBy("mh", "sh").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))

    cold = content.where("key IS NULL")
    size = cold.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0] // 6
    shards = max(spark.sparkContext.defaultParallelism, -(-size // SHARD_WORDS))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        texts, ids, seen = [], [], set()
        for b in batches:
            for mh, sh, n, content in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (mh, sh) not in seen:
                    seen.add((mh, sh))
                    texts.append(np.array([known.setdefault(w, len(known) + 1) for w in content.split(b" ")], np.int64))
                    ids.append((mh, sh, n))
        if not texts:
            return
        index = FMIndex(texts)
        alone = [i for i, (_, _, n) in enumerate(ids) if n == 1]
        for a in range(0, len(alone), 20_000):
            some = alone[a : a + 20_000]
            masks = [_mask(x) for x in repeated_windows(index, [texts[i] for i in some], window)]
            out = [(ids[i][0], ids[i][1], m) for i, m in zip(some, masks) if m]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], names=["mh", "sh", "mask"])

    cold_masks = cold.select("mh", "sh", "n", "content").repartition(shards, "mh").mapInArrow(search, "mh long, sh long, mask long")
    masks = keep(hot_masks.unionByName(cold_masks).groupBy("mh", "sh").agg(F.bit_or("mask").alias("mask")), "masks")
    # a segment with an equal one is repeated as a whole
    equal = distinct.where("n > 1").select("mh", "sh", F.lit(-1).cast("long").alias("mask"))
    decided = equal.union(masks.join(equal.select("mh", "sh"), ["mh", "sh"], "left_anti"))
    ranges = kept.join(decided, ["mh", "sh"]).groupBy("k", F.col("pos").bitwiseAND(0xFFFF).alias("t")).agg(F.collect_set(F.struct(F.shiftright("pos", 22).alias("start"), F.shiftright("pos", 16).bitwiseAND(63).cast("int").alias("count"), "mask")).alias("ranges"))
    id_type = docs.schema[id_col].dataType.simpleString()
    last = "kept_sha256" if digest else "kept"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = []
            for data, ranges in zip(b.column(1), b.column(2)):
                words = data.as_py().split()
                n = len(words)
                if (found := ranges.as_py()) is not None:
                    hit = np.zeros(n + 1, np.int64)
                    for r in found:
                        full = r["mask"] & ((1 << r["count"]) - 1)
                        for i in range(r["count"]):
                            if full >> i & 1:
                                hit[r["start"] + i] += 1
                                hit[min(n, r["start"] + i + window)] -= 1
                    gone = np.cumsum(hit[:n]) > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                text = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(text).hexdigest() if digest else text.decode()))
            made = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(made[0]), pa.int64()), pa.array(list(made[1]), pa.int64()), pa.array(list(made[2]), pa.string())], names=[id_col, "n_words", "n_removed", last])

    whole = rows.join(ranges, ["k", "t"], "left").select(id_col, "raw", "ranges")
    return whole.mapInArrow(finish, f"`{id_col}` {id_type}, n_words long, n_removed long, {last} string")
