"""Byte-level BPE by corpus-level merge replay, and its decoding.

The distinct pieces of a batch form one corpus. An inverted index leads from a pair of
adjacent tokens to the places where it stands; pairs are taken in rank order, each is merged
at all of its places at once, left to right, and only the touched neighbours enter the index
anew. That gives what merging piece by piece gives, since pieces do not touch.

A null text is empty; an empty text has no tokens. Special tokens are ordinary text."""

from __future__ import annotations

import base64
import hashlib
import re
import string
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm._common import prepare

#: Parts, and bytes of parts and their ids, that a worker remembers at most; beyond, it starts anew. Results do not depend on it.
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 128 << 20
# Fixed value: the pattern whose pieces never reach over a single space, so that texts may be cut there.
CUTTABLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Merges:
    """A vocabulary's merges: which two adjacent tokens make which third."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        self.byte = np.full(256, -1, np.int64)
        keys, made = [], []
        for t, r in ranks.items():
            self.token[r] = t
            if len(t) == 1:
                self.byte[t[0]] = r
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(r)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.made = np.append(np.array(made, np.int64)[order], -1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, -1 where they do not merge; a token below 0 is a gap."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.made[at], -1)


def replay(pieces: list[bytes], merges: Merges) -> list[bytes]:
    """The token ids of each piece, as little-endian unsigned 32-bit integers."""
    # all pieces end to end with a gap around each; left and right lead to the neighbours that are left
    data = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    gaps = np.concatenate([[0], np.cumsum(sizes + 1)])
    token = merges.byte[data]
    token[gaps] = -1
    n = len(token)
    right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
    places: dict[int, list[int]] = {}  # the inverted index, by the rank that a pair makes

    def enter(at: np.ndarray, rank: np.ndarray) -> None:
        ok = rank >= 0
        for r, i in zip(rank[ok].tolist(), at[ok].tolist()):
            if r in places:
                places[r].append(i)
            else:
                places[r] = [i]
                heappush(heap, r)

    heap: list[int] = []
    enter(np.arange(n - 1), merges.of(token[:-1], token[1:]))
    while heap:
        r = heappop(heap)
        i = np.array(places.pop(r), np.int64)
        i.sort()
        # a place may have been touched since it was entered, or entered twice
        i = i[(token[i] >= 0) & (merges.of(token[i], token[right[i]]) == r)]
        if len(i) > 1:
            i = i[np.append(True, i[1:] != i[:-1])]
            if (right[i[:-1]] == i[1:]).any():
                i = _apart(i, right)
        if not len(i):
            continue
        j = right[i]
        k = right[j]
        token[i], token[j] = r, -2
        right[i] = k
        left[k] = i
        h = left[i]
        enter(h, merges.of(token[h], token[i]))
        enter(i, merges.of(token[i], token[k]))
    kept = token >= 0
    ids = token[kept].astype("<u4").tobytes()
    ends = np.concatenate([[0], np.cumsum(kept)])[gaps] * 4
    return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _apart(i: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of places whose pairs overlap, every second of a run, from the left."""
    out, taken = [], -1
    for x, nxt in zip(i.tolist(), right[i].tolist()):
        if x != taken:
            out.append(x)
            taken = nxt
    return np.array(out, np.int64)


#: Texts with other white space than single spaces and line feeds between other characters.
_OTHER = r"\t\r\x{0b}\x{0c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf"[{_OTHER}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: Marks that are neither letters nor digits nor white space.
MARKS = string.punctuation
#: A single space between two characters that are not white space.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class Memory:
    """Parts of texts and what they are encoded to, over all batches of a worker.

    No piece of the pattern reaches over a single space between two characters that are not
    white space: the space begins the next piece. A line feed between two such characters is
    a piece. So each part can be encoded, and remembered, alone; ``marks`` after a letter or digit
    are a piece too. A key is a part after a
    space, or a line feed and the part after it. ``encode`` gives the ids of strings, as
    little-endian unsigned 32-bit integers."""

    def __init__(self, encode, marks: str = MARKS) -> None:
        self.encode, self.marks = encode, marks
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0
        self.feed = encode(["\n"])[0]

    def _learn(self, keys: list[str]) -> None:
        fresh = [k for k in keys if k not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.known, self.held, fresh = {"": b""}, 0, [k for k in keys if k]
        # marks at the end, after a letter or digit, are a piece of their own: the stem is learnt alone
        stems = {k: stem for k in fresh if not k[-1].isalnum() and (stem := k.rstrip(self.marks)) and len(stem) < len(k) and stem[-1].isalnum()}
        whole = [*{*stems.values(), *(k for k in fresh if k not in stems)}.difference(self.known)]
        marks = [*{k[len(stem) :] for k, stem in stems.items()}]
        ids = self.encode([*[k[1:] if k[0] == "\n" else " " + k for k in whole], *marks])
        end = dict(zip(marks, ids[len(whole) :]))
        self.known.update([(k, self.feed + i if k[0] == "\n" else i) for k, i in zip(whole, ids)])
        self.known.update([(k, self.known[stem] + end[k[len(stem) :]]) for k, stem in stems.items()])
        self.held += sum(map(len, whole)) + sum(map(len, ids)) + sum(len(k) + len(self.known[k]) for k in stems)

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids."""
        odd = pc.match_substring_regex(texts, _ODD)
        plain = texts.filter(pc.invert(odd))
        marked = pc.replace_substring(pc.binary_join_element_wise("\n", plain, ""), "\n", " \n")
        parts = pc.split_pattern(marked, " ")
        coded = parts.flatten().dictionary_encode()
        keys, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self._learn(keys)
        ids = [self.known[k] for k in keys]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(ids), "<u4")
        many = sizes[at]
        ends = np.concatenate([[0], np.cumsum(many)])
        flat = data[np.repeat(starts[:-1][at] - ends[:-1], many) + np.arange(ends[-1])] if len(at) else data[:0]
        bounds = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
        drop, k = len(self.feed) // 4, 0
        for i, is_odd in enumerate(odd.to_pylist()):
            if is_odd:
                first, *rest = _BETWEEN.split(texts[i].as_py())
                self._learn(list(dict.fromkeys(rest)))
                yield np.frombuffer(self.encode([first])[0] + b"".join([self.known[p] for p in rest]), "<u4")
            else:
                yield flat[bounds[k] + drop : bounds[k + 1]]
                k += 1


class Uncut:
    """Encodes whole texts, for patterns whose pieces may reach over spaces."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for ids in self.encode(texts.to_pylist()):
            yield np.frombuffer(ids, "<u4")


_memories: dict[str, Memory | Uncut] = {}


def memory(key: str, encode, kind: type = Memory) -> Memory | Uncut:
    """The worker's encoder under a key, made on first use."""
    if key not in _memories:
        _memories.clear()
        _memories[key] = kind(encode())
    return _memories[key]


def merge_encoder(merges: Merges, pattern: str):
    import regex

    split = regex.compile(pattern).findall
    ranks = merges.ranks

    def encode(parts: list[str]) -> list[bytes]:
        cut = [[p.encode() for p in split(x)] for x in parts]
        ids = {p: ranks[p].to_bytes(4, "little") for p in {q for c in cut for q in c} if p in ranks}
        pieces = [*{p for c in cut for p in c}.difference(ids)]
        ids.update(zip(pieces, replay(pieces, merges)))
        return [ids[c[0]] if len(c) == 1 else b"".join([ids[p] for p in c]) for c in cut]

    return encode


def few_at_a_time(texts: pa.Array, most: int = 8 << 20) -> Iterator[pa.Array]:
    """Slices of about so many bytes, so that a slice's tokens fit in memory."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most)))
        yield texts.slice(a, b - a)
        a = b


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for t, r in ranks.items():
        table[r] = t
    return table


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (binary) in place of the text."""
    return _encoded(docs, ranks, pattern, text_col, digests=False)


def token_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 in place of the text."""
    return _encoded(docs, ranks, pattern, text_col, digests=True)


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str, digests: bool) -> DataFrame:
    spark = prepare(docs.sparkSession)
    shipped = spark.sparkContext.broadcast(ranks)  # a vocabulary: of a fixed size
    key = hashlib.sha1(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    new = ("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    rest = [c for c in docs.columns if c not in (text_col, *new)]
    types = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = memory(key, lambda: merge_encoder(Merges(shipped.value), pattern), Memory if pattern == CUTTABLE else Uncut)
        token = _tokens(shipped.value)
        decimal = [str(i) for i in range(len(token))]
        for b in batches:
            kept = [b.column(i) for i in range(len(rest))]
            rows = []
            for few in few_at_a_time(b.column(len(rest))):
                for found in held.of(few):
                    ids = found.tolist()
                    back = b"".join(map(token.__getitem__, ids))
                    if digests:
                        listed = " ".join(map(decimal.__getitem__, ids)).encode()
                        rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(back).hexdigest()))
                    else:
                        rows.append((ids, back))
            made = list(zip(*rows)) if rows else [[] for _ in new]
            kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(list(m), k) for m, k in zip(made, kinds))], names=[*rest, *new])

    return docs.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, schema)
